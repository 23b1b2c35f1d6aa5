"""Confinement of paths to a root folder, and of fetched addresses to public hosts."""

from __future__ import annotations

import ipaddress
import os
import posixpath


class Escape(ValueError):
    """The path isn't inside the root."""


def lexical(path: str) -> str:
    """A relative path in its shortest form; NULs, absolute paths and ways out of the root raise Escape."""
    if "\x00" in path:
        raise Escape("a path holds a NUL")
    if path.startswith("/"):
        raise Escape(f"{path}: absolute")
    clean = posixpath.normpath(path or ".")
    if clean == ".." or clean.startswith("../"):
        raise Escape(f"{path}: outside the root")
    return clean


class Root:
    """A folder that nothing may lead out of, links included."""

    def __init__(self, folder: str):
        self.folder = os.path.realpath(folder)

    def holds(self, real: str) -> bool:
        return real == self.folder or real.startswith(self.folder.rstrip("/") + "/")

    def resolve(self, path: str) -> str:
        real = os.path.realpath(os.path.join(self.folder, lexical(path)))
        if not self.holds(real):
            raise Escape(f"{path}: leads outside the root")
        return real

    def relative(self, absolute: str) -> str:
        return os.path.relpath(absolute, self.folder)


#: Private networks.
PRIVATE = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")]


def blocked_address(ip: str) -> bool:
    """Loopback, private, link-local, multicast or unspecified, IPv4 in its IPv6 form too; what is no address is blocked."""
    try:
        a = ipaddress.ip_address(ip.partition("%")[0])
    except ValueError:
        return True
    a = getattr(a, "ipv4_mapped", None) or a
    private = any(a.version == n.version and a in n for n in PRIVATE)
    return a.is_loopback or private or a.is_link_local or a.is_multicast or a.is_unspecified
