"""Clients of a chat server and of web pages. What sends a request is an argument, so nothing here needs a network by itself."""

from __future__ import annotations

import http.client
import json
import socket
import ssl
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path
from urllib.parse import urljoin, urlparse, urlunparse

import numpy as np

from corpusmill.functions.embedding import unit
from corpusmill.functions.extract import article_markdown
from corpusmill.functions.text import SPACE
from corpusmill.sources.paths import blocked_address

#: Bytes of a page's text, what stands after a cut one, and redirects that are followed.
MAX_TEXT, CUT, MAX_REDIRECTS = 32 << 10, "\n\n[content truncated]", 10


def post(host: str, timeout: float = 300) -> Callable[[str, dict | None], Iterable[bytes]]:
    """Sends JSON to host + path (None: a plain GET) and gives the answer's lines."""

    def send(path: str, body: dict | None) -> Iterable[bytes]:
        request = urllib.request.Request(host.rstrip("/") + path, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            yield from answer

    return send


class Server:
    """A chat server that streams NDJSON."""

    def __init__(self, send: Callable[[str, dict | None], Iterable[bytes]], model: str):
        self.send, self.model = send, model

    def chat(self, messages: list[dict], tools: list[dict], on_part: Callable[[dict], None] | None = None) -> dict:
        """The parts of an answer put together; a stream without an end is an error."""
        out: dict = {"content": "", "thinking": "", "tool_calls": []}
        for line in self.send("/api/chat", {"model": self.model, "messages": messages, "tools": tools, "stream": True}):
            if not line.strip():
                continue
            part = json.loads(line)
            if part.get("error"):
                raise OSError(part["error"])
            message = part.get("message") or {}
            for key in ("content", "thinking"):
                out[key] += message.get(key) or ""
            out["tool_calls"] += [c.get("function", c) for c in message.get("tool_calls") or []]
            if on_part:
                on_part(part)
            if part.get("done"):
                return out
        raise OSError("the stream ended before the answer did")

    def _one(self, path: str, body: dict | None) -> dict:
        return json.loads(b"".join(self.send(path, body)))

    def models(self) -> list[str]:
        return [m["name"] for m in self._one("/api/tags", None).get("models", [])]

    def show(self) -> tuple[list[str], int]:
        """Capabilities, and the context length that the model's details name (0: none)."""
        got = self._one("/api/show", {"model": self.model})
        lengths = (v for k, v in sorted((got.get("model_info") or {}).items()) if k.endswith(".context_length"))
        return got.get("capabilities") or [], int(next(lengths, 0))

    def embed(self, texts: list[str]) -> np.ndarray:
        """Unit vectors, one a text; another number of them is an error."""
        got = self._one("/api/embed", {"model": self.model, "input": texts}).get("embeddings") or []
        if len(got) != len(texts):
            raise OSError(f"{len(got)} vectors for {len(texts)} texts")
        return unit(np.array(got, np.float32).reshape(len(texts), -1))


class Refused(ValueError):
    """The address may not be fetched."""


def addresses(host: str) -> list[str]:
    return [a[4][0] for a in socket.getaddrinfo(host, None)]


def check_url(url: str, https_only: bool = True, resolve: Callable[[str], list[str]] = addresses) -> str:
    """The address to connect to. Only http and https, and only hosts all of whose addresses are public."""
    parts = urlparse(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise Refused(f"{url}: not a web address")
    if https_only and parts.scheme != "https":
        raise Refused(f"{url}: only https")
    found = resolve(parts.hostname)
    if not found or any(map(blocked_address, found)):
        raise Refused(f"{url}: not a public host")
    return found[0]


class _Plain(http.client.HTTPConnection):
    """A connection to the address that was checked, whatever its host's name stands for by now."""

    address = ""

    def connect(self):
        self.sock = socket.create_connection((self.address, self.port), self.timeout)


class _Secure(http.client.HTTPSConnection):
    address = ""

    def connect(self):
        plain = socket.create_connection((self.address, self.port), self.timeout)
        self.sock = ssl.create_default_context().wrap_socket(plain, server_hostname=self.host)


def get(url: str, address: str, timeout: float = 30, max_bytes: int = 2 << 20) -> tuple[int, dict, bytes]:
    """Status, headers (lower-case names) and the first bytes of the body, from a server at this address; redirects aren't followed."""
    parts = urlparse(url)
    connection = (_Secure if parts.scheme == "https" else _Plain)(parts.hostname, parts.port, timeout=timeout)
    connection.address = address
    try:
        connection.request("GET", urlunparse(("", "", parts.path or "/", parts.params, parts.query, "")), headers={"User-Agent": "corpusmill"})
        answer = connection.getresponse()
        return answer.status, {k.lower(): v for k, v in answer.getheaders()}, answer.read(max_bytes)
    finally:
        connection.close()


def page_of(status: int, content_type: str, body: bytes) -> str:
    """What a fetch says of an answer: "HTTP <status>", what went wrong, and the text (a page's article as Markdown), at most 32 KiB."""
    text = body.decode("utf-8", "replace")
    if "text/html" in content_type or text[:512].strip(SPACE).lower().startswith(("<!doctype html", "<html")):
        text = article_markdown(text)
    raw = text.encode()
    if len(raw) > MAX_TEXT:
        text = raw[:MAX_TEXT].decode("utf-8", "ignore") + CUT
    if 200 <= status < 300:
        return f"HTTP {status}\n\n{text}"
    reason = f"HTTP {status}\nError: {http.client.responses.get(status, '')}"
    return f"{reason}\n\n{text}" if text else reason


def fetch(url: str, https_only: bool = True, max_bytes: int = 2 << 20, send: Callable[..., tuple[int, dict, bytes]] = get, resolve: Callable[[str], list[str]] = addresses) -> str:
    """The page as page_of tells it; what fails before there is an answer is "HTTP 0". Each redirect is resolved and checked like the first address, and the checked address is the one that is connected to."""
    try:
        for _ in range(MAX_REDIRECTS + 1):
            address = check_url(url, https_only, resolve)
            status, headers, body = send(url, address, max_bytes=max_bytes)
            if status not in (301, 302, 303, 307, 308) or not headers.get("location"):
                return page_of(status, headers.get("content-type", ""), body[:max_bytes])
            url = urljoin(url, headers["location"])
    except (Refused, OSError, http.client.HTTPException) as e:
        return f"HTTP 0\nError: {e}"
    return "HTTP 0\nError: too many redirects"


#: Files of a model, and those that it can do without.
MODEL_FILES, OPTIONAL_FILES = ("tokenizer.json", "model.safetensors"), ("config.json",)


def ensure_model(repo: str, revision: str, folder: str | Path, send: Callable[[str], tuple[int, bytes]], host: str = "https://huggingface.co") -> Path:
    """The folder of a model at a pinned revision: files that aren't there yet are fetched, each put in place when it is whole. Optional ones may fail."""
    at = Path(folder) / repo.replace("/", "_")
    at.mkdir(parents=True, exist_ok=True, mode=0o700)
    for name in (*MODEL_FILES, *OPTIONAL_FILES):
        if (at / name).exists():
            continue
        url = f"{host}/{repo}/resolve/{revision}/{name}"
        try:
            status, body = send(url)
            if status != 200:
                raise OSError(f"status {status} for {url}")
        except OSError:
            if name in OPTIONAL_FILES:
                continue
            raise
        partial = at / f"{name}.tmp"
        partial.touch(0o600)
        partial.write_bytes(body)
        partial.replace(at / name)
    return at
