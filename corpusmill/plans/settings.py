"""Settings: `key=value` lines, defaults, and what values are accepted."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Key:
    kind: type
    default: object
    accepts: Callable[[object], bool] = lambda _: True
    zero_is_default: bool = False


def _positive(x) -> bool:
    return x > 0


#: Keys, types, defaults and accepted values.
KEYS: dict[str, Key] = {
    "model": Key(str, ""),
    "embed_model": Key(str, ""),
    "host": Key(str, ""),
    "mode": Key(str, "dark", lambda x: x in ("dark", "light")),
    "num_ctx": Key(int, 0, lambda x: x >= 0),
    "keep_alive": Key(str, ""),
    "chat_timeout_seconds": Key(int, 300, _positive),
    "max_read_bytes": Key(int, -1),
    "max_search_file_bytes": Key(int, 2 << 20, lambda x: x >= 0, True),
    "max_image_bytes": Key(int, 10 << 20, lambda x: x >= 0, True),
    "max_search_results": Key(int, 200, _positive),
    "max_name_results": Key(int, 500, _positive),
    "max_batch_files": Key(int, 20, _positive),
    "max_semantic_files": Key(int, 200, _positive),
    "max_semantic_results": Key(int, 10, _positive),
    "max_embed_chars": Key(int, 8000, _positive),
    "max_document_bytes": Key(int, 131072, _positive),
    "auto_context_enabled": Key(bool, True),
    "auto_context_top_k": Key(int, 5, _positive),
    "auto_context_min_score": Key(float, 0.2, lambda x: 0 < x <= 1),
    "auto_context_max_chars": Key(int, 6000, _positive),
    "cache_extracted_text": Key(bool, True),
    "cache_compression": Key(str, "flate", lambda x: x in ("flate", "none")),
    "cache_encryption": Key(bool, True),
    "cache_max_bytes": Key(int, 1 << 30, zero_is_default=True),
    "fetch_url_enabled": Key(bool, False),
    "fetch_url_https_only": Key(bool, True),
    "fetch_url_max_bytes": Key(int, 2 << 20, _positive),
    "fetch_url_timeout_seconds": Key(int, 30, _positive),
    "history_limit": Key(int, 100, _positive),
    "max_tool_calls": Key(int, 100, _positive),
}


def parse(key: str, text: str):
    """A value of the key's type; ValueError for what the key doesn't accept."""
    k = KEYS[key]
    if k.kind is bool:
        low = text.strip().lower()
        if low not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
            raise ValueError(f"{key}: {text}")
        return low in ("true", "1", "yes", "on")
    value = k.kind(text.strip())
    if not k.accepts(value):
        raise ValueError(f"{key}: {text}")
    return value


def _split(line: str) -> tuple[str, str] | None:
    line = line.strip()
    if not line or line.startswith("#") or "=" not in line:
        return None
    key, _, value = line.partition("=")
    return key.strip(), value.strip()


def load(path: str | Path) -> dict[str, object]:
    """All keys; unknown keys and unreadable numbers are ignored, and 0 stands for the default where it means nothing."""
    out = {k: v.default for k, v in KEYS.items()}
    path = Path(path)
    for line in path.read_text().splitlines() if path.exists() else ():
        if (pair := _split(line)) and pair[0] in KEYS:
            try:
                out[pair[0]] = parse(*pair)
            except ValueError:
                continue
    return {k: KEYS[k].default if KEYS[k].zero_is_default and v == 0 else v for k, v in out.items()}


def save(path: str | Path, key: str, text: str) -> None:
    """Sets one key in the file; comments, order and unknown keys stay. The file is replaced in one step."""
    parse(key, text)
    path = Path(path)
    lines = path.read_text().splitlines() if path.exists() else []
    at = next((i for i, line in enumerate(lines) if (pair := _split(line)) and pair[0] == key), None)
    if at is None:
        lines.append(f"{key}={text}")
    else:
        lines[at] = f"{key}={text}"
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False) as f:
        f.write("\n".join(lines) + "\n")
    os.replace(f.name, path)


def shown(value) -> str:
    """A value as a settings file has it."""
    return str(value).lower() if isinstance(value, bool) else str(value)
