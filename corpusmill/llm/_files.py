"""Files in the shared folder, opened from tasks: local paths and any store that pyarrow knows."""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


class Whole:
    """Writes one file under a name of its own and moves it into place when it is complete, so that a task may be run again or twice at once."""

    def __init__(self, uri: str):
        self.fs, self.path = store(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.partial"
        self.out = self.fs.open_output_stream(self.own)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)
