"""A sink of text lines that commits in two phases.

Each attempt of a task writes a file of its own below `_pending/<job>` and reports it. When all tasks are done, the driver moves the
reported files to their names and puts the next `_commits/<number>` in place, which lists them; readers take only what is listed. So a
task that dies or runs twice leaves nothing that is read, a job that fails removes what it wrote, and one that dies with its driver leaves
files that the next overwrite removes. An overwrite starts a new list in the same one step.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpusmill.sources.shared import qualified


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its file and rows; no file where it had no rows."""

    file: str | None
    rows: int


class CommittedLines(DataSource):
    """Options: path, a URI. Rows: value (string), a line each."""

    @classmethod
    def name(cls):
        return "committed_lines"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator):
        store, folder = _store(self.folder)
        at, out, rows = f"{folder}/_pending/{self.job}/{uuid.uuid4().hex}", None, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    store.create_dir(posixpath.dirname(at), recursive=True)
                    out = store.open_output_stream(at)
                lines = pa.compute.binary_join_element_wise(pa.compute.fill_null(batch.column(0).cast(pa.string()), ""), "", "\n")
                out.write("".join(lines.to_pylist()).encode())
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(at if out is not None else None, rows)

    def commit(self, messages):
        store, folder = _store(self.folder)
        if any(m is None for m in messages):
            raise ValueError("a task reported nothing")
        files = []
        for m in sorted((m for m in messages if m.file), key=lambda m: m.file):
            name = f"part-{self.job}-{len(files):06d}"
            store.move(m.file, f"{folder}/{name}")
            files.append(name)
        before = _commits(store, folder)
        said = {"files": files, "rows": sum(m.rows for m in messages), "overwrite": self.overwrite}
        store.create_dir(f"{folder}/_commits", recursive=True)
        with store.open_output_stream(f"{folder}/_commits/.{self.job}") as out:
            out.write(json.dumps(said).encode())
        number = (before[-1] if before else 0) + 1
        while store.get_file_info(f"{folder}/_commits/{number:020d}").type != fs.FileType.NotFound:
            number += 1
        store.move(f"{folder}/_commits/.{self.job}", f"{folder}/_commits/{number:020d}")
        self._drop(store, folder)
        if self.overwrite:
            kept = set(_listed(store, folder))
            for info in store.get_file_info(fs.FileSelector(folder)):
                if info.base_name.startswith("part-") and info.base_name not in kept:
                    store.delete_file(info.path)
            for n in before:
                store.delete_file(f"{folder}/_commits/{n:020d}")

    def abort(self, messages):
        self._drop(*_store(self.folder))

    def _drop(self, store, folder: str) -> None:
        at = f"{folder}/_pending/{self.job}"
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


def _commits(store: fs.FileSystem, folder: str) -> list[int]:
    at = f"{folder}/_commits"
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return []
    return sorted(int(i.base_name) for i in store.get_file_info(fs.FileSelector(at)) if i.base_name.isdigit())


def _listed(store: fs.FileSystem, folder: str) -> list[str]:
    files: list[str] = []
    for n in _commits(store, folder):
        with store.open_input_stream(f"{folder}/_commits/{n:020d}") as f:
            said = json.loads(f.read())
        files = said["files"] if said["overwrite"] else [*files, *said["files"]]
    return files


def write_lines(lines: DataFrame, folder: str, mode: str = "append") -> None:
    """lines (value) into a folder, all or none; mode: append or overwrite."""
    spark = lines.sparkSession
    spark.dataSource.register(CommittedLines)
    lines.write.format("committed_lines").mode(mode).option("path", qualified(spark, folder)).save()


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """value of all committed lines."""
    folder = qualified(spark, folder)
    files = _listed(*_store(folder))
    return spark.read.text([f"{folder}/{f}" for f in files]) if files else spark.createDataFrame([], "value string")
