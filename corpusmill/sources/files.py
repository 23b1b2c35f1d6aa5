"""Files as DataFrames: a listing source that sees what Spark's own readers hide, and readers of contents.

`fs_entries` lists a folder that all machines can see (hidden files, folders and links included), depth-first in sorted order;
skipped names are pruned with all below them, and links that lead out of the root are left out. Folders are opened from the root
down until there is enough work to deal out: a part of the listing is a run of neighbours in walk order, and a folder of many
entries is cut into runs of names. As a stream it gives what was added, changed or removed since the snapshot before.
"""

from __future__ import annotations

import itertools
import os
import pickle
import shutil
import stat
import uuid
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corpusmill.sources.paths import Root

#: Names that walks skip.
SKIPPED = (".git", "node_modules", "vendor", ".idea", ".DS_Store")
SCHEMA = "path string, name string, type string, size long, modified_at timestamp, permissions string, depth int"


def _entry(root: Root, path: str, depth: int) -> tuple:
    s = os.lstat(os.path.join(root.folder, path))
    kind = "dir" if stat.S_ISDIR(s.st_mode) else "symlink" if stat.S_ISLNK(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
    return path, os.path.basename(path), kind, s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc), stat.filemode(s.st_mode), depth


def walk(root: Root, path: str, depth: int, most: int | None, skipped: frozenset[str]):
    """The entry and, for a folder, all below it."""
    full = os.path.join(root.folder, path)
    if os.path.basename(path) in skipped or (os.path.islink(full) and not root.holds(os.path.realpath(full))):
        return
    try:
        yield _entry(root, path, depth)
        inner = sorted(os.listdir(full), key=os.fsencode) if os.path.isdir(full) and not os.path.islink(full) else []
    except OSError:
        return
    if most is None or depth < most:
        for name in inner:
            yield from walk(root, os.path.join(path, name), depth + 1, most, skipped)


class Part(NamedTuple):
    """The entry of a folder alone (low is None), or its entries named low to high (bytes of names, both included) with all below them."""

    folder: str
    low: bytes | None
    high: bytes | None
    depth: int

    def first(self) -> tuple[bytes, ...]:
        """The walk key of the first path that it can have."""
        return walk_key(self.folder) if self.low is None else (*walk_key(self.folder), self.low)


def walk_key(path: str) -> tuple[bytes, ...]:
    """Sorts paths below the root as a walk meets them."""
    return tuple(os.fsencode(path).split(b"/")) if path else ()


#: Entries of one folder that are a part of their own, and folders opened for each part wanted.
RUN, OPENED = 1024, 4


def frontier(root: Root, most: int | None, skipped: frozenset[str], want: int) -> list[list[Part]]:
    """About `want` lists of parts, neighbours in walk order, which together are the whole listing; none holds over RUN names of a folder that was opened, nor over a share of all that was found."""
    found: list[tuple[Part, int]] = []  # with the number of entries known of it
    opened, level = 0, [("", 0)]
    done: dict[str, list] = {}
    while level and opened < want * OPENED:
        after = []
        for folder, depth in level:
            opened += 1
            try:
                with os.scandir(os.path.join(root.folder, folder)) as entries:
                    inner = sorted((os.fsencode(e.name), e.is_dir(follow_symlinks=False)) for e in entries if e.name not in skipped)
            except OSError:
                inner = []
            done[folder] = [(name, is_dir and (most is None or depth + 1 < most)) for name, is_dir in inner] if most is None or depth < most else []
            after += [(os.path.join(folder, os.fsdecode(name)), depth + 1) for name, deeper in done[folder] if deeper]
        level = after

    def lay(folder: str, depth: int) -> None:
        if folder:
            found.append((Part(folder, None, None, depth), 1))
        run: list[bytes] = []

        def close() -> None:
            for at in range(0, len(run), RUN):
                some = run[at : at + RUN]
                found.append((Part(folder, some[0], some[-1], depth), len(some)))
            run.clear()

        for name, deeper in done[folder]:
            path = os.path.join(folder, os.fsdecode(name))
            if deeper and path in done:
                close()
                lay(path, depth + 1)
            elif deeper:
                close()
                found.append((Part(folder, name, name, depth), RUN))  # not opened: it may hold any number
            else:
                run.append(name)
        close()

    lay("", 0)
    share = max(1, -(-sum(n for _, n in found) // max(1, want)))
    parts: list[list[Part]] = []
    held = share
    for part, n in found:
        if held + n > share and held:
            parts.append([])
            held = 0
        held += n
        last = parts[-1][-1] if parts[-1] else None
        if last and part.low is not None and last.low is not None and last.folder == part.folder:
            parts[-1][-1] = last._replace(high=part.high)
        else:
            parts[-1].append(part)
    return parts


def listed(root: Root, parts: list[Part], most: int | None, skipped: frozenset[str]):
    """The entries of some parts."""
    for part in parts:
        if part.low is None:
            try:
                yield _entry(root, part.folder, part.depth)
            except OSError:
                continue
            continue
        try:
            names = sorted(n for n in map(os.fsencode, os.listdir(os.path.join(root.folder, part.folder))) if part.low <= n <= part.high)
        except OSError:
            continue
        if most is None or part.depth < most:
            for name in names:
                yield from walk(root, os.path.join(part.folder, os.fsdecode(name)), part.depth + 1, most, skipped)


class FsEntries(DataSource):
    """Options: path (the root), depth (levels below it; all if absent), skip (names, comma-joined), parts (about how many to deal the listing to); for a stream snapshots, a folder outside the root that all machines can see."""

    @classmethod
    def name(cls):
        return "fs_entries"

    def schema(self):
        return SCHEMA + (", change string" if self.options.get("snapshots") else "")

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Changes(self.options)


class _Listing:
    def __init__(self, options):
        self.root = Root(options["path"])
        self.depth = int(options["depth"]) if options.get("depth") else None
        self.skipped = frozenset(options.get("skip", ",".join(SKIPPED)).split(","))
        self.want = int(options.get("parts", 32))

    def frontier(self) -> list[list[Part]]:
        return frontier(self.root, self.depth, self.skipped, self.want)


class _Reader(_Listing, DataSourceReader):
    def partitions(self):
        return [InputPartition([tuple(p) for p in parts]) for parts in self.frontier()] or [InputPartition([])]

    def read(self, partition):
        yield from listed(self.root, [Part(*p) for p in partition.value], self.depth, self.skipped)


class _Changes(_Listing, DataSourceStreamReader):
    """Offsets number snapshots. The one of a batch is written by its tasks, part by part, as they compare it with the one before: so a batch that is run again gives the same rows, whatever has happened to the files.

    `<number>/plan` has the parts and the first path of each; `<number>/<part>.parquet` the files (not folders) in walk order. A part also answers for
    what the snapshot before has from its first path up to the next part's.
    """

    def __init__(self, options):
        super().__init__(options)
        self.at = options["snapshots"]

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in os.listdir(self.at) if n.isdigit()) if os.path.isdir(self.at) else []

    def initialOffset(self):
        return {"snapshot": 0}

    def latestOffset(self):
        return {"snapshot": max(self._numbers(), default=0) + 1}

    def _plan(self, number: int) -> list[list]:
        with open(f"{self.at}/{number}/plan", "rb") as f:
            return pickle.load(f)

    def partitions(self, start, end):
        if start["snapshot"] == end["snapshot"]:
            return []
        number = end["snapshot"]
        if not os.path.exists(f"{self.at}/{number}/plan"):
            plan = [[tuple(p) for p in parts] for parts in self.frontier()] or [[]]
            os.makedirs(f"{self.at}/{number}", exist_ok=True)
            _whole(f"{self.at}/{number}/plan", lambda at: _pickled(at, plan))
        plan = self._plan(number)
        firsts = [Part(*p[0]).first() if p and i else None for i, p in enumerate(plan)]
        return [InputPartition((start["snapshot"], number, i, plan[i], firsts[i], firsts[i + 1] if i + 1 < len(plan) else None)) for i in range(len(plan))]

    def _before(self, number: int, low, high):
        """The rows of a snapshot from low to below high, in order."""
        if not number:
            return
        plan = self._plan(number)
        firsts = [Part(*p[0]).first() if p and i else None for i, p in enumerate(plan)]
        for i, first in enumerate(firsts):
            beyond = firsts[i + 1] if i + 1 < len(firsts) else None
            if (high is not None and first is not None and first >= high) or (low is not None and beyond is not None and beyond <= low):
                continue
            for batch in pq.ParquetFile(f"{self.at}/{number}/{i}.parquet").iter_batches():
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key = walk_key(row[0])
                    if (low is None or key >= low) and (high is None or key < high):
                        yield row

    def read(self, partition):
        before, number, i, parts, low, high = partition.value
        at = f"{self.at}/{number}/{i}.parquet"
        if not os.path.exists(at):
            _whole(at, lambda to: self._write(to, [Part(*p) for p in parts]))
        old = self._before(before, low, high)
        was = next(old, None)
        for batch in pq.ParquetFile(at).iter_batches():
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = walk_key(row[0])
                while was is not None and walk_key(was[0]) < key:
                    yield (*was, "removed")
                    was = next(old, None)
                if was is not None and was[0] == row[0]:
                    if was[2:6] != row[2:6]:
                        yield (*row, "changed")
                    was = next(old, None)
                else:
                    yield (*row, "added")
        while was is not None:
            yield (*was, "removed")
            was = next(old, None)

    def _write(self, to: str, parts: list[Part]) -> None:
        with pq.ParquetWriter(to, _SNAPSHOT) as out:
            rows = (r for r in listed(self.root, parts, self.depth, self.skipped) if r[2] != "dir")
            while some := list(itertools.islice(rows, 10_000)):
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _SNAPSHOT, strict=True)], schema=_SNAPSHOT))

    def commit(self, end):
        for n in self._numbers():
            if n < end["snapshot"]:
                shutil.rmtree(f"{self.at}/{n}", ignore_errors=True)


_SNAPSHOT = pa.schema([("path", pa.string()), ("name", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("permissions", pa.string()), ("depth", pa.int32())])


def _pickled(at: str, value) -> None:
    with open(at, "wb") as f:
        pickle.dump(value, f)


def _whole(at: str, write) -> None:
    """Writes a file under a name of its own and moves it into place: a task may run again or twice at once."""
    own = f"{at}.{uuid.uuid4().hex}"
    write(own)
    os.replace(own, at)


def _source(reader, root: str, depth: int | None, skip: tuple[str, ...], parts: int):
    reader = reader.format("fs_entries").option("skip", ",".join(skip)).option("parts", parts).option("path", os.path.realpath(root))
    return reader.option("depth", depth) if depth is not None else reader


def entries(spark: SparkSession, root: str, depth: int | None = None, skip: tuple[str, ...] = SKIPPED, parts: int | None = None) -> DataFrame:
    """The listing of a folder, dealt to about so many tasks (some for each core)."""
    spark.dataSource.register(FsEntries)
    return _source(spark.read, root, depth, skip, parts or 4 * spark.sparkContext.defaultParallelism).load()


def changes(spark: SparkSession, root: str, snapshots: str, depth: int | None = None, skip: tuple[str, ...] = SKIPPED, parts: int | None = None) -> DataFrame:
    """A stream of the files of a folder (links too, folders not) that each batch finds added, changed (type, size, time or permissions) or removed since the batch before, with change. snapshots: a folder outside the root that all machines can see, for this stream alone."""
    spark.dataSource.register(FsEntries)
    return _source(spark.readStream, root, depth, skip, parts or 4 * spark.sparkContext.defaultParallelism).option("snapshots", snapshots).load()


def contents(listing: DataFrame, root: str, max_bytes: int | None = None) -> DataFrame:
    """path, content of the listed files, read by the tasks; larger files are left out."""
    confined = Root(root)
    files = listing.where(F.col("type").isin("file", "symlink"))
    if max_bytes is not None:
        files = files.where(F.col("size") <= max_bytes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(confined.resolve(path), "rb") as f:
                        data = f.read()
                except (OSError, ValueError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], ["path", "content"])

    return files.select("path").mapInArrow(run, "path string, content binary")


def binary_files(spark: SparkSession, root: str, max_bytes: int | None = None, glob: str | None = None) -> DataFrame:
    """path (below root), content, mtime_ms and size through Spark's own reader, from any store; size and name are pruned before contents are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    return df.select(F.substring_index(F.col("path"), base, -1).alias("path"), "content", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))


def from_table(df: DataFrame, path, text: str = "text") -> DataFrame:
    """A corpus (path, text) from a table: path is a Column."""
    return df.select(path.alias("path"), F.col(text).alias("text"))
