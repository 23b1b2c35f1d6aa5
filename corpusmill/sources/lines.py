"""Numbered lines of files of any size: a file is cut into byte ranges, which tasks read.

A first pass counts the line feeds of each range; sums over a file's ranges, one row each, give the number of a range's first line. A
line belongs to the range in which it begins; the task that has it reads on to its end. Ranges that can't have a wanted line
aren't read a second time. Lines are those of `functions.text.lines`: parted by line feeds, a carriage return before each dropped,
none after a last line feed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.paths import Root
from corpusmill.sources.shared import shuffle_partitions, staged

RANGE_BYTES = 64 << 20
#: Bytes read at a time, and lines of a batch.
_BLOCK, _LINES = 1 << 20, 10_000


def _count(confined: Root, path: str, start: int, end: int) -> int:
    n = 0
    with open(confined.resolve(path), "rb") as f:
        f.seek(start)
        while start < end and (data := f.read(min(_BLOCK, end - start))):
            n += data.count(b"\n")
            start += len(data)
    return n


def _lines(confined: Root, path: str, start: int, end: int):
    """(line feeds of the range before the line, the line) of all lines that begin in the range."""
    with open(confined.resolve(path), "rb") as f:
        passed = 0
        if start:
            f.seek(start - 1)
            before = f.readline(_BLOCK)  # the rest of a line that began earlier, or just the line feed before the range
            at = start - 1 + len(before)
            while not before.endswith(b"\n"):
                if not before or at >= end:
                    return
                before = f.readline(_BLOCK)
                at += len(before)
            passed = int(at > start)  # the line feed at start - 1 is the range before's
        else:
            at = 0
        while at < end:
            line = f.readline()
            if not line:
                return
            at += len(line)
            body = line[:-1] if line.endswith(b"\n") else line
            yield passed, body[:-1] if body.endswith(b"\r") else body
            passed += 1


def numbered_lines(files: DataFrame, root: str, start: int | None = None, end: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files (path, size) below root, a folder that all machines see: path, line (from 1) and text of the lines from start to end (both included)."""
    confined = Root(root)
    tasks = max(shuffle_partitions(files.sparkSession), files.sparkSession.sparkContext.defaultParallelism)
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {range_bytes}"))).alias("part"))
    ranges = ranges.select("path", "part", (F.col("part") * range_bytes).alias("a"), F.least("size", (F.col("part") + 1) * range_bytes).alias("b")).repartition(tasks, "path", "part")

    def count(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_count(confined, p, a, b) for p, _, a, b in rows], pa.int64())], ["path", "part", "a", "b", "n"])

    counted = staged(ranges.mapInArrow(count, "path string, part long, a long, b long, n long"), "line-ranges")
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    placed = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.where(F.col("base") + F.col("n") + 1 >= start) if start else placed
    placed = placed.where(F.col("base") + 1 <= end) if end else placed

    def read(batches):
        for batch in batches:
            for path, _, a, b, _, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                numbers, texts = [], []
                for passed, line in _lines(confined, path, a, b):
                    numbers.append(base + passed + 1)
                    texts.append(line)
                    if len(numbers) == _LINES:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * _LINES), pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())], ["path", "line", "raw"])
                        numbers, texts = [], []
                if numbers:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(numbers)), pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())], ["path", "line", "raw"])

    found = placed.select("path", "part", "a", "b", "n", "base").repartition(tasks, "path", "part").mapInArrow(read, "path string, line long, raw binary")
    found = found.where(F.col("line") >= start) if start else found
    found = found.where(F.col("line") <= end) if end else found
    return found.select("path", "line", F.col("raw").cast("string").alias("text"))
