"""A persistent index for exact search: groups of files in walk order, their zones, and posting lists of their trigrams.

`texts/grp=<n>` holds the files of one group, about `group_bytes` of text or more, numbered in walk order; `zones` has a row for each group
(its files and first and last path); `postings` has (gram, grp) for each three bytes in a row that a group's texts or
lower-cased texts have, sorted by gram, so Parquet statistics find a gram's rows. A search reads only groups that have all
grams of the needle: a text that holds the needle has them, so no match is lost. A needle under three bytes skips nothing.
A search with a limit goes in waves of groups, in walk order, each twice as large as the one before, and ends with the wave that
reaches the limit; what it would have opened up to there is counted from the zones.

The rows are those of `search.search_exact`. A null text is a file that a search opens but doesn't search. The index is built anew, not
updated; a build that fails leaves no zones, and an index without zones is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import search
from corpusmill.sources.shared import PIECE_BYTES, pieces, shuffle_partitions, staged

GROUP_BYTES = 64 << 20
#: Groups smaller than GROUP_BYTES are as many as this, about: each is a folder of its own, and costs more than its bytes do.
SMALL_GROUPS = 256
#: Groups that one task writes at most, and grams of a needle that are looked up (more would leave Parquet's pushed filters).
GROUPS_A_TASK, MOST_GRAMS = 16, 10
#: Groups in the first wave, and in the largest.
FIRST_WAVE, LAST_WAVE = 8, 4096
_SHIFT = 20
TEXTS = "path string, text string, grp long"
FOUND = "path string, line int, excerpt string"


def _grams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.empty(0, np.int32)


def grams_of(needle: str, case_sensitive: bool) -> list[int]:
    """Some of the grams that a text must have to hold the needle, spread over it: all of them where they are few."""
    found = _grams((needle if case_sensitive else needle.lower()).encode()).tolist()
    return found if len(found) <= MOST_GRAMS else [found[i * (len(found) - 1) // (MOST_GRAMS - 1)] for i in range(MOST_GRAMS)]


def _grouped(batches, group_bytes: int):
    """Adds grp: files of a partition, in order, are in one group until their texts have so many bytes."""
    base, size = TaskContext.get().partitionId() << _SHIFT, 0
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = size + np.cumsum(sizes) - sizes
        size += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base + before // group_bytes)], ["path", "text", "grp"])


def _mark(have: np.ndarray, texts: pa.Array) -> None:
    """Sets the places of all grams within these texts, none across two of them."""
    texts = texts.drop_null().cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    inner = edges[1:-1] - edges[0]
    for at in range(0, max(0, len(data) - 2), PIECE_BYTES):
        b = data[at : at + PIECE_BYTES + 2].astype(np.int32)
        grams = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        own = np.ones(len(grams), bool)
        for back in (1, 2):
            crossing = inner - at - back
            own[crossing[(crossing >= 0) & (crossing < len(own))]] = False
        have[grams[own]] = True


def _posted(batches):
    """(grp, grams) of rows grp, text, folded; a group may come in several rows."""
    have, current = np.zeros(1 << 24, bool), None

    def row(grp: int):
        grams = np.flatnonzero(have).astype(np.int32)
        have[grams] = False
        return pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), pa.array(grams))], ["grp", "grams"])

    for piece in pieces(batches):
        groups = piece.column(0).to_numpy()
        starts = [*np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1)).tolist(), len(groups)]
        for at, to in zip(starts, starts[1:], strict=False):
            if current is not None and current != int(groups[at]):  # groups come one after the other
                yield row(current)
            current = int(groups[at])
            for column in (1, 2):
                _mark(have, piece.column(column).slice(at, to - at))
    if current is not None:
        yield row(current)


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.zones = spark.read.parquet(f"{self.folder}/zones")

    @classmethod
    def build(cls, corpus: DataFrame, folder: str, group_bytes: int = GROUP_BYTES) -> TextIndex:
        """corpus: path, text (null: opened, not searched). group_bytes: the size of groups, which grows up to GROUP_BYTES where they would be more than SMALL_GROUPS. Texts move once, to their place in walk order."""
        spark, folder = corpus.sparkSession, folder.rstrip("/")
        size = corpus.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        group_bytes = max(group_bytes, min(GROUP_BYTES, size // SMALL_GROUPS))
        tasks = max(shuffle_partitions(spark) if size > group_bytes else 1, -(-size // (group_bytes * GROUPS_A_TASK)))
        order = [T.walk_key(F.col("path")), F.col("path")]
        dealt = corpus.select("path", "text").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        dealt.mapInArrow(lambda batches: _grouped(batches, group_bytes), TEXTS).write.partitionBy("grp").parquet(f"{folder}/texts")
        texts = spark.read.schema(TEXTS).parquet(f"{folder}/texts")
        posted = texts.select("grp", "text", F.lower("text").alias("folded")).mapInArrow(_posted, "grp long, grams array<int>")
        posted = posted.select(F.explode("grams").alias("gram"), "grp").distinct()
        posted.repartitionByRange(shuffle_partitions(spark), "gram", "grp").sortWithinPartitions("gram", "grp").write.parquet(f"{folder}/postings")
        key = T.walk_key(F.col("path"))
        zones = texts.groupBy("grp").agg(F.count("*").alias("n_opened"), F.count("text").alias("n_texts"), F.min(key).alias("first"), F.max(key).alias("last"))
        zones.write.parquet(f"{folder}/zones")
        return cls(spark, folder)

    def groups(self, needle: str, case_sensitive: bool = False) -> DataFrame:
        """grp: the groups that a search for the needle has to read."""
        wanted = grams_of(needle, case_sensitive)
        if not wanted:
            return self.zones.where("n_texts > 0").select("grp")
        rows = self.spark.read.schema("gram int, grp long").parquet(f"{self.folder}/postings").where(F.col("gram").isin(wanted))
        return rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("grp")

    def _texts(self, groups: list[int]) -> DataFrame:
        return self.spark.read.schema(TEXTS).option("basePath", f"{self.folder}/texts").parquet(*[f"{self.folder}/texts/grp={g}" for g in groups])

    def search(self, needle: str, case_sensitive: bool = False, limit: int | None = 200) -> DataFrame:
        """path, line, excerpt of lines that hold the needle, the first `limit` in walk order."""
        if limit is None:
            texts = self.spark.read.schema(TEXTS).parquet(f"{self.folder}/texts").join(self.groups(needle, case_sensitive), "grp", "left_semi")
            return search.search_exact(texts, needle, case_sensitive, None)
        rows, _, _ = self._first(needle, case_sensitive, limit)
        return self.spark.createDataFrame(rows, FOUND)

    def _first(self, needle: str, case_sensitive: bool, limit: int) -> tuple[list, list[int], int]:
        """The first `limit` matches, the groups read in the last wave, and how many were read in all."""
        wanted = staged(self.groups(needle, case_sensitive), "groups-to-search")
        found, read, at, size = [], 0, None, FIRST_WAVE
        while True:
            ahead = wanted if at is None else wanted.where(F.col("grp") > at)
            wave = [r["grp"] for r in ahead.orderBy("grp").limit(size).collect()]  # LAST_WAVE at most
            if wave and limit > len(found):
                found += search.search_exact(self._texts(wave), needle, case_sensitive, limit - len(found)).collect()  # limit rows at most
                read += len(wave)
            if len(wave) < size or len(found) >= limit:
                return [tuple(r) for r in found], wave, read
            at, size = wave[-1], min(2 * size, LAST_WAVE)

    def report(self, needle: str, case_sensitive: bool = False, limit: int = 200) -> DataFrame:
        """One row: matches (array, null if there are none), files_inspected (what a search without index opens: all files, or up to the one with the last match), truncated, groups_read, groups."""
        rows, wave, read = self._first(needle, case_sensitive, limit)
        truncated, opened = len(rows) >= limit, self.zones
        total = opened.agg(F.sum("n_opened").alias("n"), F.count("*").alias("groups")).first()
        inspected = total["n"] or 0
        if truncated and rows:
            last = F.split(F.lit(rows[-1][0]), "/", -1)
            at = opened.where(F.col("grp").isin(wave) & (F.col("first") <= last) & (F.col("last") >= last)).agg(F.max("grp")).first()[0]
            inspected = (opened.where(F.col("grp") < at).agg(F.sum("n_opened")).first()[0] or 0) + self._texts([at]).where(T.walk_key(F.col("path")) <= last).count()
        schema = "matches array<struct<path: string, line: int, excerpt: string>>, files_inspected long, truncated boolean, groups_read long, groups long"
        return self.spark.createDataFrame([(rows or None, inspected, truncated, read, total["groups"])], schema)


def opened(files: DataFrame, max_bytes: int = search.MAX_FILE_BYTES) -> DataFrame:
    """files (path, content) as a corpus to build an index of: larger ones left out, binary ones with a null text."""
    fits = files.where(F.octet_length("content") <= max_bytes)
    return fits.select("path", F.when(T.is_text(F.col("content")), F.col("content").cast("string")).alias("text"))
