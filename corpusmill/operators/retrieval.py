"""Searches that index what they need as they go, and context for every turn of many conversations."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import search
from corpusmill.operators.index import Index
from corpusmill.sources.shared import shuffle_partitions, staged

Read = Callable[[DataFrame], DataFrame]


def refresh(files: DataFrame, index: Index, read: Read, now: int) -> None:
    """Brings the index up to date for these files (path, mtime_ms, size): those it has as they are count as used, the others go through read (to chunks with embeddings) and one upsert."""
    known = index.files()
    stale = index.stale(files)
    if not known.isEmpty():
        index.hits(files, now)
    if not stale.isEmpty():
        index.upsert(stale, read(stale), now)


def search_files(files: DataFrame, index: Index, read: Read, query: list[float], now: int, top_k: int = 10, threshold: float = 0.0, extensions: list[str] | None = None, most_files: int = 200, most_chunks: int = 5000) -> DataFrame:
    """A semantic search of files (path, mtime_ms, size): those that one takes (neither empty nor too large, the first in walk order) are indexed where they changed, then searched, as far as the cap on chunks allows. The rows of search.search_semantic."""
    wanted = search.embeddable(files, most_files).select("path", "mtime_ms", "size")
    refresh(wanted, index, read, now)
    sizes = index.files().join(wanted.select("path"), "path", "left_semi").select("path", "n_chunks")
    searched = search.chunk_cap(sizes, most_chunks).select("path")
    return search.search_semantic(index.chunks().join(searched, "path", "left_semi"), query, top_k, threshold, extensions)


def search_one(files: DataFrame, index: Index, read: Read, path: str, query: list[float], now: int, top_k: int = 5, threshold: float = 0.3) -> DataFrame:
    """A semantic search of one of files, indexed first if it changed: the rows of search.search_document."""
    one = files.where(F.col("path") == path).select("path", "mtime_ms", "size")
    refresh(one, index, read, now)
    live = index.chunks().join(one.select("path"), "path", "left_semi")  # nothing of a file that is gone
    return search.search_document(live, path, query, top_k, threshold)


def context_for_turns(turns: DataFrame, chunks: DataFrame, top_k: int = 5, min_score: float = 0.2, id_col: str = "vec_id") -> DataFrame:
    """turns: conv_id, turn, q (its query vector); chunks: id_col, embedding. conv_id, turn, id_col, score, rank: what search.auto_context picks for each turn, no chunk twice in a conversation.

    A turn's picks are among its top_k * n best where n turns came up to it, so one batch of nearest neighbours of the distinct query vectors gives all candidates; what was
    picked before is then left out turn by turn, in tasks that read conversations in order and hold one one's picks.
    """
    placed = turns.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    most = placed.agg(F.max("n")).first()[0] or 0
    asked = placed.groupBy("q").agg((F.max("n") * top_k).cast("long").alias("need"))  # a vector that many turns have is searched once
    asked = staged(asked.withColumn("name", F.monotonically_increasing_id()), "asked")
    found = search.batch_top_k(chunks, asked, id_col, "name", top_k * most or 1, "need").select("name", F.col(id_col).alias("id"), "score", F.col("rank").cast("long").alias("rank"))
    named = placed.join(asked.select("q", "name"), "q").select("name", "conv_id", "turn", "n")
    found = named.join(found, "name").where(F.col("rank") <= top_k * F.col("n")).select("conv_id", "turn", "id", "score", "rank")
    found = found.repartition(shuffle_partitions(chunks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "rank")

    def pick(batches):
        own, turn, seen, taken = object(), None, set(), []

        def done():
            """What the turn takes: nothing if the best of it is below the least score."""
            if not taken or not taken[0][1] >= min_score:
                return []
            seen.update(i for i, _ in taken)
            return [(own, turn, i, score, rank) for rank, (i, score) in enumerate(taken, 1)]

        for batch in batches:
            out = []
            for conv, t, i, score in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (conv, t) != (own, turn):
                    out += done()
                    if conv != own:
                        seen = set()
                    own, turn, taken = conv, t, []
                if len(taken) < top_k and i not in seen:
                    taken.append((i, score))
            yield _picked(out)
        yield _picked(done())

    def _picked(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["conv_id", "turn", "id", "score", "rank"])

    picked = found.select("conv_id", "turn", "id", "score").mapInArrow(pick, "conv_id long, turn long, id long, score double, rank long")
    return picked.withColumnRenamed("id", id_col)
