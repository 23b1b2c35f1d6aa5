"""Exact and semantic search. C: (path, text); K: chunks with path, chunk_index, section, text, embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vectors as V

MAX_LINE_BYTES = 1 << 20


def search_exact(corpus: DataFrame, query: str, case_sensitive: bool = False, limit: int | None = 200, keys: tuple[str, ...] = ("path",), order: list[Column] | None = None) -> DataFrame:
    """Lines that hold the query as it stands, as keys, line and excerpt, the first `limit` in walk order. A text with a line over 1 MiB has no matches."""
    text = F.col("text")
    hit = lambda x: F.contains(x if case_sensitive else F.lower(x), F.lit(query if case_sensitive else query.lower()))
    rows = corpus.where(hit(text) if "\r" not in query and "\n" not in query else F.lit(True))  # whole texts first, so few are split
    fits = ~F.exists(F.split(text, "\n"), lambda x: F.octet_length(x) > MAX_LINE_BYTES)
    rows = rows.where((F.octet_length(text) <= MAX_LINE_BYTES) | fits)
    rows = rows.select(*keys, F.posexplode(T.lines(text)).alias("line", "text")).where(hit(F.col("text")))
    rows = rows.select(*keys, (F.col("line") + 1).alias("line"), T.excerpt(F.col("text")).alias("excerpt"))
    rows = rows.orderBy(*(order or [T.walk_key(F.col("path"))]), "line")
    return rows if limit is None else rows.limit(limit)


MAX_FILE_BYTES = 2 << 20


def searchable(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """files (path, content) as the corpus of an exact search: path, text of those that aren't larger than max_bytes nor binary."""
    return files.where((F.octet_length("content") <= max_bytes) & T.is_text(F.col("content"))).select("path", F.col("content").cast("string").alias("text"))


def embeddable(files: DataFrame, most: int = 200, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """files (path, size) that a semantic search indexes: neither empty nor larger than max_bytes, the first in walk order."""
    return first_files(files.where(F.col("size").between(1, max_bytes)), most)


def files_inspected(corpus: DataFrame, max_bytes: int = MAX_FILE_BYTES, size: str = "text") -> DataFrame:
    """How many texts (or files, size: content) an exact search opens when it isn't cut short."""
    return corpus.where(F.octet_length(size) <= max_bytes).agg(F.count("*").alias("files_inspected"))


def search_report(files: DataFrame, query: str, case_sensitive: bool = False, limit: int = 200, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """An exact search of files (path, content) in one row: matches (array, null if there are none), files_inspected (binary ones too, up to the one with the last match if the search is cut short) and truncated."""
    found = search_exact(searchable(files, max_bytes), query, case_sensitive, limit)
    key = F.struct(T.walk_key(F.col("path")).alias("k"), "line", F.struct("path", "line", "excerpt").alias("m"))
    rows = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["m"])
    report = found.agg(F.when(F.count("*") > 0, rows).alias("matches"), F.max(T.walk_key(F.col("path"))).alias("last"), (F.count("*") >= limit).alias("truncated"))
    opened = files.where(F.octet_length("content") <= max_bytes).select(T.walk_key(F.col("path")).alias("at"))
    counted = opened.join(F.broadcast(report.select("last", "truncated")), ~F.col("truncated") | (F.col("at") <= F.col("last")))  # one row
    return report.select("matches", "truncated").crossJoin(F.broadcast(counted.agg(F.count("*").alias("files_inspected")))).select("matches", "files_inspected", "truncated")


def first_files(files: DataFrame, most: int = 200) -> DataFrame:
    """The first files in walk order."""
    return files.orderBy(T.walk_key(F.col("path"))).limit(most)


def chunk_cap(files: DataFrame, most: int = 5000) -> DataFrame:
    """files (path, n_chunks) with chunks, in walk order, as long as those before have no more than `most` chunks together."""
    # each has a chunk at least, so no more than most + 1 can stay, and the window sees a bounded number of rows
    ahead = first_files(files.where("n_chunks > 0"), most + 1)
    w = Window.orderBy(T.walk_key(F.col("path"))).rowsBetween(Window.unboundedPreceding, -1)
    return ahead.withColumn("_before", F.coalesce(F.sum("n_chunks").over(w), F.lit(0))).where(F.col("_before") <= most).drop("_before")


def _scored(chunks: DataFrame, query: list[float], score: str = "score") -> DataFrame:
    return chunks.withColumn(score, V.dot(F.col("embedding"), V.literal(query)))


def search_semantic(chunks: DataFrame, query: list[float], top_k: int = 10, threshold: float = 0.0, extensions: list[str] | None = None) -> DataFrame:
    """Best chunks of all documents: path, chunk_index, section, score, excerpt; ties by path and index. top_k outside 1 to 10 counts as 10."""
    top_k = top_k if 1 <= top_k <= 10 else 10
    df = chunks if not extensions else chunks.where(T.extension(T.file_name(F.col("path"))).isin([e.lower() for e in extensions]))
    df = _scored(df, query).where(F.col("score") >= threshold)
    return df.select("path", "chunk_index", "section", "score", T.excerpt(F.col("text")).alias("excerpt")).orderBy(F.desc("score"), "path", "chunk_index").limit(top_k)


def search_document(chunks: DataFrame, path: str, query: list[float], top_k: int = 5, threshold: float = 0.3) -> DataFrame:
    """Best chunks of one document: chunk_index, section, tokens, similarity, summary; top_k between 1 and 10."""
    one = chunks.where(F.col("path") == path).withColumn("similarity", V.cosine(F.col("embedding"), V.literal(query))).where(F.col("similarity") >= F.lit(threshold).cast("float"))
    return one.select("chunk_index", "section", "tokens", "similarity", T.summary(F.col("text")).alias("summary")).orderBy(F.desc("similarity"), "chunk_index").limit(max(1, min(10, top_k)))


#: Queries that go with a plan, or are compared at a time; vectors that they are compared with at a time.
QUERY_BLOCK, SLICE = 4096, 4096
#: Scores that one product gives at most, and best ones that are held for queries compared at a time.
SCORES, HELD = 1 << 20, 1 << 19
#: Queries and vectors of a block in an exchange: each vector is sent once for so many queries, each query once for so many vectors.
QUERIES, VECTOR_BLOCK = 1 << 14, 1 << 17


def _nearest(batches, names: list, queries: np.ndarray, k: int, need: np.ndarray | None = None):
    """For batches of (id, embedding): each query's k (or need) best of the whole partition, ties by id, NaN above all as Spark has it. Scores are made for some rows at a time, and what can't be among the best any more is dropped at once."""
    need = np.full(len(names), k) if need is None else np.minimum(need, k)
    top = int(need.max(initial=0))
    least = np.full(len(names), -np.inf)  # what each query's next must reach
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]  # query, id, score
    waiting, n_waiting = [], 0

    def merged():
        q, ids, scores = (np.concatenate([h, *w]) for h, w in zip(held, zip(*waiting, strict=True), strict=True)) if waiting else held
        odd = np.isnan(scores)
        order = np.lexsort((ids, -scores, ~odd, q))
        q, ids, scores = q[order], ids[order], scores[order]
        n = np.bincount(q, minlength=len(names))
        rank = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        last = rank == need[q] - 1
        least[q[last]] = np.where(np.isnan(scores[last]), np.inf, scores[last])
        keep = rank < need[q]
        waiting.clear()
        return [q[keep], ids[keep], scores[keep]]

    rows = max(1, SCORES // max(1, len(names)))
    for batch in batches:
        for at in range(0, batch.num_rows if names else 0, rows):
            some = batch.slice(at, rows)
            ids = some.column(0).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(some.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            fits = sizes == queries.shape[1]  # other lengths have score 0
            scores = np.zeros((len(names), len(ids)))
            if fits.any():
                vectors = some.column(1).filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, queries.shape[1])
                scores[:, fits] = queries @ vectors.T
            bound = least
            if len(ids) > top > 0 and np.isneginf(least).any():  # the first rows
                own = np.partition(scores, -top, 1)[:, -top]
                bound = np.maximum(least, np.where(np.isnan(own), np.inf, own))
            q, c = np.nonzero(~(scores < bound[:, None]))
            waiting.append((q, ids[c], scores[q, c]))
            n_waiting += len(q)
            if np.isneginf(least).any() or n_waiting > need.sum() + SCORES // 4:
                held, n_waiting = merged(), 0
    q, ids, scores = merged()
    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids.astype(np.int64)), pa.array(scores)], ["q", "id", "score"])


def _meet(k: int):
    """For a block of vectors and a block of queries: each query's k best (or as many as its column need says), a slice of vectors and some of the queries at a time."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names, found = queries.column("name"), []
        rows = vectors.select(["id", "embedding"]).combine_chunks()
        need = np.minimum(queries.column("need").to_numpy(), k) if "need" in queries.column_names else np.full(queries.num_rows, k)
        before = np.cumsum(need) - need
        at = 0
        while at < queries.num_rows and rows.num_rows:
            to = min(at + QUERY_BLOCK, max(at + 1, int(np.searchsorted(before, before[at] + HELD))))
            some = queries.slice(at, to - at)
            matrix = np.array(some.column("q").to_pylist(), np.float64)
            (best,) = _nearest(rows.to_batches(max_chunksize=SLICE), some.column("name").to_pylist(), matrix, k, need[at:to])
            found.append(pa.table([some.column("name").take(best.column(0)), best.column(1), best.column(2)], ["name", "id", "score"]))
            at = to
        return pa.concat_tables(found) if found else pa.table([names.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], ["name", "id", "score"])

    return run


def batch_top_k(vectors: DataFrame, queries: DataFrame, id_col: str, query_col: str, k: int = 10, need: str | None = None) -> DataFrame:
    """For each query (query_col, q: its vector) the k nearest of vectors (id_col, embedding): query_col, id_col, score, rank.

    The queries are a stated set. Up to QUERY_BLOCK of them go with the plan: each partition scores its vectors against them with one
    matrix product a batch and keeps k rows a query, so that only those are shuffled. More are a table: blocks of queries
    meet blocks of vectors by one exchange, and each meeting keeps k rows a query. need: a column of queries with how many of the k each
    has to get, where they differ; it may get more.
    """
    kind = queries.schema[query_col].dataType.simpleString()
    asked = queries.select(F.col(query_col).alias("name"), "q", *([F.col(need).cast("long").alias("need")] if need else []))
    block = asked.limit(QUERY_BLOCK + 1).collect()
    rank = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    if not block:
        return vectors.limit(0).select(F.lit(None).cast(kind).alias(query_col), F.col(id_col).cast("long"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), "embedding")
    if len(block) <= QUERY_BLOCK:
        names, matrix = [r[0] for r in block], np.array([r[1] for r in block], np.float64)
        wanted = np.array([r["need"] for r in block]) if need else None
        found = rows.mapInArrow(lambda b: _nearest(b, names, matrix, k, wanted), "q int, id long, score double")
        top = found.withColumn("rank", rank("q")).where(F.col("rank") <= k)
        key = vectors.sparkSession.createDataFrame(list(enumerate(names)), f"q int, `{query_col}` {kind}")
        return top.join(key, "q").select(query_col, F.col("id").alias(id_col), "score", "rank")
    counts = rows.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    vector_blocks, query_blocks = max(1, -(-counts[0] // VECTOR_BLOCK)), -(-counts[1] // QUERIES)
    left = rows.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(vector_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("name"), F.lit(query_blocks)).cast("int"))
    right = right.withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vector_blocks - 1).cast("long"))))
    met = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(_meet(k), f"name {kind}, id long, score double")
    top = met.withColumn("rank", rank("name")).where(F.col("rank") <= k)
    return top.select(F.col("name").alias(query_col), F.col("id").alias(id_col), "score", "rank")


def auto_context(chunks: DataFrame, query: list[float], top_k: int = 5, min_score: float = 0.2, exclude: DataFrame | None = None) -> DataFrame:
    """The best chunks not injected before (exclude: key), or none at all if the best of them is below min_score: key, path, chunk_index, score, text."""
    df = _scored(chunks, query).withColumn("key", T.chunk_key(F.col("path"), F.col("chunk_index")))
    if exclude is not None:
        df = df.join(exclude, "key", "left_anti")
    best = df.select("key", "path", "chunk_index", "section", "score", "text").orderBy(F.desc("score"), "path", "chunk_index").limit(top_k)
    return best.withColumn("_best", F.max("score").over(Window.partitionBy())).where(F.col("_best") >= min_score).drop("_best")


def render_context(picked: DataFrame, max_chars: int = 6000) -> tuple[str, list[str]]:
    """The context as JSON text, cut after so many bytes with a notice, and the keys of all that was picked."""
    import json

    rows = picked.orderBy(F.desc("score"), "path", "chunk_index").collect()  # top_k rows
    body = json.dumps([{"path": r["path"], "chunk_index": r["chunk_index"], "score": r["score"], "text": r["text"]} for r in rows], ensure_ascii=False, separators=(",", ":"))
    raw = body.encode()
    if len(raw) > max_chars:
        body = raw[:max_chars].decode("utf-8", "ignore") + "\n[context cut]"
    return body, [r["key"] for r in rows]


def injected_keys(injected: DataFrame, picked: DataFrame) -> DataFrame:
    """The keys that a conversation has seen, with those of what was picked now."""
    return injected.select("key").unionByName(picked.select("key")).distinct()
