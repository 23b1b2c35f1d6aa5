"""Searches that index as they go, and context for all turns of conversations."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.operators import index as I
from corpusmill.operators import retrieval, search

CHUNKS = "path string, chunk_index int, total int, section string, tokens long, text string, embedding array<float>"


def test_files_are_indexed_once_and_searched(spark, tmp_path):
    index, asked = I.Index(spark, f"file://{tmp_path}/index", "m"), []
    vectors = {"a.md": [1.0, 0.0], "b.txt": [0.6, 0.8], "c.md": [0.0, 1.0], "large.md": [1.0, 0.0], "none.md": [1.0, 0.0]}

    def listed(**times):
        rows = [(f"{n}.{'txt' if n == 'b' else 'md'}", t, 0 if n == "none" else search.MAX_FILE_BYTES + (n == "large")) for n, t in times.items()]
        return spark.createDataFrame(rows, "path string, mtime_ms long, size long")

    def read(stale):
        asked.append(sorted(r.path for r in stale.collect()))
        rows = [(p, i + 1, 2, "", 1, f"{p} {i}", v) for p, v in vectors.items() for i in range(2)]
        return spark.createDataFrame(rows, CHUNKS).join(stale.select("path"), "path", "left_semi").select(*[c.split()[0] for c in CHUNKS.split(", ")])

    def found(files, now, **args):
        return [(r.path, r.chunk_index) for r in retrieval.search_files(files, index, read, [1.0, 0.0], now, **args).collect()]

    first = listed(a=1, b=1, c=1, large=1, none=1)
    assert found(first, 5, top_k=3) == [("a.md", 1), ("a.md", 2), ("b.txt", 1)]
    assert asked == [["a.md", "b.txt", "c.md"]]
    vectors["c.md"] = [1.0, 0.0]
    again = listed(a=1, b=1, c=2)
    assert found(again, 6, top_k=9, extensions=[".md"]) == [("a.md", 1), ("a.md", 2), ("c.md", 1), ("c.md", 2)]
    assert asked[1:] == [["c.md"]] and {r.path: r.last_access for r in index.files().collect()} == {"a.md": 6, "b.txt": 6, "c.md": 6}
    assert found(again, 7, most_files=1) == [("a.md", 1), ("a.md", 2)] and found(again, 8, most_chunks=1) == [("a.md", 1), ("a.md", 2)]
    one = retrieval.search_one(listed(a=1, b=9), index, read, "b.txt", [1.0, 0.0], 9).collect()
    assert [r.chunk_index for r in one] == [1, 2] and asked[2:] == [["b.txt"]]
    assert retrieval.search_one(listed(a=1), index, read, "gone", [1.0, 0.0], 9).count() == 0 and len(asked) == 3


def test_context_is_that_of_turns_one_after_the_other(spark):
    e = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    turns = spark.createDataFrame([(c, t, [1.0, -0.5 * (c % 3), 0.0 if c % 2 else -9.0]) for c in range(6) for t in range(5)] + [(None, 0, [1.0, 1.0, 1.0])], "conv_id long, turn long, q array<double>")
    got = {}
    for r in retrieval.context_for_turns(turns, e, 3, 1.0).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r["rank"], r.vec_id))
    chunks = e.select(F.lit("p").alias("path"), F.col("vec_id").cast("int").alias("chunk_index"), F.lit("").alias("section"), F.lit("").alias("text"), "embedding")
    for c in (0, 1, 2, 5):
        seen = []
        for t in range(5):
            q = [1.0, -0.5 * (c % 3), 0.0 if c % 2 else -9.0]
            exclude = spark.createDataFrame([(f"p#{i}",) for i in seen], "key string")
            picked = [r.chunk_index for r in search.auto_context(chunks, q, 3, 1.0, exclude).collect()]
            assert [i for _, i in sorted(got.get((c, t), []))] == picked
            seen += picked
    assert len(got[(None, 0)]) == 3
    assert retrieval.context_for_turns(turns.limit(0), e).count() == 0


def test_nearest_holds_few_scores(monkeypatch):
    """Many queries against a batch of many vectors: no matrix of all their scores, and the same best ones, ties by id, NaN first."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (3000, 4)).astype(np.float32)
    vectors[17, 0] = np.nan
    queries = rng.integers(-2, 3, (50, 4)).astype(np.float64)
    queries[:, 0] = np.where(queries[:, 0] == 0, 1, queries[:, 0])
    batch = pa.record_batch([pa.array(np.arange(3000)), pa.array(list(vectors), pa.list_(pa.float32()))], ["id", "embedding"])
    monkeypatch.setattr(search, "SCORES", 1000)
    largest, zeros = [0], np.zeros
    monkeypatch.setattr(search.np, "zeros", lambda shape, *a, **b: largest.append(int(np.prod(shape))) or zeros(shape, *a, **b))
    need = np.arange(50) % 7 + 1
    (got,) = search._nearest([batch], list(range(50)), queries, 7, need)
    assert max(largest) <= 1000
    found = list(zip(*(c.to_pylist() for c in got.columns), strict=True))
    scores = queries @ vectors.astype(np.float64).T
    for q in range(50):
        want = sorted(range(3000), key=lambda i: (not np.isnan(scores[q, i]), -np.nan_to_num(scores[q, i]), i))[: need[q]]
        assert [i for own, i, _ in found if own == q] == want


def test_equal_turns_are_searched_once(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    turns = spark.createDataFrame([(c, t, [1.0, 0.0]) for c in range(5) for t in range(3)], "conv_id long, turn long, q array<float>")
    asked, was = [], search.batch_top_k
    monkeypatch.setattr(search, "batch_top_k", lambda v, q, *a: asked.append(q.count()) or was(v, q, *a))
    got = {(r.conv_id, r.turn, r.rank): r.vec_id for r in retrieval.context_for_turns(turns, chunks, 2).collect()}
    assert asked == [1] and got == {(c, t, r): 20 - 2 * t - r for c in range(5) for t in range(3) for r in (1, 2)}
