"""Searches of the clustered index are those of the full scan, ties and odd vectors included, and read a part of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import search, vector_index
from corpusmill.operators.vector_index import VectorIndex

SCHEMA = "path string, chunk_index int, section string, text string, vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    rows = []
    for i in range(1500):
        v = centres[i % 20] + 0.15 * rng.normal(size=16)
        rows.append((f"d{i // 10}.{'md' if i % 3 else 'txt'}", i % 10, None, f"text {i}", i, (v / np.linalg.norm(v)).tolist()))
    same = rows[40][-1]
    rows += [(f"copy{i:03d}.md", 1, "s", f"copy {i}", 2000 + i, same) for i in range(400)]  # a hot cell of ties
    rows += [("odd.md", 1, "s", "null", 3000, None), ("odd.md", 2, "s", "short", 3001, [1.0]), ("odd.md", 3, "s", "zero", 3002, [0.0] * 16)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(chunks, tmp_path_factory):
    return VectorIndex.build(chunks, f"file://{tmp_path_factory.mktemp('vectors')}", ("path", "chunk_index"))


def asked(chunks, *ids):
    return [np.array(r.embedding, np.float64).tolist() for r in chunks.where(F.col("vec_id").isin(*ids)).orderBy("vec_id").collect()]


def test_same_rows(chunks, index):
    for query in [*asked(chunks, 3, 40), [0.0] * 16, (-np.array(asked(chunks, 3)[0])).tolist(), [1.0, 2.0]]:
        for args in [(10, 0.0, None), (7, 0.5, None), (3, -1.0, [".TXT"]), (99, 0.99, None)]:
            assert index.search(query, *args).collect() == search.search_semantic(chunks, query, *args).collect()


def test_part_of_the_vectors_is_read(chunks, index):
    best, work = index.nearest(asked(chunks, 3)[0], 10, 0.0)
    assert len(best) == 10 and work["vectors"] == 1903 and work["vectors_read"] < 1903 // 4 and work["cells_read"] < work["cells"] // 2
    assert index.zones.agg(F.sum("n")).first()[0] == 1903


def test_batch(spark, chunks, index):
    queries = chunks.where("vec_id % 50 = 0 and vec_id < 2500").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    found = sorted(map(tuple, index.batch_top_k(queries, "vec_id", "qid", 5).collect()))
    want = sorted(map(tuple, search.batch_top_k(chunks, queries, "vec_id", "qid", 5).collect()))
    assert [(q, i, r) for q, i, _, r in found] == [(q, i, r) for q, i, _, r in want] and np.allclose([x[2] for x in found], [x[2] for x in want])
    assert index.batch_top_k(queries.limit(0), "vec_id", "qid", 5).count() == 0


def test_batch_in_blocks(chunks, index, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(search, "QUERIES", 3)
    queries = chunks.where("vec_id % 100 = 0 and vec_id < 2200").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    found, want = (sorted((r.qid, r.vec_id, r["rank"]) for r in df.collect()) for df in (index.batch_top_k(queries, "vec_id", "qid", 4), search.batch_top_k(chunks, queries, "vec_id", "qid", 4)))
    assert found == want


def test_not_finite_and_empty(spark, tmp_path):
    rows = [("a", 1, "s", "t", 1, [1.0, float("nan")]), ("b", 1, "s", "t", 2, [1.0, 0.0]), ("c", 1, "s", "t", 3, [float("inf"), 0.0])]
    chunks = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex.build(chunks, f"file://{tmp_path}/odd", ("path", "chunk_index"))
    assert repr(index.search([1.0, 1.0]).collect()) == repr(search.search_semantic(chunks, [1.0, 1.0]).collect())
    none = VectorIndex.build(chunks.limit(0), f"file://{tmp_path}/none", ("path", "chunk_index"))
    assert none.search([1.0, 1.0]).count() == 0 and none.batch_top_k(chunks.select("vec_id", F.col("embedding").alias("q")), "vec_id", "vec_id").count() == 0


def test_rows_are_pruned_by_distance(chunks, index):
    rows = index.rows([int(c) for c in index.cells if c >= 0][:3]).where("distance >= 0.25")
    assert "GreaterThanOrEqual(distance,0.25)" in rows._jdf.queryExecution().toString()
    assert vector_index.MOST_CELLS >= len(index.cells) - 1
