"""Queries do the whole job: all rows, both branches, production defaults."""

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import reading
from corpusmill.plans import registry

SF = "/root/testdata/sf0.01"


def test_read_documents_all_and_manifests(spark):
    words = "\n\n".join(f"# part {i}\nalpha{i} beta. gamma " + "w" * 9000 for i in range(3))
    corpus = spark.createDataFrame([("a/doc1", "short text"), ("a/doc2.md", words), ("b/doc3.TXT", "")], "path string, text string")
    got = reading.read_documents(corpus).collect()
    by = {p: [r for r in got if r.path == p] for p in ("a/doc1", "a/doc2.md", "b/doc3.TXT")}
    assert [(r.text, r.chunk_index) for r in by["a/doc1"]] == [("short text", None)]
    assert [(r.text, r.chunk_index) for r in by["b/doc3.TXT"]] == [("(no extractable text)", None)]
    long = sorted(by["a/doc2.md"], key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in long] == list(range(1, len(long) + 1)) and len(long) > 3
    assert all(r.text is None and r.total == len(long) and r.tokens <= 2000 for r in long) and long[0].summary == "alpha0 beta." and long[0].section == "part 0"


def test_read_documents_query(spark):
    got = registry.QUERIES["read_documents"](spark, SF)
    per = got.groupBy("path").agg(F.max("chunk_index").alias("chunks")).collect()
    assert len(per) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r.chunks is not None for r in per) > 0


def test_natural_order_ranks_every_path(spark):
    got = registry.QUERIES["natural_sort"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    ranks = got.groupBy(F.regexp_extract("path", "^(.*)/", 1)).agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.countDistinct("rank").alias("ranks")).collect()
    assert all(r.n == r.top == r.ranks for r in ranks)


def test_read_batch_defaults(spark):
    from pyspark.testing import assertDataFrameEqual

    wide = spark.createDataFrame([(i, f"d{i:02}", "x" * (131073 if i == 1 else 131072)) for i in range(30)], "pos long, path string, text string")
    got = {r.pos: r for r in reading.read_batch(wide.select("path", "text"), wide.where("pos < 20").select("pos", "path")).collect()}
    assert sorted(got) == list(range(20)) and got[1].text == "x" * 131072 + "\n[cut after 131072 bytes]" and got[2].text == "x" * 131072
    first = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(19).select("text")
    rows = registry.QUERIES["read_batch"](spark, SF)
    assert [r.pos for r in rows.orderBy("pos").collect()] == list(range(20))
    assertDataFrameEqual(rows.where("pos > 0").select("text"), first)


def test_figures_round_as_the_reference(spark):
    counts = [0, 999, *range(1000, 4001), 1250, 1350, 10_050, 99_950, 999_950, 12_345_650, 12_345_750]
    seconds = [i / 40 for i in range(1000)] + [i / 20 for i in range(300)] + [0.05, 0.15, 0.25, 0.35, 9.95, 9.96, 10.5, 11.5, -0.25, -1.5]
    got = spark.createDataFrame([(n,) for n in counts], "n long").select("n", T.format_count(F.col("n")).alias("y")).collect()
    assert [(r.n, r.y) for r in got if r.y != (str(r.n) if r.n < 1000 else f"{r.n / 1000:.1f}k")] == []
    got = spark.createDataFrame([(s,) for s in seconds], "s double").select("s", T.format_elapsed(F.col("s")).alias("y")).collect()
    assert [(r.s, r.y) for r in got if r.y != (f"{r.s:.1f}s" if r.s < 10 else f"{r.s:.0f}s")] == []
