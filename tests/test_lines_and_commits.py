"""Numbered lines over byte ranges, and the sink that commits in two phases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.sources import committed
from corpusmill.sources.lines import numbered_lines


def test_lines_of_any_range(spark, tmp_path):
    rng = random.Random(2)
    bodies = {"empty": b"", "feed": b"\n", "feeds": b"\n\n\n", "one": b"no feed", "long": b"x" * 500 + b"\ny"}
    for i in range(12):
        lines = ["".join(rng.choice("ab é\r") for _ in range(rng.choice([0, 1, 7, 40]))) for _ in range(rng.randint(1, 40))]
        bodies[f"d/f{i}"] = rng.choice(["\n", "\r\n"]).join(lines).encode()
    os.makedirs(tmp_path / "d")
    for path, body in bodies.items():
        (tmp_path / path).write_bytes(body)
    files = spark.createDataFrame([(p, len(b)) for p, b in bodies.items()], "path string, size long")
    corpus = spark.createDataFrame([(p, b.decode()) for p, b in bodies.items() if b], "path string, text string")
    whole = corpus.select("path", F.posexplode(T.lines(F.col("text"))).alias("line", "text")).withColumn("line", F.col("line") + 1)
    want = sorted(map(tuple, whole.collect()))
    for size in (1, 3, 16, 100, 1 << 20):
        assert sorted(map(tuple, numbered_lines(files, str(tmp_path), range_bytes=size).collect())) == want
    some = sorted(map(tuple, numbered_lines(files, str(tmp_path), 3, 7, 16).collect()))
    assert some == [r for r in want if 3 <= r[1] <= 7]


def test_a_large_file_is_many_tasks(spark, tmp_path):
    with open(tmp_path / "big", "w") as f:
        for i in range(1, 1_000_001):
            f.write(f"line {i} of it\n")
    files = spark.createDataFrame([("big", os.path.getsize(tmp_path / "big"))], "path string, size long")
    found = numbered_lines(files, str(tmp_path), range_bytes=1 << 20).withColumn("task", F.spark_partition_id())
    seen = found.agg(F.count("*").alias("n"), F.sum((F.col("text") == F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of it"))).cast("int")).alias("right"), F.countDistinct("task").alias("tasks")).first()
    assert (seen.n, seen.right) == (1_000_000, 1_000_000) and seen.tasks >= 3
    assert [r.text for r in numbered_lines(files, str(tmp_path), 777_777, 777_778, 1 << 20).orderBy("line").collect()] == ["line 777777 of it", "line 777778 of it"]


def test_commits(spark, tmp_path):
    at = str(tmp_path / "out")
    numbers = lambda a, b, parts=4: spark.range(a, b, 1, parts).select(F.col("id").cast("string").alias("value"))
    read = lambda: sorted(int(r.value) for r in committed.read_lines(spark, at).collect())
    assert committed.read_lines(spark, at).count() == 0
    committed.write_lines(numbers(0, 50), at)
    committed.write_lines(numbers(50, 60, 20), at)
    assert read() == list(range(60))
    broken = numbers(60, 1000).withColumn("value", F.when(F.col("value") == "990", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        committed.write_lines(broken, at)
    assert read() == list(range(60)) and not os.listdir(f"{at}/_pending")
    (tmp_path / "out" / "part-left-by-a-dead-driver").write_text("7\n")
    assert read() == list(range(60))
    committed.write_lines(numbers(5, 8), at, "overwrite")
    assert read() == [5, 6, 7] and len(os.listdir(f"{at}/_commits")) == 1
    assert len([n for n in os.listdir(at) if n.startswith("part-")]) == 3


def test_an_attempt_that_dies_is_not_doubled(tmp_path):
    import pyarrow as pa

    writer = committed._Writer(f"file://{tmp_path}/out", False)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None])], ["value"])

    def dies():
        yield batch
        raise OSError("killed")

    with pytest.raises(OSError, match="killed"):
        writer.write(dies())
    again = writer.write(iter([batch]))
    none = writer.write(iter([]))
    writer.commit([again, none])
    assert committed._listed(*committed._store(f"file://{tmp_path}/out")) == [f"part-{writer.job}-000000"]
    assert (tmp_path / "out" / f"part-{writer.job}-000000").read_text() == "a\n\n" and not os.listdir(tmp_path / "out" / "_pending")
    with pytest.raises(ValueError, match="reported nothing"):
        writer.commit([None])
