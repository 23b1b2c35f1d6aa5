"""The listing source: balanced parts in walk order, and changes as a stream."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import index as I
from corpusmill.sources import files
from corpusmill.sources.paths import Root
from corpusmill.streaming import streams


def make(root, *paths):
    for p in paths:
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(p)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    make(root, *(f"big/f{i:04d}" for i in range(700)), *(f"d{i}/e{j}/x{k}" for i in range(5) for j in range(4) for k in range(3)), "a", "d0.txt", "d0/z", ".hidden", "node_modules/x", "é/ß", "deep/1/2/3/4/5/6")
    os.makedirs(root / "empty")
    os.symlink("/etc", root / "out")
    os.symlink("a", root / "in")
    return root


def plain(root, most=None):
    """The whole walk from each entry of the root."""
    r = Root(str(root))
    return [e for name in sorted(os.listdir(root), key=os.fsencode) for e in files.walk(r, name, 1, most, frozenset(files.SKIPPED))]


@pytest.mark.parametrize("want", [1, 3, 8, 64, 5000])
@pytest.mark.parametrize("most", [None, 0, 1, 2])
def test_parts_are_the_whole_walk_in_order(tree, monkeypatch, want, most):
    monkeypatch.setattr(files, "RUN", 50)
    root, skipped = Root(str(tree)), frozenset(files.SKIPPED)
    parts = files.frontier(root, most, skipped, want)
    got = [e for p in parts for e in files.listed(root, p, most, skipped)]
    assert got == ([] if most == 0 else plain(tree, most))
    if most is None and want == 8:
        sizes = [len(list(files.listed(root, p, most, skipped))) for p in parts]
        assert max(sizes) < 260 and len(parts) >= 6
    firsts = [p[0].first() for p in parts if p]
    assert firsts == sorted(firsts)


def test_a_large_folder_uses_all_tasks(spark, tmp_path):
    root = tmp_path / "one"
    os.makedirs(root / "only")
    for i in range(20_000):
        open(f"{root}/only/f{i:06d}", "w").close()
    e = files.entries(spark, str(root), parts=16)
    sizes = [r["count"] for r in e.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 14 and max(sizes) <= 2 * 20_001 / 16
    assert [r.path for r in e.select("path").collect()] == ["only", *(f"only/f{i:06d}" for i in range(20_000))]


def test_changes(spark, tmp_path, monkeypatch):
    root, snapshots = tmp_path / "root", str(tmp_path / "snapshots")
    make(root, *(f"d{i % 3}/f{i:02d}" for i in range(40)), "gone/x", "gone/y", "late", "a")

    def batch(parts):
        out, seen = str(tmp_path / "out"), set()
        if os.path.exists(out):
            seen = {tuple(r) for r in spark.read.parquet(out).select("path", "change", "size", "at").collect()}
        stream = files.changes(spark, str(root), snapshots, parts=parts).withColumn("at", F.unix_micros("modified_at"))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        rows = [tuple(r) for r in spark.read.parquet(out).select("path", "change", "size", "at").collect()]
        assert len(rows) == len(set(rows))
        return sorted((p, c) for p, c, _, _ in set(rows) - seen)

    assert batch(4) == sorted((p, "added") for p in [*(f"d{i % 3}/f{i:02d}" for i in range(40)), "gone/x", "gone/y", "late", "a"])
    assert batch(2) == []  # a restart repeats nothing
    shutil.rmtree(root / "gone")
    os.remove(root / "a")
    make(root, "d1/new", "zz/last")
    os.utime(root / "late", (5, 5))
    assert batch(7) == [("a", "removed"), ("d1/new", "added"), ("gone/x", "removed"), ("gone/y", "removed"), ("late", "changed"), ("zz/last", "added")]
    shutil.rmtree(root)
    os.makedirs(root)
    assert {c for _, c in batch(3)} == {"removed"} and batch(3) == []
    assert len(os.listdir(snapshots)) <= 2


def test_an_index_follows_a_folder(spark, tmp_path):
    root = tmp_path / "root"
    make(root, *(f"d/f{i}" for i in range(6)))
    index = I.Index(spark, f"file://{tmp_path}/index", "m")
    read_paths = []

    def read(changed):
        read_paths.append(sorted(r.path for r in changed.collect()))
        return changed.select("path", F.lit(1).alias("chunk_index"), F.lit(1).alias("total"), F.lit("").alias("section"), F.lit(1).cast("long").alias("tokens"), F.col("path").alias("text"), F.array(F.lit(1.0).cast("float")).alias("embedding"))

    def follow(now):
        stream = files.changes(spark, str(root), str(tmp_path / "snapshots"), parts=4)
        listed = stream.select("path", F.unix_millis("modified_at").alias("mtime_ms"), "size", "change")
        streams.keep_index(listed, index, read, lambda: now, str(tmp_path / "cp")).awaitTermination()

    follow(1)
    os.utime(root / "d" / "f2", (9, 9))
    os.remove(root / "d" / "f3")
    make(root, "d/g")
    follow(2)
    follow(3)
    assert read_paths == [[f"d/f{i}" for i in range(6)], ["d/f2", "d/g"]]
    assert {r.path: r.last_access for r in index.files().collect()} == {"d/f0": 1, "d/f1": 1, "d/f2": 2, "d/f4": 1, "d/f5": 1, "d/g": 2}
