"""The index as a log of commits: two writers, failures at each step, checkpoints, bucketed chunks, uses logged at any moment."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import index as I

K = "path string, chunk_index int, total int, section string, tokens long, text string"

def listed(spark, *paths, mtime=1, size=9):
    return spark.createDataFrame([(p, mtime, size) for p in paths], "path string, mtime_ms long, size long")

def chunks(spark, text, *paths, n=1):
    return spark.createDataFrame([(p, i + 1, n, "", 1, f"{text} {p} {i + 1}") for p in paths for i in range(n)], K).withColumn("embedding", F.array(F.lit(1.0).cast("float")))

def texts(index):
    return sorted(r.text for r in index.chunks().collect())

@pytest.fixture
def index(spark, tmp_path):
    return I.Index(spark, f"file://{tmp_path}/index", "m")

def interrupt(index, step, times=1):
    """Runs step just before the index's next commits."""
    left, put = [times], index._put

    def late(at, said):
        if "/log/" in at and left[0]:
            left[0] -= 1
            step()
        return put(at, said)

    index._put = late

def test_one_bucket_is_several_tasks_work(spark, index):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.upsert(listed(spark, *"abcdefgh", size=1), chunks(spark, "one", *"abcdefgh"), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index._all_chunks().select(F.input_file_name()).distinct().count() > 1
    assert texts(index) == [f"one {c} 1" for c in "abcdefgh"] and index.chunk("c", 1).count() == 1

def test_two_writers(spark, index):
    other = I.Index(spark, index.top, "m")
    index.upsert(listed(spark, "a", "b"), chunks(spark, "one", "a", "b"), 1)
    interrupt(index, lambda: other.upsert(listed(spark, "b", "c", mtime=5), chunks(spark, "theirs", "b", "c"), 2))
    index.upsert(listed(spark, "a", "b", "d", mtime=3), chunks(spark, "mine", "a", "b", "d"), 3)
    assert texts(index) == texts(other) == ["mine a 1", "mine d 1", "theirs b 1", "theirs c 1"]
    # eviction is computed again for what came between
    interrupt(index, lambda: other.upsert(listed(spark, "e", mtime=9), chunks(spark, "late", "e"), 9), 2)
    index.evict(2 * (I.ENTRY_BYTES + 12))
    assert sorted(r.path for r in index.files().collect()) == ["d", "e"] or len(index.files().collect()) == 2
    assert "late e 1" in texts(index)

def test_failures_at_each_step_leave_nothing(spark, index, monkeypatch):
    index.upsert(listed(spark, "a"), chunks(spark, "one", "a"), 1)
    for step in ("_write_chunks", "_write_delta", "_put"):
        done = getattr(I.Index, step)

        def fails(self, *args, done=done, step=step):
            if step != "_put":
                done(self, *args)
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(I.Index, step, fails)
            with pytest.raises(OSError, match="lost"):
                index.upsert(listed(spark, "a", "b", mtime=2), chunks(spark, step, "a", "b"), 2)
        assert texts(index) == ["one a 1"] and index.files().count() == 1
    index.vacuum()  # young data of no commit may be another writer's
    assert len(index._names(f"{index.folder}/chunks")) == 4
    monkeypatch.setattr(I, "GRACE_MS", -1)
    index.vacuum()
    assert len(index._names(f"{index.folder}/chunks")) == 1 and texts(index) == ["one a 1"]
    index.upsert(listed(spark, "a", "b", mtime=2), chunks(spark, "again", "a", "b"), 3)
    assert texts(index) == ["again a 1", "again b 1"]

def test_checkpoints(spark, index, monkeypatch):
    monkeypatch.setattr(I, "CHECKPOINT_EVERY", 2)
    want = {}
    for i in range(7):
        path = f"p{i % 3}"
        index.upsert(listed(spark, path, mtime=i + 1), chunks(spark, str(i), path), i)
        want[path] = f"{i} {path} 1"
        index.touch(listed(spark, "p0"), 100 + i)
        assert texts(index) == sorted(want.values())
    assert {r.path: r.last_access for r in index.files().collect()} == {"p0": 106, "p1": 4, "p2": 5}
    assert len(index._numbers("checkpoints")) == 2 and len(index._names(f"{index.folder}/tables")) == 2
    assert len(index._numbers("log")) <= 4 and len(index._names(f"{index.folder}/deltas")) == len(index._numbers("log"))
    assert len(index._names(f"{index.folder}/access")) < 7
    assert I.Index(spark, index.top, "m").files().count() == 3
    index.evict(I.ENTRY_BYTES + 20)
    assert [r.path for r in index.files().collect()] == ["p0"] and texts(index) == [want["p0"]]

def test_a_use_logged_during_a_checkpoint_counts(spark, index, monkeypatch):
    monkeypatch.setattr(I, "CHECKPOINT_EVERY", 1)
    index.upsert(listed(spark, "a"), chunks(spark, "one", "a"), 1)
    other = I.Index(spark, index.top, "m")
    interrupt(index, lambda: other.touch(listed(spark, "a"), 50))
    index.upsert(listed(spark, "b"), chunks(spark, "one", "b"), 2)
    assert {r.path: r.last_access for r in index.files().collect()} == {"a": 50, "b": 2}

def test_one_chunk_is_in_one_bucket(spark, index, monkeypatch):
    monkeypatch.setattr(I, "BUCKET_BYTES", 100)
    monkeypatch.setattr(I, "BUCKET_ROWS", 10)
    paths = [f"f{i}" for i in range(60)]
    index.upsert(listed(spark, *paths, size=20), chunks(spark, "x", *paths, n=2).unionByName(chunks(spark, "long", "hot", n=55)), 1)
    files = index._all_chunks().inputFiles()
    one = index.chunk("f7", 2)
    assert [r.text for r in one.collect()] == ["x f7 2"] and len({f.rsplit("/", 1)[0] for f in one.inputFiles()}) == 1
    assert len({f.rsplit("/", 1)[0] for f in files}) > 8 and len(one.inputFiles()) < len(files) / 4
    assert "EqualTo(path,f7)" in one._jdf.queryExecution().toString()
    assert index.chunk("f7", 3).count() == 0 == index.chunk("none", 1).count()

def test_budget(spark, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}/small", "m", budget=2 * I.ENTRY_BYTES + 40)
    for i, path in enumerate("abc"):
        index.upsert(listed(spark, path), chunks(spark, "x", path), i)
    assert sorted(r.path for r in index.files().collect()) == ["b", "c"] and texts(index) == ["x b 1", "x c 1"]
