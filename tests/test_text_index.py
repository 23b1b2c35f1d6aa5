"""Exact search by the trigram index: the rows of the search without one, fewer groups read, the early stop."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import search, text_index
from corpusmill.operators.text_index import TextIndex
from corpusmill.plans import agent


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        lines = ["".join(rng.choice("abcdé ÉΣσß") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 12))]
        if i % 50 == 7:
            lines.append(f"100%_sure ΟΔΟΣ Needle{i} x\r")
        rows.append((f"d{i % 7}/f{i:03d}.txt", rng.choice(["\n", "\r\n"]).join(lines)))
    rows += [("d9/none", None), ("d9/empty", ""), ("d9/long", "y" * ((1 << 20) + 5) + "\nNeedle too long a line"), ("d9/dots.txt", "a.b\nneedle")]
    return spark.createDataFrame(rows, "path string, text string")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return TextIndex.build(corpus, f"file://{tmp_path_factory.mktemp('texts')}", 2000)


@pytest.mark.parametrize("case_sensitive", [False, True])
@pytest.mark.parametrize("needle", ["Needle", "NEEDLE57", "é", "ab", "%", "100%_Sure", "ΟΔΟΣ", "σ", "ß É", "nothing like this", "x\r", "a\nb", "a.b"])
def test_same_rows(corpus, index, needle, case_sensitive):
    searched = corpus.where("text is not null")
    for limit in (None, 3, 200):
        want = search.search_exact(searched, needle, case_sensitive, limit).collect()
        assert index.search(needle, case_sensitive, limit).collect() == want


def test_groups_are_skipped_and_counted(corpus, index):
    groups = index.zones.count()
    assert groups > 20
    assert index.groups("Needle57").count() == 1 and index.groups("nothing like this").count() == 0
    assert index.groups("%").count() == index.zones.where("n_texts > 0").count()
    rare = index.report("needle57").first()
    assert (len(rare.matches), rare.groups_read, rare.groups, rare.truncated, rare.files_inspected) == (1, 1, groups, False, 304)
    none = index.report("nothing like this").first()
    assert none.matches is None and none.groups_read == 0 and none.files_inspected == 304
    files = corpus.select("path", F.coalesce(F.col("text").cast("binary"), F.lit(b"\x00")).alias("content"))
    common = index.report("a", limit=5).first()
    want = search.search_report(files, "a", limit=5).first()
    assert common.groups_read <= text_index.FIRST_WAVE < groups and common.truncated
    assert [tuple(m) for m in common.matches] == [tuple(m) for m in want.matches] and common.files_inspected == want.files_inspected


def test_waves(corpus, index, monkeypatch):
    monkeypatch.setattr(text_index, "FIRST_WAVE", 1)
    monkeypatch.setattr(text_index, "LAST_WAVE", 2)
    assert index.search("needle", limit=6).collect() == search.search_exact(corpus.where("text is not null"), "needle", limit=6).collect()
    assert index.report("needle", limit=1).first().groups_read == 1


def test_groups_grow_with_the_corpus(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SMALL_GROUPS", 3)
    index = TextIndex.build(corpus, f"file://{tmp_path}/i", 2000)
    assert index.zones.count() <= 3 + 2 * 4  # each of four tasks begins one and ends one
    searched = corpus.where("text is not null")
    assert index.search("needle", limit=None).collect() == search.search_exact(searched, "needle", limit=None).collect()


def test_grams_of_many_texts(monkeypatch):
    monkeypatch.setattr(text_index, "PIECE_BYTES", 5)
    texts = ["abcdefghijklm", None, "", "é", "ab", "xyz", "q", "w", "e", "longer than a piece"]
    have = np.zeros(1 << 24, bool)
    text_index._mark(have, pa.array(["left out", *texts, "left out"]).slice(1, len(texts)))
    want = {g for t in texts if t for g in text_index._grams(t.encode()).tolist()}
    assert set(np.flatnonzero(have).tolist()) == want


def test_pushed_down(index):
    plan = index.spark.read.schema("gram int, grp long").parquet(f"{index.folder}/postings").where(F.col("gram").isin(text_index.grams_of("a needle of many grams", True)))
    assert "In(gram, " in plan._jdf.queryExecution().toString()


def test_empty(spark, tmp_path):
    index = TextIndex.build(spark.createDataFrame([], "path string, text string"), f"file://{tmp_path}/i")
    assert index.search("a").count() == 0 and index.search("abc", limit=None).count() == 0 and index.report("abc").first().files_inspected == 0


def test_files(spark, tmp_path):
    files = spark.createDataFrame([("a", b"abc"), ("b", b"\x00abc"), ("c", b"abc" * 9)], "path string, content binary")
    index = TextIndex.build(text_index.opened(files, 20), f"file://{tmp_path}/i")
    r = index.report("ABC").first()
    assert [m.path for m in r.matches] == ["a"] and r.files_inspected == 2


def test_agent_searches_through_the_index(spark, corpus, index):
    searched = corpus.where("text is not null")
    plain, indexed = (agent.registry(spark, searched, text_index=i)["search"]({"query": "needle57"}) for i in (None, index))
    assert json.loads(plain)["matches"] == json.loads(indexed)["matches"] != []


def test_a_result_is_never_cut_in_silence(spark):
    assert json.loads(agent.rows_json(spark.range(3), 3)) == [{"id": 0}, {"id": 1}, {"id": 2}]
    with pytest.raises(ValueError, match="more than 2 rows"):
        agent.rows_json(spark.range(3), 2)
