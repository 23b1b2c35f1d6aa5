"""Near copies among rows with null and repeated ids."""

import random

import pytest

from corpusmill.llm import near_dedup


@pytest.mark.parametrize("short_list", [24, 1])
@pytest.mark.parametrize("size", [30, 200])
def test_near_copies_with_null_and_repeated_ids(spark, monkeypatch, short_list, size):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short_list)
    rng = random.Random(5)

    def text():
        return [f"w{rng.randint(0, 9999)}" for _ in range(size)]

    def near(words):
        return " ".join([*words[:-1], f"x{rng.randint(0, 9999)}"])

    x, y, z, u = text(), text(), text(), text()
    rows = [(1, near(x)), (2, near(y)), (None, near(x)), (None, near(y)), (None, " ".join(z)), (None, near(z)), (7, " ".join(u)), (7, near(x)), (9, near(u)), (None, "alone on its own here"), (7, " ".join(u))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in near_dedup.drop_near_copies(df).collect()]
    assert {rows[0], rows[1]} <= set(kept) and kept.count(rows[6]) == 2 and rows[9] in kept  # b is like no other kept document
    assert not {rows[2], rows[3], rows[7], rows[8]} & set(kept) and len({rows[4], rows[5]} & set(kept)) == 1
    digest = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_digest(df).collect()]
    want = [(1, 1, True), (2, 2, True), (None, 1, False), (None, 2, False), (None, None, True), (None, None, False), (7, 7, True), (7, 7, True), (7, 1, False), (9, 7, False), (None, None, True)]
    assert sorted(map(repr, digest)) == sorted(map(repr, want))
