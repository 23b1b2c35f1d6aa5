"""The pipeline's stages on a small corpus, each against what it must keep."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import decontamination, mixing, near_dedup, quality

SF = "/root/testdata/sf0.001"


def _kept(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at, before = docs.columns, docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = at.collect()
        before = {r.doc_id: r for r in rows}
        at = _kept(spark, stage(spark, at, SF))
        got = at.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns
        if name == "quality_classifier":
            model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r.doc_id for r in got} == {r.doc_id for r in quality.score(docs, model).where("score >= 0.5").collect()}
        elif name == "near_dedup":
            want = near_dedup.brute_force({i: r.text for i, r in before.items()})
            assert {r.doc_id for r in got} == {i for i, c in want.items() if i == c}
        elif name == "decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
            assert {r.doc_id for r in got} == {i for i, r in before.items() if not decontamination.brute_force(r.text, items)[4]}
        elif name == "source_mix":
            mixed = mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()
            assert Counter(r.doc_id for r in got) == Counter({r.id: int(r.taken / r["size"] + 0.5) for r in mixed if r["size"] and int(r.taken / r["size"] + 0.5)})
        else:
            assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
            slots = defaultdict(list)
            for r in got:
                slots[r.shard].append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, ties, repeated rows, an empty table, and columns named like internal ones: what each stage keeps."""
    names = ("id", "copies", "key", "size", "_id", "_h", "_copy", "row", "shard", "dropped_id", "n_words", "mix_key", "slots", "ref", "score")
    df, empty = (x.drop("id").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]) for x in odd)
    at = str(tmp_path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    rows = df.collect()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0
        out = stage(spark, df, at)
        got = out.collect()
        assert all(r[n] == i for r in got for i, n in enumerate(names) if n != "shard")
        kept = Counter((r.doc_id, r.text, r.source) for r in got)
        every = Counter((r.doc_id, r.text, r.source) for r in rows)
        if name == "quality_classifier":
            model = quality.fit(df, spark.read.parquet(f"{at}/labels.parquet"))
            want = Counter((r.doc_id, r.text, r.source) for r, s in zip(rows, model.scores(quality.statistics(pa.array([r.text for r in rows], pa.string()))), strict=True) if s >= 0.5)
            assert kept == want
        elif name == "near_dedup":  # 4, 5 and both 6 are near copies
            assert kept == Counter({k: n for k, n in every.items() if k[0] not in (5, 6)})
        elif name == "decontamination":
            assert kept == Counter({k: n for k, n in every.items() if k[0] != 1})
        elif name == "source_mix":
            mixed = mixing.mix(df).collect()
            want = Counter()
            for r in rows:
                own = [int(m.taken / m["size"] + 0.5) if m["size"] else 0 for m in mixed if m.id == r.doc_id and m.source == r.source]
                want[(r.doc_id, r.text, r.source)] += round(sum(own) / len(own))
            assert kept == +want and not any((r.text or "").strip() == "" for r in got)
        else:
            assert kept == every and out.columns[-2:] == ["shard", "slot"]
        if name != "sharding":
            assert out.columns == df.columns
    assert 1 not in {r.doc_id for r in corpus_pipeline.decontaminate(spark, df, at).collect()}


def test_mix_comes_in_the_order_of_the_schedule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs)
    slots = {r.id: r.slots for r in mixed.collect()}
    out = mixing.repeated(docs, mixed).withColumn("p", F.spark_partition_id()).select("p", "doc_id").collect()
    want = sorted(x for i, s in slots.items() for x in _copies(s, i, out))
    got, seen = [], Counter()
    for r in out:
        own = slots[r.doc_id]
        got.append((own[min(seen[r.doc_id], len(own) - 1)], r.doc_id))
        seen[r.doc_id] += 1
    assert [t for t, _ in got] == [t for t, _ in want] and sorted(got) == want


def _copies(slots, doc_id, out):
    n = sum(r.doc_id == doc_id for r in out)
    return [(slots[min(k, len(slots) - 1)], doc_id) for k in range(n)]
