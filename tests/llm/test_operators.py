"""Each operator against brute force, on odd rows and on an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import _kernel, chat, components, decontamination, fingerprints, mixing, near_dedup, quality, sharding, substring_dedup, suffix_dedup, token_output
from corpusmill.llm._common import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_tokens(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for df in odd:
        folder = new_folder(spark, "test")
        index = token_output.write_tokens(df, folder, path, files=3)
        got = sorted(token_output.read_tokens(spark, folder, index).collect(), key=lambda r: r.start)
        rows = sorted(texts_of(df), key=lambda x: (x[0] is not None, x[0] or 0))
        assert [r.doc_id for r in got] == [i for i, _ in rows]
        at = 0
        for r, (_, text) in zip(got, rows, strict=True):
            ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4")))
            at += len(ids)
        shuffled = token_output.read_shuffled(spark, folder, index, 3).collect()
        assert Counter((r.doc_id, len(r.ids)) for r in shuffled) == Counter((r.doc_id, r.n_tokens) for r in got)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|turn|>x\\<|end|>"), (1, 2, None, None), (None, 0, "assistant", "\n é😀"), (2, None, "user", ""), (2, 1, "assistant", None), (2, 1, "assistant", "<|endoftext|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digest(spark, df).collect()}
    want = defaultdict(list)
    for c, t, r, x in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(said))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.chat_digest(spark, df.limit(0)).count() == 1


def test_conversations_are_encoded_as_the_tokenizer_does(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(7)
    atoms = [" ", "  ", "\n", "the", "don't", "12", ".", "é", "日本", "😀", "x" * 30, "<|endoftext|>", "<|turn|>", "<|", "|>", "\\", "\t", "\u00a0", "\u3000", "<|end|>"]
    rows = [(c, rng.choice(["user", "assistant", "tool\n<|text|>", ""]), "".join(rng.choice(atoms) for _ in range(rng.choice([0, 1, 5, 40])))) for c in range(30) for _ in range(rng.randint(1, 6))]
    batch = pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in rows]), pa.array([r for _, r, _ in rows]), pa.array([t for _, _, t in rows])], ["conv_id", "role", "text"])
    want = [r for b in chat._conversations([batch], path, "assistant") for r in b.to_pylist()]
    assert [r["conv_id"] for r in want] == list(range(30))
    for r in want:
        turns = [(role, text) for c, role, text in rows if c == r["conv_id"]]
        whole = chat.tokenizer(path).encode(r["formatted"], add_special_tokens=False)
        assert r["ids"] == whole.ids and chat.parse(r["formatted"]) == turns
        assert chat.encoder(path).offsets(np.array(r["ids"]), r["formatted"]).tolist() == [list(x) for x in whole.offsets]
        rendered, spans = chat.render(turns)
        assert "".join(rendered) == r["formatted"] and r["mask"] == [any(x < b and y > a for a, b in spans) for x, y in whole.offsets]
    monkeypatch.setattr(chat, "BATCH", 10)
    monkeypatch.setattr(_kernel, "PIECE", 16)
    assert [r for b in chat._conversations([batch.slice(0, 7), batch.slice(7)], path, "assistant") for r in b.to_pylist()] == want


def test_mix(spark, odd):
    for df in odd:
        got = mixing.mix(df, block=16).collect()
        sizes = Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in df.collect())
        assert Counter((r.id, r["size"]) for r in got) == sizes
        by = defaultdict(list)
        for r in got:
            by[r.source].append(r)
            assert 0 <= r.taken <= 3 * r["size"]
        for rows in by.values():
            assert {r.source_size for r in rows} == {sum(r["size"] for r in rows)}
            assert sum(r.taken for r in rows) == min(int(rows[0].target), 3 * rows[0].source_size)
        if got:
            assert sum(rows[0].target for rows in by.values()) == pytest.approx(sum(r["size"] for r in got))
            key = lambda r: (r.key, str(r.id), r.taken, tuple(r.slots))
            assert Counter(map(key, mixing.mix(df, block=16).collect())) == Counter(map(key, got))


def test_schedule_spreads_sources(spark):
    s = spark.createDataFrame([(0, 300, 0, 7), (1, 100, 300, 3), (2, 100, 400, 200)], "s long, slots long, edge long, blocks long")
    rows = mixing.schedule(spark, s, 500).orderBy("t").collect()
    assert [r.t for r in rows] == list(range(500)) and Counter(r.s for r in rows) == {0: 300, 1: 100, 2: 100}
    for i in range(0, 500, 50):
        assert abs(sum(r.s == 0 for r in rows[i : i + 50]) - 30) <= 5
    assert all(sorted(r["rank"] for r in rows if r.s == k) == list(range(n)) for k, n in ((0, 300), (1, 100), (2, 100)))


def test_fingerprints(spark, odd):
    for df in odd:
        rows = sorted(texts_of(df), key=lambda x: (x[0] is None, -(x[0] or 0)))
        got = fingerprints.fingerprints_with_next(df).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        for (i, text), (_, after) in zip(rows, [*rows[1:], *rows[:1]], strict=True):
            if i != 6:
                text, after = text or "", after or ""
                half = len(text) // 2
                edited = text[: len(text) - half] + after[:half]
                assert [(r.n_chars, r.edited_sha256) for r in got if r.doc_id == i] == [(len(text), hashlib.sha256(edited.encode()).hexdigest())]
    long = "\n".join(f"paragraph {i} with some words in it" for i in range(200))
    a, b = fingerprints.Trees([long, long.replace("paragraph 77 ", "changed "), long]), None
    f = [a.fingerprint(i) for i in range(3)]
    assert f[0] == f[2] != f[1] and 0.9 < fingerprints.likeness(f[0], f[1]) < 1 and fingerprints.differing(f[0], f[2]) == []
    assert len(fingerprints.differing(f[0], f[1])) == 1


def brute_bytes(rows, n):
    out = {}
    for k, (i, text) in enumerate(rows):
        own, hit = (text or "").encode(), set()
        earlier = [(t or "").encode() for j, t in rows if (j if j is not None else -1) < (i if i is not None else -1)]
        for p in range(len(own) - n + 1):
            if any(own[p : p + n] in e for e in earlier):
                hit.update(range(p, p + n))
        out[k] = (i, len(own), len(hit), sum(p - 1 not in hit for p in hit), bytes(b for p, b in enumerate(own) if p not in hit))
    return out


def brute_words(rows, n):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[p : p + n]) for w in words for p in range(len(w) - n + 1))
    out = {}
    for k, w in enumerate(words):
        hit = {q for p in range(len(w) - n + 1) if count[tuple(w[p : p + n])] > 1 for q in range(p, p + n)}
        out[k] = (rows[k][0], len(w), len(hit), " ".join(x for p, x in enumerate(w) if p not in hit))
    return out


def test_copies_share_an_id_with_another_text(spark):
    text, other = "the first text is here and is long", "another text of that length, all its own"
    rows = [(1, text), (2, text), (2, other), (2, text), (3, other[:30] + "x"), (None, other)]
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 20, 6).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter(brute_bytes(rows, 20).values())


def small_corpus(seed):
    rng = random.Random(seed)
    pieces = [" ".join(rng.choice("ab cé d") for _ in range(rng.randint(1, 40))) for _ in range(8)]
    return [(i if rng.random() < 0.95 else None, None if rng.random() < 0.05 else " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))) for i in range(40)]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed):
    rows = small_corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeated_bytes(df, 20, 6).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter(brute_bytes(rows, 20).values())
    got = substring_dedup.remove_repeated_words(df, 9, 3).collect()
    assert Counter(map(tuple, got)) == Counter(brute_words(rows, 9).values())


def test_repeats_on_odd_rows(spark, odd):
    df, empty = odd
    rows = texts_of(df)
    got = substring_dedup.remove_repeated_words(df).collect()
    assert Counter(map(tuple, got)) == Counter(brute_words(rows, 35).values())
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(df).collect()}
    assert {(i, n, k) for i, n, k, *_ in brute_bytes([(i, t) for i, t in rows if t is None or len(t) < 5000], 50).values()} <= got
    assert next(k for i, _, k in got if i == 5) == len(rows[4][1]) and next(k for i, _, k in got if i == 4) == 0
    assert substring_dedup.remove_repeated_words(empty).count() == 0 == suffix_dedup.remove_repeated_bytes(empty).count()


@pytest.mark.parametrize("short_list", [24, 1])
def test_near_copies(spark, monkeypatch, short_list):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short_list)
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 5000)}"
    base, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    texts = {0: None, 1: "", 2: "a b", 3: "A b", 4: " \n"}
    for i in range(5, 60):
        copy = base[:]
        for _ in range(rng.choice([0, 1, 3, 6, 9, 20])):
            copy[rng.randrange(200)] = word()
        texts[i] = " ".join(copy)
    for i in range(60, 100):
        texts[i] = " ".join([*(word() for _ in range(rng.choice([5, 20, 60]))), *passage])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_digest(df).collect()}
    want = near_dedup.brute_force(texts)
    assert {i: got[i].component_id for i in texts} == want and want[3] == 2
    assert {i for i in texts if got[i].kept} == {i for i, c in want.items() if i == c}
    assert {r.doc_id for r in near_dedup.drop_near_copies(df).collect()} == {i for i, c in want.items() if i == c}


def test_near_on_odd_rows(spark, odd):
    df, empty = odd
    got = {r.doc_id: r for r in near_dedup.near_digest(df).collect()}
    assert (got[4].component_id, got[5].component_id, got[6].component_id) == (4, 4, 4) and got[2].n_shingles == 0 and got[2].kept and got[None].kept
    assert near_dedup.near_digest(empty).count() == 0
    assert near_dedup.drop_near_copies(df).columns == df.columns


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(components.components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shards(spark, odd):
    for df in odd:
        rows = sharding.shard_digest(df).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts_of(df))
        slots = defaultdict(list)
        for r in rows:
            assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_against_a_full_sort(spark):
    rng = random.Random(9)
    texts = [f"text {rng.randint(0, 300)} " * rng.choice([1, 3, 9, 40]) for _ in range(1500)] + [None, ""] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_digest(df).collect()
    shard, slot = {r.doc_id: r.shard for r in rows}, {r.doc_id: r.slot for r in rows}
    key = {r.doc_id: (r.h, r.doc_id) for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    order = sorted(key, key=key.get)
    size = {i: len((texts[i] or "").encode()) + 1 for i in key}
    assert [shard[i] for i in order] == sorted(shard.values())  # shards are runs of the sorted rows
    total, most = sum(size.values()), max(1, int(sum(size.values()) / 16 * 0.001))
    at, below = {}, 0
    for i in order:
        at.setdefault(shard[i], below)
        below += size[i]
    groups = Counter()  # a splitter is off its target by the tolerance, or by the row or the group of copies that it may not divide
    for i in order:
        groups[key[i][0]] += size[i]
    assert all(abs(at[k] - total * k // 16) <= max(most, max(groups.values())) for k in range(16))
    for k in range(16):
        own = [i for i in order if shard[i] == k]
        assert [slot[i] for i in own] == list(range(len(own)))
    together = defaultdict(set)
    for i in order:
        together[texts[i]].add(shard[i])
    assert sum(len(s) > 1 for s in together.values()) <= 15 and all(len(s) == 1 for t, s in together.items() if groups[key[texts.index(t)][0]] <= most)


def test_shards_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "_h", "_i", "_size", "h", "i", "size", "row", "range", "rank", "base", "copies", "a.b", "Shard"]
    df = spark.createDataFrame([(i, f"t{i}", *range(i, i + 13)) for i in range(40)], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    out = sharding.shard(df, 4)
    assert out.columns == [*names[:-1], "shard", "slot"]
    assert Counter(tuple(r)[:14] for r in out.collect()) == Counter(tuple(r)[:14] for r in df.collect())


def test_shards_are_even_despite_a_giant_group(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = sharding.shard(df, 8).withColumn("n", F.octet_length("text") + 1)
    sizes = [r["sum(n)"] for r in out.groupBy("shard").agg(F.sum("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8


@pytest.mark.parametrize("ranges", [None, 3])
def test_shards_are_even_despite_rows_alike_in_id_and_text(spark, ranges):
    df = spark.range(4000).select(F.when(F.col("id") >= 2000, F.col("id")).alias("doc_id"), F.when(F.col("id") < 2000, F.lit("the same.")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.col("id").alias("other"))
    rows = sharding.shard(df, 16, ranges_per_shard=ranges).collect()
    assert sorted(r.other for r in rows) == list(range(4000))
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += len(r.text) + 1
        slots[r.shard].append(r["slot"])
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_long_items_are_cut_into_overlapping_pieces(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 60)}" for _ in range(900)]
    items = [("long", " ".join(words[:400])), ("short", "w1 w2"), ("twelve", " ".join(words[500:512])), (None, None), ("edge", " ".join(words[600:650]))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(i, " ".join(words[i * 7 : i * 7 + rng.choice([12, 13, 40])])) for i in range(120)], "doc_id long, text string")
    want = sorted(map(repr, decontamination.contamination_digest(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 50)
    blocks = list(decontamination.automata(benchmark))
    assert max(len(b.length) for b in blocks) <= 2 * 50 + 1 and len(blocks) > 8
    assert sorted(map(repr, decontamination.contamination_digest(docs, benchmark).collect())) == want


def test_quality(spark, odd):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{rng.randint(0, 999)}"]) for _ in range(60)) + "." for _ in range(150)]
    bad = ["$$$ ### " * rng.randint(5, 40) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") < 150).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int"))
    rows = quality.quality_digest(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == (r.doc_id < 150) for r in rows if r.held_out]) > 0.97
    model = quality.fit(df, labels)
    assert model.scores(quality.statistics(pa.array([good[0], bad[0]])))[0] > 0.5
    assert quality.keep_good(odd[0], model).columns == odd[0].columns
    assert {r.score for r in quality.quality_digest(odd[0], labels.limit(0)).collect()} == {0.5} and quality.quality_digest(odd[1], labels).count() == 0


def test_quality_on_held_out_rows_of_the_tables(spark):
    """AUC and accuracy of documents that were never learnt from."""
    at = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{at}/documents.parquet").where(F.col("doc_id").isin(list(labels)))
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in quality.quality_digest(docs, spark.read.parquet(f"{at}/labels.parquet")).collect() if r.held_out and labels[r.doc_id] is not None]
    good, bad = [s for s, _, y in rows if y == 1], [s for s, _, y in rows if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(rows) > 100 and auc > 0.99 and np.mean([p == y for _, p, y in rows]) > 0.97


def test_quality_of_repeated_and_contradicting_labels(spark):
    rows = [(i, f"good text number {i}." if i % 2 else "### $$$ " * i) for i in range(1, 60)] + [(7, "another text"), (7, "good text number 7."), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(7, 0), (7, 1), (7, None), (None, 1)], "doc_id long, quality int")
    models = [quality.fit(d, labels) for d in (df, df.repartition(7))]
    assert np.allclose(models[0].weights, models[1].weights) and models[0].threshold == models[1].threshold


def test_decontamination(spark, odd):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "cé", "d1"]) for _ in range(n))
    items = {i: text(rng.randint(0, 9)) for i in range(6)} | {6: None, 7: "!!"}
    docs = {i: text(rng.randint(0, 40)) for i in range(80)} | {80: None, 81: ""}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = {i: decontamination.brute_force(t, items) for i, t in docs.items()}
    assert {r.doc_id: tuple(r)[1:] for r in decontamination.contamination_digest(df, bench).collect()} == want
    for block in (3, 10):
        decontamination.BLOCK_WORDS, before = block, decontamination.BLOCK_WORDS
        try:
            got = {r.doc_id: tuple(r)[1:] for r in decontamination.contamination_digest(df, bench).collect()}
        finally:
            decontamination.BLOCK_WORDS = before
        assert got == want
    kept = {r.doc_id for r in decontamination.remove_spans(df, bench).collect()}
    assert kept == {i for i, w in want.items() if not w[4]}
    names = ("row", "n_words", "spans", "items", "_row")
    more = df.select("doc_id", *[F.col("doc_id").alias(n) for n in names], "text")
    decontamination.BLOCK_WORDS, before = 3, decontamination.BLOCK_WORDS  # several blocks, and other columns with their names
    try:
        cut = decontamination.remove_spans(more, bench, max_span=2)
        assert cut.columns == more.columns
        cut = {r.doc_id: r for r in cut.collect()}
    finally:
        decontamination.BLOCK_WORDS = before
    assert set(cut) == kept and all(r[n] == i for i, r in cut.items() for n in names)
    assert {i: r.text for i, r in cut.items()} == {r.doc_id: r.text for r in decontamination.remove_spans(df, bench, max_span=2).collect()}
    assert decontamination.contamination_digest(odd[0], bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination_digest(odd[1], bench).count() == 0
