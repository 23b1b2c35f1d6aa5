"""Merkle trees: texts without plain spaces, a plain tree beside the query's, long texts in stretches, texts that fool sums of powers, hot ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import _kernel, fingerprints


@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(0x4E00, 0x5200))), "abcdefghij(){};=", "abcdefgh\tklm\tn", "éàüößçîôûêâ"])
def test_text_without_spaces_has_leaves(alphabet):
    rng = random.Random(3)
    text = "".join(rng.choice(alphabet) for _ in range(4000))
    edited = text[:2000] + "".join(rng.choice(alphabet) for _ in range(2000))
    one = text[:1000] + "#" + text[1000:]
    trees = fingerprints.Trees([text, edited, one, "x" + text])
    a, b, c, d = (trees.fingerprint(i) for i in range(4))
    leaves = trees.first[1] - trees.first[0]
    assert 20 < leaves < 500
    assert 0.3 < fingerprints.likeness(a, b) < 0.7
    assert fingerprints.likeness(a, c) > 0.9 and fingerprints.likeness(a, d) > 0.9
    assert 1 <= sum(j - i for i, j, _, _ in fingerprints.differing(a, c)) <= 3


def plain_leaves(text):
    """Leaves by going through the bytes one by one."""
    raw, out, start = text.encode(), [], 0
    for p in range(1, len(raw)):
        cut = raw[p - 1] == 0x0A
        if p >= 6:
            h = int(_kernel.byte_grams(np.frombuffer(raw[p - 6 : p], np.uint8), 6)[0])
            cut = cut or (raw[p - 1] == 0x20 and h % fingerprints.PIECE == 0) or (raw[p] & 0xC0 != 0x80 and h % fingerprints.ANYWHERE == 0)
        if cut:
            out.append(raw[start:p])
            start = p
    return [*out, raw[start:]] if raw else []


def digest(data):
    return hashlib.blake2b(data, digest_size=16).digest()


def plain_root(text):
    sections, own = [], []
    for leaf in map(digest, plain_leaves(text)):
        own.append(leaf)
        if int.from_bytes(leaf[:8], "little") % fingerprints.SECTION == 0:
            sections.append(digest(b"".join(own)))
            own = []
    sections += [digest(b"".join(own))] if own else []
    return digest(b"".join(sections) + len(text.encode()).to_bytes(8, "little")).hex()


def plain_likeness(a, b):
    x, y = (Counter(digest(leaf)[:4] for leaf in plain_leaves(t)) for t in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 1.0


def test_query_against_a_plain_tree(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "dog", "é😀", "jumps", "over", "lazy\n", "日本語", f"w{rng.randint(0, 99)}"])
    texts = {i: " ".join(word() for _ in range(rng.choice([0, 1, 3, 30, 300]))) for i in range(60)} | {60: None}
    for i in range(1, 60, 4):
        texts[i] = texts[i - 1]
    got = {r.doc_id: r for r in fingerprints.fingerprints_with_next(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    ids = sorted(texts, reverse=True)
    for i, after in zip(ids, [*ids[1:], *ids[:1]], strict=True):
        text, following = texts[i] or "", texts[after] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint.split(".")[0], got[i].edited_fingerprint.split(".")[0]) == (plain_root(text), plain_root(edited))
        assert got[i].near_edited == pytest.approx(plain_likeness(text, edited)) and got[i].near_next == pytest.approx(plain_likeness(text, following))
        assert fingerprints.likeness(got[i].fingerprint, got[i].edited_fingerprint) == pytest.approx(got[i].near_edited)


@pytest.mark.parametrize("piece", [7, 33, 100])
def test_long_texts_have_the_same_trees(monkeypatch, piece):
    rng = random.Random(piece)
    texts = ["".join(rng.choice("ab cé\n日 ") for _ in range(n)) for n in (0, 1, 5, 6, 7, 8, 40, 300, 900)]
    want = fingerprints.Trees(texts)
    want = [want.fingerprint(i) for i in range(len(texts))]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    monkeypatch.setattr(_kernel, "PIECE", piece)
    for cut in (0, 3, 50):
        trees = fingerprints.Trees([[r[:cut], r[cut:]] for r in raw])
        assert [trees.fingerprint(i) for i in range(len(texts))] == want
    assert [fingerprints._characters(r) for r in raw] == [len(t) for t in texts]
    assert all(fingerprints._place(r, k) == len(t[:k].encode()) for r, t in zip(raw, texts, strict=True) for k in (0, 1, 7, 20, 2000))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_texts_that_fool_sums_of_powers(n):
    for join in ("", " ", "\n"):
        one, two = (join.join("ab"[(bin(i).count("1") & 1) ^ flip] for i in range(n)) for flip in (0, 1))
        trees = fingerprints.Trees([one, two, one])
        a, b, c = (trees.fingerprint(i) for i in range(3))
        assert a == c and a.split(".")[0] != b.split(".")[0]


def test_many_rows_of_one_id_go_to_several_buckets():
    bounds = fingerprints._bounds([5, 5, 5, 5, 9])
    assert [k for k, _ in bounds] == [5, 5, 5, 5, 9] and len({t for k, t in bounds if k == 5}) == 4
