"""Near copies in lists of over 24 members: recall against all pairs; texts that fool sums of powers; long texts in stretches."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import _kernel, near_dedup


def corpus(seed):
    """Clusters whose members are near the threshold of each other, templates of which 60 to 90 in 100 are common, and loners."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 20000)}"
    texts = []
    for size in (120, 60, 40):
        base = [word() for _ in range(rng.randint(120, 300))]
        for _ in range(size):
            own = base[:]
            at = rng.randrange(len(own))
            for i in range(at, min(len(own), at + int(len(own) * rng.choice([0.01, 0.05, 0.1, 0.13, 0.16, 0.3])))):
                own[i] = word()
            texts.append(own)
    passages = [[word() for _ in range(60)] for _ in range(4)]
    for _ in range(150):
        chosen = rng.sample(passages, 3)
        texts.append([*chosen[0], *chosen[1], *chosen[2], *(word() for _ in range(rng.choice([10, 30, 60, 90])))])
    texts += [[word() for _ in range(rng.randint(1, 200))] for _ in range(60)]
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 16)])
def test_components_in_long_lists(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = corpus(seed)
    got = {r.doc_id: r.component_id for r in near_dedup.near_digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == near_dedup.brute_force(texts)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_and_sequences_that_fool_sums_of_powers(n):
    a, b = ("".join("ab"[(bin(i).count("1") & 1) ^ flip] for i in range(n)) for flip in (0, 1))
    for one, two in ((a, b), (" ".join(a), " ".join(b))):
        x, y = near_dedup.shingle_sets(pa.array([one, two]))
        assert len(set(x.tolist())) == len({tuple(one.split()[i : i + 5]) for i in range(max(1, len(one.split()) - 4))})
        assert (len(np.intersect1d(x, y)) == 0) == (" " not in one)


def test_long_texts_have_the_same_sets(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "c" * 30, "D"]) for _ in range(n)) for n in (0, 1, 3, 5, 6, 50, 400)]
    want = [s.tolist() for s in near_dedup.shingle_sets(pa.array(texts))]
    monkeypatch.setattr(_kernel, "PIECE", 20)
    assert [s.tolist() for s in near_dedup.shingle_sets(pa.array(texts))] == want
