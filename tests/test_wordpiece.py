"""Pieces of many texts at once are those of one word at a time."""

import random

import numpy as np
import pytest

from corpusmill.functions import embedding as E


def same(pieces, texts):
    flat, sizes = pieces.batch(texts)
    want = [pieces.ids(t) for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("prefix", ["##", "", "é"])
def test_random_vocabularies(prefix):
    rng = random.Random(len(prefix))
    for _ in range(40):
        letters = "abé日#İ"
        tokens = {"[UNK]", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(25)), *(prefix + "".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(25)), ".", "##"}
        vocabulary = {t: i for i, t in enumerate(sorted(tokens))}
        pieces = E.WordPiece(vocabulary, prefix=prefix, max_chars=rng.choice([3, 100]), lowercase=rng.random() < 0.5)
        same(pieces, ["".join(rng.choice("abé日#İAB. \n\t! ") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(20)])
    same(E.WordPiece({}), ["a b", ""])
    same(E.WordPiece({"a": 3}), [])


def test_a_real_vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    vocabulary = {n[1:] if n.startswith("▁") and len(n) > 1 else f"##{n}": i for i, n in enumerate(names)}
    assert len(vocabulary) > 30_000 and sum(n.startswith("##") for n in vocabulary) > 5_000
    rng = random.Random(5)
    words = [n.strip("▁") for n in names if n.strip("▁")]
    texts = ["".join(rng.choice(words) + rng.choice(["", "", " ", ".", "\n"]) for _ in range(rng.choice([3, 300]))) for _ in range(60)]
    same(E.WordPiece(vocabulary, "##<unk>"), texts)


def test_long_texts_are_summed_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = {w: i for i, w in enumerate(["[UNK]", "a", "b", "##a", "##b", "c"])}
    texts = ["ab ba c x " * 50, "", "a", "abab " * 9]
    whole = E.StaticModel(E.WordPiece(vocabulary), rng.normal(size=(5, 3)).astype(np.float32))
    want, sizes = whole.embed_with_sizes(texts)
    monkeypatch.setattr(E, "_CHARS", 10)
    monkeypatch.setattr(E, "_GATHER", 7)
    got, again = whole.embed_with_sizes(texts)
    assert np.allclose(got, want) and sizes.tolist() == again.tolist() == [sum(0 <= i < 5 for i in whole.tokenizer.ids(t)) for t in texts]
