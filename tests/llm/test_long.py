"""Long texts in stretches, and texts that fool sums of powers: the same results as in one piece."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import _kernel, _records, decontamination, quality, token_output

PATH = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n, a, b, join=""):
    return join.join((a, b)[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_token_ids_of_texts_that_fool_sums_of_powers(n):
    whole, encoder = Tokenizer.from_file(PATH), token_output.FragmentEncoder(PATH)
    texts = [thue_morse(n, a, b, join) for join in ("", " ") for a, b in (("a", "b"), ("b", "a"))] * 2
    for batch in (texts, texts[::-1]):
        ids, ranges = encoder.encode(*_kernel.pack(pa.array(batch)))
        for i, t in enumerate(batch):
            assert ids[ranges[i] : ranges[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_fragments_with_one_hash_are_told_apart(monkeypatch):
    whole, encoder = Tokenizer.from_file(PATH), token_output.FragmentEncoder(PATH)
    monkeypatch.setattr(_kernel, "mix", lambda x: x & np.uint64(7))  # hashes that hardly differ
    texts = ["the quick brown fox", "jumps over the lazy dog " * 3, "antidisestablishmentarianism is long"]
    for _ in range(3):
        ids, ranges = encoder.encode(*_kernel.pack(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[ranges[i] : ranges[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("piece", [5, 40, 300])
def test_long_texts_have_the_same_token_ids(monkeypatch, piece):
    rng = random.Random(piece)
    atoms = [" ", "  ", "\n", "a", "the", "don't", "12", ".", ",", "é", "日本", "😀", "x" * 30, "<|endoftext|>", "\t", " ", "　"]
    whole, encoder = Tokenizer.from_file(PATH), token_output.FragmentEncoder(PATH)
    monkeypatch.setattr(_kernel, "PIECE", piece)
    for n in (1, 3, 30, 400):
        text = "".join(rng.choice(atoms) for _ in range(n))
        assert encoder.encode_long(np.frombuffer(text.encode(), np.uint8)).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_records_are_read_in_pieces_and_by_index(tmp_path, monkeypatch):
    rng = random.Random(1)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.choice([4, 10, 300, 5000]))) for _ in range(40)]
    data, at = _records.frame(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in bodies]))))
    for part in range(3):
        (tmp_path / f"{part}").write_bytes(data)
    reads = []

    class Stream:
        def __init__(self):
            self.at = 0

        def read(self, n):
            reads.append(n)
            out, self.at = data[self.at : self.at + n], self.at + n
            return out

    for size in (1, 12, 100, 1 << 20):
        monkeypatch.setattr(_records, "READ", size)
        reads.clear()
        got = [body[x:y].tobytes() for body, a, b in _records.stream_records(Stream()) for x, y in zip(a, b)]
        assert got == bodies and sum(reads) < 3 * len(data) + 3 * (1 << 20)
    monkeypatch.setattr(_records, "OPEN", 2)
    order = rng.sample([(p, i) for p in range(3) for i in range(40)], 120)
    with _records.Files(lambda part: f"file://{tmp_path}/{part}") as files:
        some = files.fetch(np.array([p for p, _ in order]), np.array([at[i] for _, i in order]), np.array([at[i + 1] - at[i] for _, i in order]))
    assert some == [data[at[i] : at[i + 1]] for _, i in order]


@pytest.mark.parametrize("piece", [20, 90, 1000])
def test_long_texts_have_the_same_hits(monkeypatch, piece):
    rng = random.Random(piece)
    word = lambda: rng.choice(["a", "B", "cé", "d1", "e" * 25])
    items = [(i, [w.lower().encode() for w in (word() for _ in range(rng.randint(1, 30)))]) for i in range(12)]
    automaton = decontamination.Automaton(items, 9)
    texts = [" ,".join(word() for _ in range(n)) for n in (0, 1, 8, 50, 400)]
    want = list(decontamination.find(automaton, pa.array(texts)))
    monkeypatch.setattr(_kernel, "PIECE", piece)
    assert [list(decontamination.find(automaton, pa.array([t])))[0] for t in texts] == want
    raw = np.frombuffer(texts[4].encode(), np.uint8)
    cut = [decontamination._cut(raw, [(3, 7), (100, 180)])]
    monkeypatch.setattr(_kernel, "PIECE", 1 << 20)
    words = texts[4].split(" ,")
    assert cut == [decontamination._cut(raw, [(3, 7), (100, 180)])] == [" ,".join(words[:3]) + " ,  ," + " ,".join(words[7:100]) + " ,  ," + " ,".join(words[180:])]


def test_long_texts_have_the_same_statistics(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(quality, "WORDS", 16)
    texts = [" ".join(rng.choice(["the", "dog.", "x" * 14, "#", "é😀", "A|B", f"w{rng.randint(0, 40)}"]) for _ in range(n)) + end for n in (1, 15, 16, 17, 33, 500) for end in ("", ".")]
    want = quality.statistics(pa.array(texts))
    monkeypatch.setattr(_kernel, "PIECE", 37)
    got = np.concatenate([quality.statistics(pa.array([t])) for t in texts])
    assert np.allclose(got, want)
    count = len({*texts[8].split()})
    assert count <= 33 and want[8][3] == pytest.approx(sum(len(set(texts[8].split()[i : i + 16])) for i in (0, 16, 32)) / 33)


def test_a_fragment_beyond_the_table(monkeypatch):
    monkeypatch.setattr(token_output, "LONG_BYTES", 50)
    whole, encoder = Tokenizer.from_file(PATH), token_output.FragmentEncoder(PATH)
    for text in ("short words here", "x" * 400, "y" * 30 + " z", "x" * 400, "short words here"):
        ids, ranges = encoder.encode(*_kernel.pack(pa.array([text, text])))
        want = whole.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want + want and ranges.tolist() == [0, len(want), 2 * len(want)]
