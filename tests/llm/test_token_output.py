import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import _kernel, _records, token_output
from corpusmill.llm.token_output import FragmentEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ATOMS = [" ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", " ", " ", "　", "\u0085", "a", "the", "The", "don't", "'s", "'", "12", ".", ",", "!?", "|", "<|endoftext|>", "<|", "|>", "é", "ñandú", "ß", "日本", "😀", "_", "$x", "(b)", '"q"', "#", "%", "&", "*"]
WIDE = ["\n", "\n", " ", "日本", "語", "。", "、", "「", "」", "，", "！", "한국", "カナ", "かな", "ー", "　", "\u2003", "\u0085", "я", "é", "a", "'s", "1", "１", ".", "😀", "<|endoftext|>", "\u200b", "ｱ", "々"]


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_east_asian_texts_encode_like_whole_ones(monkeypatch, piece):
    monkeypatch.setattr(_kernel, "PIECE", piece)
    rng = random.Random(9)
    whole, encoder = Tokenizer.from_file(PATH), FragmentEncoder(PATH)
    for _ in range(300):
        texts = ["".join(rng.choice(WIDE) for _ in range(rng.randint(0, 25))) for _ in range(20)]
        ids, ranges = encoder.encode(*_kernel.pack(pa.array(texts, pa.string())))
        for i, t in enumerate(texts):
            want = whole.encode(t, add_special_tokens=False).ids
            assert ids[ranges[i] : ranges[i + 1]].tolist() == want, repr(t)
            assert not t or encoder.encode_long(np.frombuffer(t.encode(), np.uint8)).tolist() == want, repr(t)


def test_a_long_east_asian_text_is_encoded_in_stretches():
    rng = random.Random(4)
    lines = ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(rng.randint(3, 40))) + "。" for _ in range(400)]
    text = "\n".join(rng.choice(lines) for _ in range(40_000)).encode()
    buf = np.frombuffer(text, np.uint8)
    assert len(buf) > 2 * _kernel.PIECE and token_output._cuts(buf[: _kernel.PIECE]).sum() > 10_000
    ids = FragmentEncoder(PATH).encode_long(buf)
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(text.decode(), add_special_tokens=False).ids


@pytest.mark.parametrize("table", [1_000_000, 60, 1])
def test_fragments_encode_like_whole_texts(monkeypatch, table):
    monkeypatch.setattr(token_output, "TABLE", table)
    rng = random.Random(5)
    whole, encoder = Tokenizer.from_file(PATH), FragmentEncoder(PATH)
    for _ in range(300):
        texts = ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 12))) for _ in range(20)] + [None, ""]
        ids, ranges = encoder.encode(*_kernel.pack(pa.array(texts, pa.string())))
        for i, t in enumerate(texts):
            assert ids[ranges[i] : ranges[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_checksum_known_value_and_round_trip():
    body = np.frombuffer(b"123456789" + bytes(32) + b"x" * 1000, np.uint8)
    offsets = np.array([0, 9, 41, 1041])
    assert _records.crc32c(body, offsets).tolist()[:2] == [0xE3069283, 0x8A9136AA]
    data, at = _records.frame(body, offsets)
    got, a, b, used = _records.unframe(data + b"\x05")
    assert used == len(data) and [got[x:y].tobytes() for x, y in zip(a, b)] == [body[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
    broken = bytearray(data)
    broken[20] ^= 1
    try:
        _records.unframe(bytes(broken))
    except ValueError:
        return
    raise AssertionError
