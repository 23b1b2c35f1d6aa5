"""The exchange of repeated windows, run in this process: long texts in stretches, blocks of groups, texts that fool sums of powers."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import _kernel, _windows, substring_dedup, suffix_dedup
from corpusmill.llm._windows import Kind
from test_operators import brute_bytes, brute_words


class Cells:
    value = np.zeros(_windows.CELLS, np.uint8)


def exchange(rows, kind, finish, schema, groups, blocks=True):
    """judge without Spark: what each pass returns, dealt out in dictionaries."""

    def deal(tables, *keys):
        out = defaultdict(list)
        for t in tables:
            for i in range(t.num_rows):
                out[tuple(t.column(k)[i].as_py() for k in keys)].append(t.slice(i, 1))
        return {k: pa.concat_tables(v) for k, v in out.items()}

    dealt = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        dealt[i % groups].append((doc_id, text))
    tables = {p: pa.table({"doc_id": pa.array([r[0] for r in v], pa.int64()), "text": pa.array([r[1] for r in v], pa.string()), "groups": pa.array([groups] * len(v), pa.int32()), "pid": pa.array([p] * len(v), pa.int32())}) for p, v in dealt.items()}
    again = deal([_windows._find_again(t) for t in deal([_windows._request(kind, groups, Cells)(t) for t in tables.values()], "bucket").values()], "pid")
    none = _windows._table(_windows._ANSWER, [])
    strings = [_windows._send_strings(kind, groups, Cells)(t, again.get((p,), none)) for p, t in tables.items()]
    if not blocks:
        answers = [_windows._answer_windows(kind)(t) for t in deal(strings, "bucket").values()]
    else:
        found = [_windows._answer_windows(kind)(t) for t in deal([_windows._combine(t) for t in deal(strings, "bucket", "block").values()], "bucket").values()]
        found = deal(found, "bucket", "pid")
        answers = [_windows._pass_on(t, found.get(k, none)) for k, t in deal(strings, "bucket", "block").items()]
    answers = deal(answers, "pid")
    return [tuple(r.values()) for p, t in tables.items() for r in _windows._apply(kind, Cells, finish, schema)(t, answers.get((p,), none)).to_pylist()]


def texts(rng):
    pieces = [" ".join(rng.choice("ab cé d") for _ in range(rng.randint(1, 40))) for _ in range(6)]
    return [(i if rng.random() < 0.95 else None, None if rng.random() < 0.05 else "  ".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for i in range(24)]


@pytest.mark.parametrize("piece", [1 << 20, 50])
@pytest.mark.parametrize("blocks", [False, True])
def test_stretches_and_blocks(monkeypatch, piece, blocks):
    monkeypatch.setattr(_kernel, "PIECE", piece)
    monkeypatch.setattr(_windows, "BLOCK", 2)
    for seed in range(4):
        rows = texts(random.Random(seed))
        got = exchange(rows, Kind("bytes", 20, 6, False), suffix_dedup._finish, suffix_dedup._OUT, 5, blocks)
        assert Counter(got) == Counter(brute_bytes(rows, 20).values())
        got = exchange(rows, Kind("words", 9, 3, True), substring_dedup._finish, substring_dedup._OUT, 5, blocks)
        assert Counter(got) == Counter(brute_words(rows, 9).values())


def thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") & 1] for i in range(n)]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_strings_that_fool_sums_of_powers(n):
    for join in ("", " "):
        one, two = join.join(thue_morse(n, "a", "b")), join.join(thue_morse(n, "b", "a"))
        rows = [(1, one), (2, two), (3, one)]
        got = exchange(rows, Kind("bytes", 50, 16, False), suffix_dedup._finish, suffix_dedup._OUT, 2)
        assert Counter(got) == Counter(brute_bytes(rows, 50).values())
        got = exchange(rows, Kind("words", 35, 8, True), substring_dedup._finish, substring_dedup._OUT, 2)
        assert Counter(got) == Counter(brute_words(rows, 35).values())


def test_stretches_cover_all_words(monkeypatch):
    monkeypatch.setattr(_kernel, "PIECE", 7)
    rng = random.Random(2)
    for _ in range(200):
        text = np.frombuffer("".join(rng.choice("ab  \n") for _ in range(rng.randint(1, 60))).encode(), np.uint8)
        start, end, _ = _kernel.words(text, np.array([0, len(text)]), _kernel.WHITE)
        for overlap in (0, 1, 4):
            seen = {}
            for number, a, b, at, stop in _kernel.stretches(text, _kernel.WHITE, overlap):
                for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                    assert seen.setdefault(number + i, (x + at, y + at)) == (x + at, y + at)
            assert [seen[i] for i in range(len(start))] == list(zip(start.tolist(), end.tolist(), strict=True)) and len(seen) == len(start)
