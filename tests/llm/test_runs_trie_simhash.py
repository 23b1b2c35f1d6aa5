"""Periodic runs, the trie of prefixes and SimHash components against brute force, on odd rows and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpusmill.llm import _kernel, periodic_runs, prefix_trie, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs_of(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(rng, count):
    for _ in range(count):
        words, n = [], rng.choice([0, 1, 13, 40, 200])
        while len(words) < n:
            block = [rng.choice("abcdé") for _ in range(rng.randint(1, 12))]
            words += block * rng.randint(1, 6) if rng.random() < 0.4 else block
        yield "".join(w + rng.choice([" ", "\n", "  \t"]) for w in words[:n])


@pytest.mark.parametrize(("piece", "slice_"), [(1 << 20, 1 << 18), (64, 7)])
def test_runs_are_those_of_brute_force(monkeypatch, piece, slice_):
    monkeypatch.setattr(_kernel, "PIECE", piece)
    monkeypatch.setattr(periodic_runs, "SLICE", slice_)
    short, long = "a", "a b"
    for _ in range(10):
        short, long = long, f"{long} {short}"
    morse = " ".join("ab"[bin(i).count("1") & 1] for i in range(600))
    texts = [*periodic_texts(random.Random(3), 150), None, "", " \n", long, morse, "x " * 500]
    for text, (n, runs, kept, changed) in zip(texts, periodic_runs._analysed(pa.array(texts), 12), strict=True):
        words = WORD.findall(text or "")
        want = runs_of(words)
        assert n == len(words) and list(zip(*(x.tolist() for x in runs), strict=True)) == want
        assert kept.decode() == collapsed(words, want) and changed == bool(want)


def planted(i, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is None or h % 10 or not n:
        return words
    a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def test_runs_digest(spark, odd):
    rng = random.Random(4)
    more = spark.createDataFrame([(i, t) for i, t in enumerate(periodic_texts(rng, 120), 100)], "doc_id long, text string")
    for df in (*odd, more):
        want = []
        for r in df.collect():
            words = planted(r.doc_id, r.text)
            runs = runs_of(words)
            top = min(((-n, s, p) for s, n, p in runs), default=None)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            longest = (None,) * 4 if top is None else (top[1], -top[0], top[2], -1000 * top[0] // top[2])
            want.append((r.doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
        assert sorted(map(repr, map(tuple, periodic_runs.runs_digest(df).collect()))) == sorted(map(repr, want))
        out = periodic_runs.collapse_runs(df)
        assert out.columns == df.columns
        keep = [(r.doc_id, collapsed(WORD.findall(r.text or ""), runs_of(WORD.findall(r.text or ""))) if runs_of(WORD.findall(r.text or "")) else r.text) for r in df.collect()]
        assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, keep))


def trie_of(rows):
    """(conv_id, depth, parent, members, children, leaves, saved, ends) of each node of the rebuilt conversations; null ids come last."""
    said = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        said[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    said = {c: [x[3:] for x in sorted(turns)] for c, turns in said.items()}
    made = {}
    for c, turns in said.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = [] if c is None else said.get(int(c - np.fmod(c, 100)), [])
        made[c] = tuple(base[:h] + turns[h:])
    last = lambda c: (c is None, c or 0)
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if made[c] == prefix and c is not None))
        parent = min(nodes[prefix[:-1]], key=last) if prefix else None
        out.append((min(members, key=last), len(prefix), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rng = random.Random(5)
    rows = []
    for c in [*range(40), *range(100, 130), 250, 251, -7, -107, None]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["same", "ab", "é😀"])))
    rows += [(7, None, None, None), (7, None, None, None), (7, 3, "user", ""), (8, 1, "user", "same"), (8, 1, "user", "same"), (None, 2, "user", None)]
    rows += [(60, t, "user", f"w{t % 3}") for t in range(70)]  # a long one
    rows += [(c, 0, "system", "hello") for c in range(300, 340)]  # one first turn of many
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    got = sorted(repr(tuple(r[c] for c in columns)) for r in prefix_trie.trie_digest(df).collect())
    assert got == trie_of(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie_digest(df).count() == 0
    assert prefix_trie.trie(df).nodes.count() == 0


def bits_of(text):
    words = WORD.findall((text or "").translate(FOLD))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(values, distance=2):
    """The least value that links reach, of each."""
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    order = sorted(values)
    at = np.array(order, np.uint64)
    for i, v in enumerate(order):
        for j in np.flatnonzero(np.bitwise_count(at[i + 1 :] ^ at[i]) <= distance).tolist():
            a, b = top(v), top(order[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {v: top(v) for v in values}


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_fingerprints(monkeypatch, piece):
    monkeypatch.setattr(_kernel, "PIECE", piece)
    rng = random.Random(1)
    texts = [None, "", " \n", "a", "A b", "A\nb  c", *("".join(rng.choice(["Ab", "é", "x", "日本"]) + rng.choice([" ", "\n", " \t"]) for _ in range(rng.randrange(60))) for _ in range(150))]
    assert list(simhash.fingerprints_of(pa.array(texts))) == [bits_of(t) for t in texts]


@pytest.mark.parametrize("full", [1024, 3])
def test_hamming_components(spark, monkeypatch, full):
    monkeypatch.setattr(simhash, "FULL", full)
    monkeypatch.setattr(simhash, "BATCH", 500)
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(200)}
    for base in rng.sample(sorted(values), 12):  # chains and dense balls
        x = base
        for _ in range(rng.choice([3, 60])):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 3)):
                y ^= 1 << b
            values.add(y)
            x = rng.choice([x, y])
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp long"))
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in found.collect():
        u, v = r.u & (1 << 64) - 1, r.v & (1 << 64) - 1
        assert 0 < (u ^ v).bit_count()
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    assert {v: top(v) for v in values} == components_of(values)


def test_large_groups_are_looked_up():
    rng = random.Random(3)
    mask, base, values = 0xFFFFFFFFFFFF, rng.getrandbits(64), set()
    while len(values) < 2000:
        x = base
        for b in rng.sample(range(48, 64), rng.randint(0, 10)):
            x ^= 1 << b
        values.add(x)
    x = np.array(sorted(values), np.uint64)
    u, v = simhash._forest(x, np.zeros(len(x), int), np.full(len(x), mask, np.uint64), 2)
    assert len(u) < len(x)
    want = components_of(values)
    assert len(set(want.values())) == len(x) - len({int(a) for a in u})


def test_simhash_digest(spark, odd):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(120)) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(texts, 50)] + [(200 + i, t.replace(" ", "\n", 3).upper()) for i, t in enumerate(texts)] + [(300 + 20 * k + i, t + f" x{k}") for i, t in enumerate(texts) for k in range(6)] + [(None, texts[0]), (None, "alone here and now")]
    for df in (*odd, spark.createDataFrame(rows, "doc_id long, text string")):
        data = [(r.doc_id, bits_of(r.text)) for r in df.collect()]
        roots = components_of({b for _, b in data})
        least = {}
        for i, b in data:
            if i is not None:
                least[roots[b]] = min(least.get(roots[b], i), i)
        want = [(i, f"{b:016x}", least.get(roots[b])) for i, b in data]
        got = [tuple(r) for r in simhash.simhash_digest(df).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        kept = simhash.drop_near_copies(df)
        assert kept.columns == df.columns
        stay = {i for i, _, c in want if i == c}
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in data if i in stay)


def test_sql_crc32():
    sql = queries._crc32("i::varchar")
    for i, h in duckdb.sql(f"select i, {sql} from (select unnest([0, 7, -107, 123456789012]) as i)").fetchall():
        assert h == zlib.crc32(str(i).encode())
