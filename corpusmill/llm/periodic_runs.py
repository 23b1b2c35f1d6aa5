"""Periodic runs of words, found by Karp-Miller-Rosenberg naming, in texts that Spark deals to tasks.

A run is a stretch of a text's words with least period q, of at least max(`least`, 2 * q) words, that neither neighbour extends.

1. Names: equal words of a document have one number; the name of 2**(k+1) words at a place is the dense number of the pair
   of names of its halves. A block that its document has only once gets no name, and no longer block with it has one.
2. Candidates: for periods 2**(k+1) - 1 to 2**(k+2) - 2 the first q words of a run hold a block of 2**k words at a multiple of 2**k
   that comes again q words on. So at each level, blocks on the grid meet equal blocks that far behind them: two for each
   word of the text at most. Of neighbouring blocks on the grid that meet at the same distance, the first stands for all.
3. Both ends are extended by the longest common extension: from the longest names down, each level passes 2**k words or none.
   No hashes of blocks and no sorted suffixes are used.
4. The same stretch under several periods keeps the least.

A null text has no words. An empty text or one of white space has no runs. Ties and repeated rows are rows of their own. Rows keep
null ids. Other columns, whatever their names, stay in `collapse_runs` and aren't read otherwise. A text is one task's work: names of
4 bytes a word are kept for each level whose blocks repeat, so a wholly periodic text of n words takes about 4 * n * log2(n) bytes
beside some 60 * n; others a fraction. No rows are moved between tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import _kernel
from corpusmill.llm._common import exact

LEAST = 12
#: Candidates extended at a time.
SLICE = 1 << 18
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class _Level:
    """Names of the blocks of one length that come again; -1 elsewhere. Kept by place where many have one, else in order of place."""

    def __init__(self, at: np.ndarray, names: np.ndarray, n: int):
        self.n = n
        self.dense = 6 * len(at) >= n
        if self.dense:
            self.names = np.full(n + 1, -1, np.int32)
            self.names[at] = names
        else:
            order = np.argsort(at)
            self.at, self.names = at[order].astype(np.int32), names[order].astype(np.int32)

    def look(self, places: np.ndarray) -> np.ndarray:
        """Names at these places; -1 beyond the ends."""
        inside = np.where((places >= 0) & (places < self.n), places, self.n)
        if self.dense:
            return self.names[inside]
        found = np.minimum(np.searchsorted(self.at, inside.astype(np.int32)), len(self.at) - 1)
        return np.where(self.at[found] == inside, self.names[found], -1)


def _named(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key comes again and the keys' dense numbers, in order of number and place."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    single = new.copy()
    single[:-1] &= new[1:]
    keep = ~single
    return at[order[keep]], np.cumsum(new[keep], dtype=np.int32) - 1


def find_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in order of start and period. words: their numbers; doc: each word's document, in order."""
    n = len(words)
    levels: list[_Level] = []
    found: list[np.ndarray] = []
    if n:
        key = doc.astype(np.int64) * (int(words.max()) + 1) + words
        at, names = _named(key, np.arange(n))
        del key
        while len(at):
            levels.append(level := _Level(at, names, n))
            found.append(_candidates(at, names, level, len(levels) - 1, n))
            size = 1 << (len(levels) - 1)
            after = level.look(at + size)
            both = after >= 0
            at, names = at[both], names[both].astype(np.int64) * (int(names[-1]) + 1) + after[both]
            at, names = _named(names, at)
    out = [_extended(c[a : a + SLICE], k, levels, least) for k, c in enumerate(found) for a in range(0, len(c), SLICE)]
    start, length, period = np.concatenate(out, 1) if out else np.empty((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _candidates(at: np.ndarray, names: np.ndarray, level: _Level, k: int, n: int) -> np.ndarray:
    """Rows (place, period): blocks on the grid of level k that come again at one of the level's periods, the first of neighbours only."""
    size = 1 << k
    code = names.astype(np.int64) * (n + 4 * size) + at
    grid = np.flatnonzero(at % size == 0)
    low = np.searchsorted(code, code[grid] + (2 * size - 1))
    count = np.searchsorted(code, code[grid] + (4 * size - 2), "right") - low
    has = count > 0
    grid, low, count = grid[has], low[has], count[has]
    ends = np.cumsum(count)
    kept = [np.empty((0, 2), np.int64)]
    a = 0
    while a < len(grid):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        item, place = _kernel.ragged(count[a:b])
        i, j = at[grid[a:b]][item], at[low[a:b][item] + place]
        before = level.look(i - size)
        first = (before < 0) | (before != level.look(j - size))
        kept.append(np.stack([i[first], (j - i)[first]], 1))
        a = b
    return np.concatenate(kept)


def _extended(candidates: np.ndarray, k: int, levels: list[_Level], least: int) -> np.ndarray:
    """Rows start, length, period of the candidates that are runs of some period."""
    i, p = candidates[:, 0], candidates[:, 1]
    ahead = i.copy()
    for d in range(len(levels) - 1, -1, -1):
        name = levels[d].look(ahead)
        ahead += ((name >= 0) & (name == levels[d].look(ahead + p))).astype(np.int64) << d
    back = i.copy()
    for d in range(k - 1, -1, -1):  # a whole block would be the grid's block before
        name = levels[d].look(back - (1 << d))
        back -= ((name >= 0) & (name == levels[d].look(back - (1 << d) + p))).astype(np.int64) << d
    same = ahead - back
    run = (same >= p) & (same + p >= least)
    return np.stack([back[run], (same + p)[run], p[run]])


def _word_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, each document's first word (one more than documents), and the words' numbers: equal ones are the same bytes."""
    if len(offsets) == 2 and len(raw) > _kernel.PIECE:
        starts, ends, chunks = [], [], []
        for _, start, end, at, stop in _kernel.stretches(raw, _kernel.WHITE, 0):
            chunks.append(_binary(raw[at:stop], start, end))
            starts.append((start + at).astype(np.int64))
            ends.append((end + at).astype(np.int64))
        start, end = np.concatenate(starts), np.concatenate(ends)
        first = np.array([0, len(start)])
        encoded = pa.chunked_array(chunks).dictionary_encode()
        numbers = np.concatenate([c.indices.to_numpy() for c in encoded.chunks])
        return start, end, first, numbers
    start, end, first = _kernel.words(raw, offsets, _kernel.WHITE)
    return start, end, first, _binary(raw, start, end).dictionary_encode().indices.to_numpy()


def _binary(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as an Arrow array."""
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])


def _analysed(texts, least: int):
    """For each text: number of words, its runs as three arrays counted from its first word, its kept words joined by one space, and whether any word went."""
    whole, offsets = _kernel.pack(texts)
    for a, b in _kernel.parts(offsets):
        raw = whole[offsets[a] : offsets[b]]
        own = offsets[a : b + 1] - offsets[a]
        start, end, first, numbers = _word_places(raw, own)
        doc = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(first))
        at, length, period = find_runs(numbers, doc, least)
        edge = np.zeros(len(start) + 1, np.int32)
        np.add.at(edge, at + period, 1)
        np.add.at(edge, at + length, -1)
        kept = np.cumsum(edge[:-1]) == 0
        body, mask = raw.copy(), np.zeros(len(raw) + 1, np.int8)
        s, e, d = start[kept], end[kept], doc[kept]
        mask[s] += 1
        mask[e] -= 1
        mask = np.cumsum(mask[:-1], dtype=np.int8).view(bool)
        gap = e[:-1][d[1:] == d[:-1]]  # white space follows a word that isn't the document's last
        body[gap] = 0x20
        mask[gap] = True
        cuts = np.concatenate(([0], np.cumsum(mask)))[own]
        body = body[mask]
        bounds = np.searchsorted(at, first)
        for t in range(b - a):
            x, y = bounds[t], bounds[t + 1]
            yield first[t + 1] - first[t], (at[x:y] - first[t], length[x:y], period[x:y]), body[cuts[t] : cuts[t + 1]].tobytes(), y > x


def _run_lists(runs: list[tuple]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r[0]) for r in runs]))).astype(np.int32)
    columns = [pa.array(np.concatenate([r[c] for r in runs]) if runs else np.empty(0, np.int64), pa.int64()) for c in range(3)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (by start, then period; start counts words from 0) and collapsed of every row: its words but for those that a run has after its first period, joined by one space."""

    def work(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 1024):
                part = batch.slice(x, 1024)
                n, runs, kept = [], [], []
                for words, found, text, _ in _analysed(part.column(1), least):
                    n.append(words)
                    runs.append(found)
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), _run_lists(runs), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])
                _kernel.release()

    rows = docs.select(exact(id_col).alias("id"), exact(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs {_RUNS}, collapsed string")


def collapse_runs(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """docs, all columns as they were, with each run of a text cut to its first period; a text without runs isn't touched, white space included."""
    where = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            texts = batch.column(where)
            new = [text if any_ else None for _, _, text, any_ in _analysed(texts, least)]
            merged = pa.array([None if x is None else x.decode() for x in new], texts.type)
            merged = pa.compute.coalesce(merged, texts)
            yield pa.RecordBatch.from_arrays([merged if c == where else batch.column(c) for c in range(batch.num_columns)], schema=batch.schema)
            _kernel.release()

    return docs.mapInArrow(work, docs.schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic by rule from a crc32 of the id; a null id's text is as it was.

    With h the id's crc32, g = floor(h / 10): where h % 10 = 0, the words from a = g % n on repeat the first 1 + floor((n - a) / (3 + g % 8)) of them.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    words = F.expr(r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)")
    g, n = F.floor(F.col("h") / 10), F.size("words")
    rows = rows.where("h % 10 = 0").select("doc_id", "text", words.alias("words"), g.alias("g"), n.alias("n")).where("n > 0")
    rows = rows.withColumn("a", F.expr("int(g % n)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    text = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)), ' ')")
    made = rows.select("doc_id", text.alias("text"))
    words_in = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rest = docs.where(~F.coalesce((h % 10 == 0) & words_in, F.lit(False)))
    return rest.select("doc_id", "text").unionByName(made)


def runs_digest(docs: DataFrame) -> DataFrame:
    """Query op11."""
    out = periodic_runs(planted(docs))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = out.select("id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_runs",
        (-F.col("m.start")).alias("start"),
        F.col("m.length").alias("length"),
        (-F.col("m.period")).alias("period"),
        F.expr("1000 * m.length div -m.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
