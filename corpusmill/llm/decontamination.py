"""Benchmark decontamination: a generalised suffix automaton of normalised test items.

Test items become word sequences (A-Z lower-cased; words are runs of ASCII letters, digits and
non-ASCII characters). The automaton of all items is built over word numbers, in blocks of items
that are bounded in words (`BLOCK_WORDS`), and its transitions are kept as sorted numbers. Driver and tasks hold one block at a
time: a benchmark of several takes a pass over the documents for each. A document's words stream through it: the state and the longest matching length follow
each word, and where that length reaches the window (or a short item's whole length), the last words are hit.

Stretches of words that no item has end every match, so only stretches of known words, long
enough for some window, are walked. Known words are found by hash and then compared as bytes.

Defined cases: a null text has no words, an item without words has no windows; repeated rows
and ids are judged row by row; an empty benchmark hits nothing; other columns, whatever their names, are kept by
`remove_spans` and ignored by `find_hits`; a long text is walked a stretch at a time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import _kernel
from corpusmill.llm._common import exact, free, staged

WINDOW = 13
#: Bytes of words before A-Z are lower-cased.
_MEMBER = _kernel.ALNUM[_kernel.LOWER]
BLOCK_WORDS = 400_000


def normalised(text: str | None) -> list[bytes]:
    buf = _kernel.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end, _ = _kernel.words(buf, np.array([0, len(buf)]), _kernel.ALNUM)
    return [buf[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


class Automaton:
    """Suffix automaton of several word sequences; states know which items have their windows."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, self.number[w])
        moves = [((s << 32) | w, to) for s, follow in enumerate(self.follow) for w, to in follow.items()]
        moves.sort()
        self.moves, self.to = array("q", [m for m, _ in moves]), array("l", [to for _, to in moves])  # by state and word
        self.link, self.length = array("l", self.link), array("l", self.length)
        del self.follow, moves
        self.names = [str(name) for name, _ in items]
        whole: dict[int, list[tuple[int, int]]] = {}  # state of a short item: its length and number
        seen: set[int] = set()  # a window's state and the items that have it
        shortest = window
        for number, (_, ws) in enumerate(items):
            state, n = 0, 0
            for w in ws:
                state, n = self.step(state, n, self.number[w])
                if n >= window:
                    seen.add((state << 32) | number)
            if 0 < len(ws) < window:
                whole.setdefault(state, []).append((len(ws), number))
                shortest = min(shortest, len(ws))
        self.windows = array("q", sorted(seen))
        self.shortest = shortest
        self.ends: dict[int, list[tuple[int, int]]] = {}  # short items that a state ends with, through its suffix links
        if whole:
            for state in sorted(range(len(self.length)), key=self.length.__getitem__):
                up = self.ends.get(self.link[state], []) if state else []
                if own := [*whole.get(state, []), *up]:
                    self.ends[state] = own
        words = list(self.number)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = ends - np.array([len(w) for w in words], np.int64)
        self.known = np.sort(_kernel.word_hashes(np.frombuffer(b"".join(words), np.uint8), starts, ends)) if words else np.empty(0, np.uint64)

    def _extend(self, last: int, w: int) -> int:
        """The state of the sequence so far with w added; earlier sequences' states are shared."""
        follow, link, length = self.follow, self.link, self.length
        if w in follow[last]:
            at = follow[last][w]
            return at if length[at] == length[last] + 1 else self._split(last, w, at)
        state = len(length)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in follow[p]:
            follow[p][w] = state
            p = link[p]
        if p != -1:
            at = follow[p][w]
            link[state] = at if length[at] == length[p] + 1 else self._split(p, w, at)
        return state

    def _split(self, p: int, w: int, at: int) -> int:
        state = len(self.length)
        self.follow.append(dict(self.follow[at]))
        self.link.append(self.link[at])
        self.length.append(self.length[p] + 1)
        self.link[at] = state
        while p != -1 and self.follow[p].get(w) == at:
            self.follow[p][w] = state
            p = self.link[p]
        return state

    def go(self, state: int, w: int) -> int:
        """The state that a word leads to; -1 where there is none."""
        move = (state << 32) | w
        i = bisect_left(self.moves, move)
        return self.to[i] if i < len(self.moves) and self.moves[i] == move else -1

    def having(self, state: int) -> Iterator[int]:
        """Numbers of the items with a window's state."""
        for i in range(bisect_left(self.windows, state << 32), bisect_left(self.windows, (state + 1) << 32)):
            yield self.windows[i] & 0xFFFFFFFF

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """One more word: the state of the longest suffix that items have, cut to the window, and its length."""
        link, length = self.link, self.length
        to = self.go(state, w)
        while state and to < 0:
            state = link[state]
            n = length[state]
            to = self.go(state, w)
        if to < 0:
            return 0, 0
        state, n = to, min(n + 1, self.window)
        while length[link[state]] >= n and state:
            state = link[state]
        return state, n

    def walk(self, numbers: list[int | None]) -> Iterator[tuple[int, int, Iterable[int]]]:
        """End (exclusive), length and item numbers of each window that occurs."""
        state = n = 0
        for i, w in enumerate(numbers):
            if w is None:
                state = n = 0
                continue
            state, n = self.step(state, n, w)
            if n == self.window:
                yield i + 1, n, self.having(state)
            if n:
                for length, item in self.ends.get(state, ()):
                    if length <= n:
                        yield i + 1, length, (item,)


def _hits(automaton: Automaton, part: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, number: int, hits: dict[int, tuple[list, set]]) -> None:
    """Adds to hits, by document, the hit spans of words and the items of these texts; number: the document's word with which the part begins."""
    if not len(start) or not len(automaton.known):
        return
    hashes = _kernel.word_hashes(part, start, end)
    known = automaton.known[np.minimum(np.searchsorted(automaton.known, hashes), len(automaton.known) - 1)] == hashes
    x, y = _kernel.spans(known)
    long = y - x >= automaton.shortest
    for p, q in zip(x[long].tolist(), y[long].tolist(), strict=True):
        while p < q:  # a stretch may run on into the next documents
            doc = int(np.searchsorted(first, p, "right")) - 1
            stop = min(q, int(first[doc + 1]))
            if stop - p >= automaton.shortest:
                numbers = [automaton.number.get(part[u:v].tobytes()) for u, v in zip(start[p:stop].tolist(), end[p:stop].tolist(), strict=True)]
                for at, n, items in automaton.walk(numbers):
                    if number and p + at < automaton.window:
                        continue  # the stretch before ended with these words and had it
                    runs, found = hits.setdefault(doc, ([], set()))
                    v = p + at - int(first[doc]) + number
                    u = v - n
                    while runs and u <= runs[-1][1]:
                        a, b = runs.pop()
                        u, v = min(u, a), max(v, b)
                    runs.append((u, v))
                    found.update(items)
            p = stop


def find(automaton: Automaton, texts) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its number of words, the hit spans of words (apart, in order), and the items whose windows occur."""
    buf, offsets = _kernel.pack(texts)
    for a, b in _kernel.parts(offsets):
        raw, hits = buf[offsets[a] : offsets[b]], {}
        if b - a == 1 and len(raw) > _kernel.PIECE:
            n = 0
            for number, start, end, at, stop in _kernel.stretches(raw, _MEMBER, automaton.window - 1):
                _hits(automaton, _kernel.LOWER[raw[at:stop]], start, end, np.array([0, len(start)]), number, hits)
                n = number + len(start)
            counts = [n]
        else:
            part = _kernel.LOWER[raw]
            start, end, first = _kernel.words(part, offsets[a : b + 1] - offsets[a], _kernel.ALNUM)
            _hits(automaton, part, start, end, first, 0, hits)
            counts = np.diff(first).tolist()
        for doc in range(b - a):
            runs, items = hits.get(doc, ([], ()))
            yield counts[doc], runs, {automaton.names[i] for i in items}


def _pieces(benchmark: DataFrame, window: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """name, words: items of at most so many words whole; longer ones in pieces that overlap by window - 1 words, so each window is in one."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ws = normalised(text)
                starts = range(0, max(1, len(ws) - window + 1), most - window + 1) if len(ws) > most else (0,)
                for at in starts:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], batch.schema.types[0]), pa.array([b" ".join(ws[at : at + most]).decode()])], ["name", "words"])

    rows = benchmark.select(exact(id_col).alias("name"), exact(text_col).alias("text"))
    return rows.mapInArrow(run, f"name {rows.schema['name'].dataType.simpleString()}, words string")


def automata(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> Iterator[Automaton]:
    """Automata of blocks of items or pieces of items, each block bounded in words; the driver holds one block at a time."""
    block, n = [], 0
    for name, words in _pieces(benchmark, window, max(BLOCK_WORDS, 2 * window), id_col, text_col).toLocalIterator():
        ws = words.encode().split()
        if block and n + len(ws) > BLOCK_WORDS:
            yield Automaton(block, window)
            block, n = [], 0
        block.append((name, ws))
        n += len(ws)
    yield Automaton(block, window)


_FOUND = "row long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _pass(rows: DataFrame, automaton: Automaton, kind: str) -> DataFrame:
    """One pass over rows (row, text): row, n_words, spans, items; kind is the type of row."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)  # bounded by BLOCK_WORDS

    def run(batches):
        for batch in batches:
            n_words, spans, items = [], [], []
            for n, runs, names in find(shared.value, batch.column(1)):
                n_words.append(n)
                spans.append([{"a": u, "b": v} for u, v in runs])
                items.append(sorted(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])
            _kernel.release()

    return rows.mapInArrow(run, _FOUND.replace("row long", f"row {kind}"))


def _merged(rows: DataFrame, blocks: Iterator[Automaton]) -> DataFrame:
    """_pass for every block, one at a time, each written to the shared folder; what they found of a row is put together. rows: row (long), text."""
    found = None
    for automaton in blocks:
        one = staged(_pass(rows, automaton, "long"), "decontamination-block")
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr(
        """aggregate(s, cast(array() as array<struct<a:bigint,b:bigint>>), (done, x) ->
        if(size(done) > 0 and x.a <= done[size(done) - 1].b,
           concat(slice(done, 1, size(done) - 1), array(named_struct('a', done[size(done) - 1].a, 'b', greatest(done[size(done) - 1].b, x.b)))),
           concat(done, array(x))))"""
    )
    return found.select("row", "n_words", merged.alias("spans"), "items")


def _one_or_more(benchmark: DataFrame, window: int) -> tuple[Automaton | None, Iterator[Automaton]]:
    """The automaton if one block holds all items; else None and the blocks."""
    blocks = automata(benchmark, window)
    first = next(blocks)
    second = next(blocks, None)
    return (first, iter(())) if second is None else (None, itertools.chain([first, second], blocks))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, spans (hit words [a, b), apart, in order) and items (names, as strings, in order)."""
    one, blocks = _one_or_more(benchmark, window)
    rows = docs.select(exact(id_col).alias("id"), exact(text_col).alias("text"))
    if one is not None:
        return _pass(rows, one, rows.schema["id"].dataType.simpleString()).withColumnRenamed("row", "id")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    return rows.select("row", "id").join(_merged(rows.select("row", "text"), blocks), "row").drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_hits with n_hit, n_items and contaminated (n_hit > 0 and n_hit at least this share of the words)."""
    hits = find_hits(docs, benchmark, window, id_col, text_col)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    hits = hits.withColumn("n_hit", n_hit)
    return hits.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / share) >= F.col("n_words")))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = 50, max_share: float = 0.05, text_col: str = "text") -> DataFrame:
    """The documents, all columns as they were, without those whose hit words reach max_share of their words; of the others, hit spans of over max_span words are cut from the text (a space stands for each)."""
    one, blocks = _one_or_more(benchmark, window)
    names, most = docs.columns, round(1 / max_share)
    at = names.index(text_col)

    def edited(batch: pa.RecordBatch, found: Iterable[tuple[int, list[tuple[int, int]]]]) -> pa.RecordBatch:
        buf, offsets = _kernel.pack(batch.column(at))
        keep, new = [], {}
        for i, (n, runs) in enumerate(found):
            hit = sum(b - a for a, b in runs)
            keep.append(not hit or most * hit < n)
            if keep[-1] and (long := [r for r in runs if r[1] - r[0] > max_span]):
                new[i] = _cut(buf[offsets[i] : offsets[i + 1]], long)
        columns = list(batch.columns[: len(names)])
        if new:
            columns[at] = pa.array([new.get(i, x) for i, x in enumerate(columns[at].to_pylist())], columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    if one is not None:
        shared = docs.sparkSession.sparkContext.broadcast(one)  # bounded by BLOCK_WORDS

        def run(batches):
            for batch in batches:
                yield edited(batch, ((n, runs) for n, runs, _ in find(shared.value, batch.column(at))))
                _kernel.release()

        return docs.mapInArrow(run, docs.schema)
    row, n_words, spans = free(docs, "row", "n_words", "spans")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
    found = _merged(rows.select(F.col(row).alias("row"), exact(text_col).alias("text")), blocks)
    found = found.select(F.col("row").alias(row), F.col("n_words").alias(n_words), F.col("spans").alias(spans))

    def run_found(batches):
        for batch in batches:
            runs = ([(r["a"], r["b"]) for r in x] for x in batch.column(len(names) + 1).to_pylist())
            yield edited(batch, zip(batch.column(len(names)).to_pylist(), runs, strict=True))

    return rows.join(found, row).select(*map(exact, names), n_words, spans).mapInArrow(run_found, docs.schema)


def _cut(raw: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """A text without these spans of words; a space stands for each."""
    bounds = {}  # place of the first byte of a span's first word, and after the last byte of its last
    wanted = np.array([w for a, b in spans for w in (a, b - 1)])
    for number, start, end, at, _ in _kernel.stretches(raw, _MEMBER, 0):
        for w in wanted[(wanted >= number) & (wanted < number + len(start))].tolist():
            bounds[w] = (at + int(start[w - number]), at + int(end[w - number]))
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : bounds[a][0]].tobytes())
        done = bounds[b - 1][1]
    return b" ".join([*out, raw[done:].tobytes()]).decode()


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Query op10: each document's contamination under the contract's rule."""
    found = contamination(docs, benchmark)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def brute_force(text: str | None, items: dict[object, str | None], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """What contamination_digest says of one text, by looking for every window at every place."""
    ws, hit, names = normalised(text), set(), set()
    for name, item in items.items():
        iw = normalised(item)
        n = min(window, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for j in range(len(ws) - n + 1):
                if ws[j : j + n] == iw[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(name))
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)
