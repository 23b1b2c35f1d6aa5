"""Finding windows that repeat across a corpus, exactly, without moving every window.

Documents are dealt once to groups of a few MB by a hash of the row and its input split (so that identical rows spread). All passes read that one exchange.

1. A window's minimiser is the rarest of its k-mers: the order of k-mers is by how often a bounded sample has them, then by
   hash. Equal windows have equal minimisers, whatever the order; a rare one is seldom shared by other windows, and no phrase
   that is common in the language fills a bucket. Each group sends the distinct minimisers of its windows, as 32 bits, to
   buckets; a bucket answers each group with those that occur again anywhere.
2. Consecutive windows that share such a minimiser travel as one packed string to the minimiser's bucket, once a
   group however often it occurs there, with the least document id and whether it occurs again in the group. There the strings'
   windows are ordered and compared, byte by byte or word by word, so equal windows are found exactly.
3. A bucket answers each group with a value for each window of its strings: how often the window occurs, or the least id
   of the documents that have it. The answer names a string by 128 bits of BLAKE2b, which the group compares for the runs of
   the answered minimisers, and then applies the values to all places of a string.

Strings meet in two steps: blocks of `BLOCK` groups put equal ones together before the bucket, and pass its answers on. So a passage
that all documents share costs each group one string and the bucket one a block, and no task holds more than one
group of documents, or one bucket (a hash share of the repeated strings) or block of it.
A text of over `_kernel.PIECE` bytes is taken in stretches that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import _kernel
from corpusmill.llm._common import exact, shuffle_partitions

GROUP_BYTES = 8 << 20
#: Groups whose equal strings are put together before they go to their bucket.
BLOCK = 256
#: Partitions of an exchange: one a group up to so many; beyond, what the session says.
MOST_PARTITIONS = 10_000
#: A run of windows with one minimiser is cut after so many, so that periodic texts travel in short strings.
LONGEST_RUN = 2048
#: The sample from which k-mers are ordered: so many slices of so many characters at most, counted in so many cells. No result depends on it.
SAMPLE_SLICES, SLICE, CELLS = 4096, 2048, 1 << 22
LOW = -(1 << 63)
_U32 = np.uint64(0xFFFFFFFF)
_NAME = 16
_REQUEST = "bucket int, pid int, keys binary, again binary"
_ANSWER = "pid int, bucket int, c binary, key binary, n binary, length binary, value binary"
_STRINGS = "bucket int, block int, pid int, key binary, low binary, again binary, n_windows binary, n_bytes binary, body binary"


@dataclass(frozen=True)
class Kind:
    """What windows are made of: units 'words' or 'bytes', window and k in units; counted: values are counts, else least ids."""

    units: str
    window: int
    k: int
    counted: bool


def _values(kind: Kind, buf: np.ndarray, start: np.ndarray | None, end: np.ndarray | None) -> np.ndarray:
    """Hashes of all k-mers."""
    if start is None:
        return _kernel.byte_grams(buf, kind.k)
    return _kernel.grams(_kernel.word_hashes(buf, start, end), kind.k) if len(start) else np.empty(0, np.uint64)


class Part:
    """The windows of a few documents, or of a stretch of one: runs of windows [start, end) with one minimiser each, by unit."""

    def __init__(self, kind: Kind, buf: np.ndarray, offsets: np.ndarray, cells: np.ndarray | None, inner: bool = False, units: tuple | None = None):
        """cells: how common k-mers are, by hash; inner: also find the runs with several places of their minimiser, which alone can have a window twice."""
        self.buf, self.offsets, self.twice = buf, offsets, np.empty(0, bool)
        if kind.units == "words":
            self.start, self.end, self.first = units or _kernel.words(buf, offsets, _kernel.WHITE)
        else:
            self.start, self.end, self.first = None, None, offsets
        w = kind.window
        empty = np.empty(0, np.int64)
        self.run_start, self.run_end, self.minimiser = empty, empty, np.empty(0, np.uint64)
        counts = np.diff(self.first)
        if counts.max(initial=0) < w:
            return
        hashes = _values(kind, buf, self.start, self.end)
        if cells is not None:
            hashes = (cells[hashes & np.uint64(CELLS - 1)].astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(6))
        least = _kernel.sliding_min(hashes, w - kind.k + 1)
        edge = np.zeros(len(least) + 1, np.int8)
        long = counts >= w
        edge[self.first[:-1][long]] += 1
        edge[self.first[1:][long] - w + 1] -= 1
        valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
        change = least[1:] != least[:-1]
        head, tail = valid.copy(), valid.copy()
        head[1:] &= ~valid[:-1] | change
        tail[:-1] &= ~valid[1:] | change
        a, b = np.flatnonzero(head), np.flatnonzero(tail) + 1
        if (b - a).max(initial=0) > LONGEST_RUN:
            item, place = _kernel.ragged(-(-(b - a) // LONGEST_RUN))
            a, b = a[item] + place * LONGEST_RUN, np.minimum(b[item], a[item] + (place + 1) * LONGEST_RUN)
        if inner:
            place = np.arange(w - kind.k + 1)
            first = a + (hashes[a[:, None] + place] == least[a, None]).argmax(1)
            last = b - 1 + place[-1] - (hashes[b[:, None] - 1 + place[::-1]] == least[a, None]).argmax(1)
            self.twice = first != last
        self.run_start, self.run_end, self.minimiser = a, b, _kernel.mix(least[a])

    def raw(self, kind: Kind, chosen: np.ndarray) -> list[bytes]:
        """The bytes of these runs as they stand in the text."""
        a, b = self.run_start[chosen], self.run_end[chosen] - 1 + kind.window
        if self.start is not None:
            a, b = self.start[a], self.end[b - 1]
        data = self.buf.tobytes()
        return [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]

    def string(self, kind: Kind, i: int) -> bytes:
        """The bytes of run i's windows; words are joined by one space."""
        a, b = int(self.run_start[i]), int(self.run_end[i]) - 1 + kind.window
        if self.start is None:
            return self.buf[a:b].tobytes()
        return b" ".join([self.buf[x:y].tobytes() for x, y in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)])


def _pieces(kind: Kind, table: pa.Table, cells: np.ndarray, inner: bool = False):
    """(first row, last row, unit of the document with which the part begins, Part) for all of a group, in order."""
    buf, offsets = _kernel.pack(table.column("text"))
    for a, b in _kernel.parts(offsets, _kernel.PIECE):
        text = buf[offsets[a] : offsets[b]]
        if len(text) <= _kernel.PIECE:
            yield a, b, 0, Part(kind, text, offsets[a : b + 1] - offsets[a], cells, inner)
        elif kind.units == "words":
            for number, start, end, at, stop in _kernel.stretches(text, _kernel.WHITE, kind.window - 1):
                yield a, b, number, Part(kind, text[at:stop], np.array([0, stop - at]), cells, inner, (start, end, np.array([0, len(start)])))
        else:
            for at in range(0, len(text) - kind.window + 1, _kernel.PIECE):
                own = text[at : at + _kernel.PIECE + kind.window - 1]
                yield a, b, at, Part(kind, own, np.array([0, len(own)]), cells, inner)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(LOW).to_numpy(zero_copy_only=False).astype(np.int64)


def _places(minimisers: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (high half) and 32-bit key (low half) of mixed minimisers."""
    return (((minimisers >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (minimisers & _U32)


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values if len(sorted_) else np.zeros(len(values), bool)


def _by_value(sorted_: np.ndarray):
    """For values in order: each value and its range."""
    edges = np.flatnonzero(np.diff(sorted_)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(sorted_)], strict=True):
        if b > a:
            yield int(sorted_[a]), a, b


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    """The numbers that a column's values hold, one value after the other."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _name(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=_NAME).digest()


def _request(kind: Kind, buckets: int, cells) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        pid = table.column("pid")[0].as_py()
        found = [np.empty(0, np.uint64)]
        for *_, part in _pieces(kind, table, cells.value, True):
            places, counts = np.unique(_places(part.minimiser, buckets), return_counts=True)
            found += [places, places[counts > 1], _places(part.minimiser[part.twice], buckets)]
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        rows = [(b, pid, (keys[x:y] & _U32).astype("<u4").tobytes(), np.packbits(counts[x:y] > 1).tobytes()) for b, x, y in _by_value(keys >> np.uint64(32))]
        _kernel.release()
        return _table(_REQUEST, rows)

    return run


def _find_again(table: pa.Table) -> pa.Table:
    """For a bucket: to each group, those of its keys that another group has too or that it has more than once."""
    keys = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("again").to_pylist(), keys, strict=True)]).astype(bool)
    _, back, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    again |= counts[back] > 1
    bucket, out, at = table.column("bucket")[0].as_py(), [], 0
    for pid, k in zip(table.column("pid").to_pylist(), keys, strict=True):
        mine = k[again[at : at + len(k)]]
        at += len(k)
        if len(mine):
            out.append((pid, bucket, b"", mine.tobytes(), b"", b"", b""))
    return _table(_ANSWER, out)


def _asked(answers: pa.Table) -> np.ndarray:
    """The places that a group's answers name, in order."""
    rows = zip(answers.column("bucket").to_pylist(), answers.column("key").to_pylist(), strict=True)
    found = [(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, "<u4").astype(np.uint64) for b, k in rows]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _pack(bucket: int, block: int, pid: int, key, low, again, windows, bodies: list[bytes]) -> tuple:
    return (bucket, block, pid, key.astype("<u4").tobytes(), low.astype("<i8").tobytes(), np.packbits(again).tobytes(), windows.astype("<u4").tobytes(), np.array([len(x) for x in bodies], "<u4").tobytes(), b"".join(bodies))


def _send_strings(kind: Kind, buckets: int, cells) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _table(_STRINGS, [])
        pid, ids = table.column("pid")[0].as_py(), _ids(table)
        again = _asked(answers)
        number: dict[bytes, int] = {}
        which, low, place, windows, strings = [], [], [], [], []
        for a, b, _, part in _pieces(kind, table, cells.value):
            places = _places(part.minimiser, buckets)
            chosen = np.flatnonzero(_among(places, again))
            known = len(number)
            own = np.array([number.setdefault(x, len(number)) for x in part.raw(kind, chosen)], np.int64)
            which.append(own)
            low.append(ids[a:b][np.searchsorted(part.first, part.run_start[chosen], "right") - 1])
            new = np.flatnonzero(own >= known)
            _, first = np.unique(own[new], return_index=True)
            new = new[first]
            place.append(places[chosen[new]])
            windows.append(part.run_end[chosen[new]] - part.run_start[chosen[new]])
            if kind.units == "words":
                strings += [part.string(kind, x) for x in chosen[new].tolist()]
        which, low, place, windows = (np.concatenate(x) for x in (which, low, place, windows))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, which, low)
        counts = np.bincount(which, minlength=len(number))
        strings = strings or list(number)  # bytes stand in a string as in the text
        bucket, order = (place >> np.uint64(32)).astype(np.int64), np.argsort(place, kind="stable")
        rows = []
        for b, x, y in _by_value(bucket[order]):
            o = order[x:y]
            rows.append(_pack(b, pid // BLOCK, pid, place[o] & _U32, least[o], counts[o] > 1, windows[o], [strings[j] for j in o.tolist()]))
        _kernel.release()
        return _table(_STRINGS, rows)

    return run


class _Strings:
    """The strings of several packed rows: distinct ones by bytes, and for each string sent its number, name, key, sender."""

    def __init__(self, table: pa.Table):
        number: dict[bytes, int] = {}
        which, senders = [], []
        for pid, n_bytes, body in zip(table.column("pid").to_pylist(), table.column("n_bytes").to_pylist(), table.column("body").to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(n_bytes, "<u4"), dtype=np.int64).tolist()
            which += [number.setdefault(body[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            senders.append(np.full(len(ends), pid))
        self.strings, self.which, self.senders = list(number), np.array(which, np.int64), np.concatenate(senders)
        self.low = _joined(table, "low", "<i8")
        self.keys, windows = _joined(table, "key", "<u4"), _joined(table, "n_windows", "<u4")
        self.again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(n) // 4) for x, n in zip(table.column("again").to_pylist(), table.column("key").to_pylist(), strict=True)])
        n = len(self.strings)
        self.size, self.key = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.size[self.which], self.key[self.which] = windows, self.keys
        # each distinct string once: how often it occurs (more than once counts as twice), the least id
        self.count = np.bincount(self.which, 1 + self.again, n).astype(np.int64)
        self.least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, self.low)

    def names(self, wanted: np.ndarray) -> np.ndarray:
        """By number the names of these distinct strings; of others, nothing that means anything."""
        out = np.zeros(len(self.strings), f"V{_NAME}")
        chosen = np.flatnonzero(np.bincount(wanted, minlength=len(self.strings)))
        if len(chosen):
            out[chosen] = np.frombuffer(b"".join([_name(self.strings[i]) for i in chosen.tolist()]), f"V{_NAME}")
        return out


def _combine(table: pa.Table) -> pa.Table:
    """Of a bucket's strings from one block of groups, each distinct one once, in the block's name."""
    s = _Strings(table)
    bucket, block = table.column("bucket")[0].as_py(), table.column("block")[0].as_py()
    return _table(_STRINGS, [_pack(bucket, block, block, s.key, s.least, s.count > 1, s.size, s.strings)])


def _pass_on(table: pa.Table, answers: pa.Table) -> pa.Table:
    """A bucket's answers to a block, given to each of its groups that sent the string."""
    if not table.num_rows or not answers.num_rows:
        return _table(_ANSWER, [])
    s = _Strings(table)
    known, n, length, value = _answers(answers)
    names = s.names(s.which)
    at = np.array([known.get(x.tobytes(), -1) for x in names], np.int64)[s.which]
    first = np.cumsum(n) - n
    order = np.argsort(s.senders, kind="stable")
    order = order[at[order] >= 0]
    bucket, out = table.column("bucket")[0].as_py(), []
    for pid, x, y in _by_value(s.senders[order]):
        o = order[x:y]
        i, p = _kernel.ragged(n[at[o]])
        r = first[at[o]][i] + p
        out.append((pid, bucket, names[s.which[o]].tobytes(), s.keys[o].tobytes(), n[at[o]].astype("<u4").tobytes(), length[r].astype("<u4").tobytes(), value[r].astype("<i8").tobytes()))
    return _table(_ANSWER, out)


def _answers(answers: pa.Table) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """All answers: each name's number; by number how many runs of values it has; the runs' lengths and values."""
    c = b"".join(answers.column("c").to_pylist())
    names = {c[at : at + _NAME]: i for i, at in enumerate(range(0, len(c), _NAME))}
    return names, _joined(answers, "n", "<u4").astype(np.int64), _joined(answers, "length", "<u4").astype(np.int64), _joined(answers, "value", "<i8")


def byte_groups(body: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth-limited radix sort: suffixes at `starts`, ordered through their first `window` bytes only.

    Passes go from the most significant digit (8 bytes) down; a suffix that is alone in its group after a
    pass is done with. Returns the suffixes that share all their bytes with another, in order, and their groups.
    """
    padded = np.concatenate([body, np.zeros(8, np.uint8)]).astype(np.uint64)
    digit = np.zeros(len(body), np.uint64)
    for i in range(8):
        digit = (digit << np.uint64(8)) | padded[i : len(body) + i]
    live, group = np.arange(len(starts)), np.zeros(len(starts), np.uint64)
    for depth in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:
        d = digit[starts[live] + depth]
        # one sort: of the digit in the first pass, then of the group and half of the digit's hash
        key = (group << np.uint64(32)) | (_kernel.mix(d) >> np.uint64(32)) if depth else d
        order = np.argsort(key)
        key, other = key[order], d[order]
        if depth and ((key[1:] == key[:-1]) & (other[1:] != other[:-1])).any():  # two digits with one half
            order = np.lexsort((d, group))
        live, group, d = live[order], group[order], d[order]
        new = np.ones(len(live), bool)
        new[1:] = (d[1:] != d[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new).astype(np.uint64)
        shared = ~new
        shared[:-1] |= ~new[1:]
        live, group = live[shared], group[shared]
    return live, group


def word_groups(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of word numbers at `starts` that are equal to another, and their groups: names of 1, 2, 4 ... words by sorting pairs of names."""
    name, length = words.astype(np.uint64), 1
    while 2 * length <= window:
        _, name = np.unique((name[:-length] << np.uint64(32)) | name[length:], return_inverse=True)
        name = name.astype(np.uint64)
        length *= 2
    last = (name[starts] << np.uint64(32)) | name[starts + window - length]
    order = np.argsort(last, kind="stable")
    last = last[order]
    new = np.ones(len(last), bool)
    new[1:] = last[1:] != last[:-1]
    shared = ~new
    shared[:-1] |= ~new[1:]
    return order[shared], np.cumsum(new)[shared]


def _answer_windows(kind: Kind) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        s = _Strings(table)
        item, place = _kernel.ragged(s.size)
        at = np.cumsum(s.size + kind.window - 1) - (s.size + kind.window - 1)
        if kind.units == "words":
            numbers: dict[bytes, int] = {}
            words = np.array([numbers.setdefault(w, len(numbers)) for x in s.strings for w in x.split(b" ")], np.int64)
            live, group = word_groups(words, at[item] + place, kind.window)
        else:
            live, group = byte_groups(np.frombuffer(b"".join(s.strings), np.uint8), at[item] + place, kind.window)
        value = (s.count if kind.counted else s.least)[item]
        if len(live):
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            of_group = (np.add if kind.counted else np.minimum).reduceat(value[live], heads)
            value[live] = np.repeat(of_group, np.diff(heads, append=len(live)))
        if kind.counted:
            value = (value > 1).astype(np.int64)
        # runs of equal values within each string
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (item[1:] != item[:-1])
        heads = np.flatnonzero(new)
        lengths, values, owner = np.diff(heads, append=len(value)), value[heads], item[heads]
        first = np.searchsorted(owner, np.arange(len(s.strings) + 1))
        greatest = np.maximum.reduceat(values, first[:-1]) if kind.counted else np.minimum.reduceat(values, first[:-1])
        useful = greatest[s.which] > 0 if kind.counted else (greatest[s.which] < s.low) | (s.again > 0)
        bucket, names, out = table.column("bucket")[0].as_py(), s.names(s.which[useful]), []
        for b, x, y in _by_value(s.senders):
            chosen = np.flatnonzero(useful[x:y]) + x
            if len(chosen):
                n = first[s.which[chosen] + 1] - first[s.which[chosen]]
                i, p = _kernel.ragged(n)
                r = first[s.which[chosen]][i] + p
                out.append((b, bucket, names[s.which[chosen]].tobytes(), s.keys[chosen].tobytes(), n.astype("<u4").tobytes(), lengths[r].astype("<u4").tobytes(), values[r].astype("<i8").tobytes()))
        _kernel.release()
        return _table(_ANSWER, out)

    return run


def _apply(kind: Kind, cells, finish, schema: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(schema, [])
        ids, null = _ids(table), table.column("doc_id").is_null().to_pylist()
        asked = _asked(answers)
        names, n, length, value = _answers(answers)
        first = np.cumsum(n) - n
        buckets = table.column("groups")[0].as_py()
        buf, offsets = _kernel.pack(table.column("text"))
        rows, long = [], None
        seen: dict[bytes, int] = {}

        def hits(a: int, b: int, part: Part) -> np.ndarray:
            chosen = np.flatnonzero(_among(_places(part.minimiser, buckets), asked))
            i = np.empty(len(chosen), np.int64)
            for j, (raw, run) in enumerate(zip(part.raw(kind, chosen), chosen.tolist(), strict=True)):
                if raw not in seen:
                    seen[raw] = names.get(_name(part.string(kind, run) if kind.units == "words" else raw), -1)
                i[j] = seen[raw]
            chosen, i = chosen[i >= 0], i[i >= 0]
            run_, p = _kernel.ragged(n[i])
            r = first[i][run_] + p
            windows, _ = _kernel.ragged(length[r])  # runs of values, window by window
            of = run_[windows]
            _, q = _kernel.ragged(np.bincount(of, minlength=len(chosen)))
            starts = part.run_start[chosen][of] + q
            v = value[r][windows]
            own = ids[a:b][np.searchsorted(part.first, starts, "right") - 1]
            return starts[v > 0] if kind.counted else starts[v < own]

        def close():
            """The row of a document that came in stretches."""
            row, total, found = long
            removed = _kernel.cover(np.concatenate([np.empty(0, np.int64), *found]), kind.window, total)
            rows.append((None if null[row] else int(ids[row]), *finish(buf[offsets[row] : offsets[row + 1]], None, removed)))

        for a, b, unit, part in _pieces(kind, table, cells.value):
            size = int(offsets[b] - offsets[a])
            if long is not None and long[0] != a:
                close()
                long = None
            hit = hits(a, b, part)
            if size > _kernel.PIECE:
                long = long or [a, 0, []]
                long[2].append(hit + unit)
                long[1] = size if kind.units == "bytes" else unit + int(part.first[-1])
                continue
            total = int(part.first[-1])
            removed = _kernel.cover(hit, kind.window, total) if len(hit) else np.zeros(total, bool)
            for j in range(b - a):
                x, y = int(part.first[j]), int(part.first[j + 1])
                units = None if kind.units == "bytes" else (part.start[x:y] - part.offsets[j], part.end[x:y] - part.offsets[j])
                rows.append((None if null[a + j] else int(ids[a + j]), *finish(buf[offsets[a + j] : offsets[a + j + 1]], units, removed[x:y])))
        if long is not None:
            close()
        _kernel.release()
        return _table(schema, rows)

    return run


def _cells(rows: DataFrame, kind: Kind, n: int) -> np.ndarray:
    """How common k-mers are, by hash: logarithms of their counts in a sample of at most SAMPLE_SLICES slices of texts, taken at places that a hash gives."""
    at = 1 + F.pmod(F.xxhash64(F.octet_length("text"), "doc_id"), F.greatest(F.lit(1), F.octet_length("text") - SLICE)).cast("int")
    some = rows.where("text is not null").sample(min(1.0, SAMPLE_SLICES / max(1, n)), 5) if n > SAMPLE_SLICES else rows
    counts = np.zeros(CELLS, np.int64)
    for (text,) in some.select(F.substring(F.col("text"), at, F.lit(SLICE))).limit(2 * SAMPLE_SLICES).collect():
        buf = np.frombuffer((text or "").encode(), np.uint8)
        start, end, _ = _kernel.words(buf, np.array([0, len(buf)]), _kernel.WHITE) if kind.units == "words" else (None, None, None)
        np.add.at(counts, (_values(kind, buf, start, end) & np.uint64(CELLS - 1)).astype(np.int64), 1)
    return np.minimum(63, np.ceil(np.log2(counts + 1))).astype(np.uint8)


def judge(docs: DataFrame, kind: Kind, finish, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, then what finish(its bytes, starts and ends of its words, removed units) returns; None for starts and ends of bytes, and of a long text."""
    spark = docs.sparkSession
    rows = docs.select(exact(id_col).cast("long").alias("doc_id"), exact(text_col).alias("text"))
    whole = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(shuffle_partitions(spark), -(-(whole["bytes"] or 0) // GROUP_BYTES))
    partitions = max(shuffle_partitions(spark), min(groups, MOST_PARTITIONS))
    cells = spark.sparkContext.broadcast(_cells(rows, kind, whole["n"]))  # CELLS bytes
    dealt = rows.withColumn("groups", F.lit(groups).cast("int")).withColumn("pid", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups)).cast("int")).repartition(partitions, "pid")
    by = lambda df, *keys: df.repartition(partitions, *keys).groupBy(*keys)
    requests = dealt.groupBy("pid").applyInArrow(_request(kind, groups, cells), _REQUEST)
    again = by(requests, "bucket").applyInArrow(_find_again, _ANSWER)
    strings = dealt.groupBy("pid").cogroup(by(again, "pid")).applyInArrow(_send_strings(kind, groups, cells), _STRINGS)
    if groups <= BLOCK:  # one block: it would pass on what it gets
        answers = by(strings, "bucket").applyInArrow(_answer_windows(kind), _ANSWER)
    else:
        in_blocks = strings.repartition(partitions, "bucket", "block")
        found = by(in_blocks.groupBy("bucket", "block").applyInArrow(_combine, _STRINGS), "bucket").applyInArrow(_answer_windows(kind), _ANSWER)
        answers = in_blocks.groupBy("bucket", "block").cogroup(by(found.withColumn("block", F.col("pid")), "bucket", "block")).applyInArrow(_pass_on, _ANSWER)
    return dealt.groupBy("pid").cogroup(by(answers, "pid")).applyInArrow(_apply(kind, cells, finish, schema), schema)
