"""Token-ID output: length-delimited binary records with masked checksums, and an offset index.

`write_tokens` range-partitions documents by id, encodes them and writes one record file a
partition to a shared folder, with an index table beside them; `read_tokens` reads the files
back in order, `read_shuffled` reads records by the index in another order. A payload is
doc_id (int64), a flag byte (1: the id is null), the width of an id in bytes (2 or 4), and the ids.

Encoding works on fragments: the tokenizer's pre-tokenizer always ends a piece before a single
space that follows a non-space and precedes a byte that can't begin white space, between an ASCII letter
and most punctuation or a line feed, around a single line feed, and between East Asian letters and marks, so a text's ids are its fragments' ids in a row. Each distinct fragment is encoded by the tokenizers library once
in a worker's table (`TABLE` fragments and those of one more batch at most, then the later half is forgotten). A fragment is found by a hash and then
compared: its bytes, where it has 16 at most, are two numbers; a longer one has a number of its own in a dictionary.
A text of over `_kernel.PIECE` bytes is encoded a stretch at a time, cut where fragments end; a stretch without any such
place (a run of megabytes without space) goes on until one comes.

Defined cases: a null or empty text has only the end id; repeated rows give a record each; rows
with equal doc_id are ordered by a hash of their text; a null doc_id comes first; other columns
are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import _files, _kernel, _records
from corpusmill.llm._common import exact, new_folder, shuffle_partitions, staged, volume

TABLE = 1_500_000
FILE_BYTES = 64 << 20
#: Bytes of long fragments that a table keeps.
LONG_BYTES = 32 << 20
_SHORT = 16
#: Columns of the table: hash, low, high, length, place in the pool, number of ids.
_LENGTH, _PLACE, _SIZE = 3, 4, 5
_HEAD = struct.Struct("<qBB")
_INDEX = "part int, record long, doc_id long, offset long, n_bytes long, n_tokens long"
#: Bytes that can follow the space before which a text may be cut: not white space, nor the first byte of any.
_AFTER = np.ones(256, bool)
_AFTER[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Punctuation that no special token has after a letter, and the line feed: a piece of letters ends before it.
_STOP = np.zeros(256, bool)
_STOP[[*b"\n.,;:!?\"()$#&%*"]] = True

#: UTF-8 of runs of East Asian letters (kana, ideographs, Hangul), and of marks that no letter is joined to.
_WIDE_LETTERS = [(0xE38181, 0xE38296), (0xE382A1, 0xE383BA), (0xE4B880, 0xE9BEA5), (0xEAB080, 0xED9EA3)]
_WIDE_MARKS = [int.from_bytes(c.encode(), "big") for c in "、。「」『』！，：；？"]

#: Fragments that may stand before a line feed: no white space but a first space, and no byte that may begin any.
_joins = re.compile(rb" ?(?:[^\x00-\x20\x7f\xc2\xe1\xe2\xe3]|\xe3(?!\x80\x80))+").fullmatch


class FragmentEncoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library, each distinct fragment once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.levels: list[list[np.ndarray]] = []  # keys in order, names (_NAME columns), place and size in the pool; each level at least twice as long as the next
        self.pool, self.used = np.empty(1 << 20, np.uint16 if self.width == 2 else np.uint32), 0
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def _shrink(self) -> None:
        """Forgets long fragments, and all but the longest level, where the common fragments are, and that too if it alone fills half the table."""
        keep = self.levels[0] if self.levels else None
        if keep is not None:
            order = np.flatnonzero(keep[_LENGTH] <= _SHORT)
            if len(order) > TABLE // 2:
                order = np.sort(order[np.argsort(keep[_PLACE][order], kind="stable")[: TABLE // 2]])  # those learnt first
            keep = [x[order] for x in keep]
        if keep is None or not len(keep[0]):
            self.clear()
            return
        item, place = _kernel.ragged(keep[_SIZE])
        pool = self.pool[keep[_PLACE][item] + place]
        self.clear()
        self.pool, self.used = np.concatenate([pool, self.pool]), len(pool)
        self.levels = [[*keep[:_PLACE], np.cumsum(keep[_SIZE]) - keep[_SIZE], keep[_SIZE]]]

    def _learn(self, texts: list[bytes], names: list[np.ndarray]) -> None:
        """Encodes new fragments; keys are in order."""
        ids, size = self._encode_all(texts)
        total = len(ids)
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(total, len(self.pool) // 2), self.pool.dtype)])
        self.pool[self.used : self.used + total] = ids
        self.levels.append([*names, self.used + np.cumsum(size) - size, size])
        self.used += total
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(-2), self.levels.pop(), strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append([x[order] for x in both])

    def _encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments in a row, and how many each has. Fragments without a line feed are encoded many at once with a
        line feed after each, which is one id that no other bytes have; it ends any piece before it and takes nothing after it."""
        size = np.zeros(len(texts), np.int64)
        found: list[np.ndarray] = []
        plain = np.fromiter((_joins(x) is not None for x in texts), bool, len(texts))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        joined = [texts[i] for i in order[: plain.sum()].tolist()]
        for at in range(0, len(joined), 8192):
            some = joined[at : at + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([(b"\n".join(some) + b"\n").decode("utf-8", "replace")], add_special_tokens=False)[0].ids, self.pool.dtype)
            ends = np.flatnonzero(ids == self.feed)
            assert len(ends) == len(some)
            size[order[at : at + len(some)]] = np.diff(ends, prepend=-1) - 1
            found.append(ids[ids != self.feed])
        alone = order[plain.sum() :]
        encoded = [np.array(x.ids, self.pool.dtype) for x in self.tokenizer.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in alone.tolist()], add_special_tokens=False)] if len(alone) else []
        size[alone] = [len(x) for x in encoded]
        ids = np.concatenate([*found, *encoded]) if found or encoded else self.pool[:0]
        starts = np.cumsum(size[order]) - size[order]
        place = np.empty(len(texts), np.int64)
        place[order] = starts
        item, at = _kernel.ragged(size)
        return ids[place[item] + at], size

    def _find(self, names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and size in the pool of the fragments with these names, and whether each is known."""
        n = len(names[0])
        at, size, found = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for level in self.levels:
            left = np.flatnonzero(~found)
            i = np.minimum(np.searchsorted(level[0], names[0][left]), len(level[0]) - 1)
            hit = _same([x[i] for x in level[:_PLACE]], [x[left] for x in names])
            at[left[hit]], size[left[hit]], found[left[hit]] = level[_PLACE][i[hit]], level[_SIZE][i[hit]], True
        return at, size, found

    def _names(self, buf: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
        """For each fragment a hash, and what tells it from all others: its bytes as two numbers, and its length; or its number among long ones."""
        start, n = edges[:-1], np.diff(edges)
        eight = _kernel.eights(buf)
        low = eight[start] & _kernel.MASK[np.minimum(n, 8)]
        high = eight[start + 8 * (n > 8)] & _kernel.MASK[np.clip(n - 8, 0, 8)]
        length = np.minimum(n, _SHORT + 1).astype(np.uint8)
        for i in np.flatnonzero(n > _SHORT).tolist():
            text = buf[edges[i] : edges[i + 1]].tobytes()
            known = len(self.long)
            low[i], high[i] = self.long.setdefault(text, known), 0
            self.long_bytes += len(text) if len(self.long) > known else 0
        return [_kernel.mix(_kernel.join(_kernel.mix(low), high) + length.astype(np.uint64)), low, high, length]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's range in them (n + 1)."""
        if not len(buf):
            return self.pool[:0], np.zeros(len(offsets), np.int64)
        if sum(len(x[0]) for x in self.levels) > TABLE or self.long_bytes > LONG_BYTES:
            self._shrink()
        cut = _cuts(buf)
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        names = self._names(buf, edges)
        _, first, back = np.unique(names[0], return_index=True, return_inverse=True)
        unique = [x[first] for x in names]
        at, size, found = self._find(unique)
        if not found.all():
            new = first[~found]
            self._learn([buf[a:b].tobytes() for a, b in zip(edges[new].tolist(), edges[new + 1].tolist(), strict=True)], [x[~found] for x in unique])
            at, size, found = self._find(unique)
        if not found.all() or not _same([x[back] for x in unique], names).all():  # different fragments with one hash
            ids, size = self._encode_all([buf[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return ids, np.concatenate(([0], np.cumsum(size)))
        at, size = at[back], size[back]
        item, place = _kernel.ragged(size)
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.pool[at[item] + place], ends[np.searchsorted(edges, offsets)]

    def encode_long(self, text: np.ndarray) -> np.ndarray:
        """The ids of one text, encoded a stretch at a time."""
        found, at, piece = [], 0, max(16, _kernel.PIECE)
        while at < len(text):
            stop = min(len(text), at + piece)
            while stop < len(text):
                # a cut depends on at most five bytes before it and four after; the last of the stretch that has all of them
                first = max(at, stop - piece)
                cuts = np.flatnonzero(_cuts(text[first:stop])[:-4]) + first
                cuts = cuts[cuts > first + 5]
                if len(cuts):
                    stop = int(cuts[-1])
                    break
                stop = min(len(text), stop + piece - 8)
            found.append(self.encode(text[at:stop], np.array([0, stop - at]))[0])
            at = stop
        return np.concatenate(found)


def _cuts(buf: np.ndarray) -> np.ndarray:
    """Whether a text may be cut before each byte (n + 1)."""
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf) > 2:
        feed, letter, solid = buf == 0x0A, _LETTER[buf], _kernel.WHITE[buf]
        cut[1 : len(buf) - 1] = (buf[1:-1] == 0x20) & solid[:-2] & _AFTER[buf[2:]]
        cut[1 : len(buf)] |= _STOP[buf[1:]] & letter[:-1]
        cut[1 : len(buf)] |= feed[1:] & _STOP[buf[:-1]] & solid[:-1]
        cut[2 : len(buf)] |= feed[1:-1] & solid[:-2] & letter[2:]
    if len(buf) > 6 and (buf >= 0x80).any():
        _cut_wide(buf, cut)
    return cut


def _cut_wide(buf: np.ndarray, cut: np.ndarray) -> None:
    """Adds the cuts around a single line feed between characters of any script that are no white space, and between East Asian letters and marks."""
    three = (buf[:-2].astype(np.uint32) << 16) | (buf[1:-1].astype(np.uint32) << 8) | buf[2:]
    two, wide, four = (buf >= 0xC3) & (buf <= 0xDF), (buf >= 0xE4) & (buf <= 0xEF), (buf >= 0xF0) & (buf <= 0xF4)  # first bytes of characters that are no white space
    wide[:-2] |= (buf[:-2] == 0xE3) & (three != 0xE38080)
    plain = (buf > 0x20) & (buf < 0x7F)
    ends = plain.copy()  # a character that is no white space ends here
    ends[1:] |= two[:-1]
    ends[2:] |= wide[:-2]
    ends[3:] |= four[:-3]
    begins = plain | two | wide | four
    feed = np.flatnonzero((buf[1:-1] == 0x0A) & ends[:-2] & begins[2:]) + 1
    cut[feed] = cut[feed + 1] = True
    letter = np.zeros(len(three), bool)
    for low, high in _WIDE_LETTERS:
        letter |= (three >= low) & (three <= high)
    mark = np.isin(three, _WIDE_MARKS)
    cut[3 : len(three)] |= (letter[:-3] & mark[3:]) | (mark[:-3] & letter[3:])


def _same(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    out = a[0] == b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out &= x == y
    return out


@functools.lru_cache(1)
def encoder(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def _payloads(ids: np.ndarray, ranges: np.ndarray, doc_ids: list, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width, counts = ids.itemsize, np.diff(ranges) + 1
    offsets = np.concatenate(([0], np.cumsum(counts * width + _HEAD.size)))
    body = np.empty(int(offsets[-1]), np.uint8)
    raw, end = ids.view(np.uint8), np.array([end_id], ids.dtype).view(np.uint8)
    for i, doc_id in enumerate(doc_ids):
        at = int(offsets[i])
        body[at : at + _HEAD.size] = np.frombuffer(_HEAD.pack(doc_id or 0, doc_id is None, width), np.uint8)
        stop = int(offsets[i + 1])
        body[at + _HEAD.size : stop - width] = raw[ranges[i] * width : ranges[i + 1] * width]
        body[stop - width : stop] = end
    return body, offsets, counts


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Writes record files part-NNNNN.rec below folder in ascending id order and returns their index table, itself a Parquet table in the shared folder."""
    rows = docs.select(exact(id_col).cast("long").alias("doc_id"), exact(text_col).alias("text"))
    files = files or max(shuffle_partitions(docs.sparkSession), -(-volume(rows, "text") // FILE_BYTES))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie"))

    def write(batches):
        part, record, offset, out, encode = TaskContext.get().partitionId(), 0, 0, None, encoder(tokenizer)
        for batch in batches:
            if batch.num_rows and out is None:
                out = _files.Whole(f"{folder}/part-{part:05d}.rec")
            buf, offsets = _kernel.pack(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for a, b in _kernel.parts(offsets, _kernel.PIECE):
                if offsets[b] - offsets[a] > _kernel.PIECE:
                    ids = encode.encode_long(buf[offsets[a] : offsets[b]])
                    ranges = np.array([0, len(ids)])
                else:
                    ids, ranges = encode.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                body, at, counts = _payloads(ids, ranges, doc_ids[a:b], end_id)
                data, starts = _records.frame(body, at)
                out.write(data)
                n = b - a
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(record, record + n)), pa.array(doc_ids[a:b], pa.int64()), pa.array(offset + starts[:-1]), pa.array(np.diff(starts)), pa.array(counts)], ["part", "record", "doc_id", "offset", "n_bytes", "n_tokens"])
                record, offset = record + n, offset + len(data)
            _kernel.release()
        if out is not None:
            out.close()

    return staged(rows.select("doc_id", "text").mapInArrow(write, _INDEX), "token-index")


def _decode(body: np.ndarray, start: int, end: int) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = _HEAD.unpack(body[start : start + _HEAD.size])
    return None if null else doc_id, body[start + _HEAD.size : end].view(f"<u{width}") if (start + _HEAD.size) % width == 0 else np.frombuffer(body[start + _HEAD.size : end].tobytes(), f"<u{width}")


def _crc32(tokens: np.ndarray) -> int:
    out = 0
    for at in range(0, len(tokens), 1 << 20):
        out = zlib.crc32(tokens[at : at + (1 << 20)].astype("<u4"), out)
    return out


def read_tokens(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record, read from the files in order: doc_id, start (ids before it), n_tokens, ids_crc32 (over the ids as uint32)."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each file
    starts, base = [], 0
    for t in totals:
        starts.append((t["part"], base))
        base += t["n"]

    def read(batches):
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = _files.store(f"{folder}/part-{part:05d}.rec")
                done = base
                with fs.open_input_stream(path) as stream:
                    for body, a, b in _records.stream_records(stream):
                        ids, first, count, crc = [], [], [], []
                        for x, y in zip(a.tolist(), b.tolist(), strict=True):
                            doc_id, tokens = _decode(body, x, y)
                            ids.append(doc_id)
                            first.append(done)
                            count.append(len(tokens))
                            crc.append(_crc32(tokens))
                            done += len(tokens)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, first, count, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(starts, "part int, base long").repartition(max(1, len(starts)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(spark: SparkSession, folder: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """Records fetched through the index, in an order that depends on the seed alone: doc_id, ids array.

    A batch of records is read file by file, each opened once a task (`_records.OPEN` at most at a time), neighbours in one read; then it is put in order.
    """
    order = index.withColumn("o", F.xxhash64(F.lit(seed), "part", "record"))
    order = order.repartitionByRange(shuffle_partitions(spark), "o").sortWithinPartitions("o").select("part", "offset", "n_bytes")

    def read(batches):
        with _records.Files(lambda part: f"{folder}/part-{part:05d}.rec") as files:
            for batch in batches:
                part, at, n = (batch.column(c).to_numpy().astype(np.int64) for c in range(3))
                for x, y in _kernel.parts(np.concatenate(([0], np.cumsum(n))), 8 << 20):
                    ids, tokens = [], []
                    for record in files.fetch(part[x:y], at[x:y], n[x:y]):
                        body, a, b, _ = _records.unframe(record)
                        doc_id, own = _decode(body, int(a[0]), int(b[0]))
                        ids.append(doc_id)
                        tokens.append(own.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return order.mapInArrow(read, "doc_id long, ids array<int>")


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Query op1: all documents written as records with the 50k byte-level vocabulary, and read back."""
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    index = write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder, index)
