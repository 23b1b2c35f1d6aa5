"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut into paragraphs at line feeds, and a long paragraph into pieces at spaces that its own bytes
choose, and more rarely between any two characters, so an edit moves no cut elsewhere and text without spaces has leaves too. A section is a run of pieces that ends after a piece whose hash says
so. Leaves are the pieces' hashes, a section's node is the hash of its leaves, and the root that of the
sections and the length, all 128 bits of BLAKE2b, so roots test equality. A fingerprint is a string: the root in hex, then sections and leaves
(32 bits each) in base64; `differing` compares two trees from the sections down and tells which leaves differ, and
`likeness` is the share of leaves that both have. A long text is cut and hashed a stretch at a time.

Defined cases: a null text is an empty one (no leaves); two empty texts have likeness 1; a null id counts as the
smallest; rows with equal ids, null too, follow each other by a hash of their text, and are dealt to several tasks where they are many; identical rows are each other's next;
a single row is its own next; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import difflib
import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import _kernel
from corpusmill.llm._common import exact, shuffle_partitions

#: A space ends a piece once in so many, any other character once in so many, a piece ends a section once in so many.
PIECE, ANYWHERE, SECTION = 8, 64, 16
_CONTEXT = 6
_DIGEST = 16
_LOW = -(1 << 63)


def _choices(buf: np.ndarray) -> np.ndarray:
    """Whether a text may be cut before each byte (n), by the _CONTEXT bytes before it and itself; places with fewer bytes before them are not told."""
    cut = np.zeros(len(buf), bool)
    if len(buf) > _CONTEXT:
        choice = _kernel.byte_grams(buf, _CONTEXT)[:-1]
        whole = buf[_CONTEXT:] & 0xC0 != 0x80  # no character is cut
        cut[_CONTEXT:] = ((choice % np.uint64(PIECE) == 0) & (buf[_CONTEXT - 1 : -1] == 0x20)) | ((choice % np.uint64(ANYWHERE) == 0) & whole)
    return cut


def _leaf(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=_DIGEST).digest()


def _short_leaves(buf: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Digests of all leaves of some texts, one after the other, and each text's first leaf (n + 1)."""
    cut = np.zeros(len(buf) + 1, bool)
    cut[:-1] = _choices(buf)
    near = offsets[:-1, None] + np.arange(_CONTEXT)  # a cut never depends on another document's bytes
    cut[near[near <= len(buf)]] = False
    cut[1:][buf == 0x0A] = True
    cut[offsets] = True
    edges, data = np.flatnonzero(cut), buf.tobytes()
    return b"".join([_leaf(data[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]), np.searchsorted(edges, offsets)


def _long_leaves(segments: list[np.ndarray]) -> bytes:
    """The same of one text, given in segments."""
    out, leaf, before, at, open_ = [], hashlib.blake2b(digest_size=_DIGEST), np.empty(0, np.uint8), 0, False
    for segment in segments:
        for x in range(0, len(segment), _kernel.PIECE):
            buf = np.concatenate([before, segment[x : x + _kernel.PIECE]])
            own = len(before)
            cut = _choices(buf)
            cut[: max(0, own - at + _CONTEXT)] = False
            cut[1:] |= buf[:-1] == 0x0A
            places = np.flatnonzero(cut[own:]) + own
            data = buf.tobytes()
            if len(places):
                if places[0] > own or open_:
                    leaf.update(data[own : places[0]])
                    out.append(leaf.digest())
                out += [_leaf(data[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                out = [b"".join(out)]
                leaf = hashlib.blake2b(digest_size=_DIGEST)
            leaf.update(data[places[-1] if len(places) else own :])
            open_ = True
            at += len(buf) - own
            before = buf[-_CONTEXT:]
    return b"".join([*out, leaf.digest()]) if open_ else b""


class Trees:
    """Leaves, sections and roots of some texts, each given as str or as segments of bytes."""

    def __init__(self, texts: list):
        docs = [[np.frombuffer(t.encode(), np.uint8)] if isinstance(t, str) else t for t in texts]
        self.lengths = np.array([sum(map(len, d)) for d in docs], np.int64)
        raw, counts, i = [], [np.zeros(1, np.int64)], 0
        while i < len(docs):
            if self.lengths[i] > _kernel.PIECE:
                raw.append(_long_leaves(docs[i]))
                counts.append(np.array([len(raw[-1]) // _DIGEST]))
                i += 1
                continue
            j, size = i, 0
            while j < len(docs) and size <= _kernel.PIECE and self.lengths[j] <= _kernel.PIECE:
                size += int(self.lengths[j])
                j += 1
            offsets = np.concatenate(([0], np.cumsum(self.lengths[i:j])))
            leaves, first = _short_leaves(np.concatenate([s for d in docs[i:j] for s in d] or [np.empty(0, np.uint8)]), offsets)
            raw.append(leaves)
            counts.append(np.diff(first))
            i = j
        self.raw = b"".join(raw)
        self.leaves = np.frombuffer(self.raw, "<u8")[::2]
        self.first = np.cumsum(np.concatenate(counts))  # each document's leaves
        stop = np.zeros(len(self.leaves) + 1, bool)
        stop[1:] = self.leaves % np.uint64(SECTION) == 0
        stop[self.first] = True
        at = np.flatnonzero(stop)
        self.sections = b"".join([_leaf(self.raw[_DIGEST * a : _DIGEST * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        self.sizes = np.diff(at)
        self.first_section = np.searchsorted(at, self.first)

    def fingerprint(self, i: int) -> str:
        a, b = int(self.first_section[i]), int(self.first_section[i + 1])
        sections = self.sections[_DIGEST * a : _DIGEST * b]
        root = _leaf(sections + int(self.lengths[i]).to_bytes(8, "little")).hex()
        parts = (np.frombuffer(sections, "<u4")[:: _DIGEST // 4], self.sizes[a:b], self.leaves[self.first[i] : self.first[i + 1]] & np.uint64(0xFFFFFFFF))
        return ".".join([root, *(base64.b64encode(x.astype("<u4").tobytes()).decode() for x in parts)])

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these documents, numbered from 0: distinct (number, leaf), how often each, and each one's number of leaves."""
        n = self.first[which + 1] - self.first[which]
        item, place = _kernel.ragged(n)
        leaves = self.leaves[self.first[which][item] + place] & np.uint64(0xFFFFFFFF)
        keys, counts = np.unique((item.astype(np.uint64) << np.uint64(32)) | leaves, return_counts=True)
        return keys, counts, n


def _characters(text: np.ndarray) -> int:
    return sum(int(np.count_nonzero(text[x : x + _kernel.PIECE] & 0xC0 != 0x80)) for x in range(0, len(text), _kernel.PIECE))


def _place(text: np.ndarray, k: int) -> int:
    """Where character k begins; the end where there are no more."""
    for x in range(0, len(text), _kernel.PIECE):
        heads = np.flatnonzero(text[x : x + _kernel.PIECE] & 0xC0 != 0x80)
        if k < len(heads):
            return x + int(heads[k])
        k -= len(heads)
    return len(text)


def _likeness(a: tuple, b: tuple) -> np.ndarray:
    keys, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.bincount((keys >> np.uint64(32)).astype(np.int64), np.minimum(a[1][x], b[1][y]), len(a[2]))
    total = a[2] + b[2]
    return np.where(total > 0, 2 * both / np.maximum(total, 1), 1.0)


def _parts(fingerprint: str) -> tuple[str, list[int], list[int], list[int]]:
    root, *rest = fingerprint.split(".")
    return root, *(np.frombuffer(base64.b64decode(x), "<u4").tolist() for x in rest)


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common, 0 to 1."""
    x, y = (np.sort(_parts(f)[3]) for f in (a, b))
    if not len(x) and not len(y):
        return 1.0
    (u, m), (v, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return float(2 * np.minimum(m[i], n[j]).sum() / (len(x) + len(y)))


def differing(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where two trees differ: leaves [i, j) of a stand for leaves [k, l) of b. Only branches under differing sections are opened."""
    (root, sections, sizes, leaves), (other_root, other, other_sizes, other_leaves) = _parts(a), _parts(b)
    if root == other_root:
        return []
    at, other_at = np.concatenate(([0], np.cumsum(sizes))).astype(int), np.concatenate(([0], np.cumsum(other_sizes))).astype(int)
    out = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, sections, other, autojunk=False).get_opcodes():
        if tag != "equal":
            p, q, r, s = int(at[i]), int(at[j]), int(other_at[k]), int(other_at[m])
            inner = difflib.SequenceMatcher(None, leaves[p:q], other_leaves[r:s], autojunk=False).get_opcodes()
            out += [(p + u, p + v, r + x, r + y) for t, u, v, x, y in inner if t != "equal"]
    return out


def _emit(rows: list[tuple]) -> pa.RecordBatch | None:
    """Rows (bucket, ahead, id, text) in order: a result for each that has a successor in its bucket and is no look-ahead itself."""
    at = np.array([i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]], np.int64)
    if not len(at):
        return None
    trees = Trees([[r[3]] for r in rows])
    edited, n_chars, digests = [], [], []
    for i in at.tolist():
        text, following = rows[i][3], rows[i + 1][3]
        n_chars.append(_characters(text))
        half = n_chars[-1] // 2
        edited.append([text[: _place(text, n_chars[-1] - half)], following[: _place(following, half)]])
        digest = hashlib.sha256(edited[-1][0])
        digest.update(edited[-1][1])
        digests.append(digest.hexdigest())
    after = Trees(edited)
    own = trees.keys(at)
    columns = [
        pa.array([rows[i][2] for i in at.tolist()], pa.int64()),
        pa.array(n_chars, pa.int64()),
        pa.array(digests),
        pa.array([trees.fingerprint(i) for i in at.tolist()]),
        pa.array([after.fingerprint(i) for i in range(len(edited))]),
        pa.array(_likeness(own, after.keys(np.arange(len(edited))))),
        pa.array(_likeness(own, trees.keys(at + 1))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _follow(batches):
    """Streams rows in order of bucket; a few texts are in memory at a time."""
    rows, size = [], 0
    for batch in batches:
        buf, offsets = _kernel.pack(batch.column(3))
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            rows.append((*row, buf[offsets[i] : offsets[i + 1]]))
            size += len(rows[-1][3])
            if size > _kernel.PIECE:
                if (out := _emit(rows)) is not None:
                    yield out
                rows, size = [(*rows[-1][:3], rows[-1][3].copy())], 0
        rows = [(*r[:3], r[3].copy()) for r in rows]  # the batch goes
    if (out := _emit(rows)) is not None:
        yield out
    _kernel.release()


def _bounds(quantiles: list[int]) -> list[tuple[int, int]]:
    """Bounds (key, tie) between buckets; a key that is several quantiles is divided by its ties."""
    times = Counter(quantiles)
    return sorted((key, _LOW + (j << 64) // n) for key, n in times.items() for j in range(n))


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last half replaced by the start of the next document's, in descending order of id).

    Texts are moved once: buckets are ranges of ids, and each bucket's first document also goes to the bucket before, as a look-ahead.
    """
    spark = docs.sparkSession
    rows = docs.select(exact(id_col).cast("long").alias("doc_id"), exact(text_col).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LOW))).withColumn("tie", F.bitwise_not(F.xxhash64("text")))
    buckets = 4 * shuffle_partitions(spark)
    bounds = _bounds((rows.select(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 100 * buckets)).first() or [None])[0] or [])
    keys, ties = (np.array([b[i] for b in bounds], np.int64) for i in range(2))

    @F.pandas_udf("int")
    def bucket(key: pd.Series, tie: pd.Series) -> pd.Series:
        key, tie = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        for x in np.unique(first[last > first]).tolist():
            own = (first == x) & (last > first)
            first[own] += np.searchsorted(ties[x : int(np.searchsorted(keys, keys[x], "right"))], tie[own], "right")
        return pd.Series(first.astype(np.int32))

    rows = rows.withColumn("bucket", bucket("key", "tie"))
    heads = rows.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head")).orderBy("bucket").collect()  # a row for each bucket
    # a bucket's first document goes to the bucket before, in descending order; the greatest of all to the last
    ahead = [(h["head"]["key"], h["head"]["tie"], heads[(i + 1) % len(heads)]["bucket"]) for i, h in enumerate(heads)]
    rows = rows.join(F.broadcast(spark.createDataFrame(ahead, "key long, tie long, to int")), ["key", "tie"], "left")
    own, other = F.struct("bucket", F.lit(False).alias("ahead")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("ahead"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("to").isNotNull(), F.array(own, other)).otherwise(F.array(own))))
    rows = rows.select("place.bucket", "place.ahead", "doc_id", "text", "key", "tie").repartition(shuffle_partitions(spark), "bucket")
    rows = rows.sortWithinPartitions("bucket", "ahead", F.col("key").desc(), F.col("tie").desc()).select("bucket", "ahead", "doc_id", "text")
    return rows.mapInArrow(_follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
