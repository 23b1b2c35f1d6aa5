"""SimHash near-dedup: fingerprints that differ in few bits, found by pigeonhole blocks.

1. A text's shingles of words, repeats included, vote with the bits of their XXH64; a bit of the fingerprint is set where
   over half of them have it. Rows of one fingerprint are one node.
2. The 64 bits are split into `distance` + 2 blocks. Fingerprints within the distance have two blocks in common at least, so
   all of them meet under one of the pairs of blocks as a key; the keys are joined on by an exchange.
3. A key of more than `FULL` fingerprints is divided: its free bits are split and met in the same way again. So a group has FULL
   fingerprints at most, or as many as its few free bits can tell apart (2**16 for a distance of 2), however large the corpus.
4. In a group, sorted, fingerprints are compared by their Hamming distance (a large one by looking up each one's neighbours);
   a spanning forest of the links leaves the task, never more rows than fingerprints. No link between different fingerprints is lost.
5. Components of all links; each row's component is the least id that links reach.

A null or empty text and one of white space has fingerprint zero, which is linked like any other. Fewer words than a shingle are one
shingle. Equal texts have equal fingerprints; repeated rows are rows of their own. A null id counts as greater than all others, a
component of null ids only is null. Other columns aren't read by `near_components`, and stay, whatever their names, in
`drop_near_copies`. A long text is read in stretches.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import _kernel
from corpusmill.llm._common import exact, free, lookup, shuffle_partitions, staged
from corpusmill.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: A key with more fingerprints is divided.
FULL = 1024
#: Fingerprints compared at a time.
BATCH = 1 << 16
_NULL_ID = (1 << 63) - 1


def _votes(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a part the number of its shingles and, for each bit, of those that have it."""
    buf = _kernel.LOWER[raw]
    start, end, first = _kernel.words(buf, offsets, _kernel.WHITE)
    texts, n = len(offsets) - 1, np.diff(first)
    mask = np.zeros(len(buf) + 1, np.int8)
    mask[start] += 1
    mask[end] -= 1
    mask = np.cumsum(mask[:-1], dtype=np.int8).view(bool)
    doc = np.repeat(np.arange(texts), n)
    gap = end[:-1][doc[1:] == doc[:-1]]
    buf[gap] = 0x20
    mask[gap] = True
    at = np.concatenate(([0], np.cumsum(mask)))
    data = buf[mask].tobytes()  # words, one space between those of a text
    size = np.minimum(shingle, n)
    count = np.where(n > 0, n - size + 1, 0)
    text, place = _kernel.ragged(count)
    head = first[:-1][text] + place
    begins, ends = at[start[head]], at[end[head + size[text] - 1]]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(data[a:b], SEED) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)), "<u8", len(head))
    votes = np.zeros((texts, 64), np.int64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = (np.cumsum(count) - count)[some]
        votes[some] = np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    return count, votes


def fingerprints_of(texts, shingle: int = SHINGLE):
    """For each text its fingerprint."""
    whole, offsets = _kernel.pack(texts)
    for a, b in _kernel.parts(offsets):
        raw = whole[offsets[a] : offsets[b]]
        if b - a == 1 and len(raw) > _kernel.PIECE:
            count, votes = np.zeros(1, np.int64), np.zeros((1, 64), np.int64)
            for number, start, _, at, stop in _kernel.stretches(raw, _kernel.WHITE, shingle - 1):
                if not number or len(start) >= shingle:
                    n, v = _votes(raw[at:stop], np.array([0, stop - at]), shingle)
                    count += n
                    votes += v
        else:
            count, votes = _votes(raw, offsets[a : b + 1] - offsets[a], shingle)
        yield from np.packbits(2 * votes > count[:, None], axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (its 64 bits as a long) of every row."""

    def work(batches):
        for batch in batches:
            found = np.array(list(fingerprints_of(batch.column(1), shingle)), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fingerprint"])
            _kernel.release()

    return docs.select(exact(id_col).cast("long").alias("id"), exact(text_col).alias("text")).mapInArrow(work, "id long, fingerprint long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(free_bits: int, distance: int) -> list[int]:
    """Masks of two blocks out of distance + 2 that the free bits are split into."""
    places = [i for i in range(64) if free_bits >> i & 1]
    parts = [sum(1 << i for i in x.tolist()) for x in np.array_split(np.array(places), distance + 2)]
    return [x | y for x, y in combinations(parts, 2)]


def _neighbours(mask: int, distance: int) -> np.ndarray:
    """Differences of at most so many bits outside of the mask."""
    places = [1 << i for i in range(64) if not mask >> i & 1]
    return np.array([sum(c) for d in range(1, distance + 1) for c in combinations(places, d)], np.uint64)


def _forest(x: np.ndarray, group: np.ndarray, mask: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of each group's fingerprints within the distance. Groups are in order, fingerprints in order within."""
    new = np.concatenate(([True], group[1:] != group[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(x)])))
    left, right = [], []
    probes: dict[int, np.ndarray] = {}
    large = np.zeros(len(x), bool)
    for a, n in zip(first[size > 256].tolist(), size[size > 256].tolist(), strict=True):
        m = int(mask[a])
        if m not in probes:
            probes[m] = _neighbours(m, distance)
        if n <= len(probes[m]):
            continue
        large[a : a + n] = True
        own = x[a : a + n]
        for d in probes[m]:
            at = np.minimum(np.searchsorted(own, own ^ d), n - 1)
            hit = np.flatnonzero((own[at] == own ^ d) & (at > np.arange(n)))
            left.append(a + hit)
            right.append(a + at[hit])
    idx, step = np.flatnonzero(~large), 1
    while len(idx):
        idx = idx[idx + step < len(x)]
        idx = idx[group[idx + step] == group[idx]]
        hit = idx[np.bitwise_count(x[idx] ^ x[idx + step]) <= distance]
        left.append(hit)
        right.append(hit + step)
        step += 1
    left, right = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (left, right))
    root = np.arange(len(x))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    moved = np.flatnonzero(root != np.arange(len(x)))
    return x[moved], x[root[moved]]


def _grouped_links(rows: DataFrame, distance: int) -> DataFrame:
    """rows: mask, value, fp. Links u, v within each (mask, value)."""

    def work(batches):
        held: list[pa.RecordBatch] = []
        waiting = 0

        def links(columns):
            mask, value, fp = columns
            new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))
            group = np.cumsum(new)
            order = np.lexsort((fp.view(np.uint64), group))
            u, v = _forest(fp.view(np.uint64)[order], group[order], mask.view(np.uint64)[order], distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        def columns():
            return [np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3)]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.num_rows
            if waiting >= BATCH:
                whole = columns()
                last = int(np.flatnonzero((whole[0] != whole[0][-1]) | (whole[1] != whole[1][-1]))[-1]) + 1 if (whole[0][0], whole[1][0]) != (whole[0][-1], whole[1][-1]) else 0
                if last:
                    yield links([c[:last] for c in whole])
                    held = [pa.RecordBatch.from_arrays([pa.array(c[last:]) for c in whole], ["mask", "value", "fp"])]
                    waiting = len(whole[0]) - last
        if waiting:
            yield links(columns())

    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "mask", "value").sortWithinPartitions("mask", "value")
    return rows.select("mask", "value", "fp").mapInArrow(work, "u long, v long")


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """distinct: fp (long), each once. Links u, v that connect whatever fingerprints within the distance do."""
    every = (1 << 64) - 1
    masks = _blocks(every, distance)
    keyed = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    counts = staged(keyed.groupBy("mask", "value").agg(F.count("*").alias("m")).where("m > 1"), "block-counts")
    met = lookup(keyed, counts, ("mask", "value"), how="inner")
    whole = met.where(F.col("m") <= FULL).select("mask", "value", "fp")
    finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(m | f)) for f in _blocks(every & ~m, distance)]))])
    divided = met.where(F.col("m") > FULL).select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
    divided = divided.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    return _grouped_links(whole.unionByName(divided), distance)


def near_components(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint and component_id (the least id that links reach) of every row."""
    null = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    rows = fingerprints(docs, shingle, id_col, text_col).select(F.coalesce("id", F.lit(_NULL_ID)).alias("id"), F.col("fingerprint").alias("fp"))
    rows = staged(rows, "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    found = staged(components(staged(links(nodes.select("fp"), distance), "hamming-links")).withColumnRenamed("node", "fp"), "components")
    linked = staged(nodes.join(found, "fp"), "linked")
    heads = staged(linked.groupBy("component").agg(F.min("least").alias("head")), "heads")
    heads = lookup(linked, heads, ("component",)).select("fp", "head")
    named = staged(nodes.join(heads, "fp", "left").select("fp", F.coalesce("head", "least").alias("component_id")), "named")
    return lookup(rows, named, ("fp",)).select(null("id").alias("id"), F.col("fp").alias("fingerprint"), null("component_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, columns as they were, without rows whose component has a lesser id. Rows of one id share their fate: all stay where one does."""
    placed = staged(near_components(docs, distance, shingle, id_col, text_col), "near")
    (own,) = free(docs, "kept_id")
    kept = placed.where("id <=> component_id").select(F.col("id").alias(own)).distinct()
    return docs.join(kept, exact(id_col).cast("long").eqNullSafe(F.col(own)), "left_semi")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """Query op13: shingles of three words, at most two differing bits."""
    out = near_components(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
