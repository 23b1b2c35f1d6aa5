"""MinHash near-dedup with bottom-k sketches from one hash function.

1. A document's set is its distinct shingles of words, hashed to 64 bits; its sketch is the `K` least hashes. Documents
   with equal sets are one class, a node of the graph with a number of its own; its row of least id stands for its text.
2. Inverted lists of retained values give overlaps. A pair at the threshold shares at least `SHARED` of its values but
   for a chance of under 1e-6, so, with values in order of rarity, it shares one of each side's rarest K - SHARED + 1:
   only these are listed, and a class that shares fewer with all others has no list.
3. Lists of at most `SHORT_LIST` classes give all their pairs (so a class never has more than that from a list); the union
   sketch's estimate filters them, and the exact Jaccard on full sets verifies what is left.
4. Longer lists (a common passage, many copies) would give pairs with the square of their length. Their members are listed
   anew under the `LEAST` least hashes of their whole sets (a pair at the threshold shares none of them with a chance of 6e-8), but
   for documents of which too much is their own to be linked at all. Each member meets the hub of its list and band of
   sizes, the one with the least of its own; the estimate and the verification follow as before, and links give components.
   Pairs still in different components are compared on whole sets, once, in blocks of a list, unless their sizes or what they can
   share at most rule them out; only links leave the task.
5. Components of all links; the row of least id of each stays, of equal ids that of the least hash of its text.

Hot lists and classes are only ever aggregated, broadcast (a bounded number of them), dealt out by shares or cut in blocks.

Defined cases: a null text or one without words has an empty set, is its own component and linked with nothing; with fewer
words than a shingle the whole sequence is the one shingle; rows with equal ids and different texts are documents of their own, of which
each has its own component; rows equal in id and text are one document, kept or dropped together; a null id counts as the greatest, and
component_id is null where a component has no other; other columns are kept by `drop_near_copies`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm import _kernel
from corpusmill.llm._common import exact, free, shuffle_partitions, staged
from corpusmill.llm.components import components

K, SHARED, SHINGLE = 48, 20, 5
#: Lists of at most so many members give all their pairs; longer ones are compared in blocks of BLOCK.
SHORT_LIST, BLOCK = 24, 512
#: Whole sets of members of long lists meet under so many least hashes; a pair at the threshold shares none with a chance of 0.25**12.
LEAST = 12
_NULL_ID = (1 << 63) - 1
#: Pairs of one class that are verified in one place; a key with a greater share of the rows than one in so many is hot.
SHARE, HOT = 64, 1000
#: Ids that are broadcast at most (32 MB); more are joined by a shuffle of the texts.
FEW_IDS = 4_000_000


def _shingles(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of all runs of so many words; of fewer words, of the whole sequence."""
    return _kernel.grams(hashes, min(shingle, len(hashes))) if len(hashes) else hashes


def _united(found: np.ndarray, more: list[np.ndarray]) -> np.ndarray:
    """The union of sets in order, in little more room than they take."""
    out = np.concatenate([found, *more])
    more.clear()
    out.sort(kind="stable")  # merges runs
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    return out[new]


def shingle_sets(texts, shingle: int = SHINGLE):
    """For each text its distinct shingle hashes, in order; a long text is read in stretches."""
    whole, offsets = _kernel.pack(texts)
    for a, b in _kernel.parts(offsets):
        raw = whole[offsets[a] : offsets[b]]
        if b - a == 1 and len(raw) > _kernel.PIECE:
            found, more, waiting = np.empty(0, np.uint64), [], 0
            for number, start, end, at, stop in _kernel.stretches(raw, _kernel.WHITE, shingle - 1):
                if not number or len(start) >= shingle:
                    more.append(np.unique(_shingles(_kernel.word_hashes(_kernel.LOWER[raw[at:stop]], start, end), shingle)))
                    waiting += len(more[-1])
                    if waiting > max(len(found) // 4, _kernel.PIECE):
                        found, more, waiting = _united(found, more), [], 0
            yield _united(found, more)
            continue
        buf = _kernel.LOWER[raw]
        start, end, first = _kernel.words(buf, offsets[a : b + 1] - offsets[a], _kernel.WHITE)
        words = _kernel.word_hashes(buf, start, end) if len(start) else np.empty(0, np.uint64)
        hashes = _kernel.grams(words, shingle)
        for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(hashes[x : y - shingle + 1]) if y - x >= shingle else _shingles(words[x:y], shingle)


def sketches(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rows: id, ref, text. id, ref, n (size of the set), key (names the set), sketch (its K least hashes, as signed longs)."""

    def run(batches):
        for batch in batches:
            n, keys, least = [], [], []
            for s in shingle_sets(batch.column(2), shingle):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                least.append(s[:K].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["id", "ref", "n", "key", "sketch"])
            _kernel.release()

    return rows.select("id", "ref", "text").mapInArrow(run, "id long, ref long, n long, key binary, sketch array<long>")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """classes: id, n, sketch. v, id, n: each class under its rarest shared values, as far as a linked class must share one."""
    entries = classes.select("id", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    common = entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = entries.join(common, "v")
    own = Window.partitionBy("id")  # K rows at most
    least = F.greatest(F.lit(1), F.floor(F.col("kept") * SHARED / K))
    shared = shared.withColumn("rank", F.row_number().over(own.orderBy("df", "v"))).withColumn("m", F.count("*").over(own))
    return shared.where(F.col("rank") <= F.col("m") - least + 1).select("v", "id", "n")


def _pairs(found: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b whose sizes allow the similarity."""
    sizes = (F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent) & (F.col("id") != F.col("other"))
    return found.where(sizes).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the union sketch doesn't rule out; sure: both sketches are whole sets, so the answer is exact."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.array_intersect("s_a", "s_b")
    p = p.withColumn("i", F.size(both)).withColumn("sure", (F.col("n_a") <= K) & (F.col("n_b") <= K))
    linked = F.col("i") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("i")) * percent
    # of the union's K least values (unsigned order, the sketches' own), those that both have
    unsigned = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))
    union = F.slice(F.array_sort(unsigned(F.array_union("s_a", "s_b"))), 1, K)
    p = p.withColumn("matches", F.size(F.array_intersect(union, unsigned(both)))).withColumn("of", F.size(union))
    return p.where(F.when(F.col("sure"), linked).otherwise(F.col("matches") * K >= F.col("of") * SHARED)).select("a", "b", "sure")


def _ref(id_: Column, text: Column) -> Column:
    """Tells rows of different ids or texts apart."""
    return F.xxhash64(id_, text)


def _texts(rows: DataFrame, ids: DataFrame, classes: DataFrame) -> DataFrame:
    """id, text of the classes with these ids, each id once."""
    wanted = staged(ids.join(classes.select("id", "ref"), "id"), "ids")
    few = wanted.count() <= FEW_IDS
    return rows.select("ref", "text").join(F.broadcast(wanted) if few else wanted, "ref").select("id", "text").dropDuplicates(["id"])


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links u, v: the pairs that are sure, and those whose full sets are similar enough."""
    open_ = pairs.where(~F.col("sure")).select("a", "b")
    members = open_.select(F.col("a").alias("id")).unionByName(open_.select(F.col("b").alias("id"))).distinct()
    texts = _texts(rows, members, classes)
    # a hub has a pair with each member of its list: its text goes to as many places as its pairs need
    degrees = open_.groupBy("a").agg(F.count("*").alias("degree")).withColumn("shares", F.ceil(F.col("degree") / SHARE).cast("int"))
    degrees = staged(degrees.select("a", "shares"), "degrees")
    salted = open_.join(degrees, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")).drop("shares")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("t_a")).join(degrees, "a").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    joined = salted.join(texts.select(F.col("id").alias("b"), F.col("text").alias("t_b")), "b").join(left, ["a", "share"])

    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for t in range(0, batch.num_rows, 256):
                left, last, last_text = [], None, None
                texts_a = batch.column(2).slice(t, 256).to_pylist()
                other = shingle_sets(batch.column(3).slice(t, 256), shingle)
                for x in texts_a:  # a centre's text comes many times in a row
                    if last is None or x != last_text:
                        (last,) = shingle_sets(pa.array([x], pa.string()), shingle)
                        last_text = x
                    left.append(last)
                for x, y in zip(left, other, strict=True):
                    i = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(i * 100 >= (len(x) + len(y) - i) * percent)
            yield pa.RecordBatch.from_arrays([a, b], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
            _kernel.release()

    exact_links = joined.select("a", "b", "t_a", "t_b").mapInArrow(run, "u long, v long")
    return pairs.where("sure").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(exact_links)


def _whole_sets(rows: DataFrame, ids: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """id, v: every shingle hash of the documents with these ids."""
    texts = _texts(rows, ids, classes)

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["id", "shingles"])
            _kernel.release()

    return texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def _least_lists(sets: DataFrame, percent: int) -> DataFrame:
    """v, id, n, s, keys: each document under the LEAST least hashes (keys) of its whole set.

    n is the size of the set, s how many of it any other of these documents has; a document that shares too little
    with all the others has no list.
    """
    entries = sets.select("id", F.explode("shingles").alias("v"))
    alone = entries.groupBy("v").agg(F.count("*").alias("df"), F.min("id").alias("id")).where("df = 1").groupBy("id").agg(F.count("*").alias("own"))
    sized = sets.select("id", F.size("shingles").cast("long").alias("n"), F.slice("shingles", 1, LEAST).alias("keys")).join(alone, "id", "left")
    sized = sized.withColumn("s", F.col("n") - F.coalesce("own", F.lit(0))).where(F.col("s") * 100 >= F.col("n") * percent)
    return sized.select(F.explode("keys").alias("v"), "id", "n", "s", "keys")


def _may_link(n, s, other_n, other_s, percent: int):
    """Whether what both can share at most would make them similar enough."""
    most = F.least(s, other_s)
    return most * 100 >= (n + other_n - most) * percent


def _band(n: Column, percent: int) -> Column:
    """Bands of sizes: sizes that allow a link are in one band or in two beside each other."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")


def _hubs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of each member with the hub of its list and band of sizes and of the bands beside: the one with the least that no other has."""
    banded = lists.withColumn("band", _band(F.col("n"), percent))
    hubs = banded.groupBy("v", "band").agg(F.min(F.struct((F.col("n") - F.col("s")).alias("own"), F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("s").alias("other_s"))).alias("h")).select("v", "band", "h.*")
    hubs = staged(hubs, "hubs")  # a table of its own, so that Spark can split the join of a long list
    near = banded.select("v", "id", "n", "s", F.explode(F.array("band", F.col("band") - 1, F.col("band") + 1)).alias("band"))
    met = near.join(hubs, ["v", "band"]).where(_may_link(F.col("n"), F.col("s"), F.col("other_n"), F.col("other_s"), percent))
    return met.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _block_links(lists: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links u, v across components in lists with members in several: blocks of members meet in tasks, which compare whole sets and emit links only.

    A list is cut by size first: a band's blocks meet each other and those of the next band, and only bands with members of
    several components between them are looked at.
    """
    placed = lists.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    placed = staged(placed.withColumn("band", _band(F.col("n"), percent)), "placed-whole")
    whole = placed.groupBy("v").agg(F.count("*").alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("members_2"))
    whole = whole.groupBy("m", "members", "members_2").agg(F.min("v").alias("v")).select("v")  # lists of the same members stand for each other
    bands = placed.join(whole, "v", "left_semi").groupBy("v", "band").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    bands = staged(bands.withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int")), "bands")
    after = bands.select("v", (F.col("band") - 1).alias("band"), F.col("nb").alias("next_nb"), F.col("x").alias("next_x"), F.col("y").alias("next_y"))
    inside = bands.where("x <> y").select("v", "band", F.lit(0).alias("step"), "nb", F.col("nb").alias("other_nb"))
    across = bands.join(after, ["v", "band"]).where("least(x, next_x) <> greatest(y, next_y)").select("v", "band", F.lit(1).alias("step"), "nb", F.col("next_nb").alias("other_nb"))
    meetings = staged(inside.unionByName(across), "meetings")  # a row for each band of a list, and each two of them
    columns = ("v", "id", "n", "s", "keys", "comp")

    def block(nb: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(nb)).cast("int")

    # x <= y within a band; across bands every block of one meets every block of the other
    own = placed.join(meetings.where("step = 0"), ["v", "band"]).withColumn("i", block("nb")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    own = own.select(*columns, "band", "step", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), F.col("i").alias("block"))
    lower = placed.join(meetings.where("step = 1"), ["v", "band"]).withColumn("x", block("nb")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("other_nb") - 1)))
    upper = placed.withColumn("band", F.col("band") - 1).join(meetings.where("step = 1"), ["v", "band"]).withColumn("y", block("other_nb")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = own.unionByName(lower.select(*columns, "band", "step", "x", "y", F.lit(0).alias("block"))).unionByName(upper.select(*columns, "band", "step", "x", "y", F.lit(1).alias("block")))
    rows = rows.join(sets, "id")

    def compare(key: int, group: list[tuple]) -> list[tuple[int, int]]:
        ids, n, s, comp, block, keys, arrays = (list(x) for x in zip(*group, strict=True))
        n, s, comp, block = (np.array(x) for x in (n, s, comp, block))
        most = np.minimum(s[:, None], s)
        open_ = (comp[:, None] != comp) & (most * 100 >= (n[:, None] + n - most) * percent)
        if block.min() != block.max():
            open_ &= block[:, None] < block
        else:
            open_ = np.triu(open_, 1)
        least, ends = np.concatenate(keys), np.concatenate(([0], np.cumsum([len(x) for x in keys])))
        for p in np.flatnonzero(open_.any(1)).tolist():  # a pair is compared under its first common key only
            if len(lower := keys[p][keys[p] < key]):
                open_[p] &= np.add.reduceat(np.isin(least, lower).astype(np.int64), ends[:-1]) == 0
        out = []
        if not open_.any():
            return out
        sets_ = [np.asarray(x) for x in arrays]
        flat, edges = np.concatenate(sets_), np.concatenate(([0], np.cumsum([len(x) for x in sets_])))
        for p in np.flatnonzero(open_.any(1)).tolist():
            shared = np.add.reduceat(np.isin(flat, sets_[p]).astype(np.int64), edges[:-1])
            linked = open_[p] & (shared * 100 >= (n[p] + n - shared) * percent)
            out += [(ids[p], ids[q]) for q in np.flatnonzero(linked).tolist()]
        return out

    def run(batches):
        key, group = None, []

        def done():
            links = compare(key[0], group) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in links], pa.int64()), pa.array([q for _, q in links], pa.int64())], ["u", "v"])

        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True))
            rest = [batch.column(c).to_pylist() for c in range(5, 10)]
            keys, arrays = batch.column(10), batch.column(11)
            for k in range(batch.num_rows):
                if key != where[k]:
                    if group:
                        yield done()
                    key, group = where[k], []
                group.append((*(c[k] for c in rest), keys[k].values.to_numpy(), arrays[k].values.to_numpy()))
        if group:
            yield done()

    at = ("v", "band", "step", "x", "y")
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), *at).sortWithinPartitions(*at)
    return rows.select(*at, "id", "n", "s", "comp", "block", "keys", "shingles").mapInArrow(run, "u long, v long").distinct()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: the greatest), ref, text."""
    rows = docs.select(F.coalesce(exact(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), exact(text_col).alias("text"))
    return rows.withColumn("ref", _ref(F.col("id"), F.col("text")))


def _lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with what table (a row a key) says of their key. Keys that have over 1/HOT of the rows are fewer than HOT, and are broadcast."""
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("m")).where(F.col("m") * HOT > total).select(key)
    hot = staged(table.join(F.broadcast(hot), key), "hot-keys")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def _placed(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, ref, n, least and kept of every row: least is the least id that links reach (all as in _rows)."""
    rows = _rows(docs, id_col, text_col)
    sets = staged(sketches(rows, shingle), "sketches")
    some = sets.where("n > 0")
    classes = some.groupBy("key").agg(F.min(F.struct("id", "ref", "n", "sketch")).alias("c"))
    classes = staged(classes.select("key", F.monotonically_increasing_id().alias("id"), F.col("c.id").alias("least"), "c.ref", "c.n", "c.sketch"), "classes")
    lists = staged(inverted_lists(classes), "lists")
    lengths = lists.groupBy("v").agg(F.count("*").alias("m"))
    sized = staged(lists.join(lengths.where("m > 1"), "v"), "sized-lists")
    # short lists: all their pairs, estimated on the sketches, then verified
    short = sized.where(F.col("m") <= SHORT_LIST)
    other = short.select("v", F.col("id").alias("other"), F.col("n").alias("other_n"))
    pairs = staged(_pairs(short.join(other, "v").where("id < other"), percent), "pairs")
    estimated = staged(_estimated(pairs, classes, percent), "estimated")
    # long lists: their members' whole sets, listed anew under rare shingles
    members = sized.where(F.col("m") > SHORT_LIST).select("id").distinct()
    sets_of = staged(_whole_sets(rows, members, classes, shingle), "whole-sets")
    whole = staged(_least_lists(sets_of, percent), "whole-lists")
    hubs = staged(_hubs(whole, percent).join(pairs, ["a", "b"], "left_anti"), "hub-pairs")
    estimated = estimated.unionByName(staged(_estimated(hubs, classes, percent), "estimated-hubs"))
    links = staged(_verified(estimated, rows, classes, percent, shingle), "links")
    found = staged(components(links), "components")
    links = links.unionByName(staged(_block_links(whole, found, sets_of, percent), "links"))
    found = components(links)
    named = classes.select("key", F.col("id").alias("node"), F.struct("least", "ref").alias("own"))
    linked = staged(named.join(found, "node").drop("node"), "linked")
    heads = staged(linked.groupBy("component").agg(F.min("own").alias("head")), "heads")
    heads = _lookup(linked, heads, "component").select("key", "head")
    named = staged(named.join(heads, "key", "left").select("key", F.coalesce("head", "own").alias("head")), "named")
    full = _lookup(some.select("id", "ref", "n", "key"), named, "key")
    none = sets.where("n = 0").select("id", "ref", "n", "key", F.lit(None).cast(full.schema["head"].dataType).alias("head"))  # their one key may be most rows'
    out = full.unionByName(none)
    kept = (F.col("n") == 0) | (F.struct("id", "ref") == F.struct("head.least", "head.ref"))
    return out.select("id", "ref", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("head.least")).alias("least"), kept.alias("kept"))


def near_components(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id that links reach) and kept of every row."""
    null = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return _placed(docs, percent, shingle, id_col, text_col).select(null("id").alias("id"), F.col("n").alias("n_shingles"), null("least").alias("component_id"), "kept")


def drop_near_copies(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, columns as they were, with only the row of least id of each component."""
    own_id, own_ref = free(docs, "dropped_id", "dropped_ref")
    dropped = _placed(docs, percent, shingle, id_col, text_col).where("not kept").select(F.col("id").alias(own_id), F.col("ref").alias(own_ref)).distinct()
    id_ = F.coalesce(exact(id_col).cast("long"), F.lit(_NULL_ID))
    return docs.join(dropped, (id_ == F.col(own_id)) & (_ref(id_, exact(text_col)) == F.col(own_ref)), "left_anti")


def near_digest(docs: DataFrame) -> DataFrame:
    """Query op6: similarity 0.75 on five words."""
    out = near_components(docs)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def brute_force(texts: dict[int, str | None], similarity: Fraction = Fraction(3, 4)) -> dict[int, int]:
    """Components by comparing all pairs; for tests."""
    sets = {i: set(s.tolist()) for i, s in zip(texts, shingle_sets(pa.array(list(texts.values()), pa.string())), strict=True)}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}
