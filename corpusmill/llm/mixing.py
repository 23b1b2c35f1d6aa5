"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

1. A document's size is its words; a source's share follows its weight, with no target above
   `max_epochs` times the source's size (the excess is reshared by weight until none is above).
2. A source's documents, shuffled by a seeded hash, form a stream of words that is cut into blocks
   of `block` words; the last is shorter. A source needs so many slots of one block each, over and over
   the stream, that its target is met to the word: the last slot takes part of a block.
3. Slot t of the schedule is the point frac(t * golden ratio), mapped through the cumulative slots of
   the sources. Slots are ranked per source; rank k of a source gets block k modulo its blocks. As the
   points are only nearly even, a few slots exceed their source's need; in order, they go to the sources
   that are short of some. Their number grows with the logarithm of the schedule only.
4. Slots join the pieces that documents have in each block, by source and block. What a document gives is the sum
   over its slots, and its slots are its places in the mix: `slots` has the first one of each epoch.

Ranks, places and cumulative sums come from two levels: totals of ranges (runs of slots, buckets of the hash), then
order within one, so that neither a source with most rows nor a great many sources are in one task.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source, the last in order; rows with
one id, null too, are told apart by their texts; identical rows share a hash and a bucket; columns with other names are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm._common import exact, free, in_order, shuffle_partitions, staged

BLOCK = 512
RUN = 1 << 14
_FEW = 10_000
_SCALE = 1 << 40
_GOLDEN = 679_556_961_735  # floor(2**40 / golden ratio), made odd: multiples modulo 2**40 meet no point twice
WORDS = r"[^\x20\x09-\x0D]+"


def _small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast only what was counted and found small; else Spark chooses."""
    return F.broadcast(df) if n <= _FEW else df


def row_key(id_: Column, text: Column, seed: int) -> Column:
    """Where a document stands in its source's shuffled stream; documents of one id and text share it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null"))))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """A row for each source of (source, size): s (its number, null last), source, source_size, rows, weight, target.

    Targets fill like water: with sources in order of capacity by weight, the first k are full and the level of the
    others is (total - their capacity) / (the others' weight), for the least k whose level the next source can hold.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("rows"))
    s = in_order(totals, [F.col("source").asc_nulls_last()]).withColumnRenamed("row", "s")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights)).cast("int") + 1).cast("long"))
    s = staged(s.withColumn("capacity", F.col("source_size") * max_epochs), "mix-weights")
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    f = in_order(s, [F.col("capacity") / F.col("weight"), F.col("s")], ("capacity", "weight"))
    f = f.withColumn("level", (F.lit(whole["size"] or 0) - F.col("before_capacity")) / (F.lit(whole["weight"] or 0) - F.col("before_weight")))
    f = staged(f, "mix-levels")
    opened = f.where(F.col("level") * F.col("weight") <= F.col("capacity")).agg(F.min(F.struct("row", "level")).alias("o")).first()["o"]
    first, level = (opened["row"], opened["level"]) if opened else (0, 0.0)
    target = F.when(F.col("row") >= first, F.lit(level) * F.col("weight")).otherwise(F.col("capacity").cast("double"))
    return f.select("s", "source", "source_size", "rows", "weight", target.alias("target"))


def word_stream(sized: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """sized (id, source, size, h: row_key) with the source's number s and the place a of the first word in the source's shuffled stream."""
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 32))
    keyed = sized.join(_small(sources.select("s", "source", "buckets"), n_sources), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    keyed = keyed.withColumn("bucket", bucket)
    totals = keyed.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    bases = totals.select("s", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("s", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return keyed.join(bases, ["s", "bucket"]).withColumn("a", F.col("base") + F.col("within"))


def schedule(spark: SparkSession, sources: DataFrame, n_slots: int) -> DataFrame:
    """A row for each slot: t, s, rank (within its source) and block (of the source's stream); sources has s, slots, edge (slots of the sources before it) and blocks."""
    # the point as an integer in [0, n_slots): multiples of the odd number modulo 2**40, in two halves so that no product overflows
    high, low = _GOLDEN >> 20, _GOLDEN & ((1 << 20) - 1)
    t = F.col("t") % F.lit(_SCALE)
    x = ((t * F.lit(low)) % F.lit(_SCALE) + (((t % F.lit(1 << 20)) * F.lit(high)) % F.lit(1 << 20)) * F.lit(1 << 20)) % F.lit(_SCALE)
    slots = spark.range(0, n_slots, 1, max(1, -(-n_slots // (16 * RUN)))).select(F.col("id").alias("t"))
    slots = slots.withColumn("u", F.floor(x.cast("double") / F.lit(float(_SCALE)) * F.lit(float(n_slots))).cast("long"))
    stretch = F.explode(F.sequence(F.floor(F.col("edge") / RUN), F.floor((F.col("edge") + F.col("slots") - 1) / RUN)))
    edges = sources.where("slots > 0").select("s", "slots", "edge", "blocks", stretch.alias("stretch"))  # cumulative weights, met by stretch
    slots = slots.withColumn("stretch", F.floor(F.col("u") / RUN)).join(edges, "stretch")
    slots = slots.where((F.col("u") >= F.col("edge")) & (F.col("u") < F.col("edge") + F.col("slots"))).drop("stretch")
    slots = slots.withColumn("run", F.floor(F.col("t") / RUN))
    counts = slots.groupBy("s", "run").count()
    earlier = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    bases = counts.select("s", "run", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    slots = slots.withColumn("k", F.row_number().over(Window.partitionBy("s", "run").orderBy("t")) - 1)
    slots = slots.join(bases, ["s", "run"]).withColumn("rank", F.col("base") + F.col("k"))
    slots = staged(slots, "mix-slots")
    kept = slots.where(F.col("rank") < F.col("slots")).select("t", "s", "rank", "blocks")
    surplus = in_order(slots.where(F.col("rank") >= F.col("slots")).select("t"), [F.col("t")]).withColumnRenamed("row", "n")
    had = counts.groupBy("s").agg(F.sum("count").alias("had"))
    short = sources.join(had, "s", "left").withColumn("had", F.coalesce("had", F.lit(0))).where(F.col("had") < F.col("slots"))
    short = in_order(short.select("s", "blocks", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("rank")), [F.col("rank"), F.col("s")]).withColumnRenamed("row", "n")
    given = surplus.join(short, "n").select("t", "s", "rank", "blocks")
    return kept.unionByName(given).withColumn("block", F.col("rank") % F.col("blocks"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For every row of docs: id, source, size, source_size, target, taken (words the mix takes of the document, repeats counted), slots (for each epoch that takes of it, the first slot that does, in order) and key (row_key)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(exact(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = staged(docs.select(exact(id_col).alias("id"), exact(source_col).alias("source"), size.alias("size"), row_key(exact(id_col), exact(text_col), seed).alias("h")), "mix-sizes")
    s = source_targets(sized, weights, max_epochs)
    words = F.least(F.floor("target"), F.col("source_size") * max_epochs)
    s = s.withColumn("take", words).withColumn("blocks", F.ceil(F.col("source_size") / block))
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("take") - F.col("epochs") * F.col("source_size"))
    s = s.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block)).withColumn("buckets", F.ceil(F.col("rows") / 4096))
    s = staged(in_order(s, [F.col("s")], ("slots",)).withColumnRenamed("before_slots", "edge").drop("row"), "mix-sources")
    whole = s.agg(F.count("*").alias("n"), F.sum("slots").alias("slots")).first()
    n_sources, n_slots = whole["n"], int(whole["slots"] or 0)
    stream = staged(word_stream(sized, s, n_sources).select("s", "id", "size", "h", "a"), "mix-stream")
    pieces = stream.where("size > 0").withColumn("b", F.col("a") + F.col("size"))
    pieces = pieces.select("s", "id", "size", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("block"))
    pieces = pieces.select("s", "id", "size", "a", "block", (F.greatest("a", F.col("block") * block) - F.col("block") * block).alias("p"), (F.least("b", (F.col("block") + 1) * block) - F.col("block") * block).alias("q"))
    slots = schedule(spark, s, n_slots)
    slots = slots.join(_small(s.select("s", "epochs", "rest", F.col("blocks").alias("per_epoch")), n_sources), "s")
    slots = slots.withColumn("epoch", F.floor(F.col("rank") / F.col("per_epoch")))
    last = F.col("epoch") >= F.col("epochs")  # the epoch that ends early
    slots = slots.select("s", "block", "epoch", "t", F.when(last, F.least(F.lit(block), F.col("rest") - F.col("block") * block)).otherwise(F.lit(block)).alias("words"))
    part = F.greatest(F.least("q", F.col("words")) - F.col("p"), F.lit(0))
    used = pieces.join(slots, ["s", "block"]).withColumn("part", part).where("part > 0")
    used = used.groupBy("s", "id", "size", "a", "epoch").agg(F.sum("part").alias("part"), F.min("t").alias("t"))
    epochs = F.array_sort(F.collect_list(F.struct("epoch", "t")))  # max_epochs and a part of one at most
    taken = used.groupBy("s", "id", "size", "a").agg(F.sum("part").alias("taken"), F.transform(epochs, lambda x: x["t"]).alias("slots"))
    own = (F.col("d.s") == F.col("t.s")) & (F.col("d.a") == F.col("t.a")) & (F.col("d.size") == F.col("t.size"))  # one row has words there
    out = stream.alias("d").join(taken.alias("t"), own, "left").select("d.s", "d.id", "d.size", "d.h", "t.taken", "t.slots")
    out = out.join(_small(s.select("s", "source", "source_size", "target"), n_sources), "s")
    return out.select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<long>")).alias("slots"), F.col("h").alias("key"))


def repeated(docs: DataFrame, mixed: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, columns as they were, as the mix (of the same seed) has them: each row as often as it is taken, a part of half or more counted as whole, in the order of the schedule, copy by copy at the slots of its epochs.

    Identical rows take the mean of their copies.
    """
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0))
    key, n, slots, place = free(docs, "mix_key", "mix_copies", "mix_slots", "mix_place")
    wanted = mixed.groupBy(F.col("key").alias(key)).agg(F.round(F.avg(copies)).cast("int").alias(n), F.min("slots").alias(slots)).where(F.col(n) > 0)
    out = docs.withColumn(key, row_key(exact(id_col), exact(text_col), seed)).join(staged(wanted, "mix-copies"), key)
    places = F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: F.coalesce(F.get(F.col(slots), i - 1), F.element_at(F.col(slots), -1)))
    out = out.withColumn(place, F.explode(places))
    own = shuffle_partitions(docs.sparkSession)
    return out.repartitionByRange(own, place, key).sortWithinPartitions(place, key).select(*map(exact, docs.columns))


def mix_digest(docs: DataFrame) -> DataFrame:
    """Query op3: all documents, sources weighing 1, 2, 3 in turn; first_slot is the document's first place in the schedule, null if nothing is taken."""
    out = mix(docs)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"))
