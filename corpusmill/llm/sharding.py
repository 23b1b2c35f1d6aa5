"""Sharding by histogram sort: equal bytes a shard, found by counting, then one exchange.

Rows are ordered by a key: a 64-bit hash of the text, then the id; rows alike in both stand by size. Splitters between shards are found without sorting: each round counts the exact bytes
below candidate keys (probes) over all partitions, keeps for every splitter the two neighbouring probes
around its target, and probes between them again, until a probe is within the tolerance. Where one
text's copies outweigh the tolerance, the splitter is refined by id within that hash value, and where rows
of one id and text do, by their places in a range sort of these rows alone, so any giant group is divided. Equal texts stand together, and in one shard unless a splitter has to divide them.

Splitters at a finer grain (`ranges_per_shard`) divide a shard's rows among tasks; a row's slot is
the exact count of rows in the ranges before its own plus its rank there, so no task holds a shard.

Defined cases: a null text has size 1, like an empty one, and hashes as one text of its own; a null
id sorts before all others; identical rows stand together, in one shard unless a splitter has to divide them; an empty table gives no
rows; other columns are kept, whatever their names, but for columns named shard or slot, which give way to the result's.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.llm._common import exact, in_order, shuffle_partitions, staged

PROBES = 32
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _index(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Number of cuts that are <= the value: range i holds cuts[i-1] <= value < cuts[i]."""
    return np.searchsorted(cuts, values, "right")


def _histogram(keys: DataFrame, column: str, cuts: list[int]) -> list[tuple[int, int, int, int, int]]:
    """For each range between cuts that has rows: exact bytes below it, its bytes, rows, least and greatest key. Every partition counts its own; the sums come here, a row for each range."""
    at = np.array(cuts, np.int64)

    def count(batches):
        for pdf in batches:
            pdf = pd.DataFrame({"range": _index(at, pdf[column].to_numpy()), "key": pdf[column], "size": pdf["size"]})
            yield pdf.groupby("range", as_index=False).agg(bytes=("size", "sum"), rows=("size", "size"), low=("key", "min"), high=("key", "max"))

    got = keys.select(column, "size").mapInPandas(count, "range int, bytes long, rows long, low long, high long")
    got = got.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    below, out = 0, []
    for r in sorted(got.collect()):
        out.append((below, r["bytes"], r["rows"], r["low"], r["high"]))
        below += r["bytes"]
    return out


def _refine(keys: DataFrame, column: str, targets: list[int], tolerance: int, probes: int) -> list[tuple[int, int, int, int, int]]:
    """For each target the range of keys around it, as of _histogram: refined until one of its ends is within the tolerance or it is one key."""

    def opened(target, bracket):
        below, n, _, low, high = bracket
        return min(target - below, below + n - target) > tolerance and low < high

    (everything,) = _histogram(keys, column, [])
    brackets = [everything] * len(targets)
    while wide := {b for t, b in zip(targets, brackets, strict=True) if opened(t, b)}:
        cuts = {low + (high + 1 - low) * i // (probes + 1) for _, _, _, low, high in wide for i in range(probes + 1)}
        cuts |= {min(high + 1, _HIGH) for *_, high in brackets} | {low for *_, low, _ in brackets}
        found = _histogram(keys, column, sorted(cuts))
        edges = [below for below, *_ in found]
        brackets = [b if not opened(t, b) else found[bisect_right(edges, t) - 1] for t, b in zip(targets, brackets, strict=True)]
    return brackets


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, probes: int = PROBES) -> list[tuple[int, int, int]]:
    """shards - 1 keys (hash, id, place), in order; keys has the columns h, i and size. A row belongs to the shard numbered by how many splitters are <= its key; place counts rows alike in hash and id, 0 for all of them where no splitter divides them."""
    total = keys.agg(F.sum("size").alias("n")).first()["n"] or 0
    if not total:
        return [(_HIGH, _HIGH, 0)] * (shards - 1)
    targets = [total * k // shards for k in range(1, shards)]
    most = max(1, int(total / shards * tolerance))
    out, divided = [], {}
    for target, (below, n, rows, low, high) in zip(targets, _refine(keys, "h", targets, most, probes), strict=True):
        if rows == 1 or min(target - below, below + n - target) <= most:
            out.append((low if target - below <= below + n - target else min(high + 1, _HIGH), _LOW, 0))
        else:
            divided.setdefault((low, below), []).append(target - below)
    for (h, _), inner in divided.items():  # one text's copies outweigh the tolerance; such groups are fewer than the shards
        group = keys.where(F.col("h") == h)
        for target, (below, n, rows, low, high) in zip(inner, _refine(group, "i", inner, most, probes), strict=True):
            if low < high or rows == 1 or min(target - below, below + n - target) <= most:
                out.append((h, low if target - below <= below + n - target else min(high + 1, _HIGH), 0))
            else:  # so do rows of one id and text: all of one size
                out.append((h, low, round((target - below) * rows / n)))
    return sorted(out)


def _range_of(splitters: list[tuple[int, int, int]]):
    """Column function: how many splitters are <= (hash, id, place)."""
    hashes = np.array([h for h, _, _ in splitters], np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(h: pd.Series, i: pd.Series, o: pd.Series) -> pd.Series:
        x, y, z = (c.to_numpy(np.int64) for c in (h, i, o))
        out, beyond = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
        for at in np.flatnonzero(beyond > out).tolist():  # splitters within one hash value
            out[at] = bisect_right(splitters, (int(x[at]), int(y[at]), int(z[at])), int(out[at]), int(beyond[at]))
        return pd.Series(out.astype(np.int32))

    return place


def _placed_alike(rows: DataFrame, splitters: list[tuple[int, int, int]]) -> DataFrame:
    """rows (h, i and others) with o: the place of a row among those alike in h and i, where a splitter divides these; else 0."""
    groups = sorted({(h, i) for h, i, o in splitters if o})
    if not groups:
        return rows.withColumn("o", F.lit(0).cast("long"))
    hot = F.broadcast(rows.sparkSession.createDataFrame(groups, "h long, i long"))  # fewer than the splitters
    alike = in_order(rows.join(hot, ["h", "i"]).withColumn("_o", F.monotonically_increasing_id()), [F.col("h"), F.col("i"), F.col("_o")])  # written in order: the places stay as they are
    first = alike.groupBy("h", "i").agg(F.min("row").alias("_first"))
    alike = alike.join(F.broadcast(first), ["h", "i"])
    rest = rows.join(hot, ["h", "i"], "left_anti").withColumn("o", F.lit(0).cast("long"))
    return rest.unionByName(alike.withColumn("o", F.col("row") - F.col("_first")).select(*rest.columns))


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int | None = None) -> DataFrame:
    """docs with shard (0 to shards - 1, near equal in bytes of text plus 1 a row) and slot (0, 1, ... in the order of the key)."""
    spark = docs.sparkSession
    key = [F.xxhash64(exact(text_col)).alias("h"), F.coalesce(exact(id_col).cast("long"), F.lit(_LOW)).alias("i"), (F.coalesce(F.octet_length(exact(text_col)), F.lit(0)).cast("long") + 1).alias("size")]
    rows = docs.select(F.struct(*map(exact, docs.columns)).alias("whole"), *key)  # the columns as one, whatever their names
    keys = staged(rows.select("h", "i", "size"), "shard-keys")
    cuts = find_splitters(keys, shards, tolerance)
    fine = ranges_per_shard or max(1, -(-shuffle_partitions(spark) // shards))
    inner = find_splitters(keys, shards * fine, 0.5) if fine > 1 else []  # only to divide the work
    ranges = sorted({*cuts, *inner})
    which, place = _range_of(cuts), _range_of(ranges)
    sizes = _placed_alike(keys, ranges).groupBy(which("h", "i", "o").alias("shard"), place("h", "i", "o").alias("range")).count()
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select("range", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy("h", "i", "o", "size")
    placed = _placed_alike(rows, ranges).withColumn("range", place("h", "i", "o")).withColumn("rank", F.row_number().over(within))
    # a row for each range, and the number of ranges is set above
    placed = placed.join(F.broadcast(sizes), "range")
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*[F.col("whole").getField(c).alias(c) for c in own], "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))


def shard_digest(docs: DataFrame) -> DataFrame:
    """Query op8: 16 shards under the law of bytes."""
    digest = docs.select("doc_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(digest, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
