"""Plumbing shared by the operators: the folder that driver and executors share, staged tables, column names, order over ranges."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of its own; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpusmill-"))
        at = spark.sparkContext.getCheckpointDir()
    return qualified(spark, at)


def qualified(spark: SparkSession, at: str) -> str:
    """A path with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it is removed when the driver ends."""
    at = f"{shared_dir(spark).rstrip('/')}/corpusmill/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, at)
    return at


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder through Spark's own file system classes; does nothing once Spark has stopped."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the gateway may be gone
        return


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a batch that Python works on at a time; a larger row stands alone.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices of at most so many bytes or one row: a batch has up to 10,000 rows or 64 MB, and what Python makes of it is several times as large."""
    for batch in batches:
        todo = [batch]
        while todo:
            piece = todo.pop()
            if piece.num_rows > 1 and piece.nbytes > most:
                half = piece.num_rows // 2
                todo += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as there are cores, where its input has fewer splits: before work that costs more than an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df  # asks the plan only


def exact(name: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def in_order(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """df with row (its place in the order, from 0) and, for each name in sums, before_<name>: the column's sum over earlier rows.

    Rows are dealt by ranges; totals of the ranges, one row each, are summed up, so no task holds more than a range. Rows that are
    equal in the order need one range.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    dealt = staged(dealt, "in-order")
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = totals.select("_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_base_{c}") for c in ("rows", *sums)])
    own = Window.partitionBy("_range").orderBy(*order)
    within = own.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(bases), "_range")  # as many rows as ranges
    out = out.withColumn("row", (F.col("_base_rows") + F.row_number().over(own) - 1).cast("long"))
    out = out.withColumns({f"before_{c}": F.col(f"_base_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    return out.drop("_range", *[f"_base_{c}" for c in ("rows", *sums)])
