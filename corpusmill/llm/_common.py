"""What the operators share: the library's plumbing under short names, and the table they work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.shared import exact, free, in_order, new_folder, remove, shared_dir, shuffle_partitions, staged

__all__ = ["documents", "exact", "free", "in_order", "lookup", "new_folder", "remove", "shared_dir", "shuffle_partitions", "staged", "volume"]


def volume(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column over all rows."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A key with more than one row in so many is hot.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """rows joined to what table (one row for each key) says of their keys. Hot keys are fewer than HOT and are broadcast, so their rows aren't moved."""
    keys = list(keys)
    total = rows.count()
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") * HOT > total).select(*keys)
    hot = staged(hot.join(table, keys, how), "hot-keys")  # fewer rows than HOT
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
