"""Listings of entries: folders, names, single entries, trees. F: DataFrame of (path, name, type, size, modified_at, permissions, depth)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def list_dir(entries: DataFrame, depth: int = 1, extensions: list[str] | None = None, name_contains: str | None = None, sort_by: str = "name") -> DataFrame:
    """Entries up to a depth; extension and name filters let folders through; by path, or newest second first."""
    df = entries.where(F.col("depth") <= depth)
    if extensions:
        df = df.where((F.col("type") == "dir") | T.extension(F.col("name")).isin([e.lower() for e in extensions]))
    if name_contains:
        df = df.where((F.col("type") == "dir") | F.contains(F.lower("name"), F.lit(name_contains.lower())))
    return df.orderBy(F.unix_seconds("modified_at").desc(), T.walk_key(F.col("path"))) if sort_by in ("mtime", "modified_time") else df.orderBy("path")


def find_all_files(entries: DataFrame) -> DataFrame:
    """All that aren't folders, in order of path."""
    return entries.where("type <> 'dir'").select("path").orderBy("path")


def all_files_by_folder(entries: DataFrame) -> DataFrame:
    """The same as a report: p (a folder, '' for the root), c (how many files stand in it) and f (their paths, in order)."""
    files = entries.where("type <> 'dir'").select("path", F.regexp_extract("path", "^(.*)/", 1).alias("p"))
    return files.groupBy("p").agg(F.count("*").alias("c"), F.sort_array(F.collect_list("path")).alias("f"))


def search_name(entries: DataFrame, pattern: str, case_sensitive: bool = False, extensions: list[str] | None = None, limit: int = 500) -> DataFrame:
    name = F.col("name") if case_sensitive else F.lower("name")
    df = entries.where(F.contains(name, F.lit(pattern if case_sensitive else pattern.lower())))
    if extensions:
        df = df.where((F.col("type") != "dir") & T.extension(F.col("name")).isin([e.lower() for e in extensions]))
    return df.select("path", "type").orderBy(T.walk_key(F.col("path"))).limit(limit)


def stat(entries: DataFrame, path: str) -> DataFrame:
    ext = F.when(F.col("type") == "file", F.nullif(T.extension(F.col("name")), F.lit("")))
    return entries.where(F.col("path") == path).select("path", "type", F.col("size").alias("size_bytes"), F.col("modified_at").alias("mod_time"), "permissions", ext.alias("extension"))


def tree(entries: DataFrame, hidden: bool = False, glob: str | None = None) -> DataFrame:
    """path, line: each entry's line of a drawn tree, in walk order (order by T.walk_key(path)); folders end in a slash.

    glob: a folder and a pattern (*, ?) for names directly in it, as in docs/*.md; without a pattern, all below the folder.
    """
    if glob is not None:
        folder, _, last = glob.rpartition("/") if any(c in glob for c in "*?") else (glob.rstrip("/"), "", "")
        if folder not in ("", "."):
            entries = entries.where(F.col("path").startswith(folder + "/")).withColumn("path", F.substring("path", len(folder) + 2, 1 << 30))
        if last:
            pattern = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in last)
            entries = entries.where(F.col("path").rlike(f"^{pattern}$"))
    df = entries if hidden else entries.where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".")))
    parts = F.split("path", "/")
    df = df.withColumn("parent", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    last = F.lead("path").over(Window.partitionBy("parent").orderBy("path")).isNull()
    df = df.withColumn("last", last)
    # one row for each entry and folder above it
    up = df.select("path", "name", "type", "last", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("level", "above"), F.size(parts).alias("levels"))
    up = up.join(df.select(F.col("path").alias("above"), F.col("last").alias("above_last")), "above")
    inner = F.when(F.col("level") == F.col("levels") - 1, F.when(F.col("above_last"), "└── ").otherwise("├── ")).otherwise(F.when(F.col("above_last"), "    ").otherwise("│   "))
    drawn = up.withColumn("p", inner).groupBy("path", "name", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "p"))), lambda x: x["p"]), "").alias("prefix"))
    return drawn.select("path", F.concat("prefix", "name", F.when(F.col("type") == "dir", "/").otherwise("")).alias("line"))


def confined(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Paths that stay below the root by their letters alone: no NUL, not absolute, never above the root on the way."""
    p = F.col(path_col)
    step = lambda d, x: F.when(x == "..", d - 1).when(x.isin("", "."), d).otherwise(d + 1)
    end = F.aggregate(F.split(p, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")), lambda s, x: F.struct(step(s["d"], x).alias("d"), F.least(s["least"], step(s["d"], x)).alias("least")))
    return paths.where(~p.startswith("/") & ~F.contains(p, F.lit("\x00")) & (end["least"] >= 0))
