"""A persistent index of vectors in cells, whose searches are exact.

Vectors go to the cell of their nearest centroid; `rows/cell=<c>` holds a cell in order of the distance to it, `cells` its centroid,
size and radius. With x in a cell of centroid c, q.x = q.c + q.(x - c) <= q.c + |q| |x - c|: so a cell's best possible score is known from
its radius, and a row's from its distance, a column that Parquet's statistics prune. Cells are read from the best bound down until none
can reach the k-th score found; ties are read. The result is that of the full scan, ties and all.

Centroids come from at most `SAMPLE` vectors (the least by hash, so builds agree) and are `MOST_CELLS` at most; every vector is in a
cell, and nothing depends on how good the cells are but the share that is read. Vectors that are null, of another length or not
finite are in cell -1, which every search reads. A cell of any size is many files: rows are dealt by ranges of (cell, distance).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators import search
from corpusmill.sources.shared import shuffle_partitions, staged

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 12
#: Cells in the first wave of a search, and in the largest.
FIRST_WAVE, LAST_WAVE = 4, 64
#: Room for rounding in bounds, as a share of the lengths involved.
ROOM = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a finite vector of this length, and these."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False).astype(bool)
    flat = column.filter(pa.array(fits)).flatten()
    rows = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf, posinf=np.inf, neginf=np.inf).reshape(-1, dim)
    finite = np.isfinite(rows).all(1)
    fits[np.flatnonzero(fits)[~finite]] = False
    return fits, rows[finite]


def _nearest_centroid(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * rows @ centroids.T, 1)


def _centroids(rows: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds from rows that are spread over the sample."""
    rows = rows.astype(np.float64)
    centroids = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)]
    for _ in range(ROUNDS):
        own = _nearest_centroid(rows, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        n = np.bincount(own, minlength=len(centroids))[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids)
    return centroids


def _bounds(queries: np.ndarray, cells: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The best score that each query can have in each cell; infinite for cell -1."""
    length = np.sqrt((queries**2).sum(1))[:, None]
    room = ROOM * (1 + length * (np.sqrt((centroids**2).sum(1)) + radius))
    return np.where(cells < 0, np.inf, queries @ centroids.T + length * radius + room)


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.zones = spark.read.parquet(f"{self.folder}/cells")
        known = self.zones.collect()  # MOST_CELLS + 1 rows at most
        self.cells = np.array([r["cell"] for r in known], np.int64)
        self.sizes = np.array([r["n"] for r in known], np.int64)
        self.radius = np.array([r["radius"] for r in known], np.float64)
        self.dim = max((len(r["centroid"]) for r in known), default=0)
        self.centroids = np.array([r["centroid"] if r["cell"] >= 0 else [0.0] * self.dim for r in known], np.float64).reshape(len(known), self.dim)
        said = spark.read.parquet(f"{self.folder}/schema").first()
        self.schema, self.names = said["ddl"], said["names"]

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, ties: tuple[str, ...], cells: int | None = None, embedding: str = "embedding") -> VectorIndex:
        """vectors: any columns (none called cell or distance) with an embedding; ties: columns that tell rows apart."""
        spark, folder = vectors.sparkSession, folder.rstrip("/")
        common = vectors.groupBy(F.size(embedding).alias("dim")).agg(F.count("*").alias("n")).where("dim > 0").orderBy(F.desc("n"), "dim").first()
        dim, total = (common["dim"], common["n"]) if common else (0, 0)
        fitting = vectors.where(F.size(embedding) == dim).select(embedding)
        sample = fitting.withColumn("h", F.xxhash64(embedding)).orderBy("h").limit(SAMPLE).select(embedding).toArrow() if dim else None
        rows = _matrix(sample.column(0).combine_chunks(), dim)[1] if dim else np.empty((0, 0))
        count = min(MOST_CELLS, cells or max(1, int(np.sqrt(total))))
        centroids = _centroids(rows, count) if len(rows) else np.empty((0, dim))
        where = vectors.columns.index(embedding)

        def assign(batches):
            for batch in batches:
                cell, distance = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
                if len(centroids):
                    fits, own = _matrix(batch.column(where), dim)
                    cell[fits] = near = _nearest_centroid(own, centroids)
                    distance[fits] = np.sqrt(((own - centroids[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], [*batch.schema.names, "cell", "distance"])

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        placed = vectors.mapInArrow(assign, f"{ddl}, cell int, distance double")
        order = ["cell", "distance", *ties]
        placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).write.partitionBy("cell").parquet(f"{folder}/rows")
        stored = spark.read.schema(f"{ddl}, cell int, distance double").parquet(f"{folder}/rows")
        sizes = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
        named = spark.createDataFrame([(-1, [0.0] * dim), *((i, c.tolist()) for i, c in enumerate(centroids))], "cell int, centroid array<double>")
        spark.createDataFrame([(ddl, vectors.columns)], "ddl string, names array<string>").write.parquet(f"{folder}/schema")
        sizes.join(F.broadcast(named), "cell").write.parquet(f"{folder}/cells")  # MOST_CELLS + 1 rows at most
        return cls(spark, folder)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The rows of these cells (all if None), with cell and distance."""
        reader = self.spark.read.schema(f"{self.schema}, distance double, cell int").option("basePath", f"{self.folder}/rows")
        if cells is None:
            return reader.parquet(f"{self.folder}/rows")
        return reader.parquet(*[f"{self.folder}/rows/cell={c}" for c in cells])

    def nearest(self, query: list[float], k: int, threshold: float, where=None, order: tuple[str, ...] = ("path", "chunk_index")) -> tuple[list, dict]:
        """The k best rows with a score of at least threshold, ties in order; and how many cells and vectors were read, of how many."""
        q = np.asarray(query, np.float64)
        bounds = _bounds(q[None, :], self.cells, self.centroids, self.radius)[0] if len(q) == self.dim else np.full(len(self.cells), np.inf)
        todo = np.argsort(-bounds, kind="stable")
        best, at, size, seen = [], 0, FIRST_WAVE, 0
        while at < len(todo):
            need = max(threshold, best[-1]["score"]) if len(best) == k else threshold
            wave = [i for i in todo[at : at + size] if bounds[i] >= need]
            if not wave:
                break
            rows = self.rows(self.cells[wave].tolist())
            if len(q) == self.dim and self.cells[wave].min() >= 0:  # rows too near their centroid can't reach the score
                length = float(np.sqrt(q @ q))
                least = min((need - float(q @ self.centroids[i])) / length - ROOM * (1 + self.radius[i]) if length else -1.0 for i in wave)
                rows = rows.where(F.col("distance") >= least) if least > 0 else rows
            rows = rows if where is None else rows.where(where)
            found = rows.withColumn("score", V.dot(F.col("embedding"), V.literal(query))).where(F.col("score") >= threshold)
            best += found.select(*self.names, "score").orderBy(F.desc("score"), *order).limit(k).collect()
            best = sorted(best, key=lambda r: tuple(r[c] for c in order))
            best = sorted(best, key=lambda r: (not np.isnan(r["score"]), -r["score"] if not np.isnan(r["score"]) else 0.0))[:k]
            seen += int(self.sizes[wave].sum())
            if len(wave) < len(todo[at : at + size]):
                at += len(wave)
                break
            at, size = at + size, min(2 * size, LAST_WAVE)
        return best, {"cells_read": min(at, len(todo)), "cells": len(todo), "vectors_read": seen, "vectors": int(self.sizes.sum())}

    def search(self, query: list[float], top_k: int = 10, threshold: float = 0.0, extensions: list[str] | None = None) -> DataFrame:
        """The rows of search.search_semantic over the indexed chunks."""
        top_k = top_k if 1 <= top_k <= 10 else 10
        where = None if not extensions else T.extension(T.file_name(F.col("path"))).isin([e.lower() for e in extensions])
        best, _ = self.nearest(query, top_k, threshold, where)
        rows = self.spark.createDataFrame([tuple(r[c] for c in ("path", "chunk_index", "section", "score", "text")) for r in best], "path string, chunk_index int, section string, score double, text string")
        return rows.select("path", "chunk_index", "section", "score", T.excerpt(F.col("text")).alias("excerpt"))

    def batch_top_k(self, queries: DataFrame, id_col: str, query_col: str, k: int = 10) -> DataFrame:
        """The rows of search.batch_top_k: each query (query_col, q) first meets the cell of its best bound, whose k-th score rules out most others."""
        if not len(self.cells):
            return search.batch_top_k(self.rows(), queries, id_col, query_col, k)
        kind = queries.schema[query_col].dataType.simpleString()
        cells, dim, centroids, radius = self.cells, self.dim, self.centroids, self.radius

        def ranked(batches, first: bool):
            for batch in batches:
                fits, rows = _matrix(batch.column(1), dim) if dim else (np.zeros(batch.num_rows, bool), np.empty((0, 0)))
                score = np.full((batch.num_rows, len(cells)), np.inf)  # odd queries meet all cells
                if len(rows):
                    score[fits] = _bounds(rows, cells, centroids, radius)
                home = np.where(cells < 0, -np.inf, score)
                own = np.argmax(home, 1)
                if first:
                    at, to = np.arange(batch.num_rows), own
                else:
                    least = pc.fill_null(batch.column(2), -np.inf).to_numpy(zero_copy_only=False)
                    wanted = score >= least[:, None]
                    wanted[np.arange(len(own)), own] = False
                    at, to = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cells[to].astype(np.int32))], ["name", "q", "cell"])

        asked = queries.select(F.col(query_col).alias("name"), F.col("q").cast("array<double>").alias("q"))
        paired = f"name {kind}, q array<double>, cell int"
        home = self._met(asked.mapInArrow(lambda b: ranked(b, True), paired), id_col, kind, k)
        home = staged(home, "home-cells")
        by_name = Window.partitionBy("name").orderBy(F.desc("score"), "id")  # k rows from each block
        kth = home.withColumn("rank", F.row_number().over(by_name)).where(F.col("rank") == k).select("name", F.col("score").alias("least"))
        rest = asked.join(kth, "name", "left").select("name", "q", "least").mapInArrow(lambda b: ranked(b, False), paired)
        found = home.unionByName(self._met(rest, id_col, kind, k))
        top = found.withColumn("rank", F.row_number().over(by_name)).where(F.col("rank") <= k)
        return top.select(F.col("name").alias(query_col), F.col("id").alias(id_col), "score", "rank")

    def _met(self, pairs: DataFrame, id_col: str, kind: str, k: int) -> DataFrame:
        """name, id, score: each pair's (name, q, cell) k best of the cell. Large cells are cut in blocks, each with a copy of its queries; many queries of a cell likewise."""
        pairs = staged(pairs, "query-cells")
        counts = pairs.groupBy("cell").agg(F.ceil(F.count("*") / search.QUERIES).cast("int").alias("qs"))
        blocks = self.zones.select("cell", F.ceil(F.col("n") / search.VECTOR_BLOCK).cast("int").alias("vs")).join(counts, "cell")
        blocks = F.broadcast(blocks)  # a row for each cell
        block = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.rows().select(F.col(id_col).cast("long").alias("id"), "embedding", "cell").join(blocks, "cell").withColumn("vb", block("id", "vs")).withColumn("qb", every("qs"))
        right = pairs.join(blocks, "cell").withColumn("qb", block("name", "qs")).withColumn("vb", every("vs"))
        keys = ("cell", "vb", "qb")
        left, right = left.select(*keys, "id", "embedding"), right.select(*keys, "name", "q")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search._meet(k), f"name {kind}, id long, score double")
