"""A persistent chunk index keyed by file fingerprint (path, mtime in ms, size), kept as a log of commits.

Below the index's folder each model tag and schema version has a folder of its own; the first commit under another tag removes
the others'. In it:

* `chunks/generation=<id>-<n>/bucket=<b>` holds the chunks of one write, never changed, dealt to n buckets by a hash of their path and
  sorted by path, with Bloom filters: one chunk is in one bucket of the generation that its file's row names.
* `deltas/<id>` has the files that one commit puts in or takes out; `log/<number>` names it. A commit writes what it has, then
  puts the next number in place in one step. Whoever finds it taken rebases: an upsert leaves out files of which a commit in between
  has newer ones, what depends on the state (eviction, vacuum) is computed again; then the next number is tried. So a commit costs
  what it changes, and a write that fails half-way leaves nothing that is read.
* `checkpoints/<number>` names the whole table of files as of that commit, written every `CHECKPOINT_EVERY` commits; readers start there.
  It lists the access logs that it has folded in. What only older checkpoints need is deleted.
* `access/<id>` logs reads. A reader takes all of them, so one written at any moment counts.

The step that puts a name in place is a rename that must fail where the name exists: file systems do that, object stores
without conditional puts don't. Data of no commit (a writer's in flight, or left by a failed one) go after `GRACE_MS`.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import zlib

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.shared import in_order, shuffle_partitions

SCHEMA_VERSION = 3
#: Fixed value: bytes that an entry costs beside its text.
ENTRY_BYTES = 4096
#: Files of one second that one task puts in order.
FEW_FILES = 1_000_000
#: Commits after which the table of files is written whole; text and vectors of a bucket; rows of one path that one task writes.
CHECKPOINT_EVERY, BUCKET_BYTES, BUCKET_ROWS = 8, 256 << 20, 50_000
#: Shares of paths for each task that writes chunks.
SHARES = 8
#: Age at which data of no commit are taken for a failed write's, and how often a commit is tried.
GRACE_MS, TRIES = 3_600_000, 1000
FILES = "path string, mtime_ms long, size long, generation string, n_chunks long, blob_size long, last_access long"
CHUNKS = "path string, chunk_index int, total int, section string, tokens long, text string, embedding array<float>"
ACCESS = "path string, last_access long"


def stale(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, mtime_ms, size) that the index doesn't have as they are."""
    return files.join(known.select("path", "mtime_ms", "size"), ["path", "mtime_ms", "size"], "left_anti")


def fresh(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, mtime_ms, size) that the index has as they are."""
    return files.join(known.select("path", "mtime_ms", "size"), ["path", "mtime_ms", "size"], "left_semi")


def status(files: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return files.agg(F.count("*").alias("files"), z("n_chunks"), z("blob_size"))


def evict(files: DataFrame, max_bytes: int) -> DataFrame:
    """The files that stay: the most recently used (ties by path) while their blobs, and 4096 bytes each, fit.

    Totals go by second of access first, so only the files of the one second at the limit are put in order: in one task if they are
    few, else by ranges of paths.
    """
    cost = F.col("blob_size") + ENTRY_BYTES
    seconds = files.groupBy("last_access").agg(F.sum(cost).alias("cost"), F.count("*").alias("n"))  # a row for each second
    seconds = seconds.withColumn("upto", F.sum("cost").over(Window.orderBy(F.desc("last_access"))))
    over = seconds.where(F.col("upto") > max_bytes).orderBy(F.desc("last_access")).limit(1).collect()
    if not over:
        return files
    at, room = over[0]["last_access"], max_bytes - over[0]["upto"] + over[0]["cost"]
    partly = files.where(F.col("last_access") == at).withColumn("_cost", cost)
    if over[0]["n"] <= FEW_FILES:
        partly = partly.withColumn("_upto", F.sum("_cost").over(Window.orderBy("path")))
    else:
        partly = in_order(partly, [F.col("path")], ("_cost",)).withColumn("_upto", F.col("before__cost") + F.col("_cost"))
    return files.where(F.col("last_access") > at).unionByName(partly.where(F.col("_upto") <= room).select(*files.columns))


def seal(data: Column, key: Column | None = None, compress: bool = True) -> Column:
    """A flags byte (1: deflated, 2: encrypted), then the data: deflated, then AES-GCM (12 bytes of nonce, data, 16 of tag)."""

    @F.pandas_udf("binary")
    def deflate(values: pd.Series) -> pd.Series:
        def one(v):
            c = zlib.compressobj(9, wbits=-15)
            return c.compress(v) + c.flush()

        return values.map(one, na_action="ignore")

    body = deflate(data.cast("binary")) if compress else data.cast("binary")
    if key is not None:
        body = F.aes_encrypt(body, key, F.lit("GCM"))
    return F.concat(F.lit(bytes([compress + 2 * (key is not None)])), body)


def unseal(sealed: Column, key: Column | None = None) -> Column:
    """What seal was given; the flags say how it was made."""

    @F.pandas_udf("binary")
    def inflate(values: pd.Series) -> pd.Series:
        return values.map(lambda v: zlib.decompress(v, wbits=-15), na_action="ignore")

    flags = F.conv(F.hex(F.substring(sealed, 1, 1)), 16, 10).cast("int")
    body = F.substring(sealed, 2, (1 << 31) - 2)
    if key is not None:
        body = F.when(flags.bitwiseAND(2) > 0, F.aes_decrypt(body, key, F.lit("GCM"))).otherwise(body)
    deflated = F.when(flags.bitwiseAND(1) > 0, body)
    return F.coalesce(inflate(deflated), F.when(flags.bitwiseAND(1) == 0, body))


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Index:
    """budget: bytes to which each upsert evicts (0: no limit)."""

    def __init__(self, spark: SparkSession, folder: str, model_tag: str, budget: int = 0):
        self.spark, self.top, self.budget = spark, folder.rstrip("/"), budget
        self.own = f"v{SCHEMA_VERSION}-" + hashlib.sha256(model_tag.encode()).hexdigest()[:32]
        self.folder = f"{self.top}/{self.own}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.top).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- the log ---

    def _names(self, at: str) -> list[str]:
        path = self._path(at)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _delete(self, at: str) -> None:
        self._fs.delete(self._path(at), True)

    def _put(self, at: str, said: dict) -> bool:
        """Puts a small JSON file in place in one step; false if there is one."""
        made = self._path(f"{self.folder}/new/{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        to = self._path(at)
        self._fs.mkdirs(to.getParent())
        try:
            if not self._fs.exists(to) and self._fs.rename(made, to):
                return True
        except Py4JJavaError:  # some stores raise where the name exists
            if not self._fs.exists(to):
                raise
        self._fs.delete(made, False)
        return False

    def _said(self, at: str) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(at).collect()))  # one line

    def _numbers(self, kind: str) -> list[int]:
        return [int(n) for n in self._names(f"{self.folder}/{kind}") if n.isdigit()]

    def _state(self) -> tuple[int, dict | None, list[int]]:
        """Number of the last commit, the last checkpoint and the numbers of the commits after it."""
        checkpoints = self._numbers("checkpoints")
        at = checkpoints[-1] if checkpoints else 0
        later = [n for n in self._numbers("log") if n > at]
        checkpoint = self._said(f"{self.folder}/checkpoints/{at:020d}") if at else None
        return max([at, *later]), checkpoint, later

    def _deltas(self, numbers: list[int]) -> DataFrame:
        """What these commits changed last: FILES and gone, a row for each path."""
        changed = self.spark.createDataFrame([], f"{FILES}, gone boolean, number long")
        for n in numbers:  # CHECKPOINT_EVERY and a few at most
            delta = self.spark.read.schema(f"{FILES}, gone boolean").parquet(f"{self.folder}/deltas/{self._said(f'{self.folder}/log/{n:020d}')['delta']}")
            changed = changed.unionByName(delta.withColumn("number", F.lit(n).cast("long")))
        last = changed.groupBy("path").agg(F.max_by(F.struct(*_columns(FILES)[1:], "gone"), "number").alias("l"))
        return last.select("path", "l.*")

    def _table(self, checkpoint: dict | None, later: list[int], access: list[str]) -> DataFrame:
        files = self.spark.read.schema(FILES).parquet(f"{self.folder}/tables/{checkpoint['table']}") if checkpoint else self.spark.createDataFrame([], FILES)
        if later:
            changed = self._deltas(later)
            files = files.join(changed.select("path"), "path", "left_anti").unionByName(changed.where("not gone").drop("gone"))
        if access:
            used = self.spark.read.schema(ACCESS).parquet(*[f"{self.folder}/access/{n}" for n in access]).groupBy("path").agg(F.max("last_access").alias("_used"))
            files = files.join(used, "path", "left").withColumn("last_access", F.greatest("last_access", "_used"))
        return files.select(*_columns(FILES))

    def _commit(self, delta: DataFrame, generations: dict[str, int], again) -> int:
        """Puts a delta (FILES, gone) into the log, with the generations that it brings and how many paths have chunks there. again, called with the delta's name and the numbers of commits that came between, gives the delta anew."""
        seen = self._state()[0]
        name = self._write_delta(delta)
        for _ in range(TRIES):
            number = seen + 1
            if self._put(f"{self.folder}/log/{number:020d}", {"delta": name, "generations": generations}):
                self._checkpoint(number)
                for n in self._names(self.top):
                    if n != self.own:
                        self._delete(f"{self.top}/{n}")
                return number
            now = self._state()[0]
            stale_name, name = name, self._write_delta(again(name, range(seen + 1, now + 1)))
            self._delete(f"{self.folder}/deltas/{stale_name}")
            seen = now
        raise OSError(f"other writers came first {TRIES} times")

    def _write_delta(self, delta: DataFrame) -> str:
        name = uuid.uuid4().hex
        delta.select(*_columns(FILES), "gone").write.parquet(f"{self.folder}/deltas/{name}")
        return name

    def _newest(self, name: str, between: range) -> DataFrame:
        """An upsert's delta without files of which the commits between (all commits, once some of these are in a checkpoint only) have newer ones."""
        own = self.spark.read.schema(f"{FILES}, gone boolean").parquet(f"{self.folder}/deltas/{name}")
        theirs = self._deltas(list(between)).where("not gone") if set(between) <= set(self._numbers("log")) else self.files()
        newer = theirs.select("path", F.col("mtime_ms").alias("_theirs"))
        return own.join(newer, "path", "left").where("_theirs is null or _theirs <= mtime_ms").drop("_theirs")

    def _checkpoint(self, number: int) -> None:
        """Writes the whole table every so many commits, then deletes what only older checkpoints need."""
        _, before, later = self._state()
        later = [n for n in later if n <= number]
        if len(later) < CHECKPOINT_EVERY:
            return
        access, name = self._names(f"{self.folder}/access"), uuid.uuid4().hex
        self._table(before, later, access).write.parquet(f"{self.folder}/tables/{name}")
        if not self._put(f"{self.folder}/checkpoints/{number:020d}", {"table": name, "folded": access, "generations": self._generations(before, later)}):
            self._delete(f"{self.folder}/tables/{name}")
            return
        kept = self._numbers("checkpoints")[-2:]  # readers of the one before go on
        for n in self._numbers("log"):
            if len(kept) > 1 and n <= kept[0]:
                self._delete(f"{self.folder}/deltas/{self._said(f'{self.folder}/log/{n:020d}')['delta']}")
                self._delete(f"{self.folder}/log/{n:020d}")
        for n in self._numbers("checkpoints"):
            if n not in kept:
                self._delete(f"{self.folder}/tables/{self._said(f'{self.folder}/checkpoints/{n:020d}')['table']}")
                self._delete(f"{self.folder}/checkpoints/{n:020d}")
        for n in before["folded"] if before else ():
            self._delete(f"{self.folder}/access/{n}")

    def _generations(self, checkpoint: dict | None, later: list[int]) -> dict[str, int]:
        """The generations that are there and that commits brought, with the number of paths that have chunks there."""
        known = dict(checkpoint["generations"]) if checkpoint else {}
        for n in later:
            known |= self._said(f"{self.folder}/log/{n:020d}")["generations"]
        there = {n.removeprefix("generation=") for n in self._names(f"{self.folder}/chunks")}
        return {g: n for g, n in known.items() if g in there}

    # --- reading ---

    def files(self) -> DataFrame:
        """A row for each file, last accesses included."""
        _, checkpoint, later = self._state()
        return self._table(checkpoint, later, self._names(f"{self.folder}/access"))

    def _all_chunks(self) -> DataFrame:
        return self.spark.read.schema(f"{CHUNKS}, generation string, bucket int").parquet(f"{self.folder}/chunks").drop("bucket")

    def chunks(self) -> DataFrame:
        """All current chunks, with their generation."""
        if not self._names(f"{self.folder}/chunks") or not self._state()[0]:
            return self.spark.createDataFrame([], f"{CHUNKS}, generation string")
        live = self.files().select("path", "generation")
        return self._all_chunks().join(live, ["path", "generation"], "left_semi").select(*_columns(CHUNKS), "generation")

    def touch(self, paths: DataFrame, now: int) -> None:
        """Logs that these files (path) were used."""
        paths.select("path", F.lit(now).cast("long").alias("last_access")).write.parquet(f"{self.folder}/access/{uuid.uuid4().hex}")

    def chunk(self, path: str, index: int, now: int | None = None) -> DataFrame:
        """One chunk, from the one bucket that can have it; with a time, the use of its file is logged."""
        own = self.files().where(F.col("path") == path)
        row = own.select("path", "generation", "n_chunks", F.xxhash64("path").alias("h")).first()
        if now is not None:
            self.touch(own, now)
        if row is None or not row["n_chunks"]:
            return self.spark.createDataFrame([], f"{CHUNKS}, generation string")
        bucket = row["h"] % int(row["generation"].split("-")[1])
        at = f"{self.folder}/chunks"
        found = self.spark.read.schema(f"{CHUNKS}, generation string, bucket int").option("basePath", at).parquet(f"{at}/generation={row['generation']}/bucket={bucket}")
        return found.where((F.col("path") == path) & (F.col("chunk_index") == index)).drop("bucket")

    def stale(self, files: DataFrame) -> DataFrame:
        return stale(files, self.files())

    def hits(self, files: DataFrame, now: int) -> DataFrame:
        """Those of files (path, mtime_ms, size) that the index has as they are; their use is logged."""
        found = fresh(files, self.files())
        self.touch(found, now)
        return found

    # --- writing ---

    def _write_chunks(self, chunks: DataFrame, size: int = 0) -> str:
        """Writes a generation of as many buckets as its size asks for. Few buckets, which size may say where texts are larger than their files, are shares of paths for several tasks each; a path's many chunks are several tasks' work."""
        buckets = max(1, -(-size // BUCKET_BYTES))
        shares = max(1, SHARES * shuffle_partitions(self.spark) // buckets)  # some for each task, so that tasks have about the same
        generation = f"{uuid.uuid4().hex}-{buckets}"
        rows = chunks.select(*_columns(CHUNKS), F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket"))
        share = F.pmod(F.xxhash64(F.lit("share"), "path"), F.lit(shares))  # by another hash than the bucket's
        rows = rows.repartition("bucket", share, F.floor(F.col("chunk_index") / BUCKET_ROWS)).sortWithinPartitions("bucket", "path", "chunk_index")
        rows.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#path", "true").parquet(f"{self.folder}/chunks/generation={generation}")
        return generation

    def upsert(self, files: DataFrame, chunks: DataFrame, now: int) -> None:
        """files: path, mtime_ms, size of what was read anew; chunks: theirs, with embeddings. Only these are written; then what the budget has no room for goes."""
        at = self._write_chunks(chunks, files.agg(F.sum("size")).first()[0] or 0)
        own = self._all_chunks().where(F.col("generation") == at)
        sums = own.groupBy("path").agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("text") + 1).alias("blob_size"))
        new = files.select("path", "mtime_ms", "size").join(sums, "path", "left").withColumn("generation", F.lit(at))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        new = new.withColumns({"n_chunks": zero("n_chunks"), "blob_size": zero("blob_size"), "last_access": F.lit(now).cast("long"), "gone": F.lit(False)})
        self._commit(new, {at: own.agg(F.countDistinct("path")).first()[0]}, self._newest)
        if self.budget:
            self.evict(self.budget)

    def remove(self, paths: DataFrame) -> None:
        """Takes these files (path) out; their chunks go with the next vacuum."""
        gone = lambda *_: self.files().join(paths.select("path").distinct(), "path", "left_semi").withColumn("gone", F.lit(True))
        delta = gone()
        if not delta.isEmpty():
            self._commit(delta, {}, gone)

    def evict(self, max_bytes: int) -> None:
        """Keeps what fits (0: everything), then deletes what isn't used any more."""
        if max_bytes > 0:
            gone = lambda *_: (f := self.files()).join(evict(f, max_bytes).select("path"), "path", "left_anti").withColumn("gone", F.lit(True))
            delta = gone()
            if not delta.isEmpty():
                self._commit(delta, {}, gone)
        self.vacuum()

    def vacuum(self) -> None:
        """Deletes chunks that no file has: generations without files go whole, the files of partly used ones move to a new generation."""
        if not self._names(f"{self.folder}/chunks"):
            return
        _, checkpoint, later = self._state()
        files, has = self.files(), self._generations(checkpoint, later)
        uses = {r["generation"]: r["n"] for r in files.where("n_chunks > 0").groupBy("generation").agg(F.count("*").alias("n")).collect()}  # a row for each write since the last time
        there = [n.removeprefix("generation=") for n in self._names(f"{self.folder}/chunks") if n.startswith("generation=")]
        gone = [g for g in there if (uses.get(g, 0) < has[g] or not has[g] if g in has else self._old(g))]
        if not gone:
            return
        moving = files.where(F.col("generation").isin(gone) & (F.col("n_chunks") > 0))
        if not moving.isEmpty():
            total = moving.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
            at = self._write_chunks(self.chunks().where(F.col("generation").isin(gone)), total["size"])
            moved = lambda *_: self.files().where(F.col("generation").isin(gone) & (F.col("n_chunks") > 0)).withColumns({"generation": F.lit(at), "gone": F.lit(False)})
            self._commit(moved(), {at: total["n"]}, moved)
        for generation in gone:
            self._delete(f"{self.folder}/chunks/generation={generation}")

    def _old(self, generation: str) -> bool:
        status = self._fs.getFileStatus(self._path(f"{self.folder}/chunks/generation={generation}"))
        return time.time() * 1000 - status.getModificationTime() > GRACE_MS

    def status(self) -> DataFrame:
        return status(self.files())

    def clear(self) -> None:
        self._delete(self.top)
