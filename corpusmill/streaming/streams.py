"""Streaming forms: folding streamed answers, keeping an index up to date, and per-conversation state."""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.functions import text as T
from corpusmill.operators.index import Index

PARTS = "request_id string, seq long, message struct<content:string,thinking:string,tool_calls:array<string>>, done boolean"
_LISTED = "path string, mtime_ms long, size long"


def answer_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Streams NDJSON parts of answers: request_id, seq, content, thinking, tool_calls, done."""
    return spark.readStream.schema(PARTS).json(folder).select("request_id", "seq", "message.*", "done")


def keep_index(files: DataFrame, index: Index, read: Callable[[DataFrame], DataFrame], clock: Callable[[], int], checkpoint: str) -> StreamingQuery:
    """Each batch of listed files (path, mtime_ms, size; change, if there is such a column): what changed is read (to chunks with embeddings) and upserted, what was removed is taken out."""
    follows = "change" in files.columns

    def upsert(batch: DataFrame, _: int) -> None:
        if follows:
            gone = batch.where("change = 'removed'").select("path")
            batch = batch.where("change <> 'removed'")
            index.remove(gone)
        latest = batch.groupBy("path").agg(F.max_by(F.struct("mtime_ms", "size"), "mtime_ms").alias("l")).select("path", "l.*")
        changed = index.stale(latest)
        if not changed.isEmpty():
            index.upsert(changed, read(changed), clock())

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_injections(events: DataFrame) -> DataFrame:
    """events (conv_id, key; key null: the conversation is cleared) in a stream: the keys that weren't injected before since the last clearing."""

    def run(key, batches, state: GroupState):
        seen = set(state.get[0]) if state.exists else set()
        for pdf in batches:
            new = []
            for k in pdf["key"]:
                if pd.isna(k):
                    seen.clear()
                elif k not in seen:
                    seen.add(k)
                    new.append(k)
            yield pd.DataFrame({"conv_id": [key[0]] * len(new), "key": new})
        state.update((sorted(seen),))

    return events.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, key string", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


class _TurnMemo(StatefulProcessor):
    """For each conversation the turn that goes on, and for each of its calls the seq of the first one that succeeded."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", "turn long")
        self.memo = handle.getMapState("memo", "key string", "seq long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        calls = pd.concat(list(rows)).sort_values(["turn", "seq"], kind="stable")
        turn = self.turn.get()[0] if self.turn.exists() else None
        sources = []
        for own, seq, call, failed in zip(calls["turn"].tolist(), calls["seq"].tolist(), calls["key"].tolist(), calls["failed"].tolist(), strict=True):
            if turn is None or own > turn:
                self.memo.clear()
                turn = own
            at = (call,)
            known = own == turn and self.memo.containsKey(at)
            sources.append(self.memo.getValue(at)[0] if known else None)
            if own == turn and not known and not failed:
                self.memo.updateValue(at, (seq,))
        if turn is not None:
            self.turn.update((turn,))
        yield pd.DataFrame({"conv_id": key[0], "turn": calls["turn"].to_numpy(), "seq": calls["seq"].to_numpy(), "source": pd.array(sources, "Int64")})

    def close(self) -> None:
        return None


def turn_memo(calls: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of calls (conv_id, turn, seq, name, arguments, error): conv_id, turn, seq and source, the seq of the first successful call of the turn with the same name and arguments, null for that call and before it.

    State is a map for each conversation, emptied when a later turn begins and, with ttl_ms, of entries so old. Turns come in order, and a turn's
    calls in the order of seq, but for calls of one batch, which are put in order; a call of an earlier turn finds nothing. Needs the RocksDB state
    store (`with_rocksdb`). A conversation's calls of one batch are one task's work.
    """
    keyed = calls.select("conv_id", "turn", "seq", T.call_key(F.col("name"), F.col("arguments")).alias("key"), F.col("error").isNotNull().alias("failed"))
    return keyed.groupBy("conv_id").transformWithStateInPandas(_TurnMemo(ttl_ms), "conv_id long, turn long, seq long, source long", "append", "None" if ttl_ms is None else "ProcessingTime")


@contextmanager
def with_rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which states of several columns need, and run batches for data only: a stream with a TTL that ends with its input would else never end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Progress(StreamingQueryListener):
    """Calls back with (done, total) as a stream's batches end, one call at a time: rows done so far, of how many that were announced."""

    def __init__(self, callback: Callable[[int, int], None], total: int):
        self.callback, self.total, self.done, self.lock = callback, total, 0, threading.Lock()

    def add(self, rows: int) -> None:
        with self.lock:
            self.done += rows
            self.callback(self.done, self.total)

    def onQueryStarted(self, event):
        self.add(0)

    def onQueryProgress(self, event):
        if event.progress.numInputRows:
            self.add(event.progress.numInputRows)

    def onQueryTerminated(self, event):
        return None

    def onQueryIdle(self, event):
        return None


def with_progress(step: Callable[[DataFrame, int], None], progress: Progress) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that also tells how many rows are done, for sinks that need the call before the next batch begins."""

    def run(batch: DataFrame, number: int) -> None:
        step(batch, number)
        progress.add(batch.count())

    return run
