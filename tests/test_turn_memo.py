"""The memo of a turn's calls as a stream: the batch form's rows over batches and a restart; cleared when a turn ends; entries expire."""

import time

from corpusmill.operators import conversations as C
from corpusmill.streaming import streams

SCHEMA = "conv_id long, turn long, seq long, name string, arguments string, error string"


def run(spark, at, rows, ttl=None):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
    with streams.with_rocksdb(spark):
        memo = streams.turn_memo(spark.readStream.schema(SCHEMA).parquet(f"{at}/in"), ttl)
        memo.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return {(r.conv_id, r.turn, r.seq): r.source for r in spark.read.parquet(f"{at}/out").collect()}


def test_same_as_the_batch_form(spark, tmp_path):
    a, b = '{"x": 1}', '{"x": 2}'
    first = [(1, 0, 2, "f", a, None), (1, 0, 1, "f", a, "lost"), (1, 0, 3, "f", a, None), (2, 0, 1, "f", a, None), (None, 0, 1, "g", b, None)]
    second = [(1, 0, 4, "f", a, None), (1, 0, 5, "f", b, None), (1, 1, 6, "f", a, None), (1, 1, 7, "f", a, None), (None, 0, 2, "g", b, None)]
    third = [(1, 1, 8, "f", b, None), (1, 1, 9, "f", a, None), (2, 3, 2, "f", a, None)]
    for rows in (first, second, third):
        got = run(spark, str(tmp_path), rows)
    want = C.tool_memo(spark.createDataFrame(first + second + third, SCHEMA))
    assert got == {(r.conv_id, r.turn, r.seq): r.source for r in want.collect()}
    assert got[(1, 0, 4)] == 2 and got[(1, 1, 6)] is None and got[(1, 1, 9)] == 6
    assert run(spark, str(tmp_path), [(1, 0, 10, "f", a, None)])[(1, 0, 10)] is None  # its turn is over


def test_entries_expire(spark, tmp_path):
    run(spark, str(tmp_path), [(1, 0, 1, "f", "{}", None)], 1000)
    time.sleep(2)
    assert run(spark, str(tmp_path), [(1, 0, 2, "f", "{}", None)], 1000)[(1, 0, 2)] is None
