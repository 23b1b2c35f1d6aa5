"""Python works on slices of a batch, not on 10,000 rows at once."""

import pyarrow as pa
import pytest

from corpusmill.functions import chunking, extract
from corpusmill.plans import file_queries, text_queries
from corpusmill.sources import shared


def test_pieces():
    batch = pa.record_batch([pa.array(range(9)), pa.array(["x" * 100] * 4 + ["y" * 5000] + [None] * 4)], ["n", "t"])
    got = list(shared.pieces([batch, batch.slice(0, 0)], 300))
    assert pa.Table.from_batches(got) == pa.Table.from_batches([batch])
    assert all(p.nbytes <= 300 or p.num_rows == 1 for p in got) and len(got) > 3


@pytest.mark.parametrize("made", ["extract", "chunks", "rtf", "wordpiece", "templates_parsed", "page_text"])
def test_long_batches_are_cut(spark, made, monkeypatch):
    """What a task is given and what it gives, without Spark's workers: a batch of 8 MB comes out in pieces."""
    tasks = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema, *a, was=frame.mapInArrow: tasks.append(run) or was(self, run, schema, *a))
    texts = spark.createDataFrame([], "path string, text string")
    {
        "extract": lambda: extract.extract(texts, "path", "text"),
        "chunks": lambda: chunking.chunk_rows(texts),
        "rtf": lambda: file_queries.extract_rtf(spark, "/root/testdata/sf0.001"),
        "wordpiece": lambda: text_queries.wordpiece(spark, "/root/testdata/sf0.001"),
        "templates_parsed": lambda: text_queries.templates_parsed(spark, "/root/testdata/sf0.001"),
        "page_text": lambda: extract.page_text(texts, "text"),
    }[made]()
    first = pa.array(["a.txt"] * 2048) if made in ("extract", "chunks", "page_text") else pa.array(range(2048))
    content = pa.array(["word " * 800] * 2048, pa.binary() if made == "extract" else pa.string())
    out = list(tasks[0](iter([pa.record_batch([first, content], ["path", "text"])])))
    assert len(out) >= 8 and sum(b.num_rows for b in out) == 2048
