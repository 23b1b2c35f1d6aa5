"""Splitting text into sections, segments and chunks of a bounded number of estimated tokens.

Greedy packing with resets can't be a window, so a chunker runs in Arrow batches: one pass over a text's lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import SPACE
from corpusmill.sources.shared import pieces

MAX_TOKENS = 2000
CHUNKS = "chunk_index int, total int, section string, tokens long, text string"


def tokens(text: str) -> int:
    return len(text) // 4 or int(text.strip(SPACE) != "")


def segments(text: str) -> Iterator[tuple[str, str]]:
    """(section, paragraph): "# name" lines open a section and are not kept, blank lines part paragraphs."""
    section, held, held_section = "", [], ""
    for line in [*text.split("\n"), ""]:
        bare = line.strip(SPACE)
        if bare and not bare.startswith("# "):
            if not held:
                held_section = section
            held.append(line)
            continue
        if paragraph := "\n".join(held).strip(SPACE):
            yield held_section, paragraph
        held = []
        if bare:
            section = bare[2:].strip(SPACE)


def split_long(text: str, most: int) -> Iterator[str]:
    """The text itself, or runs of its lines of at most so many tokens; a line beyond that is cut every 4 * most characters."""
    if tokens(text) <= most:
        yield text
        return
    run, size = [], 0

    def flush():
        # empty lines before the first line leave no trace, those after it do
        body = ""
        for x in run:
            body = f"{body}\n{x}" if body else x
        return body

    for line in text.split("\n"):
        n = tokens(line)
        if n > most or (size and size + n > most):
            if body := flush():
                yield body
            run, size = [], 0
        if n > most:
            yield from (line[i : i + 4 * most] for i in range(0, len(line), 4 * most))
        else:
            run.append(line)
            size += n
    if body := flush():
        yield body


def chunks(text: str | None, most: int = MAX_TOKENS) -> list[dict]:
    """Segments of one section packed up to so many tokens, numbered from 1."""
    most = most if most > 0 else MAX_TOKENS
    packed: list[tuple[str, list[str]]] = []
    size = 0
    for section, paragraph in segments(text or ""):
        for piece in split_long(paragraph, most):
            n = tokens(piece)
            if packed and packed[-1][0] == section and size + n <= most:
                packed[-1][1].append(piece)
                size += n
            else:
                packed.append((section, [piece]))
                size = n
    whole = [(section, "\n\n".join(pieces).strip(SPACE)) for section, pieces in packed]
    return [{"chunk_index": i, "total": len(whole), "section": section, "tokens": tokens(body), "text": body} for i, (section, body) in enumerate(whole, 1)]


def chunk_rows(df: DataFrame, text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A row for each chunk, with the other columns of df; texts without chunks give none."""
    others = [c for c in df.columns if c != text_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*others).schema)
    kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("total", pa.int32()), ("section", pa.string()), ("tokens", pa.int64()), ("text", pa.string())]))

    def run(batches):
        for batch in pieces(batches):
            made = [chunks(t, max_tokens) for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(made, kind)], [*others, "_chunks"])

    schema = f"{kinds + ', ' if kinds else ''}_chunks array<struct<chunk_index:int,total:int,section:string,tokens:bigint,text:string>>"
    return df.select(*others, text_col).mapInArrow(run, schema).select(*others, F.inline("_chunks"))
