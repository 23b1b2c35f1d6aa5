"""Sinks and renderings: JSON lines, tool and result JSON, attachments to prompts, transcripts, a sealed recall log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import conversations
from corpusmill.operators.index import seal
from corpusmill.sources import committed


def json_line(df: DataFrame, name: str = "value") -> DataFrame:
    """Each row as one compact JSON object, nulls left out, nothing escaped beyond JSON's needs."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_line(df).write.mode(mode).text(path)


def commit_json_lines(df: DataFrame, folder: str, mode: str = "append") -> None:
    """write_json_lines through the sink that commits in two phases: all rows or none, each once."""
    committed.write_lines(json_line(df), folder, mode)


def tool_json(value: Column) -> Column:
    """Compact JSON of a struct, map or array, safe to stand in HTML: <, > and & as escapes."""
    out = F.to_json(value)
    for c in "<>&":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value. The parser stops behind a value, whatever follows: so it must stand within an array and within an object, and what ends one of them early or goes on in it is an error in the other."""
    parsed = lambda before, after: F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull()
    return F.try_parse_json(text).isNotNull() & parsed("[", "]") & parsed('{"a":', "}")


def result_json(text: Column) -> Column:
    """Valid JSON as it is, other text as a JSON string, null as an empty one."""
    t = F.coalesce(text, F.lit(""))
    quoted = F.regexp_extract(F.to_json(F.struct(t.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    return F.when(is_json(t), t).otherwise(quoted)


def attach(prompts: DataFrame, corpus: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """prompts with text_col followed by "[Attached: path]" and the text of each @path in it; error names the first path that isn't in the corpus, and then nothing is attached."""
    paths = prompts.select(id_col, F.posexplode(T.at_paths(F.col(text_col))).alias("pos", "path"))
    found = paths.join(corpus.select("path", F.col("text").alias("_content")), "path", "left")
    part = F.concat(F.lit("\n\n[Attached: "), "path", F.lit("]\n"), F.coalesce("_content", F.lit("")))
    sorted_ = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    by = found.groupBy(id_col).agg(F.array_join(F.transform(sorted_, lambda x: x["part"]), "").alias("_parts"), F.min(F.when(F.col("_content").isNull(), F.struct("pos", "path")))["path"].alias("_missing"))
    out = prompts.join(by, id_col, "left")
    body = F.when(F.col("_missing").isNull(), F.concat(text_col, F.coalesce("_parts", F.lit("")))).otherwise(F.col(text_col))
    error = F.when(F.col("_missing").isNotNull(), F.concat("_missing", F.lit(": not found")))
    return out.select(*[c for c in prompts.columns if c != text_col], body.alias(text_col), error.alias("error"))


def write_transcripts(messages: DataFrame, path: str, form: str = "markdown", mode: str = "errorifexists") -> None:
    conversations.transcript(messages, form).write.mode(mode).parquet(path)


def sealed_recall(messages: DataFrame, n: int, key: Column) -> DataFrame:
    """The last n entries of each conversation's recall log as one sealed, compressed and encrypted value."""
    kept = conversations.recall_tail(messages, n)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy("conv_id").agg(lines.alias("log")).select("conv_id", seal(F.col("log"), key).alias("sealed"))


def required_first(arguments: DataFrame) -> DataFrame:
    """Tool arguments (tool, name, required) with their order: required ones first, then by name."""
    return arguments.withColumn("rank", F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("required"), "name")))
