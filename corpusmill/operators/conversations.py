"""Conversation analytics. M: messages of (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

IMAGE_TOKENS = 768
WARN_AT = 0.8
#: Fixed value: what stands before a summary.
SUMMARY_HEADING = "[Earlier conversation summary]\n"


def _text(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def message_tokens(messages: DataFrame, thinking: str | None = None, images: str | None = None) -> DataFrame:
    """messages with tokens: bytes of text and thinking by four, and 768 for each image."""
    n = F.octet_length(_text("text")) + (F.octet_length(_text(thinking)) if thinking else 0)
    tokens = F.floor(n / 4).cast("long")
    return messages.withColumn("tokens", tokens + F.coalesce(F.size(images), F.lit(0)) * IMAGE_TOKENS if images else tokens)


def context_report(messages: DataFrame, context_length: int, tool_schema_bytes: int = 0) -> DataFrame:
    """For each conversation: tokens of system messages, tools and the rest, used and free."""
    m = message_tokens(messages)
    system = F.coalesce(F.sum(F.when(F.col("role") == "system", F.col("tokens"))), F.lit(0))
    rest = F.coalesce(F.sum(F.when(F.col("role").eqNullSafe("system"), F.lit(0)).otherwise(F.col("tokens"))), F.lit(0))
    out = m.groupBy("conv_id").agg(system.alias("system_tokens"), rest.alias("conversation_tokens")).withColumn("tool_tokens", F.lit(tool_schema_bytes // 4).cast("long"))
    out = out.withColumn("used", F.col("system_tokens") + F.col("tool_tokens") + F.col("conversation_tokens"))
    return out.withColumn("context_length", F.lit(context_length).cast("long")).withColumn("free", F.greatest(F.lit(0), F.col("context_length") - F.col("used")))


def running_context(messages: DataFrame, context_length: int) -> DataFrame:
    """messages with tokens, running total, and warned: the first message at which it reaches 0.8 of the length."""
    m = message_tokens(messages)
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = m.withColumn("running", F.sum("tokens").over(w))
    at = F.col("running") >= WARN_AT * context_length
    return m.withColumn("warned", at & ~F.coalesce(F.lag("running").over(w) >= WARN_AT * context_length, F.lit(False)))


def compact_cut(messages: DataFrame, keep: int) -> DataFrame:
    """For each conversation where to cut (the place, from 0, of the keep-th last user message; the end for keep 0) and whether there is anything to cut."""
    w = Window.partitionBy("conv_id")
    m = messages.withColumn("idx", F.row_number().over(w.orderBy("turn")) - 1).withColumn("n", F.count("*").over(w))
    if keep <= 0:
        return m.groupBy("conv_id").agg(F.max("n").cast("long").alias("cut"), F.lit(True).alias("ok"))
    users = m.where((F.col("role") == "user") & (F.col("idx") > 0)).withColumn("back", F.row_number().over(w.orderBy(F.desc("idx"))))
    cuts = users.where(F.col("back") == keep).select("conv_id", F.col("idx").cast("long").alias("cut"))
    return messages.select("conv_id").distinct().join(cuts, "conv_id", "left").select("conv_id", "cut", F.col("cut").isNotNull().alias("ok"))


def compact(messages: DataFrame, keep: int, summaries: DataFrame) -> DataFrame:
    """First message, a summary (conv_id, text) in the user's name under a heading, and what follows the cut; conversations without a cut stay."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("idx", F.row_number().over(w) - 1).join(compact_cut(messages, keep), "conv_id")
    kept = m.where(~F.col("ok") | (F.col("idx") == 0) | (F.col("idx") >= F.col("cut"))).select("conv_id", F.col("idx").cast("double").alias("at"), "role", "text")
    said = summaries.join(m.where("ok").select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.lit(0.5).alias("at"), F.lit("user").alias("role"), F.concat(F.lit(SUMMARY_HEADING), "text").alias("text"))
    return kept.unionByName(said).select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("at")) - 1).cast("long").alias("turn"), "role", "text")


def visible(messages: DataFrame) -> DataFrame:
    """User messages, and assistant messages with text."""
    return messages.where((F.col("role") == "user") | ((F.col("role") == "assistant") & (_text("text") != "")))


def transcript(messages: DataFrame, form: str = "markdown", assistant: str = "Assistant") -> DataFrame:
    """conv_id, text of the visible messages: as Markdown, or as JSON, indented by two spaces, with <, > and & as escapes."""
    m = visible(messages)
    if form == "json":
        text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
        for sign in "<>&":
            text = (lambda before, sign: lambda c: F.replace(before(c), F.lit(sign), F.lit(f"\\u{ord(sign):04x}")))(text, sign)
        row = F.concat(F.lit('  {\n    "role": "'), "role", F.lit('",\n    "content": '), text(_text("text")), F.lit("\n  }"))
        rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"])
        return m.groupBy("conv_id").agg(F.concat(F.lit("[\n"), F.array_join(rows, ",\n"), F.lit("\n]\n")).alias("text"))
    head = F.when(F.col("role") == "user", F.lit("## You")).otherwise(F.lit(f"## {assistant}"))
    block = F.concat(head, F.lit("\n\n"), _text("text"), F.lit("\n\n"))
    return m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "").alias("text"))


def last_assistant(messages: DataFrame) -> DataFrame:
    said = messages.where((F.col("role") == "assistant") & (_text("text") != ""))
    return said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def recall_tail(messages: DataFrame, n: int, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """What a recall log keeps: user texts, blank ones and repetitions of the one before left out, the last n."""
    w = Window.partitionBy(*keys).orderBy("turn")
    said = messages.where((F.col("role") == "user") & (F.btrim(_text("text"), F.lit(T.SPACE)) != ""))
    said = said.withColumn("_before", F.lag("text").over(w)).where(~F.col("_before").eqNullSafe(F.col("text"))).drop("_before")
    return said.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("turn")))).where(F.col("_back") <= n).drop("_back")


def strip_injected(messages: DataFrame) -> DataFrame:
    """messages (with a column injected) without what was injected, numbered anew."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.where(~F.coalesce("injected", F.lit(False))).withColumn("turn", (F.row_number().over(w) - 1).cast("long")).drop("injected")


def append_messages(messages: DataFrame, more: DataFrame) -> DataFrame:
    """more (conv_id, turn, role, text) after each conversation's last message."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    added = more.join(last, "conv_id", "left").withColumn("turn", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(w)).cast("long")).drop("_last")
    return messages.unionByName(added)


def citations(calls: DataFrame) -> DataFrame:
    """calls: name, arguments (JSON), result (JSON). Distinct path, line (0: none) of what was read or found, in order."""
    a, r = F.try_parse_json("arguments"), F.try_parse_json("result")
    path = lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, "$.path", "variant")) == "STRING", F.try_variant_get(v, "$.path", "string"))
    kind = F.schema_of_variant(F.try_variant_get(a, "$.start_line", "variant"))
    line = F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(a, "$.start_line", "double").cast("int")).otherwise(0)
    one = calls.where(F.col("name").isin("read", "get_chunk", "stat_file")).select(path(a).alias("path"), F.coalesce(F.when(F.col("name") == "read", line), F.lit(0)).alias("line"))
    paths = F.from_json(F.get_json_object("arguments", "$.paths"), "array<variant>")
    strings = F.transform(F.filter(paths, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    many = calls.where("name = 'read'").select(F.explode(strings).alias("path"), F.lit(0).alias("line"))
    matches = F.from_json(F.get_json_object(F.to_json(r), "$.matches"), "array<struct<path:string,line:int>>")
    found = calls.where("name = 'search'").select(F.explode(matches).alias("m")).select("m.path", F.coalesce("m.line", F.lit(0)).alias("line"))
    return one.unionByName(many).unionByName(found).where("path is not null and path <> ''").distinct().orderBy("path", "line")


def tool_memo(calls: DataFrame) -> DataFrame:
    """calls (conv_id, turn, seq, name, arguments, error) with key and source: the seq of the first successful call of the turn with the same name and arguments, null for that call itself and before it."""
    c = calls.withColumn("key", T.call_key(F.col("name"), F.col("arguments")))
    w = Window.partitionBy("conv_id", "turn", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("source", F.min(F.when(F.col("error").isNull(), F.col("seq"))).over(w))


def stream_fold(parts: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """parts (keys, seq, content, thinking, tool_calls array<string>, done) of streamed answers folded into one row each; complete tells whether an end came."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", _text("content").alias("content"), _text("thinking").alias("thinking"), F.coalesce("tool_calls", F.array().cast("array<string>")).alias("tool_calls"))))
    df = parts.groupBy(*keys).agg(ordered.alias("p"), F.max(F.coalesce("done", F.lit(False))).alias("complete"))
    join = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    return df.select(*keys, join("content").alias("content"), join("thinking").alias("thinking"), F.flatten(F.transform("p", lambda x: x["tool_calls"])).alias("tool_calls"), "complete")
