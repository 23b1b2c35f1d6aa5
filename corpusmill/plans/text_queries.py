"""Queries of text functions, sinks, index, agent and settings over the driver's tables, and their SQL."""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import embedding as E
from corpusmill.functions import text as T
from corpusmill.operators import conversations as C
from corpusmill.operators import index as I
from corpusmill.operators import retrieval, search, sinks
from corpusmill.operators.text_index import opened
from corpusmill.plans import agent, clients, console, settings, templates
from corpusmill.plans.registry import _DOCS, _K, _M, _NORMALIZE, _PATHS, _RECALL, _SP, _TOKENS, _VOCABULARY, _cut_sql, _query_vector, _vector_chunks, _word_vocabulary, documents, messages, paths, query, table, text_index
from corpusmill.sources import committed
from corpusmill.sources.shared import new_folder, pieces

# --- scalar functions ---------------------------------------------------------------------------------------------------


@query(f"select doc_id, left(text, 17) as head from ({_DOCS})")
def truncate_runes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.truncate(F.col("text"), 17).alias("head"))


@query("select doc_id, case when doc_id % 50 = 7 then -1 else (doc_id % 18278)::int end as place from documents")
def column_index(spark, sf_dir):
    """Cell references made from numbers: column_index gives the numbers back; -1 for a reference without letters."""
    n = F.col("doc_id") % 18278
    letter = lambda x: F.char((x + 65).cast("int"))
    two, three = n - 26, n - 26 - 26 * 26
    name = F.when(n < 26, letter(n)).when(two < 26 * 26, F.concat(letter(F.floor(two / 26)), letter(two % 26))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    reference = F.concat(F.when(F.col("doc_id") % 50 == 7, "").when(F.col("doc_id") % 2 == 0, F.lower(name)).otherwise(name), (F.col("doc_id") + 1).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.column_index(reference).alias("place"))


@query("select doc_id, case when doc_id % 5 = 0 then '' else doc_id || chr(9) || chr(9) || coalesce(lang, '') || chr(9) || chr(9) end as line from documents")
def join_row(spark, sf_dir):
    empty = F.col("doc_id") % 5 == 0
    cells = F.create_map(F.lit(2), F.when(empty, "").otherwise(F.coalesce("lang", F.lit(""))), F.lit(0), F.when(empty, "").otherwise(F.col("doc_id").cast("string")), F.lit(4), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.join_row(cells).alias("line"))


_ARGUMENTS = "select doc_id, [doc_id::varchar, ' ' || doc_id || '.75 ', 'x' || doc_id, '-' || doc_id, 'Yes', ' off', '1', ''][doc_id % 8 + 1] as x from documents"


@query(f"""select doc_id, trunc(try_cast(trim(x, {_SP}) as double))::bigint as whole, try_cast(trim(x, {_SP}) as double) as number,
case when lower(trim(x, {_SP})) in ('true', '1', 'yes', 'y', 'on') then true when lower(trim(x, {_SP})) in ('false', '0', 'no', 'n', 'off') then false end as flag from ({_ARGUMENTS})""")
def arg_coerce(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    forms = F.array(d, F.concat(F.lit(" "), d, F.lit(".75 ")), F.concat(F.lit("x"), d), F.concat(F.lit("-"), d), F.lit("Yes"), F.lit(" off"), F.lit("1"), F.lit(""))
    x = F.element_at(forms, (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.as_int(x).alias("whole"), T.as_float(x).alias("number"), T.as_bool(x).alias("flag"))


@query("select doc_id, 'a|b' || doc_id || '|null' as kept from documents")
def string_slice(spark, sf_dir):
    x = F.concat(F.lit('["a", 1, null, "b'), F.col("doc_id").cast("string"), F.lit('", true, ["c"], {"d": "e"}, 2.5, "null"]'))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.only_strings(x), "|").alias("kept"))


_SPACED = "select doc_id, [chr(160) || chr(12288), '', chr(8195) || text || chr(5760), replace(text, ' ', chr(8199)), replace(text, chr(10), chr(12288) || chr(10) || chr(160))][doc_id % 5 + 1] as text from (" + _DOCS + ")"


@query(f"""select doc_id, ({_TOKENS})::bigint as tokens, {_NORMALIZE} as text from (select doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(x, {_SP})) as a from ({_SPACED}))""")
def unicode_space(spark, sf_dir):
    """White space beyond ASCII is trimmed, and is no text."""
    t = F.col("text")
    forms = F.array(F.lit("\xa0　"), F.lit(""), F.concat(F.lit(" "), t, F.lit(" ")), F.replace(t, F.lit(" "), F.lit(" ")), F.replace(t, F.lit("\n"), F.lit("　\n\xa0")))
    d = documents(spark, sf_dir).withColumn("text", F.element_at(forms, (F.col("doc_id") % 5 + 1).cast("int")))
    return d.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.normalize_ws(F.col("text")).alias("text"))


# --- embeddings ---------------------------------------------------------------------------------------------------------


@query("""select b::int as bits, case when e = 0 then m / 1024.0 / 16384.0 else pow(2, e - 15) * (1 + m / 1024.0) end * case when b >= 32768 then -1 else 1 end + 0.0 as value
from (select b, (b // 1024) % 32 as e, b % 1024 as m from range(65536) r(b)) where e < 31""")
def f16to32(spark, sf_dir):
    """All finite halves, subnormal ones too, read from a safetensors file's bytes."""
    bits = np.arange(65536, dtype="<u2")
    bits = bits[(bits >> 10) % 32 < 31]
    head = json.dumps({"x": {"dtype": "F16", "shape": [len(bits)], "data_offsets": [0, 2 * len(bits)]}}).encode()
    values = E.tensors(len(head).to_bytes(8, "little") + head + bits.tobytes())["x"].astype(np.float64)
    return spark.createDataFrame(pd.DataFrame({"bits": bits.astype(np.int32), "value": values + 0.0})).select("bits", "value")


def _pieces() -> dict[str, int]:
    """A vocabulary of whole words, letters, and pieces that go on a word."""
    whole = ["[UNK]", "the", "of", "and", "ing", "tion", "der", "que", *"abcdefghijklmnopqrstuvwxyz.,"]
    inner = ["er", "ing", "tion", "es", "en", *"abcdefghijklmnopqrstuvwxyz"]
    return {w: i for i, w in enumerate([*whole, *("##" + x for x in inner)])}


_MAP = "map {" + ", ".join(f"'{w}': {i}" for w, i in _pieces().items()) + "}"


@query(f"""with recursive v as (select {_MAP} as m), w as (select doc_id, unnest(regexp_extract_all(lower(text), '[!-/:-@\\[-`{{-~]|[^ \\t\\n\\r!-/:-@\\[-`{{-~]+')) as word from ({_DOCS})),
d as (select distinct word from w),
r as (select word, 1 as pos, []::int[] as ids, length(word) > 100 as bad from d
 union all select word, pos + l, list_append(ids, m[case when pos > 1 then '##' else '' end || substr(word, pos, l)]), l is null from (select r.word, pos, ids, m, list_filter([4, 3, 2, 1], lambda n: pos + n - 1 <= length(r.word) and m[case when pos > 1 then '##' else '' end || substr(r.word, pos, n)] is not null)[1] as l from r, v where not bad and pos <= length(r.word))),
f as (select word, case when bad then [0] else ids end as ids from r where bad or pos > length(word))
select doc_id, sum(len(ids))::bigint as n, sum(list_sum(ids))::bigint as total, sum(len(list_filter(ids, lambda x: x = 0)))::bigint as unknown from w join f using (word) group by doc_id""")
def wordpiece(spark, sf_dir):
    """Greedy pieces with continuations over every text: how many, the sum of their ids, how many unknown words."""
    model = E.WordPiece(_pieces())

    def run(batches):
        for some in pieces(batches):
            flat, sizes = model.batch(some.column(1).to_pylist())
            ids = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
            counts = [[len(x) for x in ids], [int(x.sum()) for x in ids], [int((x == 0).sum()) for x in ids]]
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, pa.int64()) for c in counts)], ["doc_id", "n", "total", "unknown"])

    return documents(spark, sf_dir).mapInArrow(run, "doc_id long, n long, total long, unknown long").where("n > 0")


@query(f"""with v(token, id) as (values {_VOCABULARY}),
w as (select doc_id, unnest(regexp_extract_all(lower(text), '[!-/:-@\\[-`{{-~]|[^ \\t\\n\\r!-/:-@\\[-`{{-~]+')) as token from ({_DOCS})),
x as (select doc_id, coalesce(id, 0) as id from w left join v using (token)),
s as (select doc_id, sum((id * 7) % 11 - 5) as a, sum((id * 7 + 3) % 11 - 5) as b, sum((id * 7 + 6) % 11 - 5) as c, sum((id * 7 + 9) % 11 - 5) as d from x group by doc_id)
select doc_id, round(a / sqrt(a * a + b * b + c * c + d * d), 2) + 0.0 as e0, round(d / sqrt(a * a + b * b + c * c + d * d), 2) + 0.0 as e3 from s where a <> 0 or b <> 0 or c <> 0 or d <> 0""")
def embed(spark, sf_dir):
    """Mean of the words' vectors to unit length."""
    vocabulary, vectors = _word_vocabulary()
    model = E.StaticModel(E.WordPiece(vocabulary, prefix="\x00"), np.array(vectors, np.float32))
    d = documents(spark, sf_dir).select("doc_id", E.column(model, F.col("text")).alias("e"))
    return d.where(F.exists("e", lambda x: x != 0)).select("doc_id", *[F.round(F.col("e")[i].cast("double"), 2).alias(f"e{i}") for i in (0, 3)])


@query("""with c as (select item_id, i, substr(text, i, 1) as ch from (select item_id, coalesce(text, '') as text from benchmark), unnest(range(1, length(text) + 1)) u(i)),
p as (select item_id, ord(ch) as n, (sum(strlen(ch)) over (partition by item_id order by i) - strlen(ch)) % 8 as slot from c)
select item_id, sum(n) filter (where slot = 0)::bigint as s0, sum(n) filter (where slot = 3)::bigint as s3, sum(n) filter (where slot = 7)::bigint as s7 from p group by item_id""")
def hash_embedder(spark, sf_dir):
    """The embedder that tests use, behind the same function as any other."""
    e = table(spark, sf_dir, "benchmark").where("length(text) > 0").select("item_id", E.column(E.HashEmbedder(False), F.col("text")).alias("e"))
    return e.select("item_id", *[F.col("e")[i].cast("long").alias(f"s{i}") for i in (0, 3, 7)])


# --- search and context -------------------------------------------------------------------------------------------------


@query("select 'doc' || (vec_id // 10) || '.md#' || (vec_id % 10 + 1) as key from embeddings where vec_id % 2 = 0 or vec_id % 3 = 0")
def injected_keys(spark, sf_dir):
    k = table(spark, sf_dir, "embeddings").select("vec_id", T.chunk_key(F.concat(F.lit("doc"), F.floor(F.col("vec_id") / 10).cast("string"), F.lit(".md")), F.col("vec_id") % 10 + 1).alias("key"))
    return search.injected_keys(k.where("vec_id % 2 = 0"), k.where("vec_id % 3 = 0"))


@query(f"""with p as (select * from (select * from ({_K}) order by score desc, path, chunk_index limit 5))
select string_agg('{{"path":"' || path || '","chunk_index":' || chunk_index || ',"text":"' || text || '"}}', ',' order by score desc, path, chunk_index) as shown, string_agg(path || '#' || chunk_index, ' ' order by score desc, path, chunk_index) as keys from p""")
def render_context(spark, sf_dir):
    """The context as JSON (scores left out, their digits depend on the engine) and its keys."""
    body, keys = search.render_context(search.auto_context(_vector_chunks(spark, sf_dir), _query_vector(spark, sf_dir)))
    rows = [{k: v for k, v in r.items() if k != "score"} for r in json.loads(body)]
    return spark.createDataFrame([(",".join(json.dumps(r, separators=(",", ":")) for r in rows), " ".join(keys))], "shown string, keys string")


_SEARCHED = f"""select path, i as line, case when length(t) > 200 then left(t, 200) || '…' else t end as excerpt from (select path, i, trim(l, {_SP}) as t from ({_PATHS}) f, unnest(string_split(f.text, chr(10))) with ordinality u(l, i) where f.doc_id % 11 <> 0 and contains(lower(l), 'tion'))"""


def _contents(spark, sf_dir) -> DataFrame:
    """Files of the documents; every eleventh is binary."""
    d = paths(spark, sf_dir).join(documents(spark, sf_dir), "doc_id")
    return d.select("path", F.concat(F.when(F.col("doc_id") % 11 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")), F.col("text").cast("binary")).alias("content"))


_REPORT = f"""with m as (select * from ({_SEARCHED}) order by string_split(path, '/'), line limit 200), o as (select max(string_split(path, '/')) as last, count(*) >= 200 as truncated from m)
select m.path, m.line::bigint as line, m.excerpt, truncated, (select count(*) from ({_PATHS}) f, o where not truncated or string_split(f.path, '/') <= last) as files_inspected from m, o"""


@query(_REPORT)
def search_report(spark, sf_dir):
    """Matches, whether there may be more, and how many files were opened, binary ones too, up to the last match."""
    r = search.search_report(_contents(spark, sf_dir), "TION")
    return r.select(F.inline("matches"), "truncated", "files_inspected").select("path", "line", "excerpt", "truncated", "files_inspected")


@query(_REPORT)
def search_report_indexed(spark, sf_dir):
    """The same from an index: groups in walk order until the limit, files counted from the zones."""
    r = text_index(opened(_contents(spark, sf_dir)), sf_dir, "files").report("TION")
    return r.select(F.inline("matches"), "truncated", "files_inspected").select("path", F.col("line").cast("long").alias("line"), "excerpt", "truncated", "files_inspected")


@query(f"select path from ({_PATHS}) where doc_id % 11 <> 0")
def sniff_text(spark, sf_dir):
    """Texts by their first 8192 bytes: what a search reads."""
    return search.searchable(_contents(spark, sf_dir), 1 << 30).select("path")


@query(f"select path from ({_PATHS}) where n_chars between 1 and 2000 order by string_split(path, '/') limit 200")
def size_semantic(spark, sf_dir):
    return search.embeddable(paths(spark, sf_dir).select("path", "size"), 200, 2000).select("path")


@query(f"select path from ({_PATHS}) where doc_id % 11 <> 0 and strlen(coalesce(text, '')) <= 2000")
def size_exact(spark, sf_dir):
    return search.searchable(_contents(spark, sf_dir), 2000).select("path")


@query(f"select path, (doc_id % 7 * 1000)::bigint as modified from ({_PATHS}) order by doc_id % 7 desc, string_split(path, '/')")
def list_dir_newest(spark, sf_dir):
    from corpusmill.operators import listing

    return listing.list_dir(paths(spark, sf_dir), 3, sort_by="modified_time").select("path", F.unix_seconds("modified_at").alias("modified"))


@query(f"select regexp_extract(path, '^(.*)/', 1) as p, count(*) as c, string_agg(path, ' ' order by path) as f from ({_PATHS}) group by 1")
def find_all_files(spark, sf_dir):
    from corpusmill.operators import listing

    return listing.all_files_by_folder(paths(spark, sf_dir)).select("p", "c", F.array_join("f", " ").alias("f"))


# --- sinks and attachments ----------------------------------------------------------------------------------------------


_JSON_LINES = "select doc_id, '{\"doc_id\":' || doc_id || case when lang is null then '' else ',\"lang\":\"' || lang || '\"' end || case when text is null then '' else ',\"text\":' || to_json(text) end || '}' as value from documents"


@query(_JSON_LINES)
def sink_json_result(spark, sf_dir):
    """JSON lines as written and read back."""
    at = new_folder(spark, "json-lines")
    sinks.write_json_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), at)
    return spark.read.text(at).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "value")


@query(_JSON_LINES)
def sink_json_committed(spark, sf_dir):
    """Written in two commits over an older content, with a write between them that fails half-way."""
    at = new_folder(spark, "committed-lines")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    sinks.commit_json_lines(d.withColumn("text", F.lit("old")), at)
    sinks.commit_json_lines(d.where("doc_id % 2 = 0"), at, "overwrite")
    broken = d.withColumn("lang", F.when(F.col("doc_id") % 5 == 4, F.raise_error(F.lit("half-way"))).otherwise(F.col("lang")))
    try:
        sinks.commit_json_lines(broken, at)
    except (PySparkException, Py4JJavaError):
        sinks.commit_json_lines(d.where("doc_id % 2 <> 0 or doc_id is null"), at)
    return committed.read_lines(spark, at).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "value")


@query("select doc_id, replace(replace(replace('[{\"doc_id\":' || doc_id || ',\"text\":' || to_json('<' || coalesce(text, '') || '&>') || '}]', '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') as json from documents")
def render_tool_json(spark, sf_dir):
    text = F.concat(F.lit("<"), F.coalesce("text", F.lit("")), F.lit("&>"))
    return table(spark, sf_dir, "documents").select("doc_id", sinks.tool_json(F.array(F.struct("doc_id", text.alias("text")))).alias("json"))


@query(f"select doc_id, case doc_id % 4 when 0 then '{{\"id\": ' || doc_id || '}}' when 1 then to_json(text)::varchar when 2 then '\"\"' else to_json('{{' || doc_id)::varchar end as json from ({_DOCS})")
def to_result_json(spark, sf_dir):
    d, n = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    text = F.when(n == 0, F.concat(F.lit('{"id": '), d, F.lit("}"))).when(n == 1, F.col("text")).when(n == 3, F.concat(F.lit("{"), d))
    return documents(spark, sf_dir).select("doc_id", sinks.result_json(text).alias("json"))


@query(f"""select conv_id, '[' || chr(10) || string_agg('  {{' || chr(10) || '    "role": "' || role || '",' || chr(10) || '    "content": ' || replace(replace(replace(to_json(text)::varchar, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') || chr(10) || '  }}', ',' || chr(10) order by turn) || chr(10) || ']' || chr(10) as text
from ({_M}) where role = 'user' or (role = 'assistant' and text <> '') group by conv_id""")
def transcript_json(spark, sf_dir):
    return C.transcript(messages(spark, sf_dir), "json")


@query(f"select doc_id, (strlen(text) + 29)::bigint as bytes, 2 as flags, sha256(text) as opened, sha256(text) as inflated from ({_DOCS})")
def seal_open(spark, sf_dir):
    """Sealed under a key, plain and deflated, and opened again."""
    key = F.lit(b"0123456789abcdef")
    d = documents(spark, sf_dir).select("doc_id", I.seal(F.col("text"), key, False).alias("s"), I.seal(F.col("text"), key).alias("z"))
    flags = F.conv(F.hex(F.substring("s", 1, 1)), 16, 10).cast("int")
    return d.select("doc_id", F.octet_length("s").cast("long").alias("bytes"), flags.alias("flags"), F.sha2(I.unseal(F.col("s"), key), 256).alias("opened"), F.sha2(I.unseal(F.col("z"), key), 256).alias("inflated"))


@query(f"select conv_id, string_agg(text, chr(10) order by turn) as log from ({_RECALL} where back <= 3) group by conv_id")
def history_sealed(spark, sf_dir):
    key = F.lit(b"0123456789abcdef")
    return sinks.sealed_recall(messages(spark, sf_dir), 3, key).select("conv_id", I.unseal(F.col("sealed"), key).cast("string").alias("log"))


@query("select tool, name, required, row_number() over (partition by tool order by required desc, name) as rank from (select 't' || (doc_id % 7) as tool, 'a' || doc_id as name, doc_id % 3 = 0 as required from documents)")
def required_first(spark, sf_dir):
    d = F.col("doc_id")
    a = table(spark, sf_dir, "documents").select(F.concat(F.lit("t"), (d % 7).cast("string")).alias("tool"), F.concat(F.lit("a"), d.cast("string")).alias("name"), (d % 3 == 0).alias("required"))
    return sinks.required_first(a).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with p as (select doc_id, path, coalesce(text, '') as text from ({_PATHS})), q as (select item_id, (select min(doc_id) from p) + item_id % 100 as d from benchmark)
select item_id, case when item_id % 5 = 0 then 'see @gone\\ here.txt' else 'see @' || path || ' now' || chr(10) || chr(10) || '[Attached: ' || path || ']' || chr(10) || text end as text, case when item_id % 5 = 0 then 'gone here.txt: not found' end as error from q join p on p.doc_id = q.d""")
def expand_at_tokens(spark, sf_dir):
    corpus = paths(spark, sf_dir).join(documents(spark, sf_dir), "doc_id")
    least = corpus.agg(F.min("doc_id")).first()[0]
    q = table(spark, sf_dir, "benchmark").select("item_id", (F.lit(least) + F.col("item_id") % 100).alias("doc_id")).join(corpus.select("doc_id", "path"), "doc_id")
    text = F.when(F.col("item_id") % 5 == 0, "see @gone\\ here.txt").otherwise(F.concat(F.lit("see @"), "path", F.lit(" now")))
    return sinks.attach(q.select("item_id", text.alias("text")), corpus.select("path", "text"), "item_id")


# --- conversations, agent, clients --------------------------------------------------------------------------------------


@query(f"select conv_id, turn, ((strlen(text) + strlen(role)) // 4 + 768 * (turn % 3))::bigint as tokens from ({_M})")
def message_tokens_images(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("thinking", F.col("role")).withColumn("images", F.array_repeat(F.lit("i"), (F.col("turn") % 3).cast("int")))
    return C.message_tokens(m, "thinking", "images").select("conv_id", "turn", "tokens")


def _by_conversation(spark, sf_dir, one, schema: str) -> DataFrame:
    """one(conv_id, [(turn, role, text)]) of every conversation, in a task each."""
    m = messages(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(c, [(x["turn"], x["role"], x["text"]) for x in rows]) for c, rows in zip(pdf["conv_id"], pdf["m"], strict=True)], columns=names)

    return m.mapInPandas(run, schema)


@query(f"""select conv_id, string_agg(case when role = 'assistant' then text else '' end, '' order by turn) as content, string_agg(case when role <> 'assistant' then text else '' end, '' order by turn) as thinking, count(*) filter (where turn = 2) as calls, conv_id % 4 <> 0 as ended from ({_M}) group by conv_id""")
def chat_stream(spark, sf_dir):
    """Each conversation sent as the parts of one streamed answer; one in four breaks off before its end, which is an error."""

    def one(conv, rows):
        lines = [json.dumps({"message": {("content" if role == "assistant" else "thinking"): text, "tool_calls": [{"function": {"name": "f", "arguments": {}}}] if turn == 2 else None}, "done": False}).encode() for turn, role, text in rows]
        seen: list[dict] = []
        done = [b"", b'{"done": true}'] if conv % 4 else []
        try:
            clients.Server(lambda path, body: [*lines, *done], "m").chat([], [], seen.append)
            ended = True
        except OSError:
            ended = False
        out = clients.Server(lambda path, body: [*lines, b'{"done": true}'], "m").chat([], [])
        assert len(seen) == len(lines) + ended
        return conv, out["content"], out["thinking"], len(out["tool_calls"]), ended

    return _by_conversation(spark, sf_dir, one, "conv_id long, content string, thinking string, calls long, ended boolean")


@query("select conv_id, 'm' || conv_id || ' m2' as models, case when conv_id % 2 = 0 then 'tools vision' else 'tools' end as capabilities, case when conv_id % 3 = 0 then 0 else conv_id * 8 end as context_length, 3 / 5.0::double as first, case when conv_id % 5 = 0 then '1 vectors for 2 texts' end as error from (select distinct conv_id from conversations)")
def model_calls(spark, sf_dir):
    """What a server says of its models: names, one's capabilities and context length; remote vectors to unit length, a wrong number of them refused."""

    def one(conv, _):
        info = {} if conv % 3 == 0 else {"a.other": 1, "z.context_length": conv * 8}
        said = {"/api/tags": {"models": [{"name": f"m{conv}"}, {"name": "m2"}]}, "/api/show": {"capabilities": ["tools", "vision"] if conv % 2 == 0 else ["tools"], "model_info": info}, "/api/embed": {"embeddings": [[3.0, 4.0]] if conv % 5 == 0 else [[3.0, 4.0], [0.0, 2.0]]}}
        server = clients.Server(lambda path, body: [json.dumps(said[path]).encode()], "m")
        capabilities, length = server.show()
        try:
            first, error = float(server.embed(["a", "b"])[0, 0]), None
        except OSError as e:
            first, error = float(server.embed(["a"])[0, 0]), str(e)
        return conv, " ".join(server.models()), " ".join(capabilities), length, round(first, 6), error

    return _by_conversation(spark, sf_dir, one, "conv_id long, models string, capabilities string, context_length long, first double, error string")


@query(f"""with s as (select conv_id, count(*) as n, string_agg(text, '' order by turn) filter (where role = 'user') as said, string_agg(role, chr(10) order by turn) as roles from ({_M}) group by conv_id)
select conv_id, case when n > 6 then null else 'done ' || length(coalesce(said, '')) end as answer, case when n > 6 then null else roles end as reasoning, least(n, 6)::bigint as calls, (least(n, 6) - 1)::bigint as repeated,
case when n > 6 then 0 else 1 end::bigint as unknown, case when n > 6 then 1 + 2 * 6 else 2 + 2 * n + 2 end::bigint as messages from s""")
def agent_run(spark, sf_dir):
    """A scripted model that thinks and calls a tool once a message, always with the same arguments, then an unknown one, then answers; more than six calls run out."""

    def one(conv, rows):
        ran: list[dict] = []
        said = "".join(text for _, role, text in rows if role == "user")
        script = [{"thinking": role, "content": "", "tool_calls": [{"name": "look", "arguments": {"b": 1, "a": [2]}}]} for _, role, _ in rows]

        class Model:
            def chat(self, history, tools):
                assert all("thinking" not in m for m in history)
                return script.pop(0)

        script += [{"tool_calls": [{"name": "nope"}]}, {"content": f"done {len(said)}"}] if len(rows) <= 6 else []

        def look(arguments):
            ran.append(arguments)
            return "plain <text>"

        limit = len(rows) + 1 if len(rows) <= 6 else 6
        try:
            out = agent.Agent(Model(), {"look": look}, max_calls=limit).run([{"role": "user", "content": "?"}])
        except agent.OutOfCalls as e:
            return conv, None, None, 6, 6 - len(ran), 0, len(e.messages)
        unknown = sum("error" in c for c in out.tool_calls)
        calls = len(out.tool_calls) - unknown
        return conv, out.answer, out.reasoning, calls, calls - len(ran), unknown, len(out.messages)

    return _by_conversation(spark, sf_dir, one, "conv_id long, answer string, reasoning string, calls long, repeated long, unknown long, messages long")


_TOOLS = [("list_dir", "path", 5), ("read", "", 4), ("search", "query", 7), ("stat_file", "path", 1), ("get_chunk", "path,chunk_index", 2), ("read_image", "path", 1), ("fetch_url", "url", 1)]


@query("with t(place, name, required, properties) as (values " + ", ".join(f"({i}, '{n}', '{r}', {p})" for i, (n, r, p) in enumerate(_TOOLS)) + "), c(vision, web) as (values (false, false), (true, false), (false, true), (true, true)) select vision, web, name, required, properties::bigint as properties, row_number() over (partition by vision, web order by place) as place from t, c where (vision or name <> 'read_image') and (web or name <> 'fetch_url')")
def tool_registry(spark, sf_dir):
    """Tools that a model is told of, by what it and the settings allow."""
    rows = []
    for vision, fetch in itertools.product((False, True), repeat=2):
        for place, d in enumerate(agent.definitions(vision, fetch), 1):
            f = d["function"]
            rows.append((vision, fetch, f["name"], ",".join(f["parameters"]["required"]), len(f["parameters"]["properties"]), place))
    return spark.createDataFrame(rows, "vision boolean, web boolean, name string, required string, properties long, place long")


_LINES = "select doc_id, regexp_replace(concat_ws(' ', source, lang, text), '[^a-zA-Z ]', '', 'g') as t from documents"


@query(f"""select doc_id, trim('d ' || t) as description, 'x|' || doc_id as args, trim('say $1 of ' || t) as body, trim(case when doc_id % 3 = 0 then 'say ' || doc_id || ' of ' || t else 'say  of ' || t end) as expanded from (select doc_id, trim(t) as t from ({_LINES}))""")
def templates_parsed(spark, sf_dir):
    """Prompt files with front matter in three forms, parsed and expanded."""
    text = F.trim(F.regexp_replace(F.concat_ws(" ", "source", "lang", "text"), "[^a-zA-Z ]", ""))

    def run(batches):
        for some in pieces(batches):
            out = []
            for n, t in zip(*(c.to_pylist() for c in some.columns), strict=True):
                args = (f"args: [x, {n}]", f"args: x {n}", f"args:\n  - x\n  - {n}")[n % 3]
                made = templates.parse("p", f"---\ndescription: d {t}\n{args}\n---\nsay $1 of {t}", "global")
                out.append((n, made.description, "|".join(made.args), made.body, templates.expand(made.body, [str(n)] if n % 3 == 0 else [])))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, pa.string()) for c in columns[1:])], ["doc_id", "description", "args", "body", "expanded"])

    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return rows.mapInArrow(run, "doc_id long, description string, args string, body string, expanded string")


def _settings_sql() -> str:
    changed = {"max_search_results": "7", "auto_context_min_score": "0.5", "fetch_url_enabled": "true", "mode": "light"}
    rows = ", ".join(f"('{k}', '{changed.get(k, settings.shown(v.default))}')" for k, v in settings.KEYS.items())
    return f"with s(key, value) as (values {rows}) select key, value from s"


@query(_settings_sql())
def settings_loaded(spark, sf_dir):
    """A settings file with comments, unknown keys and unreadable values, one key saved: all 31 values."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:  # read and written on the driver only
        at = Path(folder) / "s.conf"
        at.write_text("# comment\nmax_search_results=abc\nunknown=1\ncache_max_bytes=0\nauto_context_min_score = 0.5\nfetch_url_enabled=YES\nmode=purple\nhistory_limit=-3\n")
        settings.save(at, "max_search_results", "7")
        settings.save(at, "mode", "light")
        rows = [(k, settings.shown(v)) for k, v in settings.load(at).items()]
    return spark.createDataFrame(rows, "key string, value string")


# --- the console --------------------------------------------------------------------------------------------------------


@query(f"""with p as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as before, row_number() over (partition by conv_id, role = 'assistant' order by turn) as nth, turn = min(turn) over (partition by conv_id) as first from ({_M}) where text <> '')
select conv_id, string_agg(case when role = 'assistant' then case when before <> 'assistant' then chr(10) || '{console.DONE_THINKING}' || chr(10) || chr(10) else '' end || case when nth = 1 then case when first then chr(10) else '' end || '{console.RESPONSE}' || chr(10) else '' end || text
 else case when first or before = 'assistant' then chr(10) || '{console.THINKING}' || chr(10) else '' end || text end, '' order by turn) as shown, string_agg(text, '' order by turn) filter (where role = 'assistant') as plain from p group by conv_id""")
def stream_print(spark, sf_dir):
    """Each conversation as the parts of an answer, as a console shows them: others' texts as thinking, the assistant's as content."""

    def one(conv, rows):
        parts = [{"message": {("content" if role == "assistant" else "thinking"): text}} for _, role, text in rows]
        shown, plain = [], []
        full, bare = console.StreamPrinter(shown.append), console.StreamPrinter(plain.append, False)
        for part in parts:
            full.part(part)
            bare.part(part)
        said = "".join(plain).removeprefix(f"\n{console.RESPONSE}\n")
        return conv, "".join(shown) or None, said or None

    return _by_conversation(spark, sf_dir, one, "conv_id long, shown string, plain string").where("shown is not null")


@query(f"select conv_id, ['pbcopy', 'xclip', 'xsel', null][conv_id % 4 + 1] as program, case when conv_id % 4 < 3 then sha256(string_agg(text, chr(10) order by turn)) end as given from ({_M}) group by conv_id")
def clipboard(spark, sf_dir):
    """The first program there is gets the text; without any it is an error."""

    def one(conv, rows):
        there = [c[0] for c in console.CLIPBOARDS][conv % 4 :]
        given: list[bytes] = []
        text = "\n".join(text for _, _, text in rows)
        try:
            name = console.copy_text(text, lambda n: n if n in there else None, lambda command, input, check: given.append(input))
        except OSError:
            return conv, None, None
        return conv, name, hashlib.sha256(given[0]).hexdigest()

    return _by_conversation(spark, sf_dir, one, "conv_id long, program string, given string")


_SLASHED = f"(select *, row_number() over (order by turn) - 1 as idx, count(*) over () as n from ({_M}) where conv_id = (select min(conv_id) from conversations))"


@query(f"""with m as (select * from {_SLASHED}), u as (select idx from m where role = 'user' and idx > 0 order by idx desc limit 1 offset 0), s as (select sum(tokens) filter (where role = 'system') as a, sum(tokens) filter (where role <> 'system') as b from m),
r as (select coalesce(a, 0) as a, coalesce(b, 0) as b, coalesce(a, 0) + coalesce(b, 0) as used from s)
select '/context' as command, repeat('█', least(30, used * 30 // 5000)::int) || repeat('░', 30 - least(30, used * 30 // 5000)::int) || ' ' || case when used < 1000 then used::varchar else printf('%.1fk', used / 1000.0) end || ' of 5000' || chr(10) || 'system ' || a || ', tools 0, conversation ' || b || ', free ' || greatest(0, 5000 - used) as said from r
union all select '/copy last', 'last answer copied to clipboard: ' || (select sha256(arg_max(text, idx)) from m where role = 'assistant' and text <> '')
union all select '/compact 1', case when (select max(idx) from u) > 1 then 'compacted ' || max(n) || ' messages to ' || (2 + max(n) - (select max(idx) from u)) else 'nothing to compact' end from m
union all select '/model m2', 'Switched to model m2 (saved as default).' union all select '/config history_limit 7', 'history_limit = 7' union all select '/tools', 'Available tools (0):' union all select '/clear', 'Conversation history cleared.' union all select '/nope', 'unknown command /nope'""")
def slash_commands(spark, sf_dir):
    """Commands of a session over the first conversation."""
    import tempfile

    m = messages(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    m = m.where(F.col("conv_id") == m.agg(F.min("conv_id")).first()[0])
    copied: list[str] = []
    rows = []
    with tempfile.TemporaryDirectory() as folder:  # read and written on the driver only
        session = console.Session(m, 5000, settings_path=f"{folder}/s.conf", models=lambda: ["m1", "m2"], model="m1", summarise=lambda _: "short", copy=lambda text: copied.append(text) or "x")
        for line in ("/context", "/copy last", "/compact 1", "/model m2", "/config history_limit 7", "/tools", "/clear", "/nope"):
            try:
                said = session.run(line)
            except ValueError as e:
                said = str(e)
            rows.append((line, said + (": " + hashlib.sha256(copied[-1].encode()).hexdigest() if line == "/copy last" else "")))
        assert settings.load(f"{folder}/s.conf")["model"] == "m2"
    return spark.createDataFrame(rows, "command string, said string")


@query("with n as (select count(*) as n from documents) select name, bytes, n.n > 0 as ok from n, (values ('model.safetensors', 11), ('tokenizer.json', 8)) v(name, bytes)")
def download_model(spark, sf_dir):
    """Files of a pinned revision fetched once; an optional one that fails is left out, a partial one never stays."""
    import tempfile

    asked: list[str] = []

    def send(url):
        asked.append(url)
        return (404, b"") if url.endswith("config.json") else (200, b"of " + url.rpartition("/")[2][:5].encode() + (b"..." if "safetensors" in url else b""))

    with tempfile.TemporaryDirectory() as folder:  # on the driver only
        at = clients.ensure_model("a/b", "rev1", folder, send)
        clients.ensure_model("a/b", "rev1", folder, send)
        rows = [(p.name, p.stat().st_size) for p in sorted(at.iterdir())]
        assert at.name == "a_b" and all("/a/b/resolve/rev1/" in u for u in asked) and len(asked) == 4
    n = documents(spark, sf_dir).count()
    return spark.createDataFrame([(*r, n > 0) for r in rows], "name string, bytes int, ok boolean")


_FETCHED = "select doc_id, coalesce(text, '') as text from documents"


def _page(text: str) -> str:
    return f"<html><body><nav>menu</nav><article><h2>Doc</h2>{text}</article><footer>f</footer></body></html>"


@query(f"""with t as (select doc_id, doc_id % 6 as k, text from ({_FETCHED})), c as (select *, {_cut_sql('text', 32768, "chr(10) || chr(10) || '[content truncated]'")} as body from t)
select doc_id, case k when 0 then 'HTTP 200' || chr(10) || chr(10) || body when 1 then 'HTTP 404' || chr(10) || 'Error: Not Found' || case when text = '' then '' else chr(10) || chr(10) || body end when 2 then 'HTTP 200' || chr(10) || chr(10) || 'moved'
 when 3 then 'HTTP 0' || chr(10) || 'Error: http://h' || doc_id || '/: only https' when 4 then 'HTTP 0' || chr(10) || 'Error: https://private/: not a public host' else 'HTTP 200' || chr(10) || chr(10) || '## Doc' || chr(10) || chr(10) || '**' || doc_id || '**' end as said from c""")
def fetch_url(spark, sf_dir):
    """Fetches over a transport that plays a server: texts, errors, redirects, addresses that are refused, pages."""

    def one(n: int, text: str) -> str:
        pages = {f"https://h{n}/": [(200, {"content-type": "text/plain"}, text.encode()), (404, {}, text.encode()), (302, {"location": "/next"}, b""), None, (301, {"location": "https://private/"}, b""), (200, {"content-type": "text/html"}, _page(f"<p><b>{n}</b></p>").encode())][n % 6], f"https://h{n}/next": (200, {}, b"moved")}
        resolve = lambda host: ["10.1.2.3"] if host == "private" else ["8.8.8.8"]
        return clients.fetch(f"http://h{n}/" if n % 6 == 3 else f"https://h{n}/", send=lambda url, address, max_bytes: pages[url], resolve=resolve)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "said": [one(n, t) for n, t in zip(pdf["doc_id"], pdf["text"], strict=True)]})

    return documents(spark, sf_dir).mapInPandas(run, "doc_id long, said string")


# --- the index ----------------------------------------------------------------------------------------------------------

_BUDGET = 3_000_000


@query(f"""with f as (select 'f' || doc_id as path, case when doc_id % 20 = 0 then 3 when doc_id % 10 = 0 then 2 else 1 end as mtime_ms, case when doc_id % 20 = 0 then 'newer ' || doc_id when doc_id % 10 = 0 then 'new ' || doc_id else coalesce(text, '') end as text, case when doc_id % 7 = 0 then 300 when doc_id % 10 = 0 then 200 else 100 end as last_access from documents),
c as (select *, strlen(text) + 1 as blob_size, sum(strlen(text) + 1 + 4096) over (order by last_access desc, path) as upto from f)
select path, mtime_ms::bigint as mtime_ms, last_access::bigint as last_access, blob_size::bigint as blob_size, text from c where upto <= {_BUDGET}""")
def index_lifecycle(spark, sf_dir):
    """An index through a first write, a write that fails and is run again, changed files that two writers commit at once, uses, eviction, and another model and back: its files with their one chunk."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    files = lambda rows, mtime: rows.select("path", F.lit(mtime).cast("long").alias("mtime_ms"), F.lit(1).cast("long").alias("size"))
    chunks = lambda rows: rows.select("path", F.lit(1).alias("chunk_index"), F.lit(1).alias("total"), F.lit("").alias("section"), F.lit(1).cast("long").alias("tokens"), "text", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    at = new_folder(spark, "index")
    old = I.Index(spark, at, "old model")
    old.upsert(files(d, 9), chunks(d.withColumn("text", F.lit("old"))), 50)
    index = I.Index(spark, at, "model")
    index._write_chunks(chunks(d))  # fails here, before its commit
    index.upsert(files(d, 1), chunks(d), 100)
    changed = index.stale(files(d.where("doc_id % 10 = 0"), 2)).join(d, "path").withColumn("text", F.concat(F.lit("new "), F.col("doc_id").cast("string")))
    newer = d.where("doc_id % 20 = 0").withColumn("text", F.concat(F.lit("newer "), F.col("doc_id").cast("string")))
    slow, put = I.Index(spark, at, "model"), I.Index._put

    def late(name: str, said: dict) -> bool:
        """Another writer takes the number just before."""
        slow._put = lambda *args: put(slow, *args)
        index.upsert(files(newer, 3), chunks(newer), 200)
        return slow._put(name, said)

    slow._put = late
    slow.upsert(files(changed, 2), chunks(changed), 200)
    index.hits(files(d.where("doc_id % 7 = 0 and doc_id % 10 <> 0"), 1), 300)
    index.touch(d.where("doc_id % 70 = 0"), 300)
    index.evict(_BUDGET)
    return index.files().join(index.chunks().select("path", "text"), "path").select("path", "mtime_ms", "last_access", "blob_size", "text")


@query("select path, mtime_ms, size from (select 'f' || doc_id as path, doc_id * 10 as mtime_ms, n_chars as size, doc_id % 97 as a from documents) where a not in (3, 5)")
def cache_hits(spark, sf_dir):
    from corpusmill.plans.registry import _index_files

    f = _index_files(spark, sf_dir)
    listed = f.select("path", (F.col("mtime_ms") + (F.col("last_access") == 3).cast("int")).alias("mtime_ms"), "size")
    return I.fresh(listed, f.where("last_access <> 5"))


# --- searches that index, context of all turns --------------------------------------------------------------------------


def _searched_files(spark, sf_dir, changed: bool):
    """(files, read): ten vectors each; where a third of the files has changed, only these are as in the table, the others their opposites."""
    chunks = _vector_chunks(spark, sf_dir).withColumn("total", F.lit(10))
    third = F.regexp_extract("path", r"doc(\d+)", 1).cast("long") % 3 == 0
    mtime = F.when(third, 2).otherwise(1) if changed else F.lit(1)
    files = chunks.select("path").distinct().select("path", mtime.cast("long").alias("mtime_ms"), F.lit(100).cast("long").alias("size"))
    vectors = chunks if changed else chunks.withColumn("embedding", F.transform("embedding", lambda x: -x))
    return files, lambda stale: vectors.join(stale.select("path"), "path", "left_semi")


_FIRST_FILES = "select path from (select distinct 'doc' || (vec_id // 10) || '.md' as path from embeddings) order by path limit 200"


@query(f"""select path, chunk_index, section, round(case when vec_id // 10 % 3 = 0 then score else -score end, 6) as score, text as excerpt from (select *, substr(text, 6)::bigint as vec_id from ({_K})) k
where path in ({_FIRST_FILES}) and (case when vec_id // 10 % 3 = 0 then score else -score end) >= 0 order by (case when vec_id // 10 % 3 = 0 then score else -score end) desc, path, chunk_index limit 10""")
def search_files_indexing(spark, sf_dir):
    """Two searches of a folder: the first indexes it, the second what changed since."""
    index = I.Index(spark, new_folder(spark, "searched"), "model")
    for now, changed in ((1, False), (2, True)):
        files, read = _searched_files(spark, sf_dir, changed)
        found = retrieval.search_files(files, index, read, _query_vector(spark, sf_dir), now)
    return found.withColumn("score", F.round("score", 6))


@query("""with recursive n as (select count(*) as n from embeddings),
t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as r, e.embedding::double[] as q from conversations, n join embeddings e on e.vec_id = (conv_id * 7 + turn) % n),
s as (select conv_id, turn, r, list(struct_pack(id := vec_id, score := score) order by score desc, vec_id) as best from (select conv_id, turn, r, e.vec_id, list_dot_product(e.embedding::double[], q) as score from t, embeddings e) group by conv_id, turn, r),
p as (select conv_id, turn, r, best[1:5] as picked, case when best[1].score >= 0.2 then list_transform(best[1:5], lambda x: x.id) else [] end as seen from s where r = 1
 union all select conv_id, turn, r, picked, case when picked[1].score >= 0.2 then list_concat(seen, list_transform(picked, lambda x: x.id)) else seen end from (select s.conv_id, s.turn, s.r, p.seen, list_filter(s.best, lambda x: not list_contains(p.seen, x.id))[1:5] as picked from p join s on s.conv_id = p.conv_id and s.r = p.r + 1))
select conv_id, turn, x.id as vec_id, round(x.score, 6) as score, i::bigint as rank from p, unnest(picked) with ordinality u(x, i) where picked[1].score >= 0.2""")
def context_for_turns(spark, sf_dir):
    """What each turn of every conversation is given, nothing twice in a conversation."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    turns = messages(spark, sf_dir).select("conv_id", "turn", ((F.col("conv_id") * 7 + F.col("turn")) % n).alias("vec_id"))
    turns = turns.join(e.select("vec_id", F.col("embedding").alias("q")), "vec_id").select("conv_id", "turn", "q")
    return retrieval.context_for_turns(turns, e).withColumn("score", F.round("score", 6))
