"""Registered queries over the driver's tables, and the SQL that gives the same rows.

Texts of `documents` stand for files at source/lang/docN.txt. Where a query needs sections and paragraphs it uses the composed
corpus: per source, documents under "# lang" lines, parted by blank lines, with page numbers and a repeated footer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import chunking, extract
from corpusmill.functions import embedding as E
from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators import conversations as C
from corpusmill.operators import index as I
from corpusmill.operators import listing, reading, search
from corpusmill.operators.text_index import TextIndex
from corpusmill.operators.vector_index import VectorIndex
from corpusmill.plans import templates
from corpusmill.sources.shared import new_folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry (path, name, type, size, modified_at, permissions, depth) for each document."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".TXT").otherwise(""))
    return d.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name).alias("path"), name.alias("name"), F.lit("file").alias("type"), F.col("n_chars").alias("size"), F.timestamp_seconds(F.col("doc_id") % 7 * 1000).alias("modified_at"), F.lit("-rw-r--r--").alias("permissions"), F.lit(3).alias("depth"), "doc_id")


_PATHS = """select concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), name) as path, * from
(select *, 'doc' || doc_id || case doc_id % 3 when 0 then '.md' when 1 then '.TXT' else '' end as name from documents)"""


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each block of 25 documents: "# lang" sections, a page number and a footer after each document."""
    d = table(spark, sf_dir, "documents")
    part = F.concat(F.lit("# "), F.coalesce("lang", F.lit("none")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\nPage "), F.col("doc_id").cast("string"), F.lit(" of 20\n  kept for the record \t\n\n"))
    blocks = d.groupBy(F.floor(F.col("doc_id") / 25).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
    return blocks.select(F.concat(F.lit("block"), F.col("block").cast("string"), F.lit(".md")).alias("path"), "text")


_COMPOSED = """select 'block' || block || '.md' as path, string_agg(p, chr(10) order by doc_id) as text from
(select doc_id, doc_id // 25 as block, '# ' || coalesce(lang, 'none') || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Page ' || doc_id || ' of 20' || chr(10) || '  kept for the record ' || chr(9) || chr(10) || chr(10) as p from documents) group by block"""
#: White space that texts and lines are trimmed of, as a SQL string.
_SP = "'" + T.SPACE + "'"
_NORMALIZE = f"""trim(array_to_string(list_filter(a, lambda x, i: x <> '' or i = 1 or a[i - 1] <> ''), chr(10)), {_SP})"""
_TRIMMED = f"list_transform(string_split(text, chr(10)), lambda x: trim(x, {_SP}))"
_PAGE = r"'^\s*(?:page\s+)?\d+(?:\s*(?:/|of)\s*\d+)?\s*$'"
_CLEAN = f"""with l as (select path, i, line, trim(line, {_SP}) as t from ({{source}}) c, unnest(string_split(c.text, chr(10))) with ordinality u(line, i)),
f as (select *, count(*) over (partition by path, t) as n from l),
k as (select path, i, t, lag(t) over (partition by path order by i) as before, row_number() over (partition by path order by i) as r from f
 where t = '' or starts_with(t, '# ') or not (regexp_matches(lower(t), {_PAGE}) or (strlen(t) <= 80 and n >= 3)))
select path, trim(string_agg(t, chr(10) order by i) filter (where t <> '' or r = 1 or before <> ''), {_SP}) as text from k group by path"""
_CLEAN_COMPOSED = _CLEAN.format(source=_COMPOSED)
_TOKENS = f"case when length(text) // 4 = 0 and trim(text, {_SP}) <> '' then 1 else length(text) // 4 end"


def _lines_sql(source: str, keys: str) -> str:
    return f"""select {keys}, i as line, case when ends_with(l, chr(13)) then left(l, length(l) - 1) else l end as text
from (select *, string_split(text, chr(10)) as parts from ({source})) s, unnest(case when parts[-1] = '' then parts[:-2] else parts end) with ordinality u(l, i)"""


_DOCS = "select doc_id, coalesce(text, '') as text from documents"
_EXCERPT = "case when length(t) > 200 then left(t, 200) || '…' else t end"


# --- exact search and reading -------------------------------------------------------------------------------------------


def _exact_sql(needle: str, fold: bool, limit: bool = True) -> str:
    hay = "lower(text)" if fold else "text"
    return f"""select doc_id, line, {_EXCERPT} as excerpt from (select doc_id, line, trim(text, {_SP}) as t from ({_lines_sql(_DOCS, 'doc_id')})
where contains({hay}, '{needle}')) order by doc_id, line{' limit 200' if limit else ''}"""


def _exact(spark, sf_dir, needle, case_sensitive, limit=200):
    return search.search_exact(documents(spark, sf_dir), needle, case_sensitive, limit, ("doc_id",), [F.col("doc_id")])


@query(_exact_sql("tion", True))
def search_exact(spark, sf_dir):
    return _exact(spark, sf_dir, "TION", False)


@query(_exact_sql("Tion", False))
def search_exact_case(spark, sf_dir):
    return _exact(spark, sf_dir, "Tion", True)


@query(_exact_sql("%", False, False))
def search_exact_all_percent(spark, sf_dir):
    return _exact(spark, sf_dir, "%", True, None)


_indexes: dict[tuple, TextIndex] = {}


def text_index(corpus: DataFrame, *name: str) -> TextIndex:
    """An index of the corpus, built once a session under this name, in groups small enough to tell apart at the tables' size."""
    key = (corpus.sparkSession.sparkContext.applicationId, *name)
    if key not in _indexes:
        _indexes[key] = TextIndex.build(corpus, new_folder(corpus.sparkSession, "text-index"), 1 << 18)
    return _indexes[key]


def _indexed(spark, sf_dir, needle, case_sensitive, limit=200):
    """Documents at paths in the order of their ids."""
    corpus = documents(spark, sf_dir).select(F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("path"), "text")
    found = text_index(corpus, sf_dir, "ids").search(needle, case_sensitive, limit)
    return found.select(F.col("path").cast("long").alias("doc_id"), "line", "excerpt")


@query(_exact_sql("tion", True))
def search_exact_indexed(spark, sf_dir):
    """A needle that most groups have: waves in order, ended by the limit."""
    return _indexed(spark, sf_dir, "TION", False)


@query(_exact_sql("Tion", False))
def search_exact_case_indexed(spark, sf_dir):
    return _indexed(spark, sf_dir, "Tion", True)


@query(_exact_sql("é des", True, False))
def search_exact_rare_indexed(spark, sf_dir):
    """A needle of several bytes a character, without a limit: groups that lack one of its grams aren't read."""
    return _indexed(spark, sf_dir, "É DES", False, None)


@query(_exact_sql("%", False, False))
def search_exact_short_indexed(spark, sf_dir):
    """A needle without grams: every group is read."""
    return _indexed(spark, sf_dir, "%", True, None)


@query("select count(*) as files_inspected from documents where strlen(coalesce(text, '')) <= 2097152")
def files_inspected(spark, sf_dir):
    return search.files_inspected(documents(spark, sf_dir))


@query(f"""select doc_id, line, lpad(line::varchar, greatest(6, length(line::varchar))::int, ' ') || chr(9) || text as rendered from ({_lines_sql(_DOCS, 'doc_id')}) where line between 2 and 9""")
def read_lines(spark, sf_dir):
    return reading.read_lines(documents(spark, sf_dir), 2, 9, keys=("doc_id",))


@query(f"""select doc_id, line, rendered from (select *, sum(strlen(rendered) + 1) over (partition by doc_id order by line) as n from
(select doc_id, line, lpad(line::varchar, greatest(6, length(line::varchar))::int, ' ') || chr(9) || text as rendered from ({_lines_sql(_DOCS, 'doc_id')}))) where n <= 2000""")
def read_budget(spark, sf_dir):
    return reading.read_lines(documents(spark, sf_dir), max_bytes=2000, keys=("doc_id",))


_BATCH = f"""with p as ({_PATHS}), w as (select row_number() over (order by doc_id) as pos, path from p union all select 0, 'gone.txt'),
c as (select w.pos, w.path, p.text as whole, p.path is null as gone from w left join p using (path) where w.pos < 20)"""


def _cut_sql(text: str, most: int, notice: str) -> str:
    """The first bytes of a text, at a whole character, and a notice; a shorter text as it is."""
    first = f"list_max(list_filter(range(length({text}) + 1), lambda n: strlen(left({text}, n)) <= {most}))"
    return f"case when strlen({text}) > {most} then left({text}, {first}) || {notice} else {text} end"


@query(_BATCH + f" select pos, path, {_cut_sql('whole', 131072, chr(39) + chr(10) + '[cut after 131072 bytes]' + chr(39))} as text, case when gone then 'not found' end as error from c")
def read_batch(spark, sf_dir):
    """A missing path and the first 19 in order, as many as a batch has, under the operator's own limits."""
    pos, d = _batch(spark, sf_dir)
    return reading.read_batch(d, pos)


def _batch(spark, sf_dir):
    d = paths(spark, sf_dir).join(documents(spark, sf_dir), "doc_id").select("path", "text")
    wanted = paths(spark, sf_dir).orderBy("doc_id").limit(19).select(F.row_number().over(Window.orderBy("doc_id")).cast("long").alias("pos"), "path")
    return spark.createDataFrame([(0, "gone.txt")], "pos long, path string").unionByName(wanted), d


@query(_BATCH + f""", t as (select pos, path, {_cut_sql('whole', 500, chr(39) + chr(10) + '[cut after 500 bytes]' + chr(39))} as text from c)
select string_agg('=== ' || path || ' ===' || chr(10) || coalesce(text, 'Error: not found'), chr(10) || chr(10) order by pos) as text from t""")
def batch_concat(spark, sf_dir):
    pos, d = _batch(spark, sf_dir)
    return reading.render_batch(reading.read_batch(d, pos, max_bytes=500))


# --- text functions -----------------------------------------------------------------------------------------------------


@query(f"select path, {_NORMALIZE} as text from (select path, {_TRIMMED} as a from ({_COMPOSED}))")
def normalize_ws(spark, sf_dir):
    return composed(spark, sf_dir).select("path", T.normalize_ws(F.col("text")).alias("text"))


@query(_CLEAN_COMPOSED)
def clean_for_llm(spark, sf_dir):
    return composed(spark, sf_dir).select("path", T.clean(F.col("text")).alias("text"))


@query(f"""with l as (select path, trim(line, {_SP}) as line from ({_COMPOSED}) c, unnest(string_split(c.text, chr(10))) u(line))
select path, line, count(*) as n from l where line <> '' and strlen(line) <= 80 group by all having count(*) >= 3""")
def line_frequency(spark, sf_dir):
    return reading.line_frequency(composed(spark, sf_dir))


@query(f"select doc_id, ({_TOKENS})::bigint as tokens from ({_DOCS})")
def estimate_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"select doc_id, {_EXCERPT} as excerpt from (select doc_id, trim(text, {_SP}) as t from ({_DOCS}))")
def excerpt(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


_SUMMARY = r"""case when stop > 0 and strlen(left(one, stop)) - 1 <= 120 then left(one, stop) else left(one, 120) end"""
_SUMMARY_OF = r"""select *, case when regexp_matches(one, '[.!?] ') then length(regexp_extract(one, '^(.*?[.!?]) ', 1)) else 0 end as stop from
(select *, regexp_replace(coalesce(list_filter({trimmed}, lambda t: t <> '' and not starts_with(t, '# '))[1], ''), '[{space}]+', ' ', 'g') as one from ({source}))"""


@query(f"select doc_id, {_SUMMARY} as summary from ({_SUMMARY_OF.format(space=T.SPACE, trimmed=_TRIMMED, source=_DOCS)})")
def chunk_summary(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.summary(F.col("text")).alias("summary"))


@query(f"select doc_id, i as piece, substr(text, (i * 500 + 1)::bigint, 500) as text from ({_DOCS}), unnest(range((length(text) + 499) // 500)) u(i)")
def split_by_runes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.split_every(F.col("text"), 500)).alias("piece", "text")).withColumn("piece", F.col("piece").cast("long"))


@query(rf"select doc_id, len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]|[^ \t\n\r!-/:-@\[-`{{-~]+'))::bigint as n_words from ({_DOCS})")
def basic_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(T.basic_split(F.col("text"))).cast("long").alias("n_words"))


@query(f"select item_id, sha256(coalesce(text, '')) as name from benchmark")
def hash_name(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.hash_name(F.coalesce("text", F.lit(""))).alias("name"))


# --- chunks -------------------------------------------------------------------------------------------------------------

def _chunks_sql(source: str, most: int) -> str:
    """Both greedy folds as recursive queries: lines into pieces of at most so many tokens, pieces into chunks of one section."""
    return f"""with recursive c as ({source}),
l as (select path, i, line, trim(line, {_SP}) as t from c, unnest(string_split(c.text, chr(10))) with ordinality u(line, i)),
m as (select *, starts_with(t, '# ') as head, t = '' or starts_with(t, '# ') as cut from l),
g as (select *, sum(cut::int) over (partition by path order by i) as seg, last_value(case when head then trim(t[3:], {_SP}) end ignore nulls) over (partition by path order by i) as sec from m),
p as (select path, seg, coalesce(any_value(sec), '') as sec, trim(string_agg(line, chr(10) order by i), {_SP}) as text from g where not cut group by path, seg),
w as (select path, seg, sec, text, case when length(text) // 4 = 0 then 1 else length(text) // 4 end as tok from p),
sl as (select path, seg, sec, j, line, case when length(line) // 4 = 0 and trim(line, {_SP}) <> '' then 1 else length(line) // 4 end as lt from w, unnest(string_split(w.text, chr(10))) with ordinality u(line, j) where tok > {most}),
r1 as (select path, seg, sec, j, line, lt, lt as cum, 1 as piece from sl where j = 1
 union all select s.path, s.seg, s.sec, s.j, s.line, s.lt, case when s.lt > {most} or r1.lt > {most} or (r1.cum > 0 and r1.cum + s.lt > {most}) then s.lt else r1.cum + s.lt end,
 r1.piece + case when s.lt > {most} or r1.lt > {most} or (r1.cum > 0 and r1.cum + s.lt > {most}) then 1 else 0 end from r1 join sl s on s.path = r1.path and s.seg = r1.seg and s.j = r1.j + 1),
pc as (select path, seg, sec, piece, 0 as sub, string_agg(line, chr(10) order by j) as text from r1 where lt <= {most} group by path, seg, sec, piece
 union all select path, seg, sec, piece, k as sub, substr(line, (k * {4 * most} + 1)::bigint, {4 * most}) from r1, unnest(range((length(line) + {4 * most - 1}) // {4 * most})) u(k) where lt > {most}
 union all select path, seg, sec, 0, 0, text from w where tok <= {most}),
s as (select path, sec, text, row_number() over (partition by path order by seg, piece, sub) as i, case when length(text) // 4 = 0 and trim(text, {_SP}) <> '' then 1 else length(text) // 4 end as t from pc where text <> ''),
r as (select path, i, sec, text, t as cum, 1 as ch from s where i = 1
 union all select s.path, s.i, s.sec, s.text, case when s.sec <> r.sec or r.cum + s.t > {most} then s.t else r.cum + s.t end,
 r.ch + case when s.sec <> r.sec or r.cum + s.t > {most} then 1 else 0 end from r join s on s.path = r.path and s.i = r.i + 1),
k as (select path, ch as chunk_index, any_value(sec) as section, trim(string_agg(text, chr(10) || chr(10) order by i), {_SP}) as text from r group by path, ch),
chunks as (select path, chunk_index::int as chunk_index, (count(*) over (partition by path))::int as total, section, ({_TOKENS})::bigint as tokens, text from k)"""


_CHUNKS = _chunks_sql(_CLEAN_COMPOSED, 200)


def _chunks(spark, sf_dir, max_tokens=200):
    return reading.extract_chunks(composed(spark, sf_dir), max_tokens)


@query(_CHUNKS + " select * from chunks")
def chunk_text(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query(_CHUNKS + f" select path, chunk_index, total, section, tokens, {_SUMMARY} as summary from ({_SUMMARY_OF.format(space=T.SPACE, trimmed=_TRIMMED, source='chunks')})")
def manifest(spark, sf_dir):
    return reading.manifest(_chunks(spark, sf_dir))


@query(_CHUNKS + " select * from chunks where path = 'block1.md' and chunk_index = 3")
def get_chunk(spark, sf_dir):
    return reading.get_chunk(_chunks(spark, sf_dir), "block1.md", 3)


@query(_CHUNKS + """ select path, chunk_index, coalesce(sum(strlen(text) + 1) over (partition by path order by chunk_index rows between unbounded preceding and 1 preceding), 0)::bigint as byte_start,
(coalesce(sum(strlen(text) + 1) over (partition by path order by chunk_index rows between unbounded preceding and 1 preceding), 0) + strlen(text))::bigint as byte_end from chunks""")
def byte_ranges(spark, sf_dir):
    return reading.byte_ranges(_chunks(spark, sf_dir))


#: Every document's cleaned text; a text of which cleaning leaves nothing is an empty one.
_CLEANED = f"""select p.path, coalesce(c.text, '') as text from ({_PATHS}) p left join ({_CLEAN.format(source=_PATHS)}) c using (path)"""


_READ = (_chunks_sql(f"select path, text from ({_CLEANED}) where ({_TOKENS}) > 2000", 2000) + f""" select path, true as cleaned, ({_TOKENS})::bigint as tokens, case when text = '' then '(no extractable text)' else text end as text, null::int as chunk_index, null::int as total, null::varchar as section, null::varchar as summary from ({_CLEANED}) where ({_TOKENS}) <= 2000
union all select path, true, tokens, null, chunk_index, total, section, {_SUMMARY} from ({_SUMMARY_OF.format(space=T.SPACE, trimmed=_TRIMMED, source='chunks')})""")


@query(_READ)
def read_documents(spark, sf_dir):
    """Every document: texts, and manifests of the long ones."""
    return reading.read_documents(paths(spark, sf_dir).join(documents(spark, sf_dir), "doc_id").select("path", "text"))


_ASKED = f"(select path from ({_PATHS}) where doc_id in (select min(doc_id) from documents union all (select doc_id from documents order by n_chars desc nulls last, doc_id limit 1)))"


@query(f"select * from ({_READ}) where path in {_ASKED}")
def read_document(spark, sf_dir):
    """The first document and the longest one: a text and a manifest."""
    p = paths(spark, sf_dir)
    corpus = p.join(documents(spark, sf_dir), "doc_id").select("path", "text")
    first, longest = (p.orderBy(*order).first()["path"] for order in (("doc_id",), (F.desc_nulls_last("size"), "doc_id")))
    return reading.read_document(corpus, first).unionByName(reading.read_document(corpus, longest))


# --- vectors and semantic search ----------------------------------------------------------------------------------------

_Q = "(select embedding::double[] as q from embeddings where vec_id = 0)"


def _query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def _vector_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("doc"), F.floor(F.col("vec_id") / 10).cast("string"), F.lit(".md"))
    return e.select(path.alias("path"), (F.col("vec_id") % 10 + 1).cast("int").alias("chunk_index"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("section"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), F.lit(2).cast("long").alias("tokens"), "embedding")


_K = "select 'doc' || (vec_id // 10) || '.md' as path, (vec_id % 10 + 1)::int as chunk_index, 's' || label as section, 'text ' || vec_id as text, list_dot_product(embedding::double[], q) as score, q from embeddings, " + _Q


_TOP = f"select path, chunk_index, section, round(score, 6) as score, text as excerpt from ({_K}) where score >= 0 order by score desc, path, chunk_index limit 10"


@query(_TOP)
def semantic_topk(spark, sf_dir):
    return search.search_semantic(_vector_chunks(spark, sf_dir), _query_vector(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"select path, chunk_index, section, round(score, 6) as score, text as excerpt from ({_K}) where score >= 0.35 and path <> 'doc1' order by score desc, path, chunk_index limit 10")
def semantic_threshold(spark, sf_dir):
    return search.search_semantic(_vector_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 10, 0.35, [".MD"]).withColumn("score", F.round("score", 6))


_vector_indexes: dict[tuple, VectorIndex] = {}


def vector_index(spark, sf_dir) -> VectorIndex:
    """An index of all chunks' vectors, built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _vector_indexes:
        chunks = _vector_chunks(spark, sf_dir).withColumn("vec_id", F.regexp_extract("text", r"(\d+)$", 1).cast("long"))
        _vector_indexes[key] = VectorIndex.build(chunks, new_folder(spark, "vector-index"), ("path", "chunk_index"))
    return _vector_indexes[key]


@query(_TOP)
def semantic_topk_indexed(spark, sf_dir):
    """Cells from the best bound down, until none can reach the tenth score."""
    return vector_index(spark, sf_dir).search(_query_vector(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"select chunk_index, section, 2::bigint as tokens, round(greatest(-1, least(1, score)), 5) as similarity, text as summary from ({_K}) where path = 'doc3.md' and score >= -0.05 order by score desc, chunk_index limit 5")
def search_document(spark, sf_dir):
    found = search.search_document(_vector_chunks(spark, sf_dir), "doc3.md", _query_vector(spark, sf_dir), 5, -0.05)
    return found.withColumn("similarity", F.round(F.col("similarity").cast("double"), 5))


_BATCH_TOP = """select qid, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from
(select q.vec_id as qid, e.vec_id, list_dot_product(e.embedding::double[], q.embedding::double[]) as score from embeddings e, embeddings q where q.vec_id % 50 = 0)) where rank <= 10"""


@query(_BATCH_TOP)
def semantic_batch_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return search.batch_top_k(e, queries, "vec_id", "qid").withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(_BATCH_TOP)
def semantic_batch_topk_indexed(spark, sf_dir):
    """Each query's best cell first, then those cells that its tenth score doesn't rule out."""
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    found = vector_index(spark, sf_dir).batch_top_k(queries, "vec_id", "qid")
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(f"""select path || '#' || chunk_index as key, path, chunk_index, section, round(score, 6) as score, text from (select * from ({_K}) where not (path = 'doc0.md' and chunk_index <= 3) order by score desc, path, chunk_index limit 5)""")
def auto_context_pick(spark, sf_dir):
    seen = spark.createDataFrame([(f"doc0.md#{i}",) for i in (1, 2, 3)], "key string")
    return search.auto_context(_vector_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 5, 0.01, seen).withColumn("score", F.round("score", 6))


@query(f"""with k as ({_K}), a as (select * from k where not (path = 'doc0.md' and chunk_index = 1)), t(floor) as (values (0.1), (0.999999)),
b as (select floor, path, chunk_index, score, row_number() over (partition by floor order by score desc, path, chunk_index) as r, max(score) over (partition by floor) as best from a, t)
select floor::double as floor, path, chunk_index from b where r <= 5 and best >= floor""")
def auto_context_floor(spark, sf_dir):
    """All or nothing: the five best, where the best of those that weren't seen reaches the floor."""
    seen = spark.createDataFrame([("doc0.md#1",)], "key string")
    each = [search.auto_context(_vector_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 5, floor, seen).select(F.lit(floor).alias("floor"), "path", "chunk_index") for floor in (0.1, 0.999999)]
    return each[0].unionByName(each[1])


@query(f"select vec_id, round(greatest(-1, least(1, list_dot_product(embedding::double[], q))), 5) as similarity from embeddings, {_Q}")
def cosine_clamped(spark, sf_dir):
    q = V.literal(_query_vector(spark, sf_dir))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.cosine(F.col("embedding"), q).cast("double"), 5).alias("similarity"))


@query("""select vec_id, round(norm, 5) as norm, round((v[1]::double / norm)::float::double, 3) + 0.0 as first, round((v[len(v)]::double / norm)::float::double, 3) + 0.0 as last from
(select vec_id, list_transform(embedding, lambda x: x * 3) as v, sqrt(list_sum(list_transform(embedding, lambda x: (x * 3)::double * (x * 3)::double))) as norm from embeddings)""")
def vector_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: (x * 3).cast("float")))
    unit = V.normalize(F.col("v"))
    return e.select("vec_id", F.round(V.norm(F.col("v")), 5).alias("norm"), F.round(unit[0].cast("double"), 3).alias("first"), F.round(F.element_at(unit, -1).cast("double"), 3).alias("last"))


def _word_vocabulary() -> tuple[dict[str, int], list[list[float]]]:
    words = ["[UNK]", "the", "of", "and", "to", "in", "is", "der", "die", "und", "que", "la", "de", "el"]
    return {w: i for i, w in enumerate(words)}, [[float((i * 7 + j * 3) % 11 - 5) for j in range(4)] for i in range(len(words))]


_VOCABULARY = ", ".join(f"('{w}', {i})" for w, i in _word_vocabulary()[0].items())


@query(f"""with v(token, id) as (values {_VOCABULARY}),
w as (select doc_id, unnest(regexp_extract_all(lower(text), '[!-/:-@\\[-`{{-~]|[^ \\t\\n\\r!-/:-@\\[-`{{-~]+')) as token from ({_DOCS})),
x as (select doc_id, coalesce(id, 0) as id from w left join v using (token))
select doc_id, sum((id * 7) % 11 - 5)::bigint as s0, sum((id * 7 + 3) % 11 - 5)::bigint as s1, sum((id * 7 + 6) % 11 - 5)::bigint as s2, sum((id * 7 + 9) % 11 - 5)::bigint as s3 from x group by doc_id""")
def embed_mean_pool(spark, sf_dir):
    vocabulary, vectors = _word_vocabulary()
    import numpy as np

    model = E.StaticModel(E.WordPiece(vocabulary, prefix="\x00"), np.array(vectors, np.float32), normalize=False)
    e = spread(documents(spark, sf_dir)).select("doc_id", E.column_with_size(model, F.col("text")).alias("m")).where("m.n > 0").select("doc_id", "m.n", "m.e")
    # means times words are whole sums, which no rounding can part
    return e.select("doc_id", *[F.round(F.col("e")[i].cast("double") * F.col("n")).cast("long").alias(f"s{i}") for i in range(4)])


# --- conversations ------------------------------------------------------------------------------------------------------

_M = "select conv_id, turn, role, coalesce(text, '') as text, strlen(coalesce(text, '')) // 4 as tokens from conversations"


def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query(f"select conv_id, turn, tokens::bigint as tokens from ({_M})")
def message_tokens(spark, sf_dir):
    return C.message_tokens(messages(spark, sf_dir)).select("conv_id", "turn", "tokens")


@query(f"""select *, greatest(0, context_length - used) as free from (select *, system_tokens + tool_tokens + conversation_tokens as used from
(select conv_id, coalesce(sum(tokens) filter (where role = 'system'), 0)::bigint as system_tokens, coalesce(sum(tokens) filter (where role is distinct from 'system'), 0)::bigint as conversation_tokens, 250::bigint as tool_tokens, 1500::bigint as context_length from ({_M}) group by conv_id))""")
def context_report(spark, sf_dir):
    return C.context_report(messages(spark, sf_dir), 1500, 1000)


@query(f"""select conv_id, turn, tokens::bigint as tokens, running::bigint as running, running >= 400 and coalesce(lag(running) over (partition by conv_id order by turn) < 400, true) as warned from
(select *, sum(tokens) over (partition by conv_id order by turn) as running from ({_M}))""")
def running_context(spark, sf_dir):
    return C.running_context(messages(spark, sf_dir), 500).select("conv_id", "turn", "tokens", "running", "warned")


@query(f"""with m as (select *, row_number() over (partition by conv_id order by turn) - 1 as idx from ({_M})),
u as (select conv_id, idx, row_number() over (partition by conv_id order by idx desc) as back from m where role = 'user' and idx > 0)
select c.conv_id, u.idx as cut, u.idx is not null as ok from (select distinct conv_id from conversations) c left join (select * from u where back = 2) u using (conv_id)""")
def compact_cut(spark, sf_dir):
    return C.compact_cut(messages(spark, sf_dir), 2)


@query(f"""with m as (select *, row_number() over (partition by conv_id order by turn) - 1 as idx from ({_M})),
u as (select conv_id, idx as cut, row_number() over (partition by conv_id order by idx desc) as back from m where role = 'user' and idx > 0),
k as (select m.*, u.cut from m left join (select * from u where back = 1) u using (conv_id)),
a as (select conv_id, idx::double as spot, role, text from k where cut is null or idx = 0 or idx >= cut union all select distinct conv_id, 0.5, 'user', '[Earlier conversation summary]' || chr(10) || 'summary of ' || conv_id from k where cut is not null)
select conv_id, row_number() over (partition by conv_id order by spot) - 1 as turn, role, text from a""")
def compact(spark, sf_dir):
    m = messages(spark, sf_dir).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = m.select("conv_id").distinct().withColumn("text", F.concat(F.lit("summary of "), F.col("conv_id").cast("string")))
    return C.compact(m, 1, said)


@query(f"""select conv_id, string_agg(case when role = 'user' then '## You' else '## Assistant' end || chr(10) || chr(10) || text || chr(10) || chr(10), '' order by turn) as text from ({_M}) where role = 'user' or (role = 'assistant' and text <> '') group by conv_id""")
def transcript(spark, sf_dir):
    return C.transcript(messages(spark, sf_dir))


@query(f"select conv_id, arg_max(text, turn) as text from ({_M}) where role = 'assistant' and text <> '' group by conv_id")
def last_assistant(spark, sf_dir):
    return C.last_assistant(messages(spark, sf_dir))


_RECALL = f"""select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn desc) as back from
(select *, lag(text) over (partition by conv_id order by turn) as before from ({_M}) where role = 'user' and trim(text, {_SP}) <> '') where before is distinct from text)"""


@query(_RECALL + " where back <= 2")
def recall_tail(spark, sf_dir):
    return C.recall_tail(messages(spark, sf_dir), 2).select("conv_id", "turn", "text")


@query(_RECALL)
def dedup_consecutive(spark, sf_dir):
    return C.recall_tail(messages(spark, sf_dir), 1_000_000).select("conv_id", "turn", "text")


@query(f"select conv_id, row_number() over (partition by conv_id order by turn) - 1 as turn, role, text from ({_M}) where turn <> 1")
def strip_injected(spark, sf_dir):
    m = messages(spark, sf_dir).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") == 1).alias("injected"))
    return C.strip_injected(m)


@query(f"""select conv_id, turn, role, text from ({_M}) union all select conv_id, max(turn) + 1, 'user', 'and then?' from conversations group by conv_id""")
def history_append(spark, sf_dir):
    m = messages(spark, sf_dir).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return C.append_messages(m, m.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("and then?").alias("text")))


def _calls(spark, sf_dir):
    m = messages(spark, sf_dir)
    c = F.col("conv_id")
    name = F.element_at(F.array(*map(F.lit, ("read", "search", "get_chunk", "list_dir"))), ((c + F.col("turn")) % 4 + 1).cast("int"))
    arguments = F.concat(F.lit('{"start_line": '), F.when(F.col("turn") % 2 == 0, (c % 3).cast("string")).otherwise(F.lit('"7"')), F.lit(', "path": "f'), (c % 5).cast("string"), F.lit('.txt"}'))
    result = F.concat(F.lit('{"matches":[{"path":"m'), (c % 4).cast("string"), F.lit('.txt","line":'), (F.col("turn") + 1).cast("string"), F.lit('},{"path":"n.txt","score":0.5}]}'))
    return m.select("conv_id", F.lit(0).cast("long").alias("turn"), F.col("turn").alias("seq"), name.alias("name"), arguments.alias("arguments"), result.alias("result"), F.when(F.col("turn") == 0, "failed").alias("error"))


_CALLS = """select conv_id, turn as seq, ['read', 'search', 'get_chunk', 'list_dir'][(conv_id + turn) % 4 + 1] as name, case when turn % 2 = 0 then conv_id % 3 end as start_line, 'f' || (conv_id % 5) || '.txt' as path,
'm' || (conv_id % 4) || '.txt' as found, turn + 1 as found_line, turn = 0 as failed from conversations"""


@query(f"""select distinct path, line from (select path, coalesce(start_line, 0)::int as line from ({_CALLS}) where name = 'read' union all select path, 0 from ({_CALLS}) where name = 'get_chunk'
union all select found, found_line::int from ({_CALLS}) where name = 'search' union all select 'n.txt', 0 from ({_CALLS}) where name = 'search')""")
def citations_distinct(spark, sf_dir):
    return C.citations(_calls(spark, sf_dir))


@query(f"""select conv_id, seq, min(case when not failed then seq end) over (partition by conv_id, name, path, coalesce(start_line, -1) order by seq rows between unbounded preceding and 1 preceding) as source from ({_CALLS})""")
def tool_memo(spark, sf_dir):
    return C.tool_memo(_calls(spark, sf_dir)).select("conv_id", "seq", "source")


@query(f"""select conv_id, string_agg(case when role = 'assistant' then text else '' end, '' order by turn) as content, string_agg(case when role <> 'assistant' then text else '' end, '' order by turn) as thinking, max(turn) >= 3 as complete from ({_M}) group by conv_id""")
def stream_fold(spark, sf_dir):
    said = F.col("role") == "assistant"
    m = messages(spark, sf_dir).select("conv_id", F.col("turn").alias("seq"), F.when(said, F.col("text")).alias("content"), F.when(~said, F.col("text")).alias("thinking"), F.lit(None).cast("array<string>").alias("tool_calls"), (F.col("turn") == 3).alias("done"))
    return C.stream_fold(m, ("conv_id",)).drop("tool_calls")


@query(f"""select conv_id, turn, trim(replace(replace(replace('Say $1 to $2: $ARGS on $SELECTION for $$5', '$$', '$'), '$ARGS', role || ' ' || turn), '$SELECTION', text).replace('$9', '').replace('$8', '').replace('$7', '').replace('$6', '').replace('$5', '').replace('$4', '').replace('$3', '').replace('$2', turn::varchar).replace('$1', role), {_SP}) as prompt from ({_M})""")
def template_expand(spark, sf_dir):
    m = messages(spark, sf_dir)
    args = F.array("role", F.col("turn").cast("string"))
    return m.select("conv_id", "turn", T.expand_template(F.lit("Say $1 to $2: $ARGS on $SELECTION for $$5"), args, F.coalesce("text", F.lit(""))).alias("prompt"))


@query(f"""select conv_id, turn, case when n < 1000 then n::varchar else printf('%.1fk', n / 1000.0) end as tokens, case when s < 10 then printf('%.1fs', s) else printf('%.0fs', s) end as elapsed, repeat('█', (least(30, n * 30 // 5000))::int) || repeat('░', (30 - least(30, n * 30 // 5000))::int) as bar
from (select *, (strlen(text) // 10 * 100 + 20) as n, (strlen(text) // 4 * 2 + 1) / 40.0::double as s from ({_M}))""")
def format_figures(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("b", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    m = m.withColumn("n", F.floor(F.col("b") / 10) * 100 + 20).withColumn("s", (F.floor(F.col("b") / 4) * 2 + 1) / F.lit(40.0))
    return m.select("conv_id", "turn", T.format_count(F.col("n")).alias("tokens"), T.format_elapsed(F.col("s")).alias("elapsed"), T.context_bar(F.col("n"), F.lit(5000)).alias("bar"))


@query(f"""select conv_id, turn, case when n < 1000 then n::varchar else printf('%.1fk', n / 1000.0) end as tokens, case when s < 10 then printf('%.1fs', s) else printf('%.0fs', s) end as elapsed
from (select *, strlen(text) * 7 as n, strlen(text) / 40.0::double as s from ({_M}))""")
def format_figures_any(spark, sf_dir):
    """format_figures of values that also fall on ties."""
    b = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return messages(spark, sf_dir).select("conv_id", "turn", T.format_count(b * 7).alias("tokens"), T.format_elapsed(b / F.lit(40.0)).alias("elapsed"))


# --- pages and addresses ------------------------------------------------------------------------------------------------


@query(rf"select page_id, starts_with(h, '<!doctype html') or starts_with(h, '<html') as is_html from (select page_id, lower(trim(left(html, 512), {_SP})) as h from pages)")
def html_sniff(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.is_html(F.col("html")).alias("is_html"))


@query(r"select page_id, url, regexp_matches(lower(url), '^https://[^/?#]+') as https_only, regexp_matches(lower(url), '^https?://[^/?#]+') as any_http from pages")
def url_scheme_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", T.url_allowed(F.col("url")).alias("https_only"), T.url_allowed(F.col("url"), False).alias("any_http"))


@query()
def html_text(spark, sf_dir):
    return extract.page_text(spread(table(spark, sf_dir, "pages").select("page_id", "html"))).select("page_id", "text")


@query()
def article_text(spark, sf_dir):
    return extract.page_text(spread(table(spark, sf_dir, "pages").select("page_id", "html")), article=True).select("page_id", "text")


@query("""select ip, a = 127 or a = 10 or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 169 and b = 254) or a between 224 and 239 or (a = 0 and b = 0 and c = 0 and d = 0) as blocked
from (select case when a % 2 = 1 then '::ffff:' else '' end || a || '.' || b || '.' || c || '.' || d as ip, * from (select doc_id % 256 as a, (doc_id * 7) % 256 as b, doc_id // 256 as c, 0 as d from documents))""")
def blocked_ip(spark, sf_dir):
    n = F.col("doc_id")
    ip = F.concat(F.when(n % 2 == 1, "::ffff:").otherwise(""), F.concat_ws(".", *[x.cast("string") for x in (n % 256, n * 7 % 256, F.floor(n / 256), F.lit(0))]))
    return table(spark, sf_dir, "documents").select(ip.alias("ip")).select("ip", T.blocked_ipv4(F.col("ip")).alias("blocked"))


# --- listings and the index ---------------------------------------------------------------------------------------------


@query(f"select path, size from (select path, name, n_chars as size from ({_PATHS})) where name like '%.md' and contains(lower(name), '12')")
def list_dir(spark, sf_dir):
    return listing.list_dir(paths(spark, sf_dir), 3, [".MD"], "12").select("path", "size")


@query(f"select path, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) as ext from ({_PATHS})")
def ext_filter(spark, sf_dir):
    return paths(spark, sf_dir).select("path", T.extension(F.col("name")).alias("ext"))


@query(f"select path, row_number() over (partition by source, lang order by regexp_extract(name, '^\\D+'), doc_id, name) as rank from ({_PATHS})")
def natural_sort(spark, sf_dir):
    """Natural order of every path within its folder."""
    folder = Window.partitionBy(F.regexp_extract("path", "^(.*)/", 1)).orderBy(T.natural_key(F.col("name")), "name")
    return paths(spark, sf_dir).select("path", F.row_number().over(folder).cast("long").alias("rank"))


@query(f"select path from ({_PATHS}) order by string_split(path, '/') limit 200")
def dfs_order_limit(spark, sf_dir):
    return search.first_files(paths(spark, sf_dir)).select("path")


@query(f"select path, n_chunks from (select path, n_chars // 1000 + 1 as n_chunks, coalesce(sum(n_chars // 1000 + 1) over (order by string_split(path, '/') rows between unbounded preceding and 1 preceding), 0) as n from ({_PATHS})) where n <= 500")
def chunk_cap(spark, sf_dir):
    return search.chunk_cap(paths(spark, sf_dir).select("path", (F.floor(F.col("size") / 1000) + 1).alias("n_chunks")), 500)


@query(f"select path from ({_PATHS}) where contains(lower(path), 'doc1') order by string_split(path, '/') limit 500")
def search_name(spark, sf_dir):
    return listing.search_name(paths(spark, sf_dir), "DOC1").select("path")


@query(f"select path, 'file' as type, n_chars as size_bytes, '-rw-r--r--' as permissions, nullif(lower(regexp_extract(name, '(\\.[^.]*)$', 1)), '') as extension, (doc_id % 7 * 1000)::bigint as mod_time from ({_PATHS}) where doc_id = 7")
def stat_file(spark, sf_dir):
    p = paths(spark, sf_dir)
    return listing.stat(p, p.where("doc_id = 7").first()["path"]).withColumn("mod_time", F.unix_seconds("mod_time"))


_NODES = f"""select path, name, 3 as depth, 'file' as type from ({_PATHS}) union all select distinct coalesce(source, 'none') || '/' || coalesce(lang, 'none'), coalesce(lang, 'none'), 2, 'dir' from documents union all select distinct coalesce(source, 'none'), coalesce(source, 'none'), 1, 'dir' from documents"""


def _nodes(spark, sf_dir):
    p = paths(spark, sf_dir).select("path", "name", "type", "depth")
    parts = F.split("path", "/")
    folders = p.select(parts[0].alias("path"), parts[0].alias("name"), F.lit("dir").alias("type"), F.lit(1).alias("depth")).unionByName(p.select(F.concat_ws("/", parts[0], parts[1]).alias("path"), parts[1].alias("name"), F.lit("dir").alias("type"), F.lit(2).alias("depth")))
    return p.unionByName(folders.distinct())


_TREE = f"""with n as ({_NODES}), l as (select *, regexp_extract(path, '^(.*)/', 1) as parent, lead(path) over (partition by regexp_extract(path, '^(.*)/', 1) order by path) is null as last from n)
select a.path, coalesce(case when g.path is null then '' when g.last then '    ' else '│   ' end, '') || coalesce(case when b.path is null then '' when b.last then '    ' else '│   ' end, '') || case when a.last then '└── ' else '├── ' end || a.name || case when a.type = 'dir' then '/' else '' end as line
from l a left join l b on b.path = a.parent left join l g on g.path = b.parent"""


@query(_TREE)
def tree(spark, sf_dir):
    return listing.tree(_nodes(spark, sf_dir))


@query(f"""with n as (select * from ({_NODES}) where depth = 3 and regexp_matches(path, '^[^/]+/en/doc1[^/]*[.]md$')), f as (select min(regexp_extract(path, '^([^/]+)/', 1)) as s from ({_NODES}) where depth = 3)
select name as path, case when lead(name) over (order by name) is null then '└── ' else '├── ' end || name as line from n, f where starts_with(path, s || '/')""")
def tree_glob(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    first = nodes.agg(F.min(F.split("path", "/")[0])).first()[0]
    return listing.tree(nodes, glob=f"{first}/en/doc1*.md")


_FILES = "select 'f' || doc_id as path, doc_id * 10 as mtime_ms, n_chars as size, '1' as generation, n_chars // 1000 + 1 as n_chunks, n_chars as blob_size, doc_id % 97 as last_access from documents"


def _index_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") * 10).alias("mtime_ms"), F.col("n_chars").alias("size"), F.lit("1").alias("generation"), (F.floor(F.col("n_chars") / 1000) + 1).alias("n_chunks"), F.col("n_chars").alias("blob_size"), (F.col("doc_id") % 97).alias("last_access"))


@query(f"select count(*) as files, sum(n_chunks)::bigint as n_chunks, sum(blob_size)::bigint as blob_size from ({_FILES})")
def cache_status(spark, sf_dir):
    return I.status(_index_files(spark, sf_dir))


@query(f"select path, last_access, blob_size from (select *, sum(blob_size + 4096) over (order by last_access desc, path) as n from ({_FILES})) where n <= 3000000")
def lru_evict(spark, sf_dir):
    return I.evict(_index_files(spark, sf_dir), 3_000_000).select("path", "last_access", "blob_size")


@query(f"select path, mtime_ms + (last_access = 3)::int as mtime_ms, size from ({_FILES}) where last_access = 3 or last_access = 5")
def stale_files(spark, sf_dir):
    f = _index_files(spark, sf_dir)
    listed = f.select("path", (F.col("mtime_ms") + (F.col("last_access") == 3).cast("int")).alias("mtime_ms"), "size")
    return I.stale(listed, f.where("last_access <> 5"))


@query(f"""select name, coalesce(p.body, g.body) as body, case when p.name is null then 'global' else 'project' end as source from (select distinct 't' || (item_id % 30) as name, 'g' as body from benchmark) g full join (select distinct 't' || (item_id % 7 + 28) as name, 'p' as body from benchmark) p using (name)""")
def command_override(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    name = lambda n: F.concat(F.lit("t"), n.cast("string")).alias("name")
    g = b.select(name(F.col("item_id") % 30), F.lit("g").alias("body")).distinct()
    return templates.merge(g, b.select(name(F.col("item_id") % 7 + 28), F.lit("p").alias("body")).distinct())
