"""Queries of the training-data operators: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm._common import documents


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.token_output import token_digest

    return token_digest(spark, documents(spark, sf_dir))


def op2_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.chat import chat_digest

    return chat_digest(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.mixing import mix_digest

    return mix_digest(documents(spark, sf_dir))


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.fingerprints import fingerprints_with_next

    return fingerprints_with_next(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.suffix_dedup import suffix_digest

    return suffix_digest(documents(spark, sf_dir))


def op6_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.near_dedup import near_digest

    return near_digest(documents(spark, sf_dir))


def op7_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.substring_dedup import substring_digest

    return substring_digest(documents(spark, sf_dir))


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.sharding import shard_digest

    return shard_digest(documents(spark, sf_dir))


def op9_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.quality import quality_digest

    return quality_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.decontamination import contamination_digest

    return contamination_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.periodic_runs import runs_digest

    return runs_digest(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.prefix_trie import trie_digest

    return trie_digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.simhash import simhash_digest

    return simhash_digest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_records, op2_chat_masks, op3_source_mix, op4_merkle_fingerprints, op5_suffix_dedup, op6_bottom_k_near_dedup, op7_superkmer_dedup, op8_histogram_shards, op9_preference_quality, op10_decontaminate, op11_periodic_runs, op12_prefix_trie, op13_simhash_near_dedup)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _crc32(text: str) -> str:
    """SQL for the crc32 of a short ASCII text, bit by bit."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"


#: SQL for DuckDB over whole tables. op1 (a tokenizer), op4 (fingerprints of our own), op8 (a hash of Spark's) and op9 (a learnt
#: model) and op13 (XXH64) have none; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_chat_masks": r"""with m as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|turn|><|text|><|end|>') as n from m)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
sum(n)::bigint as formatted_chars from e group by conv_id""",
    "op3_source_mix": rf"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::bigint as size, md5('7:' || coalesce(doc_id::varchar, 'null') || ':' || coalesce(md5(text), 'null')) as h from documents),
t as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as s from d group by source),
w as (select *, [1, 2, 3][s % 3 + 1] as weight, 3 * source_size as capacity, (sum(source_size) over ())::bigint as total from t),
f as (select *, row_number() over (order by capacity / weight, s) as r,
 (total - coalesce(sum(capacity) over (order by capacity / weight, s rows between unbounded preceding and 1 preceding), 0))::double / (sum(weight) over (order by capacity / weight, s rows between current row and unbounded following))::double as level from w),
o as (select *, level * weight <= capacity as open from f),
k as (select min(r) as r, arg_min(level, r) as level from o where open),
g as (select o.s, o.source, o.source_size, case when o.r >= k.r then k.level * o.weight else o.capacity::double end as target from o, k),
x as (select *, least(floor(target)::bigint, 3 * source_size) as take, (source_size + 511) // 512 as blocks from g),
x2 as (select *, case when source_size > 0 then take // source_size else 0 end as epochs from x),
x3 as (select *, take - epochs * source_size as rest, (epochs * blocks + (take - epochs * source_size + 511) // 512)::bigint as slots from x2),
e as (select *, coalesce(sum(slots) over (order by s rows between unbounded preceding and 1 preceding), 0)::bigint as edge, (sum(slots) over ())::bigint as n from x3),
p0 as (select t, floor(((t::hugeint * 679556961735) % 1099511627776)::double / 1099511627776.0 * n::double)::bigint as u from (select max(n) as n from e), unnest(range(n)) z(t)),
p1 as (select p0.t, e.s, e.slots, e.blocks, row_number() over (partition by e.s order by p0.t) - 1 as rank from p0 join e on p0.u >= e.edge and p0.u < e.edge + e.slots),
over_ as (select t, row_number() over (order by t) as n from p1 where rank >= slots),
had as (select e.s, e.slots, e.blocks, count(p1.s) as had from e left join p1 using (s) group by all),
short as (select s, blocks, rank, row_number() over (order by rank, s) as n from had, unnest(range(had, slots)) z(rank)),
sched as (select t, s, rank, blocks from p1 where rank < slots union all select over_.t, short.s, short.rank, short.blocks from over_ join short using (n)),
slot as (select sched.t, sched.s, sched.rank % sched.blocks as block, case when sched.rank // sched.blocks >= e.epochs then least(512, e.rest - (sched.rank % sched.blocks) * 512) else 512 end as words from sched join e using (s)),
y as (select d.doc_id, d.size, d.h, e.s, e.source_size, e.target,
 coalesce(sum(d.size) over (partition by d.source order by d.h, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as a from d join e on d.source is not distinct from e.source),
pc as (select *, greatest(a - block * 512, 0) as p, least(a + size - block * 512, 512) as q from y, unnest(range(a // 512, (a + size - 1) // 512 + 1)) z(block) where size > 0),
tk as (select pc.s, pc.a, pc.size, sum(least(q, words) - p) as taken, min(t) as first_slot from pc join slot using (s, block) where least(q, words) > p group by all)
select doc_id, y.size, source_size, target, coalesce(taken, 0)::bigint as taken, first_slot from y left join tk on y.s = tk.s and y.a = tk.a and y.size = tk.size""",
    "op5_suffix_dedup": """with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
p as (select doc_id, n, i, substr(x, 2 * i + 1, 2) as byte, case when i + 50 <= n then substr(x, 2 * i + 1, 100) end as win from d, unnest(range(n)) u(i)),
q as (select doc_id, i, byte, win is not null and min(doc_id) over (partition by win) < doc_id as again from p),
r as (select doc_id, i, byte, max(again::int) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from q),
s as (select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by i), 0) = 0 as opens from r),
a as (select doc_id, sum(gone)::bigint as n_removed, count(*) filter (where opens) as n_spans, string_agg(byte, '' order by i) filter (where gone = 0) as kept from s group by doc_id)
select d.doc_id, d.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join a using (doc_id)""",
    "op6_bottom_k_near_dedup": rf"""with recursive d as (select doc_id, regexp_extract_all({_FOLD}, {_WORD}) as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (g) where x.doc_id < y.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) as component_id, d.doc_id <= coalesce(min(r.b), d.doc_id) as kept
from d left join n using (doc_id) left join r on r.a = d.doc_id group by d.doc_id, n.n""",
    "op7_superkmer_dedup": rf"""with d as (select doc_id, coalesce(regexp_extract_all(text, {_WORD}), []) as w from documents),
p as (select doc_id, i, w[i] as word, case when i + 34 <= len(w) then array_to_string(w[i:i + 34], ' ') end as win from d, unnest(range(1, len(w) + 1)) u(i)),
q as (select doc_id, i, word, win is not null and count(*) over (partition by win) > 1 as again from p),
r as (select doc_id, i, word, max(again::int) over (partition by doc_id order by i rows between 34 preceding and current row) as gone from q),
a as (select doc_id, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from r group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join a using (doc_id)""",
    "op10_decontaminate": rf"""with t as (select 'd' as k, doc_id as id, {_FOLD} as x from documents union all select 'b', item_id, {_FOLD} from benchmark),
d as (select k, id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from t),
b as (select id, w, least(13, len(w)) as n from d where k = 'b' and len(w) > 0),
bw as (select distinct id, n, array_to_string(w[i:i + n - 1], ' ') as win from b, unnest(range(1, len(w) - n + 2)) u(i)),
dw as (select d.id, n, i, array_to_string(w[i:i + n - 1], ' ') as win from d, (select distinct n from b), unnest(range(1, len(w) - n + 2)) u(i) where k = 'd'),
h as (select distinct dw.id, dw.n, dw.i from dw join bw using (n, win)),
c as (select id, count(distinct i + j) as n_hit from h, unnest(range(n)) u(j) group by id),
m as (select dw.id, list_sort(list(distinct bw.id::varchar)) as items from dw join bw using (n, win) group by dw.id)
select d.id as doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated from d left join c using (id) left join m using (id) where d.k = 'd'""",
    "op11_periodic_runs": rf"""with d0 as (select doc_id, coalesce(regexp_extract_all(text, {_WORD}), []) as w, {_crc32("doc_id::varchar")} as h from documents),
d1 as (select doc_id, w, len(w) as n, h, h // 10 as g from d0),
d2 as (select *, case when n > 0 then g % n end as a, case when n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from d1),
x as (select doc_id, i, w[1 + case when h % 10 = 0 and i >= a then a + (i - a) % p else i end] as word from d2, unnest(range(n)) u(i)),
e as (select x.doc_id, y.i - x.i as p, x.i from x join x y on x.doc_id is not distinct from y.doc_id and x.word = y.word and x.i < y.i),
f as (select *, i - row_number() over (partition by doc_id, p order by i) as stretch from e),
m as (select doc_id, p, min(i) as start, count(*) + p as length from f group by doc_id, p, stretch having count(*) >= p and count(*) + p >= 12),
r as (select doc_id, start, length, min(p) as period from m group by all),
a as (select doc_id, count(*) as n_runs, max(row(length, -start, -period)) as top, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as runs_sha256 from r group by doc_id),
gone as (select distinct r.doc_id, i from r, unnest(range(start + period, start + length)) u(i)),
k as (select x.doc_id, sha256(string_agg(word, ' ' order by i)) as kept from x anti join gone using (doc_id, i) group by x.doc_id)
select d0.doc_id, coalesce(n_runs, 0)::bigint as n_runs, (-top[2])::bigint as start, top[1]::bigint as length, (-top[3])::bigint as period, (1000 * top[1] // -top[3])::bigint as exponent_milli,
coalesce(runs_sha256, sha256('')) as runs_sha256, coalesce(kept, sha256('')) as collapsed_sha256 from d0 left join a using (doc_id) left join k using (doc_id)""",
    "op12_prefix_trie": rf"""with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as place, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
c as (select distinct conv_id, {_crc32("conv_id::varchar")} % 6 as h, conv_id - conv_id % 100 as base from conversations),
b as (select c.conv_id, place, 0 as own, role, text from c join t on t.conv_id = c.base where place <= h union all select c.conv_id, place, 1, role, text from c join t using (conv_id) where place > h),
s as (select conv_id, row_number() over (partition by conv_id order by own, place) as d, length(text) as chars, sha256(length(role) || ':' || role || text) as said from b),
m as (select conv_id, d, chars, string_agg(said, '') over (partition by conv_id order by d) as prefix from s union all select conv_id, 0, 0, '' from c),
n as (select d, prefix, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars from m group by d, prefix),
p as (select n.*, q.prefix as parent from n left join m q on q.conv_id = n.conv_id and q.d = n.d - 1),
k as (select parent as prefix, count(*) as n_children from p where d > 0 group by parent),
v as (select p.*, coalesce(n_children, 0) as n_children, u.conv_id as parent_conv_id from p left join k using (prefix) left join n u on u.prefix = p.parent and p.d > 0),
z as (select a.prefix, count(*) filter (where v.n_children = 0) as n_leaves, sum((v.n_convs - 1) * v.chars)::bigint as saved_tokens from v join m a on a.conv_id = v.conv_id and a.d <= v.d group by a.prefix),
l as (select conv_id, max(d) as d from m group by conv_id),
e as (select prefix, sha256(string_agg(l.conv_id::varchar, ',' order by l.conv_id)) as ends from l join m using (conv_id, d) group by prefix)
select v.conv_id, v.d::bigint as depth, v.parent_conv_id, v.n_convs, v.n_children, z.n_leaves, z.saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256 from v join z using (prefix) left join e using (prefix)""",
}
