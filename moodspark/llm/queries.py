"""Registered queries of this subpackage and their DuckDB SQL.

Each query applies its operator, with production parameters, to the whole
table and returns the whole result. ``None`` as SQL marks queries that SQL
can't express (or not in bearable time on whole tables); tests compare those
with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm import bpe, fingerprints, hard_negatives, jaccard, langid, licenses, line_dedup, mixing, passages, prefix_trie, quality, topk, toxicity
from moodspark.session import ship_package

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file's place; the operator takes any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_order_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(read(spark, sf_dir, "documents"))


@register("op2_bpe_encode_decode")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer_path())


@register("op3_license_scan", licenses.licence_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_report(read(spark, sf_dir, "documents"))


@register("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(read(spark, sf_dir, "documents"))


@register("op5_site_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages within a source; good: quality 1 and not toxic."""
    return quality.quality_scores(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"),
        (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))


JACCARD_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.i >= 85 * (x.n + y.n - p.i)),
e as (select a, b from l union select b, a from l),
r(node, reach) as (select distinct a, a from e union select r.node, e.b from r join e on r.reach = e.a),
c as (select node, min(reach) as least from r group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.least, d.doc_id) as component_id
from d left join n using (doc_id) left join c on c.node = d.doc_id
"""


@register("op6_jaccard_components", JACCARD_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read(spark, sf_dir, "documents"), width=4, num=85, den=100)


TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id,
        list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
      from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@register("op7_exact_topk", TOPK_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


LINES_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
k as (select doc_id, i, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') as key from l),
g as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.doc_id, k.i, k.line, g.key is not null and k.doc_id <> g.top as dropped from k left join g on k.key = g.key)
select doc_id, count(*) as n_lines, sum(dropped::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from m group by doc_id
"""


@register("op8_line_dedup", LINES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


@register("op9_repeated_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(read(spark, sf_dir, "documents"), with_kept="text", words=passages.WORDS)


MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        (('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w,
        2.0::double * source_size as cap from s0),
s2 as (select *, 1.5::double * sum(source_size) over ()
          - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_budget,
        sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_w from s1),
r as (select arg_min(left_budget / left_w, cap / w) filter (where w * (left_budget / left_w) <= cap) as rate from s2),
t as (select source, source_size, least(cap, w * rate) as target from s1, r),
j as (select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as share
      from d join t on d.source is not distinct from t.source),
q as (select *, floor(share) as whole, share - floor(share) as f,
        coalesce(sum(size) over (partition by source order by u, doc_id rows between unbounded preceding and 1 preceding), 0) as before from j)
select doc_id, size, source_size, target,
       (size * (whole + case when f > 0 and before + size / 2 <= target - whole * source_size then 1 else 0 end))::bigint as taken
from q
"""


@register("op10_source_mix", MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


TRIE_SQL = """
with t as (select conv_id as c, coalesce(text, '') as x, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as m, turn
           from conversations where conv_id is not null),
o as (select c, x, m, row_number() over (partition by c order by turn nulls first, m) as pos from t),
h as (select c, count(*) as n, c - c % 5 as b, xor(list_reduce(list_transform(range(1, len(c::varchar) + 1), lambda i: unicode((c::varchar)[i])::bigint),
        lambda s, y: list_reduce(range(8), lambda v, j: xor(v >> 1, (v & 1) * 3988292384), xor(s, y)), 4294967295::bigint), 4294967295::bigint) % 9 as h
      from o group by c),
i as (select h.*, least(h.h, coalesce(g.n, 0)) as take from h left join h g on g.c = h.b),
r as (select i.c, o.pos as d, x, m from i join o on o.c = i.b and o.pos <= i.h
      union all select i.c, i.take + o.pos - i.h, x, m from i join o on o.c = i.c and o.pos > i.h),
p as (select c, d, sha256(string_agg(m, '') over (partition by c order by d)) as k, strlen(x) as bytes from r
      union all select c, 0, '', 0 from i),
q as (select *, lag(k) over (partition by c order by d) as pk, max(d) over (partition by c) as len from p),
n as (select d, k, min(pk) as pk, min(c) as conv_id, count(*) as n_convs, max(bytes) as bytes,
        string_agg(c::varchar, ',' order by c) filter (where d = len) as ends from q group by d, k),
ch as (select d - 1 as d, pk as k, count(*) as n_children from n where d > 0 group by all),
w as (select n.*, coalesce(n_children, 0) as n_children, case when n_children is null then 1 else 0 end as leaf, (n_convs - 1) * bytes as saved
      from n left join ch using (d, k)),
s as (select a.d, a.k, sum(w.leaf) as n_leaves, sum(w.saved) as saved_tokens from w join p a on a.c = w.conv_id and a.d <= w.d group by a.d, a.k)
select w.conv_id, w.d::bigint as depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children::bigint as n_children,
       n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
from w join s using (d, k) left join n u on u.d = w.d - 1 and u.k = w.pk
"""


@register("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


NEGATIVES_SQL = """
with v as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
             list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as same,
        list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::bigint as score
      from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id and len(a.v) = len(c.v)),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as r from s where same) x where r <= 5),
n as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id)::int as rank
      from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


@register("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@register("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Builder]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
