"""E1 tail on the fixture: documents stand in for songs with lyric lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodspark.catalog import FIXTURE_LEXICON
from moodspark.functions import text as tx
from moodspark.operators import lyrics as ly
from moodspark.operators.partitioning import spread
from moodspark.operators.scoring import BUCKETS
from moodspark.plans.registry import register
from moodspark.plans.sqlbits import DOC_LINES, LATIN_GT_ACCENTED, hist_cols, lexicon_tokens_of, scored_lines
from moodspark.sources.tables import table

# Fixture script rule: ASCII Latin must beat Latin-1 accented letters.
PRIMARY, OTHER = tx.LATIN, tx.LATIN1_ACCENTED


def _masked_lines(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id"]).select("doc_id", "text")
    return ly.script_mask(ly.lyric_lines(docs), "line", PRIMARY, OTHER)


@register("song_emotion_hist", f"""
select doc_id, cast(count(*) as bigint) as n_scored, {hist_cols()}
from ({scored_lines(f"select * from ({DOC_LINES}) l where {LATIN_GT_ACCENTED}")}) s
group by doc_id
""")
def song_emotion_hist(spark, sf):
    docs = table(spark, sf, "documents")
    return ly.song_emotion_hist(docs, FIXTURE_LEXICON, 15, PRIMARY, OTHER)


@register("text_lines", f"""
select doc_id, cast(count(*) as bigint) as n_lines, cast(sum(length(line)) as bigint) as line_chars
from ({DOC_LINES}) l group by doc_id
""")
def text_lines(spark, sf):
    lines = ly.lyric_lines(table(spark, sf, "documents", ["doc_id"]).select("doc_id", "text"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"),
                                       F.sum(F.length("line")).cast("bigint").alias("line_chars"))


@register("lyric_lines", f"select doc_id, line_no, line from ({DOC_LINES}) l")
def lyric_lines(spark, sf):
    return ly.lyric_lines(table(spark, sf, "documents", ["doc_id"]).select("doc_id", "text"))


@register("script_counts", """
select doc_id,
       cast(length(regexp_replace(text, '[^가-힣]', '', 'g')) as bigint) as n_hangul,
       cast(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as bigint) as n_latin,
       cast(length(regexp_replace(text, '[^À-ÿ]', '', 'g')) as bigint) as n_accented,
       case when length(regexp_replace(text, '[^가-힣]', '', 'g'))
                 > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) then 'ko' else 'en' end as script,
       case when length(regexp_replace(text, '[^A-Za-z]', '', 'g'))
                 > length(regexp_replace(text, '[^À-ÿ]', '', 'g')) then 'latin' else 'accented' end as fixture_script
from documents
""")
def script_counts(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id"]).select("doc_id", "text")
    counted = ly.script_counts(docs, "text", {"n_hangul": tx.HANGUL, "n_latin": tx.LATIN,
                                              "n_accented": tx.LATIN1_ACCENTED})
    return counted.select(
        "doc_id", "n_hangul", "n_latin", "n_accented",
        tx.script_of("text").alias("script"),
        tx.script_of("text", PRIMARY, OTHER, "latin", "accented").alias("fixture_script"))


@register("script_mask", f"select doc_id, line_no, line from ({DOC_LINES}) l where {LATIN_GT_ACCENTED}")
def script_mask(spark, sf):
    return _masked_lines(spark, sf)


@register("score_lines", f"select doc_id, line_no, cast(pred as integer) as pred from ({scored_lines(DOC_LINES)}) s")
def score_lines(spark, sf):
    lines = ly.lyric_lines(spread(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"]))
    return ly.score_lines(lines, FIXTURE_LEXICON, ["doc_id", "line_no"])


@register("resume_slice", "select doc_id, lang, source, n_chars from documents where doc_id >= 100")
def resume_slice(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return ly.resume_slice(docs, "doc_id", 100)


@register("score_lines_model", f"select doc_id, line_no, cast(pred as integer) as pred from ({scored_lines(DOC_LINES)}) s")
def score_lines_model(spark, sf):
    """Q11 through the pluggable model path: a user model object scored in
    Arrow batches (``mapInPandas``), loaded once per Python worker. The
    stand-in model applies the lexicon rule, so the oracle is the same as
    ``score_lines``."""
    from moodspark.operators import scoring as sc
    lines = ly.lyric_lines(table(spark, sf, "documents", ["doc_id"]).select("doc_id", "text"))
    scored = sc.model_scorer(lines, "line", "fixture-lexicon", sc.LexiconModel, ["doc_id", "line_no"])
    return scored.where(F.col("pred").isNotNull())


_LANGS = ["de", "en", "es", "fr"]  # the fixture's languages stand for classes 0..3
_LANG_CASE = "case lang " + " ".join(f"when '{x}' then {i}" for i, x in enumerate(_LANGS)) + " end"


@register("score_lines_fitted", f"""
with d as (select doc_id, {_LANG_CASE} as label, ('0x' || substr(md5(text), 1, 8))::bigint % 5 = 0 as test from documents),
l as (select x.doc_id, line_no, label, test, unnest({lexicon_tokens_of('line')}) as tok from ({DOC_LINES}) x join d using (doc_id)),
c as (select doc_id, line_no, label, test, ('0x' || substr(md5(tok), 1, 8))::bigint % {BUCKETS} as bucket, count(*) as n from l group by all),
s as (select label, count(*) as n from ({DOC_LINES}) x join d using (doc_id) where not test and label is not null group by label),
m as (select c.label, bucket, sum(c.n) / any_value(s.n) as m from c join s using (label) where not test group by c.label, bucket),
b as (select s.label, coalesce(-sum(m * m) / 2, 0) as b from s left join m using (label) group by s.label),
g as (select x.doc_id, x.line_no, b.label, any_value(b.b) + coalesce(sum(c.n * m.m), 0) as logit
      from ({DOC_LINES}) x cross join b left join c on c.doc_id = x.doc_id and c.line_no = x.line_no
      left join m on m.label = b.label and m.bucket = c.bucket group by x.doc_id, x.line_no, b.label)
select doc_id, line_no, cast(label as integer) as pred
from (select *, row_number() over (partition by doc_id, line_no order by logit desc, label) as rn from g) r where rn = 1
""")
def score_lines_fitted(spark, sf):
    """D3: a model fitted by Spark on the training documents' lines, loaded once per Python worker, scores every line in Arrow batches."""
    from moodspark.operators import evaluation as ev
    from moodspark.operators import scoring as sc
    docs = table(spark, sf, "documents", ["doc_id"])
    label = F.expr("CASE lang " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(_LANGS)) + " END")
    sides = docs.select("doc_id", "text", label.alias("label"), ev.content_split(F.col("text")).alias("split"))
    lines = sides.select("doc_id", "label", "split", F.posexplode(tx.text_lines("text")).alias("p", "line"))
    means = sc.fit_text_head(lines.where("split = 0"), "line", "label")
    numbered = lines.select("doc_id", (F.col("p") + 1).cast("int").alias("line_no"), "line")
    return sc.model_scorer(numbered, "line", f"lang-head-{hash(str(means))}", lambda: sc.TextHead(means), ["doc_id", "line_no"])
