"""E2/E3 corpora on the fixture: conversations stand in for the dialogue sheet,
documents (their lines in pairs + quality label) for the chatbot CSV."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodspark import catalog as cat
from moodspark.functions import text as tx
from moodspark.operators import corpora as cp
from moodspark.operators import dialogue as dg
from moodspark.operators import lyrics as ly
from moodspark.plans.registry import register
from moodspark.plans.sqlbits import DOC_LINES, scored_lines
from moodspark.session import written
from moodspark.sources.tables import table

WIDE_SQL = """
select conv_id, cast((k - 1) // 3 + 1 as integer) as sheet_no,
  max(case when role = 'user' and (k - 1) % 3 = 0 then text end) as user_1,
  max(case when role = 'assistant' and (k - 1) % 3 = 0 then text end) as reply_1,
  max(case when role = 'user' and (k - 1) % 3 = 1 then text end) as user_2,
  max(case when role = 'assistant' and (k - 1) % 3 = 1 then text end) as reply_2,
  max(case when role = 'user' and (k - 1) % 3 = 2 then text end) as user_3,
  max(case when role = 'assistant' and (k - 1) % 3 = 2 then text end) as reply_3
from (select *, row_number() over (partition by conv_id, role order by turn) as k
      from conversations where role in ('user', 'assistant')) r
group by conv_id, (k - 1) // 3
"""

UNPIVOT_SQL = """
select u.conv_id, cast((u.k - 1) // 3 + 1 as integer) as sheet_no, cast((u.k - 1) % 3 + 1 as integer) as slot, u.text as Q, a.text as A
from (select *, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'user') u
join (select *, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'assistant') a
  on a.conv_id = u.conv_id and a.k = u.k
where u.text is not null and a.text is not null
"""

# Lines of a document in pairs: 1 and 2, 3 and 4, ...; an odd last line has no answer.
DOC_QA_SQL = f"""
select q.doc_id, cast((q.line_no + 1) // 2 as integer) as part_no, q.line as Q, a.line as A, l.quality as label
from ({DOC_LINES}) q left join ({DOC_LINES}) a on a.doc_id = q.doc_id and a.line_no = q.line_no + 1
left join labels l on q.doc_id = l.doc_id
where q.line_no % 2 = 1
"""

PAIRS_SQL = """
select q.conv_id, q.turn, q.text as Q, a.text as A
from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
where q.role = 'user' and a.role = 'assistant'
"""


def wide(spark, sf):
    return dg.dialogue_wide(table(spark, sf, "conversations"))


def unpivot(spark, sf):
    return dg.turn_unpivot(wide(spark, sf))


def doc_qa(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id"]).select("doc_id", tx.text_lines("text").alias("_ls"))
    qa = docs.select("doc_id", F.expr("""explode(transform(filter(sequence(1, greatest(size(_ls), 1)), i -> i % 2 = 1 and i <= size(_ls)),
        i -> struct(cast((i + 1) div 2 as int) as part_no, get(_ls, i - 1) as Q, get(_ls, i) as A)))""").alias("_p"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return qa.select("doc_id", "_p.part_no", "_p.Q", "_p.A").join(labels, "doc_id", "left")


def pairs(spark, sf):
    return dg.turn_pairs(table(spark, sf, "conversations"))


QA_KEYS = ["source_order", "row_key", "part_no"]


def qa_parts(spark, sf):
    dialog = unpivot(spark, sf).select("Q", "A", F.col("slot").alias("label"), F.col("conv_id").alias("row_key"),
                                       F.col("sheet_no").alias("part_no"), F.col("slot").alias("source_order"))
    docs = doc_qa(spark, sf).select("Q", "A", "label", F.col("doc_id").alias("row_key"), "part_no",
                                    F.lit(4).alias("source_order"))
    return dg.qa_corpus([dialog, docs])


@register("dialogue_wide", WIDE_SQL)
def dialogue_wide(spark, sf):
    return wide(spark, sf)


@register("turn_unpivot", UNPIVOT_SQL)
def turn_unpivot(spark, sf):
    return unpivot(spark, sf)


@register("turn_pairs", PAIRS_SQL)
def turn_pairs(spark, sf):
    return pairs(spark, sf)


QA_SQL = f"""
select Q, A, cast(label as integer) as label, row_key, part_no, cast(source_order as integer) as source_order from (
  select Q, A, slot as label, conv_id as row_key, sheet_no as part_no, slot as source_order from ({UNPIVOT_SQL}) u
  union all
  select Q, A, label, doc_id, part_no, 4 from ({DOC_QA_SQL}) d where Q is not null and A is not null and label is not null) x
"""


@register("qa_corpus", QA_SQL)
def qa_corpus(spark, sf):
    return qa_parts(spark, sf)


@register("reindex", f"""
select cast(row_number() over (order by source_order, row_key, part_no) - 1 as bigint) as row_idx, Q, A, label, source_order
from ({QA_SQL}) q
""")
def reindex(spark, sf):
    return dg.reindex(qa_parts(spark, sf), QA_KEYS).drop("row_key", "part_no")


@register("utterance_corpus", f"""
select 'dialogue' as source, conv_id as row_key, sheet_no as part_no, user_1 as text, cast(null as varchar) as label from ({WIDE_SQL}) w
union all
select 'documents', d.doc_id, d.line_no, d.line, cast(l.quality as varchar)
from ({DOC_LINES}) d left join labels l on d.doc_id = l.doc_id
""")
def utterance_corpus(spark, sf):
    """Slot 1 of every sheet row (the source uses slot 1 only) and every line of the documents."""
    w = wide(spark, sf).select(F.lit("dialogue").alias("source"), F.col("conv_id").alias("row_key"), F.col("sheet_no").alias("part_no"),
                               F.col("user_1").alias("text"), F.lit(None).cast("string").alias("label"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    lines = ly.lyric_lines(table(spark, sf, "documents", ["doc_id"]).select("doc_id", "text")).join(labels, "doc_id", "left")
    d = lines.select(F.lit("documents").alias("source"), F.col("doc_id").alias("row_key"), F.col("line_no").alias("part_no"),
                     F.col("line").alias("text"), "label")
    return w.unionByName(d)


# ---- E2 and E3 end to end on the fixture -------------------------------------

# The fixture's conversations carry no label: a sheet row takes the class that the
# lexicon scorer predicts for its first user turn, under the source's class names.
_SHEET_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(cat.FIFTEEN_BERT))
_SHEET_SQL = f"""
select w.conv_id, w.sheet_no, s.pred, w.user_1, w.reply_1, w.user_2, w.reply_2, w.user_3, w.reply_3
from ({WIDE_SQL}) w
join ({scored_lines("select conv_id, sheet_no as line_no, user_1 as line from (" + WIDE_SQL + ") x", "conv_id")}) s
  on w.conv_id = s.conv_id and w.sheet_no = s.line_no
"""


_KEYS = ("row_key", "part_no")


def _sheet(spark, sf):
    """row_key, part_no, pred and the six text columns in the source's names; written once, as the corpora read it often."""
    w = wide(spark, sf).withColumnsRenamed({"conv_id": "row_key", "sheet_no": "part_no"})
    scored = ly.score_lines(w, cat.FIXTURE_LEXICON, [*_KEYS], 15, "user_1")
    return written(w.join(scored, [*_KEYS]).select(
        *_KEYS, "pred", *[F.col(f"user_{i}").alias(f"사람문장{i}") for i in (1, 2, 3)],
        *[F.col(f"reply_{i}").alias(f"시스템문장{i}") for i in (1, 2, 3)]), "sheet")


def _fifteen_sheet(spark, sf):
    names = cat.catalog_df(spark, "fifteen_bert").select(F.col("id").alias("pred"), F.col("name").alias("감정_소분류"))
    return _sheet(spark, sf).join(names, "pred").drop("pred")


def _lm_sql(valid: bool) -> str:
    """With ``valid``, later rows of a conversation whose class some first row has are the validation sheet."""
    split = "case when sheet_no > 1 and n.name in (select m.name from sheet1 f join names m on m.id = f.pred where f.sheet_no = 1) then 1 else 0 end" if valid else "0"
    return f"""
with names as (select * from (values {_SHEET_NAMES}) n(id, name)),
sheet1 as materialized ({_SHEET_SQL}),
sheet as (select s.*, n.name as lab, {split} as split_order from sheet1 s join names n on s.pred = n.id),
ids as (select lab, row_number() over (order by first_row, lab) - 1 as id, count(*) over () as n
        from (select lab, min(struct_pack(a := conv_id, b := sheet_no)) as first_row from sheet where split_order = 0 group by lab) f),
pairs as (
  select conv_id, sheet_no, split_order, 1 as slot, user_1 as Q, reply_1 as A, lab from sheet
  union all select conv_id, sheet_no, split_order, 2, user_2, reply_2, lab from sheet
  union all select conv_id, sheet_no, split_order, 3, user_3, reply_3, lab from sheet),
rows as (
  select p.Q, p.A, ids.id as label, p.slot, p.split_order, p.conv_id as k1, p.sheet_no as k2
  from pairs p join ids on p.lab = ids.lab where p.Q is not null and p.A is not null
  union all
  select d.Q, d.A,
         case d.label when 0 then (select max(n) from ids)
                      when 1 then (select id from ids where lab = '슬픈')
                      when 2 then (select id from ids where lab = '기쁨') end,
         4, 0, d.doc_id, d.part_no
  from ({DOC_QA_SQL}) d where d.Q is not null and d.A is not null and d.label is not null)
select cast(row_number() over (order by slot, split_order, k1, k2) - 1 as bigint) as row_idx, Q, A,
       cast(label as integer) as label
from rows
"""


def _chat(spark, sf):
    return doc_qa(spark, sf).select(F.col("doc_id").alias("row_key"), "part_no", "Q", "A", "label")


@register("lm_corpus_fifteen", _lm_sql(False))
def lm_corpus_fifteen(spark, sf):
    """E2 end to end: sheet (first-appearance ids) + chatbot rows mapped by name -> re-indexed corpus."""
    return cp.lm_corpus(_fifteen_sheet(spark, sf), _chat(spark, sf), label_col=cp.FINE, key_cols=_KEYS)


@register("lm_corpus_two_sheets", _lm_sql(True))
def lm_corpus_two_sheets(spark, sf):
    """E2 with a validation sheet: training before validation inside each slot.

    The later sheet rows of conversations are the validation sheet; a class that
    no first row has stays in training, for the operator fails on a validation
    label that training lacks.
    """
    sheet = _fifteen_sheet(spark, sf)
    known = sheet.where("part_no = 1").select(F.col(cp.FINE).alias("_known")).distinct()  # at most the fifteen names
    sheet = sheet.join(F.broadcast(known), F.col(cp.FINE) == F.col("_known"), "left")
    later = (F.col("part_no") > 1) & F.col("_known").isNotNull()
    return cp.lm_corpus(sheet.where(~later).drop("_known"), _chat(spark, sf), cp.FINE, sheet.where(later).drop("_known"), key_cols=_KEYS)


# Utterances are the documents' lines under an English tag by language; one tag is dropped.
_TAGS = {"en": "fear", "de": "sadness", "es": "happiness", "fr": "neutral"}
_TAG_SQL = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in _TAGS.items()) + " end"


def _utterances(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id"]).select("doc_id", "lang", "text")
    tags = F.expr("CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TAGS.items()) + " END")
    lines = docs.select("doc_id", tags.alias(cp.UTTER_TAG), F.posexplode(tx.text_lines("text")).alias("p", cp.UTTER_TEXT))
    return lines.select(F.col("doc_id").alias("row_key"), F.col("p").alias("part_no"), cp.UTTER_TEXT, cp.UTTER_TAG)


# A first turn of fewer characters than this says little: such rows get one of the source's dropped fine names.
CURT = 80


def _classifier_sql(sheet_label: str, sheet_where: str, english: dict[str, int]) -> str:
    codes = "case tag " + " ".join(f"when '{k}' then '{v}'" for k, v in english.items()) + " else tag end"
    return f"""
select cast(row_number() over (order by source_order, k1, k2) - 1 as bigint) as row_idx, text, label from (
  select 0 as source_order, conv_id as k1, sheet_no as k2, user_1 as text, {sheet_label} as label from ({_SHEET_SQL}) s where {sheet_where}
  union all
  select 1, doc_id, line_no, line, {codes} from (
    select x.doc_id, line_no, line, {_TAG_SQL} as tag
    from ({DOC_LINES}) x join (select doc_id as d, lang from documents) y on x.doc_id = y.d) u where tag <> 'neutral') r
"""


_BIG_CASE = "case pred % 7 " + " ".join(f"when {i} then '{i}'" for i in range(6)) + " else '기타' end"


@register("classifier_corpus_six", _classifier_sql(_BIG_CASE, "true", cat.ENGLISH_TO_SIX))
def classifier_corpus_six(spark, sf):
    """E3, six classes: lenient recode (one name is not in the catalog and stays), neutral utterances dropped."""
    big = F.expr("CASE pred % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(cat.SIX_BERT)) + " ELSE '기타' END")
    return cp.classifier_corpus(_sheet(spark, sf).withColumn(cp.BIG, big), _utterances(spark, sf), 6, _KEYS)


@register("classifier_corpus_fifteen", _classifier_sql("cast(pred as varchar)", f"length(user_1) >= {CURT}", cat.ENGLISH_TO_FIFTEEN))
def classifier_corpus_fifteen(spark, sf):
    """E3, fifteen classes: fine names collapse, a dropped name takes its rows along."""
    dropped = "element_at(array(" + ", ".join(f"'{n}'" for n in cat.FINE_DROPPED) + f"), pred % {len(cat.FINE_DROPPED)} + 1)"
    fine = F.expr(f"CASE WHEN length(`{cp.HUMAN[0]}`) < {CURT} THEN {dropped} ELSE CASE pred "
                  + " ".join(f"WHEN {i} THEN '{v[-1]}'" for i, v in cat.FINE_TO_FIFTEEN.items()) + " END END")
    return cp.classifier_corpus(_sheet(spark, sf).withColumn(cp.FINE, fine), _utterances(spark, sf), 15, _KEYS)
