"""Sequence preparation bound to the fixture: conversations (and turn pairs)
for the LM path, documents for the single-sentence encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodspark import catalog as cat
from moodspark.functions import text as tx
from moodspark.operators import sequences as sq
from moodspark.operators.ordering import global_index
from moodspark.plans import q_dialogue
from moodspark.plans.registry import register
from moodspark.plans.sqlbits import tokens_of
from moodspark.sources.tables import table

MAX_LEN_SINGLE = 64
MAX_LEN_QA = 60
BATCH = 64

_SPECIALS_VALUES = ", ".join(f"('{t}', {i}, 0)" for i, t in enumerate(sq.SPECIALS))
_SPECIALS_LIST = ", ".join(f"'{t}'" for t in sq.SPECIALS)
_N_SPECIALS = len(sq.SPECIALS)


def _punct_sql(e: str) -> str:
    return f"regexp_replace({e}, '[?.!,]', ' ', 'g')"


CONV_TOKENS_SQL = f"""
select conv_id, turn, cast(pos as integer) as pos, token
from conversations, unnest({tokens_of(_punct_sql('text'))}) with ordinality as u(token, pos)
"""
DOC_TOKENS_SQL = f"""
select doc_id, token from documents, unnest({tokens_of('text')}) as u(token)
"""


def _vocab_sql(tokens_sql: str) -> str:
    return f"""
select token, cast(token_id as integer) as token_id, cast(n as bigint) as n from (values {_SPECIALS_VALUES}) s(token, token_id, n)
union all
select token, cast(row_number() over (order by n desc, token) - 1 + {_N_SPECIALS} as integer), n
from (select token, count(*) as n from ({tokens_sql}) t where token not in ({_SPECIALS_LIST})
      group by token) c
"""


CONV_VOCAB_SQL = _vocab_sql(CONV_TOKENS_SQL)
DOC_VOCAB_SQL = _vocab_sql(DOC_TOKENS_SQL)
KEYS = q_dialogue.QA_KEYS
_K = ", ".join(KEYS)

# The training form: the label follows <unused1> inside the question.
QA_TRUNC_SQL = f"""
with t as (select {_K},
                  list_concat(['<usr>'], {tokens_of(_punct_sql('Q'))}, ['<unused1>', cast(label as varchar)]) as qt,
                  list_concat(['<sys>'], {tokens_of(_punct_sql('A'))}, ['</s>']) as atok
           from ({q_dialogue.QA_SQL}) p),
c as (select *, case when len(qt) >= {MAX_LEN_QA} then qt[len(qt) - {MAX_LEN_QA // 2} + 1:] else qt end as q2 from t)
select {_K}, q2, atok[1:{MAX_LEN_QA} - len(q2)] as a2 from c
"""

QA_IDS_SQL = f"""
with tr as ({QA_TRUNC_SQL}),
e as (select {_K}, pos, coalesce(v.token_id, 1) as token_id
      from tr, unnest(list_concat(q2, a2)) with ordinality as u(token, pos)
      left join ({CONV_VOCAB_SQL}) v on v.token = u.token),
ids as (select {_K}, list(token_id order by pos) as ids from e group by {_K})
select {_K}, len(q2) as q_len, len(a2) as a_len, ids.ids from tr join ids using ({_K})
"""

QA_TARGETS_SQL = f"""
select {_K}, cast(q_len as integer) as q_len, cast(a_len as integer) as a_len,
       array_to_string(list_concat(ids, list_transform(range({MAX_LEN_QA} - len(ids)), lambda x: 0)), ' ') as token_ids,
       array_to_string(list_concat(list_transform(range(q_len), lambda x: {sq.special_id(cat.MASK_TOKEN)}),
                                   ids[q_len + 2:],
                                   list_transform(range({MAX_LEN_QA} - q_len - a_len + 1), lambda x: 0)), ' ') as labels_ids,
       array_to_string(list_transform(range({MAX_LEN_QA}), lambda x: case when x < q_len + a_len then 1 else 0 end), ' ') as mask,
       array_to_string(list_transform(range({MAX_LEN_QA}), lambda x: case when x < len(ids) then 1 else 0 end), ' ') as attention_mask
from ({QA_IDS_SQL}) q
"""


def conv_tokens(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return sq.tokens_long(conv, ["conv_id", "turn"], tx.whitespace_tokens(tx.punct_space("text")))


def conv_vocab(spark, sf):
    return sq.build_vocab(conv_tokens(spark, sf))


def qa_truncated(spark, sf):
    rows = q_dialogue.qa_parts(spark, sf)
    qt, at = sq.qa_tokens(F.col("Q"), F.col("A"), F.col("label"))
    return sq.qa_truncate(rows.select(*KEYS, qt.alias("qt"), at.alias("at")), "qt", "at", MAX_LEN_QA)


def qa_target_rows(spark, sf):
    tr = qa_truncated(spark, sf).select(*KEYS, "q_len", "a_len", F.concat("q_trunc", "a_trunc").alias("qa_tokens"))
    with_ids = sq.ids_array(tr, KEYS, "qa_tokens", conv_vocab(spark, sf), "ids", ["q_len", "a_len"])
    return sq.qa_targets(with_ids, "ids", MAX_LEN_QA)


@register("punct_space", f"select conv_id, turn, {_punct_sql('text')} as text from conversations")
def punct_space(spark, sf):
    conv = table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", tx.punct_space("text").alias("text"))


@register("qa_template", f"""
select conv_id, cast(slot as integer) as slot,
       '<usr>' || {_punct_sql('Q')} || '<unused1>' || cast(slot as varchar) as q_train,
       '<sys>' || {_punct_sql('A')} || '</s>' as a_train,
       '<usr>' || {_punct_sql('Q')} || '<unused1>' as q_infer
from ({q_dialogue.UNPIVOT_SQL}) u
""")
def qa_template(spark, sf):
    u = q_dialogue.unpivot(spark, sf)
    q, a = tx.punct_space("Q"), tx.punct_space("A")
    return u.select("conv_id", "slot",
                    tx.qa_question_template(q, F.col("slot"), cat.Q_TOKEN, cat.SENT_TOKEN).alias("q_train"),
                    tx.qa_answer_template(a, cat.A_TOKEN, cat.EOS_TOKEN).alias("a_train"),
                    tx.qa_question_template(q, None, cat.Q_TOKEN, cat.SENT_TOKEN).alias("q_infer"))


@register("tokens", CONV_TOKENS_SQL)
def tokens(spark, sf):
    return conv_tokens(spark, sf)


@register("vocab", CONV_VOCAB_SQL)
def vocab(spark, sf):
    return conv_vocab(spark, sf)


@register("encode_ids", f"""
select t.conv_id, t.turn, t.pos, cast(coalesce(v.token_id, 1) as integer) as token_id
from ({CONV_TOKENS_SQL}) t left join ({CONV_VOCAB_SQL}) v on t.token = v.token
""")
def encode_ids(spark, sf):
    return sq.encode_ids(conv_tokens(spark, sf), conv_vocab(spark, sf)).select("conv_id", "turn", "pos", "token_id")


@register("encode_unknown", f"""
select b.item_id, cast(b.pos as integer) as pos, b.token, cast(coalesce(v.token_id, 1) as integer) as token_id
from (select item_id, pos, token from benchmark, unnest({tokens_of(_punct_sql('text'))}) with ordinality as u(token, pos)) b
left join ({CONV_VOCAB_SQL}) v on b.token = v.token
""")
def encode_unknown(spark, sf):
    """Q2 on another table than the vocabulary's: what it never saw becomes the unknown id."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    rows = sq.tokens_long(items, ["item_id"], tx.whitespace_tokens(tx.punct_space("text")))
    return sq.encode_ids(rows, conv_vocab(spark, sf)).select("item_id", "pos", "token", "token_id")


@register("detokenize", f"""
select conv_id, turn,
       trim(replace(array_to_string(list_transform({tokens_of(_punct_sql('text'))}, lambda t: '▁' || t), ''), '▁', ' ')) as text
from conversations
""")
def detokenize(spark, sf):
    conv = table(spark, sf, "conversations")
    pieces = F.transform(tx.whitespace_tokens(tx.punct_space("text")), lambda t: F.concat(F.lit("▁"), t))
    return conv.select("conv_id", "turn", tx.detokenize(pieces).alias("text"))


@register("encode_single", f"""
with enc as (select doc_id, list_concat(['[CLS]'], {tokens_of('text')}[1:{MAX_LEN_SINGLE - 2}], ['[SEP]']) as toks from documents),
e as (select doc_id, pos, coalesce(v.token_id, 1) as token_id
      from enc, unnest(toks) with ordinality as u(token, pos) left join ({DOC_VOCAB_SQL}) v on v.token = u.token),
ids as (select doc_id, list(token_id order by pos) as ids from e group by doc_id)
select doc_id, cast(len(ids) as integer) as valid_length,
       array_to_string(list_concat(ids, list_transform(range({MAX_LEN_SINGLE} - len(ids)), lambda x: 0)), ' ') as input_ids,
       array_to_string(list_transform(range({MAX_LEN_SINGLE}), lambda x: 0), ' ') as segment_ids,
       array_to_string(list_transform(range({MAX_LEN_SINGLE}), lambda x: case when x < len(ids) then 1 else 0 end), ' ')
         as attention_mask
from ids
""")
def encode_single(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id"]).select("doc_id", "text")
    vocab_ = sq.build_vocab(docs.select(F.explode(tx.whitespace_tokens("text")).alias("token")))
    enc = docs.select("doc_id", sq.encode_single(sq.leading_tokens(F.col("text"), MAX_LEN_SINGLE - 2),
                                                 MAX_LEN_SINGLE).alias("enc"))
    with_ids = sq.ids_array(enc, ["doc_id"], "enc", vocab_, "ids")
    vl = F.size("ids")
    return with_ids.select(
        "doc_id", vl.alias("valid_length"),
        F.array_join(sq.pad_to(F.col("ids"), MAX_LEN_SINGLE, sq.PAD_ID), " ").alias("input_ids"),
        F.array_join(F.array_repeat(F.lit(0), MAX_LEN_SINGLE), " ").alias("segment_ids"),
        F.array_join(sq.attention_mask(vl, MAX_LEN_SINGLE), " ").alias("attention_mask"))


@register("qa_truncate", f"""
select {_K}, cast(len(q2) as integer) as q_len, cast(len(a2) as integer) as a_len,
       array_to_string(q2, ' ') as q_text, array_to_string(a2, ' ') as a_text
from ({QA_TRUNC_SQL}) t
""")
def qa_truncate(spark, sf):
    tr = qa_truncated(spark, sf)
    return tr.select(*KEYS, "q_len", "a_len", F.array_join("q_trunc", " ").alias("q_text"),
                     F.array_join("a_trunc", " ").alias("a_text"))


ARRAYS = ["token_ids", "mask", "labels_ids", "attention_mask"]


@register("qa_targets", QA_TARGETS_SQL)
def qa_targets(spark, sf):
    t = qa_target_rows(spark, sf)
    return t.select(*KEYS, "q_len", "a_len", *[F.array_join(c, " ").alias(c) for c in ARRAYS])


BATCHES_SQL = f"""
select doc_id, cast(row_number() over (order by doc_id) - 1 as bigint) as row_idx,
       cast((row_number() over (order by doc_id) - 1) // {BATCH} as bigint) as batch_id, quality
from labels
"""


def label_batches(spark, sf):
    return sq.assign_batches(table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], BATCH)


@register("batch_assign", f"select doc_id, row_idx, batch_id from ({BATCHES_SQL}) b")
def batch_assign(spark, sf):
    return label_batches(spark, sf).select("doc_id", "row_idx", "batch_id")


@register("batch_collate", f"""
select cast(i // {BATCH} as bigint) as batch_id, count(*) as n_rows,
       {", ".join(f"string_agg({c}, ';' order by i) as {c}" for c in ARRAYS)}
from (select *, row_number() over (order by {_K}) - 1 as i from ({QA_TARGETS_SQL}) t) b group by 1
""")
def batch_collate(spark, sf):
    """Q9: the four arrays of the rows of a batch, stacked in order."""
    rows = sq.assign_batches(qa_target_rows(spark, sf).select(*KEYS, *ARRAYS), KEYS, BATCH)
    c = sq.collate(rows, ARRAYS)
    joined = lambda f: F.array_join(F.transform("rows", lambda r: F.array_join(r[f], " ")), ";").alias(f)
    stacked = [joined(f) for f in ARRAYS]
    return c.select("batch_id", "n_rows", *stacked)


@register("shuffle_rows", """
select doc_id, cast(row_number() over (order by md5('42:' || cast(doc_id as varchar)), doc_id) - 1 as bigint) as shuffled_idx from labels
""")
def shuffle_rows(spark, sf):
    lab = sq.seeded_shuffle(table(spark, sf, "labels").select("doc_id"), "doc_id", 42)
    return global_index(lab, ["shuffle_key", "doc_id"], "shuffled_idx").select("doc_id", "shuffled_idx")
