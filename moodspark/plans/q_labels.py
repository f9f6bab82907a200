"""Label-space operators bound to the fixture: events.event_type and
documents.source/lang stand in for the emotion label columns."""

from __future__ import annotations


from moodspark import catalog as cat
from moodspark.operators import labels as lb
from moodspark.plans.registry import register
from moodspark.sources.tables import table

_EV_VALUES = ", ".join(f"('{n}', {i})" for i, n in enumerate(cat.EVENT_TYPES))
_EV_PARTIAL = ", ".join(f"('{n}', {i})" for i, n in enumerate(cat.EVENT_TYPES_PARTIAL))
_SRC_EDGES = ", ".join(f"('{n}', {i})" for n, i in cat.fixture_source_edges())
_SRC_DROPPED = ", ".join(f"'{n}'" for n in cat.FIXTURE_SOURCE_DROPPED)

DOC_LABELS_SQL = """
select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
from documents d left join labels l on d.doc_id = l.doc_id
"""


def _doc_labels(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


@register("label_strict", f"""
select event_id, event_type, cast(c.id as integer) as label_id
from events e left join (values {_EV_VALUES}) c(name, id) on e.event_type = c.name
""")
def label_strict(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return lb.strict_lookup(ev, "event_type", cat.catalog_df(spark, "event_type"))


@register("label_lenient", f"""
select event_id, coalesce(cast(c.id as varchar), event_type) as label
from events e left join (values {_EV_PARTIAL}) c(name, id) on e.event_type = c.name
""")
def label_lenient(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return lb.lenient_recode(ev, "event_type", cat.catalog_df(spark, "event_type_partial"), "label") \
        .select("event_id", "label")


@register("label_collapse", f"""
select doc_id, source, cast(c.id as integer) as label
from documents d join (values {_SRC_EDGES}) c(name, id) on d.source = c.name
where d.source not in ({_SRC_DROPPED})
""")
def label_collapse(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return lb.collapse(docs, "source", cat.edge_df(spark, "fixture_source"), cat.dropped_names("fixture_source"))


@register("label_index_first", """
select lang, first_row, cast(row_number() over (order by first_row, lang) - 1 as integer) as label_id
from (select lang, min(doc_id) as first_row from documents where lang is not null group by lang) f
""")
def label_index_first(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return lb.first_appearance_index(docs, "lang", "doc_id")


@register("drop_label", f"""
select doc_id, quality, toxic from ({DOC_LABELS_SQL}) x where toxic is distinct from 1
""")
def drop_label(spark, sf):
    return lb.drop_value(_doc_labels(spark, sf).select("doc_id", "quality", "toxic"), "toxic", 1)


@register("drop_label_list", """
select event_id, event_type from events where event_type is null or event_type not in ('error', 'signup')
""")
def drop_label_list(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return lb.drop_values(ev, "event_type", ["error", "signup"])


@register("label_counts", f"""
select quality, count(*) as n from ({DOC_LABELS_SQL}) x where quality is not null group by quality
""")
def label_counts(spark, sf):
    return lb.value_counts(_doc_labels(spark, sf).select("quality"), "quality")


_PROFILE_COLS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                 ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")]


@register("profile", "\nunion all\n".join(
    f"select '{c}' as column_name, {i} as ordinal, '{t}' as dtype, count({c}) as non_null, count(*) as n_rows "
    f"from ({DOC_LABELS_SQL}) x" for i, (c, t) in enumerate(_PROFILE_COLS)))
def profile(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    schema = docs.join(labels, "doc_id", "left").select(*[c for c, _ in _PROFILE_COLS]).schema
    return lb.profile(lb.null_flags(docs, ["doc_id"]).join(lb.null_flags(labels, ["doc_id"]), "doc_id", "left"), schema)


@register("head_tail", f"""
select * from (select 'head' as part, doc_id, quality from ({DOC_LABELS_SQL}) x order by doc_id limit 5) h
union all
select * from (select 'tail' as part, doc_id, quality from ({DOC_LABELS_SQL}) x order by doc_id desc limit 5) t
""")
def head_tail(spark, sf):
    """The rows are picked first; the join sees ten of them (doc_id has at most one label row)."""
    ends = lb.head_tail(table(spark, sf, "documents").select("doc_id"), "doc_id", 5)
    return ends.join(table(spark, sf, "labels"), "doc_id", "left").select("part", "doc_id", "quality")
