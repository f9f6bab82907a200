"""Scans and sinks on the fixture: CSV round trips through the shared scratch
folder (UTF-8 and cp949) and the training/validation source tag."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodspark.operators.partitioning import spread
from moodspark.plans.registry import register
from moodspark.session import scratch_path
from moodspark.sources import csv_io
from moodspark.sources.tables import table

# Fixture: Korean speaker names for the conversation roles (cp949-encodable).
ROLE_KO = {"user": "사람", "assistant": "시스템", "system": "설정"}


@register("csv_roundtrip", "select conv_id, turn, role, text from conversations")
def csv_roundtrip(spark, sf):
    conv = spread(table(spark, sf, "conversations"), ["conv_id"])
    path = scratch_path(spark, "csv_roundtrip")
    csv_io.write_csv(conv.select("conv_id", "turn", "role", "text"), path)
    return csv_io.read_csv(spark, path, "conv_id long, turn long, role string, text string")


_ROLE_CASE_SQL = "case role " + " ".join(f"when '{k}' then '{v}'" for k, v in ROLE_KO.items()) + " end"


@register("csv_cp949", f"select conv_id, turn, role, {_ROLE_CASE_SQL} as speaker, text from conversations")
def csv_cp949(spark, sf):
    """Korean columns as they are; what cp949 can't encode of the text travels escaped and comes back."""
    conv = spread(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"])
    speaker = F.create_map(*[F.lit(x) for kv in ROLE_KO.items() for x in kv])[F.col("role")]
    path = scratch_path(spark, "csv_cp949")
    out = conv.select(F.col("conv_id").alias("대화"), F.col("turn").alias("순서"), F.col("role").alias("역할"),
                      speaker.alias("발화자"), csv_io.escape_unencodable(F.col("text")).alias("발화문"))
    csv_io.write_csv(out, path, encoding=csv_io.CP949)
    back = csv_io.read_csv(spark, path, "`대화` long, `순서` long, `역할` string, `발화자` string, `발화문` string",
                           encoding=csv_io.CP949)
    return back.select(F.col("대화").alias("conv_id"), F.col("순서").alias("turn"), F.col("역할").alias("role"),
                       F.col("발화자").alias("speaker"), csv_io.unescape(F.col("발화문")).alias("text"))


@register("split_tag", """
select doc_id, source, case when cast(substr(source, 4) as integer) % 2 = 0 then 'training' else 'validation' end as split
from documents
""")
def split_tag(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    even = F.substring("source", 4, 10).cast("int") % 2 == 0
    return csv_io.tag_rows(docs, [("training", even)], "validation")
