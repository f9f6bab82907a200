"""Streaming queries on the fixture: conversations and pages arrive in folders of files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from moodspark import catalog as cat
from moodspark.functions import html as hx
from moodspark.operators import lyrics as ly
from moodspark.plans.q_pages import TITLE_SQL
from moodspark.plans.registry import register
from moodspark.plans.sqlbits import scored_lines
from moodspark.session import scratch_path, ship_package
from moodspark.sources.tables import table
from moodspark.streaming import streams as st

# The fixture's users never type the source's "0"; a turn of fewer characters than this stands for it.
SHORT = 40


def _arrivals(spark, rows, order_col: str, name: str, arrivals: int = 3) -> Iterator:
    """``rows`` landing one third of their order after the other (rows without a place first): the stream, once per arrival."""
    landing = scratch_path(spark, name)
    at = sorted({int(x) for x in rows.approxQuantile(order_col, [i / arrivals for i in range(1, arrivals)], 0.01)})
    number = sum((F.when(F.col(order_col) > x, 1).otherwise(0) for x in at), F.lit(0))
    for i in range(len(at) + 1):
        rows.where(number == i).write.parquet(f"{landing}/arrival-{i}")
        yield st.file_stream(spark, landing, rows.schema)


def _score_users(df):
    return ly.score_lines(df.select("conv_id", "turn", "text"), cat.FIXTURE_LEXICON, ["conv_id", "turn"], 15, "text", keep_unscored=True)


@register("stream_score", f"""
with ends as (select conv_id, min(turn) as last from conversations where role = 'user' and length(text) < {SHORT} group by conv_id)
select c.conv_id, c.turn, cast(s.pred as integer) as pred
from conversations c left join ends e on e.conv_id = c.conv_id
left join ({scored_lines("select conv_id, turn as line_no, text as line from conversations where role = 'user'", "conv_id")}) s
  on c.conv_id = s.conv_id and c.turn = s.line_no
where c.role = 'user' and (e.last is null or c.turn < e.last)
""")
def stream_score(spark, sf):
    """M1: the users' turns arrive by turn number; a conversation is scored until its user closes it."""
    ship_package(spark)
    users = table(spark, sf, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    sink, ckpt = scratch_path(spark, "stream_score"), scratch_path(spark, "stream_score_ckpt")
    for stream in _arrivals(spark, users, "turn", "landing-turns"):
        st.score_stream(stream, _score_users, sink, ckpt, ["conv_id"], "turn", F.length("text") < SHORT)
    return spark.read.parquet(sink).select("conv_id", "turn", "pred")


_FIRST_TITLES_SQL = f"""
select title, page_id, url from (
  select title, page_id, url, row_number() over (partition by title order by page_id) as rn
  from (select page_id, url, {TITLE_SQL} as title from pages) p where title is not null) d
where rn = 1
"""


def _titled(pages):
    rows = pages.select("page_id", "url", hx.title_text(F.col("html")).alias("title"))
    return rows.where(F.col("title").isNotNull())


@register("stream_dedupe", _FIRST_TITLES_SQL)
def stream_dedupe(spark, sf):
    """M2: pages arrive by id; titles are taken from the page inside the stream."""
    ship_package(spark)
    sink, ckpt = scratch_path(spark, "stream_dedupe"), scratch_path(spark, "stream_dedupe_ckpt")
    for stream in _arrivals(spark, table(spark, sf, "pages"), "page_id", "landing-pages"):
        st.dedupe_stream(stream, ["title"], "page_id", ["url"], sink, ckpt, _titled)
    return spark.read.parquet(sink).select("title", "page_id", "url")


@register("stream_dedupe_state", _FIRST_TITLES_SQL)
def stream_dedupe_state(spark, sf):
    """M2 with keys that expire (a day after their page, far beyond this run)."""
    ship_package(spark)
    sink, ckpt = scratch_path(spark, "stream_dedupe_state"), scratch_path(spark, "stream_dedupe_state_ckpt")
    for stream in _arrivals(spark, _titled(table(spark, sf, "pages")), "page_id", "landing-titles"):
        st.dedupe_stream(stream, ["title"], "page_id", ["url"], sink, ckpt, expire_ms=86_400_000)
    return spark.read.parquet(sink).select("title", "page_id", "url")
