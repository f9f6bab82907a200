"""E1 front half on the fixture pages (selectors are parameters: the fixture
has no og:title / trackInfo, so the <title>, nav anchors, the ad block and
<p> paragraphs stand in for them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodspark.functions import html as hx
from moodspark.operators import pages as pg
from moodspark.plans.registry import register
from moodspark.catalog import FIXTURE_LEXICON
from moodspark.functions import text as tx
from moodspark.operators import lyrics as ly
from moodspark.plans.sqlbits import LATIN_GT_ACCENTED, WS, hist_cols, scored_lines
from moodspark.session import scratch_path
from moodspark.sources import calendar as cal
from moodspark.sources.tables import table

CHART_BASE_URL = "https://charts.example.org/track/week?chartdate="


def _unescape_sql(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "\u00a9"), ("middot", "\u00b7"),
                       ("nbsp", "\u00a0"), ("amp", "&")):
        x = f"replace(replace({x}, '&{name};', '{char}'), '&{name}', '{char}')"
    return x


def _between(x: str, start: str, end: str) -> str:
    """Text from ``start`` to the next ``end``, by string positions; NULL without ``start``."""
    return f"case when contains({x}, '{start}') then split_part(substr({x}, strpos({x}, '{start}') + {len(start)}), '{end}', 1) end"


def _no_tags(x: str) -> str:
    """Text outside of tags: what follows the first > of each piece cut at <."""
    return (f"array_to_string(list_transform(string_split({x}, '<'), lambda t, i: case when i = 1 then t "
            f"else substr(t, strpos(t, '>') + 1) end), '')")


_MARKS = ["</p>", "</article>", "</body>", "</div>", "<footer", "<div", "<ul", "<article"]
RAW_TITLE_SQL = _between("html", "<title>", "</title>")
TITLE_SQL = _unescape_sql(RAW_TITLE_SQL)
_P_CUT_SQL = "case when least({0}) > length(x) then x else substr(x, 1, least({0}) - 1) end".format(
    ", ".join(f"case when contains(x, '{m}') then strpos(x, '{m}') else length(x) + 1 end" for m in _MARKS))
# a tag that the end of the page cuts off is no text
_WHOLE_SQL = "case when strpos(reverse(html), '<') > 0 and (strpos(reverse(html), '>') = 0 or strpos(reverse(html), '<') < strpos(reverse(html), '>')) " \
             "then substr(html, 1, length(html) - strpos(reverse(html), '<')) else html end"
_P_TEXT_SQL = _unescape_sql(_no_tags("x"))
P_LINES_SQL = (f"list_filter(list_transform(list_transform(string_split({_WHOLE_SQL}, '<p>')[2:], lambda x: {_P_CUT_SQL}), "
               f"lambda x: trim({_P_TEXT_SQL}, '{WS}')), lambda x: x <> '')")
RECORDS_SQL = f"""
  select page_id, title, string_split(title, '/') as parts, lines
  from (select page_id, {TITLE_SQL} as title, {P_LINES_SQL} as lines from pages) p
  where title is not null
"""
AD_SQL = _between("html", '<div class="ad">', "</div>")


def _records(spark, sf):
    pages = table(spark, sf, "pages", ["page_id"]).select("page_id", "html")
    rec = pg.song_records(pages, hx.title_text(F.col("html")), hx.paragraphs(F.col("html")))
    return rec.where(F.col("title").isNotNull())


LINKS_SQL = """list_transform(list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*>', 0), lambda t: regexp_matches(t, '\\shref="')),
                               lambda t: regexp_extract(t, '\\shref="([^"]*)"', 1))"""


@register("page_links", f"""
select page_id, cast(pos as integer) as link_no, href from pages, unnest({LINKS_SQL}) with ordinality as u(href, pos)
""")
def page_links(spark, sf):
    pages = table(spark, sf, "pages", ["page_id"]).select("page_id", "html")
    return pages.select("page_id", F.posexplode(hx.links(F.col("html"), "a")).alias("pos", "href")) \
        .select("page_id", (F.col("pos") + 1).cast("int").alias("link_no"), "href")


@register("page_title", f"select page_id, {TITLE_SQL} as title from pages")
def page_title(spark, sf):
    return table(spark, sf, "pages", ["page_id"]).select("page_id", hx.title_text(F.col("html")).alias("title"))


@register("title_parts", """
select page_id, cast(pos as integer) as part_no, part
from pages, unnest(string_split(url, '/')) with ordinality as u(part, pos)
""")
def title_parts(spark, sf):
    pages = table(spark, sf, "pages", ["page_id"]).select("page_id", "url")
    return pages.select("page_id", F.posexplode(hx.split_parts(F.col("url"))).alias("pos", "part")) \
        .select("page_id", (F.col("pos") + 1).cast("int").alias("part_no"), "part")


@register("page_container_text", f"select page_id, {_unescape_sql(_no_tags(AD_SQL))} as ad_text from pages")
def page_container_text(spark, sf):
    pages = table(spark, sf, "pages", ["page_id"]).select("page_id", "html")
    return pages.select("page_id", hx.container_text(F.col("html"), "div", "ad").alias("ad_text"))


@register("page_container_chain", f"""
select page_id, case when contains(html, '<article>') then lines[1] end as first_line
from (select page_id, html, {P_LINES_SQL} as lines from pages) p
""")
def page_container_chain(spark, sf):
    """Container (nested blocks included) -> its paragraphs -> the first one's text."""
    pages = table(spark, sf, "pages", ["page_id"]).select("page_id", "html")
    inner = hx.container_inner(F.col("html"), "article")
    return pages.select("page_id", F.get(hx.paragraphs(inner), F.lit(0)).alias("first_line"))


@register("page_meta", f"""
select page_id, {_between('html', '<meta charset="', '"')} as charset, cast(null as varchar) as og_title from pages
""")
def page_meta(spark, sf):
    """P4 on meta tags: the fixture has a charset but no og:title, so that one is NULL everywhere."""
    pages = table(spark, sf, "pages", ["page_id"])
    return pages.select("page_id", hx.meta_attr(F.col("html"), "charset").alias("charset"),
                        hx.meta_property(F.col("html"), "og:title").alias("og_title"))


# The source's own page form, which the fixture lacks, made by Spark out of each fixture page: og:title behind
# another attribute, and the lyrics in a classed container with a block nested in it. A url with a query has no
# og:title, one with a fragment no container.
def _escaped(c):
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def _song_pages(spark, sf):
    pages = table(spark, sf, "pages", ["page_id"])
    rows = pages.select("page_id", "url", hx.title_text(F.col("html")).alias("t"), hx.paragraphs(F.col("html")).alias("ls"),
                        hx.links(F.col("html"), "a").alias("as"))
    title, lines = F.coalesce("t", F.lit("")), F.col("ls")
    meta = F.when(~F.col("url").contains("?"), F.concat(F.lit('<meta content="'), _escaped(F.concat(title, F.lit(" / "), "url")), F.lit('" property="og:title">')))
    first, rest = F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    box = F.when(~F.col("url").contains("#"), F.concat(
        F.lit('<div class="box lyricsContainer wide"><div class="inner">'), _escaped(first), F.lit("</div><p><xmp>\n"), _escaped(rest), F.lit("</xmp></p></div>")))
    anchors = F.transform("as", lambda x, i: F.concat(F.lit("<a class='btn "), F.when(i % 2 == 0, "trackInfo").otherwise("trackInfoSmall"), F.lit("' href="), F.lit('"'),
                                                      x, F.lit('">link</a>')))
    html = F.concat(F.lit('<html><head><meta property="og:type" content="song">'), F.coalesce(meta, F.lit("")),
                    F.lit('</head><body><div class="lyricsContainerSmall">no lyrics</div>'), F.coalesce(box, F.lit("")),
                    F.lit('<!-- <a class="trackInfo" href="off"> --><div class="lyricsContainer">a second container</div>'),
                    F.array_join(anchors, " > "), F.lit("</body></html>"))
    return rows.select("page_id", html.alias("html"))


_SONG_FIELDS_SQL = f"""
select page_id, og_title, tracks, list_filter(list_transform(string_split(lyrics, chr(10)), lambda x: trim(x, '{WS}')), lambda x: x <> '') as lines
from (select page_id, list_filter(hrefs, lambda x, i: i % 2 = 1) as tracks, case when not contains(url, '?') then coalesce(title, '') || ' / ' || url end as og_title,
             case when contains(url, '#') then 'a second container' else coalesce(ls[1], '') || chr(10) || array_to_string(ls[2:], chr(10)) end as lyrics
      from (select page_id, url, {TITLE_SQL} as title, {P_LINES_SQL} as ls, {LINKS_SQL} as hrefs from pages) p) q
"""


@register("song_page_fields", f"""
select page_id, og_title, trim(string_split(og_title, '/')[1], ' ') as first_part, cast(len(string_split(og_title, '/')) as integer) as n_parts,
       array_to_string(lines, chr(10)) as lyrics, cast(len(lines) as integer) as n_lines,
       array_to_string(tracks, ' ') as tracks, cast(len(tracks) as integer) as n_tracks,
       case when og_title is null then 'no_title' when len(lines) = 0 then 'no_lines' else 'kept' end as reason
from ({_SONG_FIELDS_SQL}) s
""")
def song_page_fields(spark, sf):
    """P2-P7 on the source's page form: og:title, its parts, the first lyrics container's lines, tracks by class, and what is missing."""
    found = pg.extract_fields(_song_pages(spark, sf), "html", {"text": ("div", "lyricsContainer")}, {"og_title": "og:title"},
                              {"tracks": ("a", "trackInfo", "href")}).withColumn("lines", tx.text_lines("text"))
    parts = hx.split_parts(F.col("og_title"))
    tagged = pg.presence_cascade(found, [("no_title", F.col("og_title").isNotNull()), ("no_lines", F.size("lines") > 0)])
    return tagged.select("page_id", "og_title", F.trim(F.get(parts, F.lit(0))).alias("first_part"),
                         F.when(F.col("og_title").isNotNull(), F.size(parts)).alias("n_parts"),
                         F.array_join("lines", "\n").alias("lyrics"), F.size("lines").alias("n_lines"),
                         F.array_join("tracks", " ").alias("tracks"), F.size("tracks").alias("n_tracks"), "reason")


@register("page_rejects", f"""
select reason, count(*) as n_pages from (
  select case when raw_title is null then 'no_title'
              when raw_title like '%&amp;%' then 'title_entity'
              when url like '%?%' then 'url_query'
              when url like '%#%' then 'url_fragment'
              else 'kept' end as reason
  from (select url, {RAW_TITLE_SQL} as raw_title from pages) p) r
group by reason
""")
def page_rejects(spark, sf):
    pages = table(spark, sf, "pages", ["page_id"]).select("page_id", "url", "html")
    raw_title = hx.element_inner(F.col("html"), "title")
    url = F.col("url")
    tagged = pg.presence_cascade(pages.withColumn("raw_title", raw_title), [
        ("no_title", F.col("raw_title").isNotNull()),
        ("title_entity", ~F.col("raw_title").contains("&amp;")),
        ("url_query", ~url.contains("?")),
        ("url_fragment", ~url.contains("#")),
    ])
    return pg.reject_counts(tagged)


@register("song_records", f"""
select page_id, title, cast(len(parts) as integer) as n_parts, cast(len(lines) as integer) as n_lines,
       cast(len(parts) + len(lines) as integer) as width, array_to_string(list_concat(parts, lines), ' | ') as record_text
from ({RECORDS_SQL}) r
""")
def song_records(spark, sf):
    rec = _records(spark, sf)
    return rec.select("page_id", "title", F.size("title_parts").alias("n_parts"), F.size("lines").alias("n_lines"),
                      F.size("record").alias("width"), F.array_join("record", " | ").alias("record_text"))


@register("ragged_to_wide", f"""
with r as (select page_id, list_concat(parts, lines) as rec from ({RECORDS_SQL}) x),
w as (select max(len(rec)) as width from r)
select page_id, cast(width as integer) as width,
       array_to_string(list_transform(range(1, width + 1), lambda i: coalesce(rec[i], '<null>')), chr(9)) as cells
from r, w
""")
def ragged_to_wide(spark, sf):
    rect = pg.ragged_to_rows(_records(spark, sf), "record", ["page_id"])
    return rect.select("page_id", "width", F.array_join("cells", "\t", "<null>").alias("cells"))


@register("dedupe_first", f"""
select title, page_id, url from (
  select title, page_id, url, row_number() over (partition by title order by page_id) as rn
  from (select page_id, url, {TITLE_SQL} as title from pages) p where title is not null) d
where rn = 1
""")
def dedupe_first(spark, sf):
    pages = table(spark, sf, "pages", ["page_id"]).select("page_id", "url", hx.title_text(F.col("html")).alias("title"))
    return pg.dedupe_first(pages.where(F.col("title").isNotNull()), ["title"], "page_id", ["url"])


@register("chart_snapshots", """
with d as (select crawl_date, row_number() over (order by crawl_date) as date_idx
           from (select distinct cast(ts as date) as crawl_date from events) x),
n as (select max(date_idx) as n_dates from d),
f as (select min(cast(ts as date)) as crawl_date from events group by user_id, props),
ps as (select cast(ceil(date_idx / 12.0) as integer) as snapshot_no, count(*) as n_new
       from f join d using (crawl_date) group by 1),
s as (select cast(ceil(date_idx / 12.0) as integer) as snapshot_no, strftime(crawl_date, '%Y%m%d') as snapshot_date
      from d, n where date_idx % 12 = 0 or date_idx = n_dates)
select s.snapshot_no, snapshot_date, cast(coalesce(n_new, 0) as bigint) as n_new,
       cast(sum(coalesce(n_new, 0)) over (order by s.snapshot_no) as bigint) as n_keys
from s left join ps using (snapshot_no)
""")
def chart_snapshots(spark, sf):
    events = table(spark, sf, "events").select("user_id", "props", F.to_date("ts").alias("crawl_date"))
    return pg.cumulative_snapshots(events, ["user_id", "props"], "crawl_date", every=12)


_DATES_SQL = """
select cast(row_number() over (order by d) as integer) as seq, strftime(d, '%Y%m%d') as chart_date
from (select unnest(generate_series(min(cast(ts as date)), max(cast(ts as date)), interval 1 day)) as d from events) g
"""


def _chart_dates(spark, sf):
    bounds = table(spark, sf, "events").agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    return cal.calendar_spine(bounds, F.col("lo"), F.col("hi"), "1 day")


@register("chart_dates", _DATES_SQL)
def chart_dates(spark, sf):
    return _chart_dates(spark, sf)


@register("chart_urls", f"select seq, chart_date, '{CHART_BASE_URL}' || chart_date as url from ({_DATES_SQL}) d")
def chart_urls(spark, sf):
    return cal.chart_urls(_chart_dates(spark, sf), CHART_BASE_URL)


@register("snapshot_rows", """
with d as (select crawl_date, row_number() over (order by crawl_date) as date_idx
           from (select distinct cast(ts as date) as crawl_date from events) x),
f as (select user_id, props, event_id, cast(ts as date) as crawl_date from (
        select *, row_number() over (partition by user_id, props order by event_id) as rn from events) e
      where rn = 1)
select user_id, props, event_id, cast(ceil(date_idx / 12.0) as integer) as snapshot_no
from f join d using (crawl_date)
""")
def snapshot_rows(spark, sf):
    """S5 sink form, read back: each key's first event tagged with its first snapshot."""
    events = table(spark, sf, "events").select("user_id", "props", "event_id", F.to_date("ts").alias("crawl_date"))
    rows = pg.snapshot_rows(events, ["user_id", "props"], "crawl_date", "event_id", [], every=12)
    path = scratch_path(spark, "snapshots")
    pg.write_snapshots(rows.select("user_id", "props", "event_id", "snapshot_no"), path)
    return spark.read.parquet(path).select("user_id", "props", "event_id", "snapshot_no")


@register("snapshot_incremental", """
with d as (select crawl_date, cast(ceil(row_number() over (order by crawl_date) / 12.0) as integer) as snapshot_no
           from (select distinct cast(ts as date) as crawl_date from events) x)
select user_id, props, event_id, snapshot_no from (
  select user_id, props, event_id, snapshot_no, row_number() over (partition by user_id, props order by snapshot_no, event_id) as rn
  from events e join d on cast(e.ts as date) = d.crawl_date) r
where rn = 1
""")
def snapshot_incremental(spark, sf):
    """S5 as the crawl goes on: every 12 dates add the keys that are new, and read no earlier event again."""
    events = table(spark, sf, "events").select("user_id", "props", "event_id", "ts")
    path = scratch_path(spark, "snapshots")
    dates = [r["crawl_date"] for r in pg.crawl_date_index(events.select(F.to_date("ts").alias("d")), "d").orderBy("date_idx").collect()]  # the calendar
    for no, at in enumerate(range(0, len(dates), 12), 1):
        first, last = dates[at], dates[min(at + 11, len(dates) - 1)]
        batch = events.where((F.col("ts") >= F.lit(first).cast("timestamp")) & (F.col("ts") < F.date_add(F.lit(last), 1).cast("timestamp")))
        pg.add_snapshot(batch, ["user_id", "props"], "event_id", [], path, no)
    return spark.read.parquet(path).select("user_id", "props", "event_id", "snapshot_no")


@register("page_emotion_hist", f"""
with r as ({RECORDS_SQL}),
d as (select page_id, title, lines from (
        select *, row_number() over (partition by title order by page_id) as rn from r) x where rn = 1),
l as (select page_id, cast(ln as integer) as line_no, line from d, unnest(lines) with ordinality as u(line, ln)),
m as (select * from l where {LATIN_GT_ACCENTED}),
s as ({scored_lines("select * from m", "page_id")})
select d.page_id, d.title, count(*) as n_scored, {hist_cols()}
from s join d on s.page_id = d.page_id
group by d.page_id, d.title
""")
def page_emotion_hist(spark, sf):
    """E1 end to end: pages -> records -> keep-first by title -> lines -> mask -> scorer -> histogram."""
    rec = _records(spark, sf)
    firsts = pg.dedupe_first(rec, ["title"], "page_id", ["lines"])
    return ly.record_emotion_hist(firsts, ["page_id", "title"], "lines", FIXTURE_LEXICON, 15,
                                  tx.LATIN, tx.LATIN1_ACCENTED)
