"""Page extraction, presence cascade, keep-first dedupe and snapshots."""

import datetime as dt

from pyspark.sql import functions as F

from moodspark.functions import html as hx
from moodspark.operators import pages as pg

PAGE_OK = ('<html><head><meta content="노래 / 가수" property="og:title"></head><body>'
           '<a class="x trackInfo" href="/t/1">1</a><a href="/nav">n</a><a href="/t/2" class="trackInfo">2</a>'
           '<div class="lyricsContainer"><p><xmp>첫 줄\n\n 둘째 줄 </xmp></p></div></body></html>')


def test_links_with_class_in_any_attribute_order(spark):
    df = spark.createDataFrame([(PAGE_OK,)], "html string")
    got = df.select(hx.links(F.col("html"), "a", "trackInfo").alias("l")).first()["l"]
    assert got == ["/t/1", "/t/2"]
    assert df.select(hx.links(F.col("html"), "a").alias("l")).first()["l"] == ["/t/1", "/nav", "/t/2"]


def test_meta_container_and_parts(spark):
    df = spark.createDataFrame([(PAGE_OK,)], "html string")
    r = df.select(hx.meta_property(F.col("html"), "og:title").alias("t"),
                  hx.element_text(F.col("html"), "div", "lyricsContainer").alias("c")).first()
    assert r["t"] == "노래 / 가수"
    assert r["c"] == "첫 줄\n\n 둘째 줄 "
    parts = df.select(hx.split_parts(hx.meta_property(F.col("html"), "og:title")).alias("p")).first()["p"]
    assert parts == ["노래 ", " 가수"]  # no trimming, as in the source


def test_missing_selectors_are_null(spark):
    df = spark.createDataFrame([("<html><div class='other'>x</div></html>",)], "html string")
    r = df.select(hx.meta_property(F.col("html"), "og:title").alias("t"),
                  hx.element_inner(F.col("html"), "div", "lyricsContainer").alias("c")).first()
    assert r["t"] is None and r["c"] is None


def test_presence_cascade_first_failure_wins(spark):
    df = spark.createDataFrame([(1, None, None), (2, "c", None), (3, "c", "t"), (4, None, "t")],
                               "id int, container string, title string")
    tagged = pg.presence_cascade(df, [("no_container", F.col("container").isNotNull()),
                                      ("no_title", F.col("title").isNotNull())])
    assert {r["id"]: r["reason"] for r in tagged.collect()} == {1: "no_container", 2: "no_title", 3: "kept",
                                                                 4: "no_container"}


def test_dedupe_keeps_first_in_crawl_order(spark):
    rows = [(5, "노래", "가수B"), (2, "노래", "가수A"), (9, "다른 노래", "가수C"), (7, "노래", "가수C")]
    df = spark.createDataFrame(rows, "seq int, title string, artist string").repartition(3)
    got = {r["title"]: (r["seq"], r["artist"]) for r in pg.dedupe_first(df, ["title"], "seq", ["artist"]).collect()}
    assert got == {"노래": (2, "가수A"), "다른 노래": (9, "가수C")}


def test_ragged_to_wide_pads_with_null(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"])], "id int, rec array<string>")
    wide = {r["id"]: (r["c000"], r["c001"], r["c002"]) for r in pg.ragged_to_wide(df, "rec", ["id"], 3).collect()}
    assert wide == {1: ("a", "b", "c"), 2: ("x", None, None)}


def test_cumulative_snapshots_every_12_with_final(spark):
    day0 = dt.date(2010, 1, 1)
    rows = []
    for d in range(30):
        for k in range(d % 5 + 1):
            rows.append((f"title{(d * 7 + k) % 40}", day0 + dt.timedelta(days=d)))
    df = spark.createDataFrame(rows, "title string, crawl_date date")
    snaps = pg.cumulative_snapshots(df, ["title"], "crawl_date", every=12).orderBy("snapshot_no").collect()
    first = {}
    for t, d in sorted(rows, key=lambda r: r[1]):
        first.setdefault(t, d)
    expect = []
    for n, last in ((1, 11), (2, 23), (3, 29)):
        cutoff = day0 + dt.timedelta(days=last)
        expect.append((n, cutoff.strftime("%Y%m%d"), sum(1 for d in first.values() if d <= cutoff)))
    assert [(r["snapshot_no"], r["snapshot_date"], r["n_keys"]) for r in snaps] == expect


def test_container_text_handles_nesting(spark):
    html = ('<div class="wrap"><div class="big lyricsContainer"><p>첫 줄<div>안쪽<div>속</div></div>둘째 &amp; &lt;셋&gt;</p>'
            '</div><div class="lyricsContainer">다음</div></div>')
    df = spark.createDataFrame([(html,), ("<p>none</p>",), ('<div class="lyricsContainerX">no</div>',)], "html string")
    got = [r[0] for r in df.select(hx.container_text(F.col("html"), "div", "lyricsContainer")).collect()]
    assert got == ["첫 줄안쪽속둘째 & <셋>", None, None]


def test_og_title_with_attributes_in_any_order(spark):
    pages = [('<meta property="og:title" content="노래 / 가수">', "노래 / 가수"), ('<meta content="A &amp; B" property="og:title"/>', "A & B"),
             ('<meta property="og:type" content="song"><meta name="x" property="og:title" content="">', ""), ('<meta property="og:titles" content="x">', None)]
    df = spark.createDataFrame([(h,) for h, _ in pages], "html string")
    assert [r[0] for r in df.select(hx.meta_property(F.col("html"), "og:title")).collect()] == [w for _, w in pages]


def test_incremental_snapshots(spark, tmpdir_):
    """A step keeps what is new, reads the keys of earlier ones only, and may be repeated."""
    import os
    path = os.path.join(tmpdir_, "snaps")
    batches = [[(1, "a", "x"), (2, "a", "y"), (3, None, "n")], [(4, "b", "z"), (5, "a", "w"), (6, None, "m")], [(0, "c", "q"), (9, "b", "late")]]
    frames = [spark.createDataFrame(b, "seq int, title string, url string") for b in batches]
    for no in (1, 2, 3, 2, 3):
        pg.add_snapshot(frames[no - 1], ["title"], "seq", ["url"], path, no)
    got = {(r["title"], r["seq"], r["url"], r["snapshot_no"]) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 1, "x", 1), (None, 3, "n", 1), ("b", 4, "z", 2), ("c", 0, "q", 3)}
    seen, real = [], type(frames[0]).join
    type(frames[0]).join = lambda self, other, *a: seen.append(real(self, other, *a)) or seen[-1]
    try:
        pg.add_snapshot(frames[2], ["title"], "seq", ["url"], path, 3)
    finally:
        type(frames[0]).join = real
    scans = [x for x in seen[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in x]
    assert len(scans) == 1 and "ReadSchema: struct<title:string>" in scans[0] and "snapshot_no" in scans[0].split("PartitionFilters")[1]


def test_snapshot_sink_reproduces_cumulative_workbooks(spark, tmpdir_):
    import os
    day0 = dt.date(2010, 1, 1)
    rows = [(i, f"t{(i * 7) % 23}", day0 + dt.timedelta(days=i // 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "seq int, title string, crawl_date date")
    tagged = pg.snapshot_rows(df, ["title"], "crawl_date", "seq", [], every=12)
    path = os.path.join(tmpdir_, "snaps")
    pg.write_snapshots(tagged, path)
    back = spark.read.parquet(path)
    counts = {r["snapshot_no"]: r["n_keys"] for r in pg.cumulative_snapshots(df, ["title"], "crawl_date", 12).collect()}
    for k, n in counts.items():
        workbook = back.where(F.col("snapshot_no") <= k)
        assert workbook.count() == n
        assert workbook.select("title").distinct().count() == n


def test_ragged_to_rows_pads_to_the_widest(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "id int, rec array<string>")
    got = {r["id"]: (r["width"], r["cells"]) for r in pg.ragged_to_rows(df, "rec", ["id"]).collect()}
    assert got == {1: (3, ["a", "b", "c"]), 2: (3, ["x", None, None]), 3: (3, [None, None, None])}


def _parsed_paragraphs(html):
    """Paragraph texts by the standard library's parser."""
    import re
    from html.parser import HTMLParser

    from moodspark.functions.html import BLOCK_TAGS

    class Paragraphs(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.open, self.quiet = [], False, None

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.quiet = tag
            if re.fullmatch(BLOCK_TAGS, tag):
                self.open = tag == "p"
                if self.open:
                    self.out.append("")

        def handle_endtag(self, tag):
            if tag == self.quiet:
                self.quiet = None
            if re.fullmatch(BLOCK_TAGS, tag):
                self.open = False

        def handle_data(self, data):
            if self.open and not self.quiet:
                self.out[-1] += data

    parser = Paragraphs()
    parser.feed(re.sub(r"<[^>]*$", "", html))
    parser.close()
    return [x.strip() for x in parser.out if x.strip()]


def test_paragraphs_equal_a_parser_on_every_fixture_page(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(
        "html", hx.paragraphs(F.col("html")).alias("got")).collect()
    assert sum(len(r["got"]) for r in rows) == 2358
    for r in rows:
        assert r["got"] == _parsed_paragraphs(r["html"])


def test_paragraph_ends_and_decoys(spark):
    pages = ["<p>a<p class='x'>b</p>c<div><p>d</div>e", "<script>'<p>no</p>'</script><p>yes", "<p>x<ul><li>y</ul><!-- <p>z</p> -->",
             "<p>cut off <b", "<param>no<pre>no</pre>", "", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r["i"]: r["p"] for r in df.select("i", hx.paragraphs(F.col("html")).alias("p")).collect()}
    assert got == {0: ["a", "b", "d"], 1: ["yes"], 2: ["x"], 3: ["cut off"], 4: [], 5: [], 6: None}


def test_container_keeps_nested_blocks(spark):
    html = '<div class="x">no</div><div class="lyricsContainer"><div>in</div><p>one</p><DIV>two</DIV></div><div>after</div>'
    df = spark.createDataFrame([(html,), ("<div>none</div>",)], "html string")
    got = [r[0] for r in df.select(hx.container_inner(F.col("html"), "div", "lyricsContainer")).collect()]
    assert got == ["<div>in</div><p>one</p><DIV>two</DIV>", None]


def test_references_without_semicolon(spark):
    from moodspark.functions import text as tx
    cases = {"a&ampb&amp;c": "a&b&c", "&amp;lt;": "&lt;", "&copy;&middot &quot;x&#39;": '\u00a9\u00b7 "x\''}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", tx.html_unescape_basic("s")).collect()} == cases


def _parsed(html, tag, cls):
    """Text of the first ``tag`` of a class, by the standard parser."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        depth, out, done, seen = 0, [], False, False

        def handle_starttag(self, name, attrs):
            if self.done or name != tag:
                return
            if self.depth or cls is None or cls in (dict(attrs).get("class") or "").split():
                self.depth, self.seen = self.depth + 1, True

        def handle_endtag(self, name):
            if name == tag and self.depth:
                self.depth -= 1
                self.done = self.done or not self.depth

        def handle_data(self, data):
            if self.depth:
                self.out = self.out + [data]
    walk = Walk(convert_charrefs=True)
    walk.feed(html)
    walk.close()
    return "".join(walk.out) if walk.seen else None


def test_containers_of_nested_pages_equal_a_parser(spark):
    import random
    rng = random.Random(12)

    def block(depth):
        tag = rng.choice(["div", "p", "section", "span"])
        cls = rng.choice(["", ' class="x"', ' id="i" class="a lyrics b"', " class='lyrics'", ' class="lyricsX"', ' data-t="1 > 0" class=x'])
        inner = "".join(block(depth - 1) if depth and rng.random() < 0.6 else rng.choice(["글 ", "a &amp; b ", "&lt;t&gt; ", "\n", "plain "]) for _ in range(rng.randint(0, 3)))
        return f"<{tag.upper() if rng.random() < 0.2 else tag}{cls}>{inner}</{tag}>"
    pages = ["".join(block(4) for _ in range(3)) for _ in range(150)] + ["", "no tags", "<div class='lyrics'>open <b>end", "<!-- <div class='lyrics'>x</div> --><p>y</p>"]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(3)
    got = pg.extract_fields(df, "html", {"lyrics": ("div", "lyrics"), "first": ("section", None), "spans": ("span", "x")}).collect()
    assert len(got) == len(pages)
    clean = [p.replace("<!-- <div class='lyrics'>x</div> -->", "") for p in pages]
    for r in got:
        want = [_parsed(clean[r["id"]], t, c) for t, c in (("div", "lyrics"), ("section", None), ("span", "x"))]
        assert [r["lyrics"], r["first"], r["spans"]] == want, clean[r["id"]]


def test_fields_of_one_page_at_once(spark):
    html = ('<head><meta name="a" content="n"><META content=\'T &quot;x&quot; / B\' property="og:title"><meta property="og:title" content="second"></head>'
            '<a class="t trackInfo" href="/1?a=1&amp;b=2">x</a><a class="trackInfo">none</a><a href="/no" class="other">y</a><a href=/3 class=trackInfo>z</a>')
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    got = {r["id"]: r for r in pg.extract_fields(df, "html", {"box": ("div", None)}, {"og": "og:title", "d": "og:description"}, {"t": ("a", "trackInfo", "href")}).collect()}
    assert (got[1]["box"], got[1]["og"], got[1]["d"], got[1]["t"]) == (None, 'T "x" / B', None, ["/1?a=1&b=2", "/3"])
    assert got[2]["og"] is None and got[2]["t"] is None and got[3]["t"] == [] and got[3]["box"] is None
