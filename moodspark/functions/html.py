"""Column expressions that pull fields out of landed HTML.

Built on regexp functions so extraction stays JVM-side and per-row; the
patterns take the selector (tag, class, attribute) as parameters. Tag
attributes are matched in any order by first isolating the opening tag and
then reading the attribute from it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodspark.functions import text as tx


def _class_re(cls: str) -> str:
    return rf'class="(?:[^"]*\s)?{re.escape(cls)}(?:\s[^"]*)?"'


def open_tags(html: Column, tag: str) -> Column:
    """All opening tags ``<tag ...>`` in document order (array<string>)."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\s[^>]*>"), 0)


def attr_of(tag_text: Column, attr: str) -> Column:
    """Value of a double-quoted attribute in one opening tag ('' if absent)."""
    return F.regexp_extract(tag_text, rf'\s{re.escape(attr)}="([^"]*)"', 1)


def links(html: Column, tag: str = "a", cls: str | None = None, attr: str = "href") -> Column:
    """Attribute values of every ``tag`` (of a class) having ``attr``, in order."""
    tags = open_tags(html, tag)
    if cls is not None:
        tags = F.filter(tags, lambda t: t.rlike(_class_re(cls)))
    with_attr = F.filter(tags, lambda t: t.rlike(rf'\s{re.escape(attr)}="'))
    return F.transform(with_attr, lambda t: attr_of(t, attr))


def element_inner(html: Column, tag: str, cls: str | None = None) -> Column:
    """Inner HTML of the first ``<tag class=cls>`` (non-nested), NULL if absent."""
    if cls:
        pattern = rf"(?is)<{tag}\s[^>]*{_class_re(cls)}[^>]*>(.*?)</{tag}>"
    else:
        pattern = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"
    found = F.regexp_extract(html, pattern, 0)
    return F.when(found != F.lit(""), F.regexp_extract(html, pattern, 1))


def element_text(html: Column, tag: str, cls: str | None = None) -> Column:
    """Text content of the first matching element: tags removed, entities decoded."""
    return tx.html_unescape_basic(tx.strip_tags(element_inner(html, tag, cls)))


# Tags whose start or end closes an open paragraph.
BLOCK_TAGS = ("p|div|article|section|main|aside|header|footer|nav|body|html|ul|ol|li|dl|table|form|pre|blockquote|"
              "fieldset|figure|address|hr|h[1-6]")


def _cut(tag_text: Column, pattern: str) -> Column:
    return F.regexp_replace(tag_text, pattern, "")


def visible(html: Column) -> Column:
    """The page without comments, scripts, styles and a tag that the end of the page cuts off."""
    quiet = _cut(html, r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)")
    return _cut(quiet, r"(?s)<[^>]*$")


def paragraphs(html: Column) -> Column:
    """Text of every paragraph, in order, stripped, non-blank.

    A paragraph ends at its end tag, at the next paragraph or at the start or
    end of another block, as a parser would end it.
    """
    pieces = F.split(visible(html), r"(?i)<p(?=[\s>/])[^>]*>", -1)
    bodies = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
                         lambda x: _cut(x, rf"(?is)</?(?:{BLOCK_TAGS})(?=[\s>/]).*$"))
    texts = F.transform(bodies, lambda x: tx.py_strip(tx.html_unescape_basic(tx.strip_tags(x))))
    return F.filter(texts, lambda x: x != F.lit(""))


def container_inner(html: Column, tag: str, cls: str | None = None) -> Column:
    """Inner HTML of the first ``<tag class=cls>``, elements of the same tag inside it included; NULL if absent.

    What follows the opening tag is cut before every start or end of the tag
    and added up until as many have ended as begun.
    """
    opening = rf"(?is)<{tag}\s[^>]*{_class_re(cls)}[^>]*>" if cls else rf"(?is)<{tag}(?=[\s>])[^>]*>"
    halves = F.split(html, opening, 2)
    pieces = F.split(F.get(halves, F.lit(1)), rf"(?i)(?=</?{tag}[\s>])", -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.rlike(rf"(?i)^</{tag}[\s>]"), -1).when(piece.rlike(rf"(?i)^<{tag}[\s>]"), 1).otherwise(0)
        depth = F.when(acc["depth"] <= 0, acc["depth"]).otherwise(depth)
        return F.struct(depth.alias("depth"), F.when(depth > 0, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(halves) > 1, F.aggregate(pieces, start, step, lambda acc: acc["out"]))


def container_text(html: Column, tag: str, cls: str | None = None) -> Column:
    """Text of the first ``<tag class=cls>``, of what is nested in it too: tags removed, entities decoded."""
    return tx.html_unescape_basic(tx.strip_tags(container_inner(html, tag, cls)))


# ---- One pass over a page's tags ---------------------------------------------

_HEAD = r"""^(?:[^>"']|"[^"]*"|'[^']*')*>"""


def tag_attr(head: Column, attr: str) -> Column:
    """Value of an attribute in a tag's head (double, single or no quotes), decoded; NULL if absent."""
    pattern = rf"""(?is)\s{re.escape(attr)}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(head, pattern, g) for g in (1, 2, 3)])
    return F.when(head.rlike(pattern), tx.html_unescape_basic(value))


def tags(html: Column) -> Column:
    """The page's tags in order: array of (name, fin (an end tag), head, classes, text (up to the next tag, raw))."""
    pieces = F.split(visible(html), "<", -1)

    def tag(x: Column) -> Column:
        head = F.regexp_extract(x, _HEAD, 0)
        return F.struct(F.lower(F.regexp_extract(x, r"^/?([A-Za-z][A-Za-z0-9]*)", 1)).alias("name"), F.startswith(x, F.lit("/")).alias("fin"),
                        head.alias("head"), F.split(F.coalesce(tag_attr(head, "class"), F.lit("")), r"\s+").alias("classes"),
                        F.substr(x, F.length(head) + 1).alias("text"))
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), tag)


def container_spans(tags_col: str, containers: list[tuple[str, str | None]]) -> Column:
    """Per container (tag, class) the span (a, z) of the tags in its first element, nested ones of the same tag included.

    One walk along the tags for all containers: each keeps how many elements of
    its tag are open. ``a`` is 0 without such an element, ``z`` -1 if it never ends.
    """
    text = lambda x: "CAST(NULL AS STRING)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    specs = ", ".join(f"named_struct('tag', {text(t.lower())}, 'cls', {text(c)})" for t, c in containers)
    zero = ", ".join("named_struct('d', 0, 'a', 0, 'z', -1)" for _ in containers)
    return F.expr(f"""aggregate(`{tags_col}`, named_struct('i', 0, 's', array({zero})), (acc, t) -> named_struct('i', acc.i + 1, 's',
        zip_with(acc.s, array({specs}), (s, p) -> CASE
            WHEN t.name <> p.tag OR s.d < 0 THEN s
            WHEN s.d = 0 AND NOT t.fin AND (p.cls IS NULL OR array_contains(t.classes, p.cls)) THEN named_struct('d', 1, 'a', acc.i + 1, 'z', -1)
            WHEN s.d > 0 AND NOT t.fin THEN named_struct('d', s.d + 1, 'a', s.a, 'z', s.z)
            WHEN s.d = 1 THEN named_struct('d', -1, 'a', s.a, 'z', acc.i)
            WHEN s.d > 1 THEN named_struct('d', s.d - 1, 'a', s.a, 'z', s.z)
            ELSE s END)), acc -> acc.s)""")


def span_text(tags_col: str, span: Column) -> Column:
    """Text of a container by its span, entities decoded; NULL without the container."""
    n = F.when(span["z"] < 0, F.size(tags_col)).otherwise(span["z"]) - span["a"] + 1
    raw = F.array_join(F.transform(F.slice(tags_col, F.greatest(span["a"], F.lit(1)), F.greatest(n, F.lit(0))), lambda t: t["text"]), "")
    return F.when(span["a"] > 0, tx.html_unescape_basic(raw))


def tag_values(tags_col: str, tag: str, attr: str, cls: str | None = None, where: tuple[str, str] | None = None) -> Column:
    """``attr`` of every start tag ``tag`` (of a class; with an attribute of a certain value) that has it, in order."""
    def wanted(t: Column) -> Column:
        ok = (t["name"] == tag) & ~t["fin"]
        if cls is not None:
            ok = ok & F.array_contains(t["classes"], cls)
        if where is not None:
            ok = ok & (tag_attr(t["head"], where[0]) == where[1])
        return ok
    return F.filter(F.transform(F.filter(tags_col, wanted), lambda t: tag_attr(t["head"], attr)), lambda v: v.isNotNull())


def title_text(html: Column) -> Column:
    """P4 (fixture form): decoded ``<title>`` text, NULL if absent."""
    return tx.html_unescape_basic(element_inner(html, "title"))


def meta_property(html: Column, prop: str, attr: str = "content") -> Column:
    """P4 (source form): ``<meta property=prop content=...>``, NULL if absent."""
    metas = F.filter(open_tags(html, "meta"), lambda t: t.rlike(rf'property="{re.escape(prop)}"'))
    return tx.html_unescape_basic(attr_of(F.get(metas, F.lit(0)), attr))


def meta_attr(html: Column, attr: str) -> Column:
    """Value of ``attr`` of the first ``<meta>`` that has it, NULL if none has."""
    metas = F.filter(open_tags(html, "meta"), lambda t: t.rlike(rf'\s{re.escape(attr)}="'))
    return tx.html_unescape_basic(attr_of(F.get(metas, F.lit(0)), attr))


def split_parts(c: Column, sep: str = "/") -> Column:
    """P5: ordered parts, no trimming, empty parts kept."""
    return F.split(c, re.escape(sep), -1)
