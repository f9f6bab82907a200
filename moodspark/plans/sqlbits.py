"""Shared DuckDB SQL fragments for the oracle queries (independent of Spark)."""

from __future__ import annotations

from moodspark.catalog import FIXTURE_LEXICON
from moodspark.functions.text import PY_WHITESPACE

WS = PY_WHITESPACE  # trim set (no quote characters inside)

# Non-blank stripped lines of documents, 1-based position among kept lines.
DOC_LINES = f"""
  select doc_id, cast(ln as integer) as line_no, line
  from documents,
       unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, '{WS}')),
                          lambda x: x <> '')) with ordinality as u(line, ln)
"""

LATIN_GT_ACCENTED = ("length(regexp_replace(line, '[^A-Za-z]', '', 'g')) > "
                     "length(regexp_replace(line, '[^À-ÿ]', '', 'g'))")

LEXICON_VALUES = ", ".join(f"('{w}', {i})" for i, w in enumerate(FIXTURE_LEXICON))


def tokens_of(expr: str) -> str:
    """Whitespace tokens (ASCII whitespace), empties removed."""
    return f"list_filter(string_split_regex({expr}, '[\\t\\n\\x0B\\f\\r ]+'), lambda t: t <> '')"


def lexicon_tokens_of(expr: str) -> str:
    return tokens_of(f"lower(regexp_replace({expr}, '[?.!,]', ' ', 'g'))")


def scored_lines(lines_sql: str, key: str = "doc_id") -> str:
    """(key, line_no, pred): best lexicon class per line, ties to lowest."""
    return f"""
  select {key}, line_no, pred from (
    select {key}, line_no, cls as pred,
           row_number() over (partition by {key}, line_no order by n desc, cls) as rn
    from (select {key}, line_no, lx.cls, count(*) as n
          from (select {key}, line_no, unnest({lexicon_tokens_of('line')}) as tok from ({lines_sql}) ll) t
          join (values {LEXICON_VALUES}) lx(w, cls) on t.tok = lx.w
          group by all) h) b
  where rn = 1
"""


def hist_cols(n: int = 15, pred: str = "pred") -> str:
    return ", ".join(f"cast(sum(case when {pred} = {k} then 1 else 0 end) as bigint) as e{k}" for k in range(n))
