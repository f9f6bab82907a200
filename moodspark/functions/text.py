"""Column expressions for text: all built-in, JVM-side, codegen-friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() whitespace set, built by rule so the Spark expression
# strips exactly what the source's ``s.strip()`` strips.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Token separators of the whitespace tokenizer (ASCII whitespace).
TOKEN_SPLIT_RE = r"[\t\n\x0B\f\r ]+"

# Characters the LM scripts replace by one space.
PUNCT_RE = "[?.!,]"

# Script classes: Hangul syllables vs ASCII Latin letters (source rule); the
# fixture (no Hangul) uses ASCII Latin vs Latin-1 accented letters.
HANGUL = "가-힣"
LATIN = "A-Za-z"
LATIN1_ACCENTED = "À-ÿ"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace (not only U+0020).

    ``trim`` with an explicit character set (no regex) strips any of the
    Python whitespace characters from both ends.
    """
    return F.trim(col_(c), F.lit(PY_WHITESPACE))


def text_lines(c: Column | str) -> Column:
    """Text -> non-blank stripped lines, in order (array<string>)."""
    parts = F.split(col_(c), "\n", -1)
    return F.filter(F.transform(parts, lambda x: py_strip(x)), lambda x: x != F.lit(""))


def char_count(c: Column | str, char_class: str) -> Column:
    """Number of characters of ``c`` inside a regex character class body.

    Removes whole runs of the class (one regex match per word, not per
    character) and measures what was removed.
    """
    x = col_(c)
    return (F.length(x) - F.length(F.regexp_replace(x, f"[{char_class}]+", ""))).cast("bigint")


def script_of(c: Column | str, primary: str = HANGUL, other: str = LATIN,
              primary_name: str = "ko", other_name: str = "en") -> Column:
    """``primary`` if it has strictly more characters than ``other``.

    Ties, digits and empty strings go to ``other_name`` as in the source.
    """
    return F.when(char_count(c, primary) > char_count(c, other), F.lit(primary_name)) \
        .otherwise(F.lit(other_name))


def punct_space(c: Column | str) -> Column:
    """Each of ``? . ! ,`` becomes one space (not deleted, not collapsed)."""
    return F.regexp_replace(col_(c), PUNCT_RE, " ")


def whitespace_tokens(c: Column | str) -> Column:
    """Q1 default tokenizer: split on ASCII whitespace, drop empty tokens."""
    return F.filter(F.split(col_(c), TOKEN_SPLIT_RE, -1), lambda x: x != F.lit(""))


def lexicon_tokens(c: Column | str) -> Column:
    """Tokens the lexicon scorer sees: punctuation -> space, lower case."""
    return whitespace_tokens(F.lower(punct_space(c)))


def qa_question_template(q: Column, label: Column | None, q_token: str, sent_token: str) -> Column:
    """``<usr>`` + q + ``<unused1>`` (+ label when training)."""
    parts = [F.lit(q_token), q, F.lit(sent_token)]
    if label is not None:
        parts.append(label.cast("string"))
    return F.concat(*parts)


def qa_answer_template(a: Column, a_token: str, eos: str) -> Column:
    return F.concat(F.lit(a_token), a, F.lit(eos))


def detokenize(tokens: Column, marker: str = "▁") -> Column:
    """Join sub-word pieces, word marker -> space, strip the ends."""
    return F.trim(F.replace(F.array_join(tokens, ""), F.lit(marker), F.lit(" ")))


# Named character references, decoded with or without their
# semicolon; ``&amp`` comes last so that what it makes is not read again.
HTML_NAMED = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("copy", "\u00a9"), ("middot", "\u00b7"),
              ("nbsp", "\u00a0"), ("amp", "&"))


def html_unescape_basic(c: Column | str) -> Column:
    """Decode the common character references, also where the semicolon is missing."""
    out = col_(c)
    for name, char in HTML_NAMED:
        out = F.replace(F.replace(out, F.lit(f"&{name};"), F.lit(char)), F.lit(f"&{name}"), F.lit(char))
    return out


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col_(c), "<[^>]*>", "")
