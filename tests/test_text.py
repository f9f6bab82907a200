"""Hand-made rows for the text functions (fixtures have no Hangul)."""

from pyspark.sql import functions as F

from moodspark.functions import text as tx


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("o")).first()["o"]


def test_py_strip_matches_python(spark):
    samples = ["　가사　", "\t tab\t", "crlf\r", " \x85nel\xa0", "", "   ", "a b"]
    got = [r["o"] for r in spark.createDataFrame([(s,) for s in samples], "s string")
           .select(tx.py_strip("s").alias("o")).collect()]
    assert got == [s.strip() for s in samples]


def test_text_lines_matches_python(spark):
    text = "첫 줄\r\n\n  　둘째 줄　\n\t\n셋째"
    got = _one(spark, text, tx.text_lines)
    assert got == [s.strip() for s in text.split("\n") if s.strip()]


def test_script_classifier_rows(spark):
    rows = ["안녕 hi", "ㅋㅋㅋ", "1004!", "", "가a", "가나a", "K", "abc"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [r["o"] for r in df.select(tx.script_of("s").alias("o")).collect()]
    # tie -> en; jamo are not syllables -> en; Kelvin sign is not ASCII Latin (decision, quirk 5)
    assert got == ["en", "en", "en", "en", "en", "ko", "en", "en"]
    counts = df.select(tx.char_count("s", tx.HANGUL).alias("k"), tx.char_count("s", tx.LATIN).alias("e")).collect()
    assert [(r["k"], r["e"]) for r in counts] == [(2, 2), (0, 0), (0, 0), (0, 0), (1, 1), (2, 1), (0, 0), (0, 3)]


def test_punct_space_replaces_each_char(spark):
    assert _one(spark, "왜?! 그래. 응,", tx.punct_space) == "왜   그래  응 "


def test_tokens_and_detokenize(spark):
    assert _one(spark, " a\tb  c\n", tx.whitespace_tokens) == ["a", "b", "c"]
    pieces = spark.createDataFrame([(["▁안녕", "하세요", "▁반가", "워요"],)], "t array<string>")
    assert pieces.select(tx.detokenize(F.col("t")).alias("o")).first()["o"] == "안녕하세요 반가워요"


def test_unescape_order(spark):
    assert _one(spark, "a &amp;lt; b &lt; c", tx.html_unescape_basic) == "a &lt; b < c"
