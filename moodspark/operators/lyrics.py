"""Lyric lines -> script mask -> per-line emotion -> dense per-song histogram.

Plan shape: the line explode and script mask are narrow. The scorer joins
tokens with a lexicon table (Spark broadcasts it while its size is under the
threshold and shuffles beyond) and counts classes per line, combined in the
task before the exchange, as is the final histogram: a song holding a third
of all lines sends one row per line and one per task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.catalog import local_table
from moodspark.functions import text as tx
from moodspark.operators.partitioning import spread

def lyric_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-blank stripped line: (id, line_no, line).

    ``line_no`` is 1-based among the kept lines. NULL texts give no rows
    (the source's ``fillna(0)`` sentinel is replaced by NULL + filter).
    """
    return (docs.select(id_col, F.posexplode(tx.text_lines(text_col)).alias("pos", "line"))
            .select(id_col, (F.col("pos") + 1).cast("int").alias("line_no"), "line"))


def script_mask(lines: DataFrame, line_col: str = "line", primary: str = tx.HANGUL,
                other: str = tx.LATIN) -> DataFrame:
    """keep lines whose ``primary`` script count beats ``other``.

    Applied to every line (the source skips the first line when masking
    and the last line when scoring; quirk 4 is not reproduced).
    """
    return lines.where(tx.char_count(line_col, primary) > tx.char_count(line_col, other))


def resume_slice(df: DataFrame, row_id_col: str, start: int) -> DataFrame:
    """F8: resumable scoring resumes at an explicit row id, never an offset."""
    return df.where(F.col(row_id_col) >= F.lit(start))


def lexicon_table(spark: SparkSession, lexicon: list[str] | dict[str, int] | DataFrame) -> DataFrame:
    """(word, cls) rows; a list numbers its words, a DataFrame of any size is taken as it is."""
    if isinstance(lexicon, DataFrame):
        return lexicon.select("word", F.col("cls").cast("int").alias("cls"))
    mapping = lexicon if isinstance(lexicon, dict) else {w: i for i, w in enumerate(lexicon)}
    return local_table(spark, [(k, int(v)) for k, v in mapping.items()], word=pa.string(), cls=pa.int32())


def first_max_sql(cols: list[str], require_positive: bool = False) -> str:
    """SQL for the index of the largest of ``cols`` (first on ties)."""
    best = "greatest(" + ", ".join(f"`{c}`" for c in cols) + ")"
    whens = " ".join(f"WHEN `{c}` = {best} THEN {k}" for k, c in enumerate(cols))
    guard = f"WHEN {best} <= 0 THEN NULL " if require_positive else ""
    return f"CAST(CASE {guard}{whens} END AS INT)"


def score_lines(lines: DataFrame, lexicon: list[str] | dict[str, int] | DataFrame, key_cols: list[str],
                n_classes: int = 15, line_col: str = "line", keep_unscored: bool = False) -> DataFrame:
    """Q11 lexicon scorer: (keys, pred); most lexicon hits wins, ties to the lowest class.

    ``key_cols`` identify a line. Lines without any hit are removed, or kept
    with NULL ``pred`` when ``keep_unscored``. The cost does not depend on the
    size of the lexicon.
    """
    words = lexicon_table(lines.sparkSession, lexicon)
    tokens = lines.select(*key_cols, F.explode(tx.lexicon_tokens(line_col)).alias("_tok"))
    hits = tokens.join(words, F.col("_tok") == F.col("word"))
    counted = hits.groupBy(*key_cols).agg(*[F.expr(f"count_if(cls = {k}) AS _c{k}") for k in range(n_classes)])
    pred = first_max_sql([f"_c{k}" for k in range(n_classes)], require_positive=True)
    scored = counted.selectExpr(*[f"`{k}`" for k in key_cols], f"{pred} AS pred").where("pred is not null")
    if not keep_unscored:
        return scored
    found = scored.select("pred", *[F.col(k).alias(f"_s_{k}") for k in key_cols])
    same = F.lit(True)
    for k in key_cols:
        same = same & lines[k].eqNullSafe(found[f"_s_{k}"])
    return lines.select(*key_cols).join(found, same, "left").select(*key_cols, "pred")


def emotion_histogram(scored: DataFrame, key_cols: list[str], n_classes: int = 15,
                      pred_col: str = "pred") -> DataFrame:
    """A5: dense per-key histogram ``e0..e{n-1}`` (BIGINT, zeros kept).

    NULL predictions (unscored lines) count nowhere; keys without any scored
    line are dropped after the aggregate.
    """
    aggs = [F.expr(f"count(`{pred_col}`) AS n_scored")]
    aggs += [F.expr(f"CAST(count_if(`{pred_col}` = {k}) AS BIGINT) AS e{k}") for k in range(n_classes)]
    return scored.groupBy(*key_cols).agg(*aggs).where(F.col("n_scored") > 0)


def script_counts(df: DataFrame, text_col: str, classes: dict[str, str]) -> DataFrame:
    """Per-row character counts for each named class."""
    return df.select("*", *[tx.char_count(text_col, cls).alias(name) for name, cls in classes.items()])


def song_emotion_hist(docs: DataFrame, lexicon: list[str] | dict[str, int], n_classes: int = 15,
                      primary: str = tx.HANGUL, other: str = tx.LATIN,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """E1 tail: songs -> lines -> script mask -> scorer -> dense histogram."""
    lines = lyric_lines(spread(docs.select(id_col, text_col), [id_col]), id_col, text_col)
    kept = script_mask(lines, "line", primary, other)
    return emotion_histogram(score_lines(kept, lexicon, [id_col, "line_no"], n_classes), [id_col], n_classes)


def record_emotion_hist(records: DataFrame, key_cols: list[str], lines_col: str,
                        lexicon: list[str] | dict[str, int], n_classes: int = 15,
                        primary: str = tx.HANGUL, other: str = tx.LATIN) -> DataFrame:
    """Deduplicated song records (lines as an array) -> dense histogram.

    The line explode is narrow; the scorer counts per line, the histogram per record.
    """
    lines = records.select(*key_cols, F.posexplode(lines_col).alias("_pos", "line"))
    kept = script_mask(lines, "line", primary, other)
    return emotion_histogram(score_lines(kept, lexicon, [*key_cols, "_pos"], n_classes), key_cols, n_classes)
