"""End-to-end corpus builders on the source's own sheet schemas.

Inputs are DataFrames with the sheet columns (converted from the workbooks
upstream; XLSX is not read here):

* dialogue sheet: ``감정_대분류`` / ``감정_소분류``, ``사람문장1..3``, ``시스템문장1..3``
  (plus a ``row_id`` column carrying the sheet order);
* chatbot CSV: ``Q``, ``A``, ``label`` (0 everyday, 1 parting, 2 love) + ``row_id``;
* utterance CSV: ``발화문``, ``상황`` (English tags) + ``row_id``.

Every step is one of the DataFrame operators of this package; the only
shuffles are the first-appearance index (one partial aggregate), the unpivot
-free concat and the distributed re-index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark import catalog as cat
from moodspark.operators import labels as lb
from moodspark.operators.dialogue import reindex

HUMAN = ["사람문장1", "사람문장2", "사람문장3"]
SYSTEM = ["시스템문장1", "시스템문장2", "시스템문장3"]
BIG, FINE = "감정_대분류", "감정_소분류"
UTTER_TEXT, UTTER_TAG = "발화문", "상황"


def _sheet_pairs(sheet: DataFrame, label_col: str, split_order: int, key_cols: tuple[str, ...]) -> DataFrame:
    """U3 + F2 + F5: one scan, slots 1..3, NULL pairs dropped, order kept as keys."""
    args = ", ".join(f"{i + 1}, `{HUMAN[i]}`, `{SYSTEM[i]}`" for i in range(3))
    out = sheet.select(*key_cols, F.col(label_col).alias("label"),
                       F.expr(f"stack(3, {args})").alias("slot", "Q", "A"))
    return out.dropna(subset=["Q", "A", "label"]).withColumn("split_order", F.lit(split_order))


def _index_catalog(ids: DataFrame, name_col: str) -> DataFrame:
    return ids.select(F.col(name_col).alias("name"), F.col("label_id").alias("id"))


def lm_corpus(train: DataFrame, chatbot: DataFrame, label_col: str = BIG, valid: DataFrame | None = None,
              chatbot_map: str = "by_name", strict_dropna: bool = True, key_cols: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Dialogue sheets + chatbot CSV -> (row_idx, Q, A, label).

    Label ids are assigned by first appearance in the training sheet (A2/A3),
    with everyday as the next id. Slot-major order, training before
    validation inside a slot, then the chatbot rows (U3/U1/W3).
    ``chatbot_map="by_name"`` maps chatbot labels 1/2 to the sheet's
    sadness/joy names; ``"source_ids"`` reproduces the source's numeric map
    (which is wrong for the fifteen-class sheet, see SURVEY 1.4).
    ``key_cols`` together identify a row of a sheet or the CSV and give its order.
    """
    ids = lb.first_appearance_index(train, label_col, list(key_cols))
    catalog = _index_catalog(ids, label_col)
    n_first = ids.agg(F.count(F.lit(1)).alias("n"))

    def coded(sheet: DataFrame) -> DataFrame:
        return lb.strict_lookup(sheet, label_col, catalog, "_label").drop(label_col) \
            .withColumnRenamed("_label", label_col)

    parts = [_sheet_pairs(coded(train), label_col, 0, key_cols)]
    if valid is not None:
        parts.append(_sheet_pairs(coded(valid), label_col, 1, key_cols))
    sheet_rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sheet_rows = sheet_rows.select("Q", "A", "label", F.col("slot").cast("int").alias("slot"),
                                   "split_order", *key_cols)

    space = "six_first" if label_col == BIG else "fifteen_first"
    if chatbot_map == "source_ids":
        edges = cat.edge_df(chatbot.sparkSession, "raw3", space).select(
            F.col("src_name").cast("int").alias("_raw"), F.col("dst_id").alias("_mapped"))
    else:
        sad, joy = ("슬픔", "기쁨") if label_col == BIG else ("슬픈", "기쁨")
        named = catalog.where(F.col("name").isin(sad, joy)).select(
            F.when(F.col("name") == sad, 1).otherwise(2).alias("_raw"), F.col("id").alias("_mapped"))
        everyday = n_first.select(F.lit(0).alias("_raw"), F.col("n").cast("int").alias("_mapped"))
        edges = named.unionByName(everyday)
    if strict_dropna:
        chatbot = chatbot.dropna(subset=["Q", "A", "label"])
    chat = chatbot.join(edges, F.col("label") == F.col("_raw"), "left")
    mapped = F.when(F.col("label").isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(
        F.col("_mapped"), F.raise_error(F.concat(F.lit("unmapped chatbot label: "), F.col("label").cast("string")))
        .cast("int")))
    chat = chat.select("Q", "A", mapped.alias("label"), F.lit(4).alias("slot"), F.lit(0).alias("split_order"),
                       *key_cols)
    rows = sheet_rows.unionByName(chat)
    return reindex(rows, ["slot", "split_order", *key_cols]).select("row_idx", "Q", "A", "label")


def classifier_corpus(sheet: DataFrame, utterances: DataFrame | None = None, classes: int = 6,
                      key_cols: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(text, label string) rows for the classifier.

    Six classes: big-category names recoded leniently (J2), utterance tags
    recoded with ``neutral`` dropped (F3). Fifteen classes: five fine names
    dropped and 53 collapsed (F4/J3), utterance tags mapped to the fifteen
    ids. Only turn 1 of the sheet is used (quirk 16); labels are cast to
    string at the end, NULL stays NULL (X7).
    """
    spark = sheet.sparkSession
    if classes == 6:
        sheet_part = lb.lenient_recode(sheet, BIG, cat.catalog_df(spark, "six_bert"), "label") \
            .select(*key_cols, F.col(HUMAN[0]).alias("text"), "label")
        english = cat.edge_df(spark, "english", "six_bert")
    elif classes == 15:
        sheet_part = lb.collapse(sheet, FINE, cat.edge_df(spark, "raw_fine"), cat.FINE_DROPPED, "label") \
            .select(*key_cols, F.col(HUMAN[0]).alias("text"), F.col("label").cast("string").alias("label"))
        english = cat.edge_df(spark, "english", "fifteen_bert")
    else:
        raise ValueError("classes must be 6 or 15")
    out = sheet_part.withColumn("source_order", F.lit(0))
    if utterances is not None:
        kept = lb.drop_values(utterances, UTTER_TAG, cat.ENGLISH_DROPPED)
        e = english.select(F.col("src_name").alias("name"), F.col("dst_id").alias("id"))
        coded = lb.lenient_recode(kept, UTTER_TAG, e, "label") if classes == 6 else \
            lb.collapse(kept, UTTER_TAG, english, [], "label").withColumn("label", F.col("label").cast("string"))
        out = out.unionByName(coded.select(*key_cols, F.col(UTTER_TEXT).alias("text"), "label",
                                           F.lit(1).alias("source_order")))
    return reindex(out, ["source_order", *key_cols]).select("row_idx", "text", "label")
