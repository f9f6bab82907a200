"""Multi-turn dialogue -> wide sheet -> (Q, A, label) corpora.

* ``kth_turn``: number of a turn among its conversation's turns of one role. A
  conversation holding a third of all turns is cut into blocks of turn numbers;
  block counts are summed, and only rows of one block are ordered together.
* ``dialogue_wide``: three turns of each role per sheet row; a longer
  conversation goes on in further rows, so no turn is lost.
* ``turn_unpivot``: one scan with ``stack`` instead of one projection per slot.
* ``turn_pairs``: equi self-join on the composite key (conv, turn + 1), which
  is unique per row, so a hot conversation does not become a hot join key.
* ``reindex``: distributed dense index (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodspark.operators.ordering import global_index


def kth_turn(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             block: int = 4096, name: str = "k") -> DataFrame:
    """``conv`` with the 1-based number of each turn within its conversation and role, in turn order."""
    rows = conv.withColumn("_blk", F.floor(F.col(turn_col) / F.lit(block)))
    keys = [conv_col, role_col]
    sizes = rows.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*keys, "_blk").orderBy(turn_col)
    return (rows.withColumn("_r", F.row_number().over(within)).join(offsets, [*keys, "_blk"])
            .withColumn(name, F.col("_off") + F.col("_r")).drop("_blk", "_r", "_off"))


def dialogue_wide(conv: DataFrame, k: int = 3, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text", user_role: str = "user",
                  reply_role: str = "assistant") -> DataFrame:
    """(conv, sheet_no, user_1, reply_1, ..., user_k, reply_k); missing turns are NULL.

    Sheet row ``sheet_no`` (from 1) holds turns ``k * (sheet_no - 1) + 1 .. k * sheet_no`` of each role.
    """
    talk = conv.where(F.col(role_col).isin(user_role, reply_role))
    ranked = kth_turn(talk, conv_col, turn_col, role_col, name="_k")
    ranked = (ranked.withColumn("sheet_no", (F.floor((F.col("_k") - 1) / k) + 1).cast("int"))
              .withColumn("_slot", (F.col("_k") - 1) % k + 1))
    cols = []
    for i in range(1, k + 1):
        for role, name in ((user_role, f"user_{i}"), (reply_role, f"reply_{i}")):
            cols.append(F.max(F.when((F.col(role_col) == role) & (F.col("_slot") == i), F.col(text_col))).alias(name))
    return ranked.groupBy(conv_col, "sheet_no").agg(*cols)


def turn_unpivot(wide: DataFrame, k: int = 3, key_cols: tuple[str, ...] = ("conv_id", "sheet_no"),
                 label_col: str | None = None, dropna: bool = True) -> DataFrame:
    """Wide slots -> (keys, slot, Q, A[, label]) in one scan, NULL pairs dropped."""
    args = ", ".join(f"{i}, user_{i}, reply_{i}" for i in range(1, k + 1))
    keep = [*key_cols] + ([label_col] if label_col else [])
    out = wide.select(*keep, F.expr(f"stack({k}, {args})").alias("slot", "Q", "A"))
    out = out.withColumn("slot", F.col("slot").cast("int"))
    if dropna:
        out = out.dropna(subset=["Q", "A"] + ([label_col] if label_col else []))
    return out


def turn_pairs(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text", user_role: str = "user", reply_role: str = "assistant") -> DataFrame:
    """Each user turn with the immediately following assistant turn."""
    q = conv.where(F.col(role_col) == user_role).select(
        F.col(conv_col), F.col(turn_col), F.col(text_col).alias("Q"))
    a = conv.where(F.col(role_col) == reply_role).select(
        F.col(conv_col).alias("_c"), (F.col(turn_col) - 1).alias("_t"), F.col(text_col).alias("A"))
    return q.join(a, (q[conv_col] == a["_c"]) & (q[turn_col] == a["_t"])).drop("_c", "_t")


def reindex(df: DataFrame, order_cols: list[str], name: str = "row_idx") -> DataFrame:
    """Dense 0-based index after a concat (``ignore_index=True``)."""
    return global_index(df, order_cols, name)


def qa_corpus(parts: list[DataFrame], strict_dropna: bool = True) -> DataFrame:
    """Concat (Q, A, label) parts by name (``unionByName``, never positional).

    Every part carries ``source_order`` (its place in the concat), ``row_key``
    and ``part_no`` (its own row order), which ``reindex`` turns into the dense
    ``ignore_index`` numbering. ``strict_dropna`` drops NULL Q/A/label in
    every part; the source discards that drop on the chatbot CSV (F6), which
    ``strict_dropna=False`` reproduces.
    """
    out = None
    for df in parts:
        tagged = df.select("Q", "A", F.col("label").cast("int").alias("label"), "row_key", "part_no", "source_order")
        if strict_dropna:
            tagged = tagged.dropna(subset=["Q", "A", "label"])
        out = tagged if out is None else out.unionByName(tagged)
    return out
