"""Order-dependent operators without single-partition windows.

The source depends on row order everywhere (first-appearance ids, dense
re-index after concat, batch ids, running accuracy). ``Window.orderBy``
without ``partitionBy`` moves every row into one task; these helpers keep
the work distributed:

* ``global_index``: rows are range-sorted and written once to the shared folder,
  each with its place (``monotonically_increasing_id``: partition in the high
  bits, position in the low 33); the written partitions' counts (one row per
  partition, of which only that column is read) give the offsets, joined as a
  broadcast table. The input is evaluated once, nothing is joined back, and
  rows with equal keys get numbers of their own in some order.
* ``running_total``: prefix sums over a dense integer key in levels of blocks;
  each level sums ``block`` rows of the one below, so that the last one has at
  most n / block**levels rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.session import written

_LOW_BITS = 33


def global_index(df: DataFrame, order_cols: list[Column | str], name: str = "row_idx") -> DataFrame:
    """Dense 0-based position of each row in ``order_cols`` order.

    With a total order (end with a unique key) the index equals
    ``row_number() over (order by ...) - 1``.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    placed = written(df.orderBy(*cols).withColumn("_mid", F.monotonically_increasing_id()), "index")
    pid = F.shiftrightunsigned(F.col("_mid"), _LOW_BITS)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, whatever the number of rows
    offsets = placed.groupBy(pid.alias("_pid")).count().select(
        "_pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    joined = placed.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
    return joined.withColumn(name, (F.col("_off") + local).cast("bigint")).drop("_mid", "_pid", "_off")


def _before(df: DataFrame, key: str, cols: list[str], block: int, levels: int) -> DataFrame:
    """``df`` with ``_e_<col>``: the sum of each column over all smaller keys."""
    if levels == 0:
        w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_e_{c}") for c in cols])
    up = f"_b{levels}"
    with_blk = df.withColumn(up, F.floor(F.col(key) / F.lit(block)))
    totals = with_blk.groupBy(up).agg(*[F.sum(c).alias(c) for c in cols])
    offsets = _before(totals, up, cols, block, levels - 1).select(up, *[F.col(f"_e_{c}").alias(f"_u_{c}") for c in cols])
    within = Window.partitionBy(up).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = with_blk.join(offsets, up)
    for c in cols:
        out = out.withColumn(f"_e_{c}", F.col(f"_u_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop(up, *[f"_u_{c}" for c in cols])


def running_total(df: DataFrame, order_col: str, value_cols: list[str], block: int = 4096,
                  suffix: str = "_cum", levels: int = 2) -> DataFrame:
    """Inclusive prefix sums of ``value_cols`` over a dense integer ``order_col``."""
    out = _before(df, order_col, value_cols, block, levels)
    for c in value_cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_e_{c}") + F.col(c))
    return out.drop(*[f"_e_{c}" for c in value_cols])
