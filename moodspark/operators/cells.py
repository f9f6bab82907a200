"""A grid of cells: groups of packed queries meet slices of packed items.

Work that has every query look at every item (top-k by similarity) is dealt out
in cells. A cell is a task's unit: the group of queries stays resident while
the blocks of the slice stream past it, and what it leaves is a partial result
that merges with those of the group's other cells. Items are copied once per
*group*, queries once per *slice*; with few queries there is one group, and the
slices alone give the parallelism. A condition on group and block keeps blocks
from being dealt to groups that they can't serve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most item blocks that stream through one cell.
CELL_BLOCKS = 1024


def tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices_for(spark: SparkSession, n_groups: int, n_blocks: int) -> int:
    """Slices of the items: enough cells for all tasks, and no cell of more than ``CELL_BLOCKS`` blocks on average."""
    wanted = max(-(-tasks(spark) // max(1, n_groups)), -(-n_blocks // CELL_BLOCKS))
    return max(1, min(wanted, n_blocks))


def deal(groups: DataFrame, blocks: DataFrame, slices: int, n_groups: int, on: list[str], serves: Column | None = None,
         order: str = "ord", group_info: list[str] = ()) -> DataFrame:
    """Rows of all cells: grp, slice, kind (0: the group, 1: a block), ``order`` and the columns of both sides.

    ``groups`` has one row per ``on`` and ``grp``, ``blocks`` one per block with
    its ``slice``. ``on`` are columns that a group and a block must share, ``serves``
    a further condition on ``group_info`` columns of the group and those of the
    block; without ``on``, groups are numbered from 0 and every block goes to
    each. Each cell's rows are in one partition, the group first, then the
    blocks by ``order``. The groups' keys are broadcast: one narrow row for
    thousands of queries.
    """
    spark = groups.sparkSession
    asked = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("kind", F.lit(0))
    if on:
        keys = F.broadcast(groups.select("grp", *on, *group_info))
        dealt = blocks.join(keys, on)
        if serves is not None:
            dealt = dealt.where(serves)
    else:
        dealt = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    dealt = dealt.drop(*group_info).withColumn("kind", F.lit(1))
    rows = asked.unionByName(dealt, allowMissingColumns=True)
    parts = max(1, min(n_groups * slices, 4 * tasks(spark)))
    place = F.pmod((F.hash(*on) if on else F.lit(0)) + F.col("grp").cast("long") * F.lit(slices) + F.col("slice"), F.lit(parts)).cast("int")
    return rows.repartitionById(parts, place).sortWithinPartitions(*on, "grp", "slice", "kind", order)
