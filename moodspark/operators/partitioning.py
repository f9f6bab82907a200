"""Spreading of scans with few splits, on request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Session setting: the number of partitions to deal scans out to. Unset, a scan stays as its files split it.
SPREAD = "spark.moodspark.spread"


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition on ``keys`` if the session sets ``spark.moodspark.spread``.

    The caller knows its files: one row group is one task, and text work gains
    from being dealt out; many splits need no shuffle. Hash (not round-robin)
    partitioning keeps retries deterministic.
    """
    parts = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(parts, *[F.col(k) for k in keys]) if parts > 0 else df
