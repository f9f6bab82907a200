"""Scans of the landed Parquet tables (S6: pages arrive as a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str, spread_on: list[str] | None = None) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it.

    ``spread_on`` names the keys by which ``spread`` may deal the rows out before
    CPU-heavy text work, if the session asks for it.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread_on:
        from moodspark.operators.partitioning import spread
        df = spread(df, spread_on)
    return df
