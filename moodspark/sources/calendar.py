"""Calendar spine of crawl dates as ``yyyyMMdd`` strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar_spine(bounds: DataFrame, start: Column, end: Column, step: str = "1 month") -> DataFrame:
    """One row per date from ``start`` to ``end`` (inclusive) at ``step``.

    ``bounds`` is a one-row DataFrame holding the bound expressions (e.g. an
    aggregate over a table); the sequence is exploded in its own projection
    because ``explode`` cannot nest inside another expression.
    """
    seq = F.sequence(start.cast("date"), end.cast("date"), F.expr(f"interval {step}"))
    exploded = bounds.select(F.posexplode(seq).alias("pos", "d"))
    return exploded.select((F.col("pos") + 1).cast("int").alias("seq"),
                           F.date_format("d", "yyyyMMdd").alias("chart_date"))


def chart_urls(dates: DataFrame, base_url: str) -> DataFrame:
    """URL template per chart date."""
    return dates.withColumn("url", F.concat(F.lit(base_url), F.col("chart_date")))
