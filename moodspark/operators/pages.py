"""Page corpus -> song records -> keep-first dedupe -> cumulative snapshots.

Shuffle budget: extraction (P2-P8) is narrow; the dedupe is one hash
aggregate keyed by the dedupe key (partial aggregation first, so a title held
by a third of the pages is reduced per task before the exchange); snapshots
aggregate once per key and then work on per-snapshot counts only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.functions import html as hx


def presence_cascade(df: DataFrame, checks: list[tuple[str, Column]], kept: str = "kept",
                     reason_col: str = "reason") -> DataFrame:
    """Tag each row with the first failing check (in order), else ``kept``.

    ``checks`` are (reason, ok-condition); a NULL condition counts as failed,
    like the source's missing-element branches.
    """
    reason = None
    for name, ok in checks:
        failed = ~F.coalesce(ok, F.lit(False))
        reason = F.when(failed, F.lit(name)) if reason is None else reason.when(failed, F.lit(name))
    reason = F.lit(kept) if reason is None else reason.otherwise(F.lit(kept))
    return df.withColumn(reason_col, reason)


def reject_counts(tagged: DataFrame, reason_col: str = "reason") -> DataFrame:
    return tagged.groupBy(reason_col).agg(F.count(F.lit(1)).alias("n_pages"))


def song_records(pages: DataFrame, title: Column, lines: Column, id_col: str = "page_id") -> DataFrame:
    """P5+P8: record = title parts ++ lines, kept as a struct of arrays."""
    return pages.select(
        id_col,
        title.alias("title"),
        hx.split_parts(title).alias("title_parts"),
        lines.alias("lines"),
    ).withColumn("record", F.concat("title_parts", "lines"))


def ragged_to_rows(df: DataFrame, array_col: str, key_cols: list[str], width: Column | None = None) -> DataFrame:
    """The rectangle as rows (keys, width, cells): every record NULL-padded to the widest.

    The width is a scalar subquery of the same plan unless given; the schema is
    the same for any data, and the padding is narrow.
    """
    if width is None:
        width = F.coalesce(df.agg(F.max(F.size(array_col))).scalar(), F.lit(0))
    pad = F.array_repeat(F.lit(None).cast("string"), F.greatest(width - F.size(array_col), F.lit(0)))
    return df.select(*key_cols, width.cast("int").alias("width"), F.concat(F.col(array_col), pad).alias("cells"))


def ragged_to_wide(df: DataFrame, array_col: str, key_cols: list[str], width: int, prefix: str = "c") -> DataFrame:
    """P9 in column form, for a stated ``width`` (e.g. a sheet export): ``c000..``, NULL-padded."""
    keys = [f"`{k}`" for k in key_cols]
    return df.selectExpr(*keys, *[f"get(`{array_col}`, {i}) AS {prefix}{i:03d}" for i in range(width)])


def extract_fields(df: DataFrame, html_col: str, containers: dict[str, tuple[str, str | None]], metas: dict[str, str] | None = None,
                   links: dict[str, tuple[str, str | None, str]] | None = None) -> DataFrame:
    """P2-P4 at once: ``df`` without the page, with one column per field; the page is cut into tags once.

    ``containers``: field -> (tag, class), text of the first such element with all
    that is nested in it. ``metas``: field -> property, the content of the first
    ``meta`` with it. ``links``: field -> (tag, class, attribute), its values in
    order. A class may be None. What is absent is NULL, or an empty array of links.
    """
    kept = [c for c in df.columns if c != html_col]
    walked = df.select(*kept, hx.tags(F.col(html_col)).alias("_tags"))
    walked = walked.select("*", hx.container_spans("_tags", list(containers.values())).alias("_spans"))
    fields = [hx.span_text("_tags", F.get("_spans", F.lit(i))).alias(name) for i, name in enumerate(containers)]
    fields += [F.get(hx.tag_values("_tags", "meta", "content", where=("property", prop)), F.lit(0)).alias(name) for name, prop in (metas or {}).items()]
    fields += [hx.tag_values("_tags", tag, attr, cls).alias(name) for name, (tag, cls, attr) in (links or {}).items()]
    return walked.select(*kept, *fields)


def dedupe_first(df: DataFrame, key_cols: list[str], order_col: str, keep_cols: list[str]) -> DataFrame:
    """P10: first row per key in crawl order (not an arbitrary ``dropDuplicates`` row).

    ``min(struct(order, ...))`` is a hash aggregate with map-side partial
    aggregation, so hot keys are combined before the shuffle.
    """
    picked = F.min(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in keep_cols])).alias("_first")
    out = df.groupBy(*key_cols).agg(picked)
    return out.select(*key_cols, F.col("_first._o").alias(order_col), *[F.col(f"_first.{c}").alias(c) for c in keep_cols])


def crawl_date_index(df: DataFrame, date_col: str) -> DataFrame:
    """Distinct crawl dates with their 1-based position.

    The distinct-date table is bounded by the calendar (one row per crawl
    date), so ordering it in one partition is safe.
    """
    dates = df.select(F.col(date_col).alias("crawl_date")).distinct()
    return dates.withColumn("date_idx", F.row_number().over(Window.orderBy("crawl_date")).cast("int"))


def cumulative_snapshots(df: DataFrame, key_cols: list[str], date_col: str, every: int = 12,
                         emit_final: bool = True) -> DataFrame:
    """After every ``every`` crawl dates, the cumulative distinct keys.

    Output: (snapshot_no, snapshot_date, n_new, n_keys). With ``emit_final``
    a last partial snapshot is emitted for the trailing dates the source
    never saved (quirk 1).
    """
    dates = crawl_date_index(df, date_col)
    first_seen = df.groupBy(*key_cols).agg(F.min(date_col).alias("crawl_date"))
    # one row per crawl date: bounded by the calendar
    firsts = first_seen.join(F.broadcast(dates), "crawl_date").select(
        F.ceil(F.col("date_idx") / F.lit(every)).cast("int").alias("snapshot_no"))
    per_snap = firsts.groupBy("snapshot_no").agg(F.count(F.lit(1)).alias("n_new"))
    snaps = (dates.withColumn("n_dates", F.max("date_idx").over(Window.partitionBy()))
             .where((F.col("date_idx") % every == 0) | (F.col("date_idx") == F.col("n_dates")))
             .select(F.ceil(F.col("date_idx") / F.lit(every)).cast("int").alias("snapshot_no"),
                     F.date_format("crawl_date", "yyyyMMdd").alias("snapshot_date"),
                     "date_idx", "n_dates"))
    if not emit_final:
        snaps = snaps.where(F.col("date_idx") % every == 0)
    out = snaps.join(per_snap, "snapshot_no", "left").fillna(0, ["n_new"])
    w = Window.orderBy("snapshot_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select("snapshot_no", "snapshot_date", F.col("n_new").cast("bigint").alias("n_new"),
                      F.sum("n_new").over(w).cast("bigint").alias("n_keys"))


def snapshot_rows(df: DataFrame, key_cols: list[str], date_col: str, order_col: str,
                  keep_cols: list[str], every: int = 12) -> DataFrame:
    """S5 sink form: each key's first row tagged with the first snapshot holding it.

    Writing this with ``partitionBy('snapshot_no')`` and reading snapshots
    ``<= k`` reproduces the cumulative workbook k without copying rows.
    """
    dates = crawl_date_index(df, date_col)
    firsts = dedupe_first(df, key_cols, order_col, [date_col, *keep_cols])
    dates = F.broadcast(dates)  # bounded by the calendar
    return (firsts.join(dates, firsts[date_col] == dates["crawl_date"])
            .withColumn("snapshot_no", F.ceil(F.col("date_idx") / F.lit(every)).cast("int"))
            .drop("crawl_date", "date_idx"))


def write_snapshots(rows: DataFrame, path: str) -> None:
    """S5 sink: one folder per snapshot; rerunning overwrites whole snapshots.

    Snapshot k of the source's cumulative workbooks is ``snapshot_no <= k``
    (partition pruning on the folder column). No repartition by snapshot:
    the first snapshot can hold most keys, so every task writes its own files
    into each snapshot folder instead of funnelling a snapshot through one task.
    """
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_no").parquet(path))


def add_snapshot(batch: DataFrame, key_cols: list[str], order_col: str, keep_cols: list[str], path: str, snapshot_no: int) -> DataFrame:
    """S5 step by step: the rows of snapshot ``snapshot_no`` (from 1) whose keys no earlier snapshot has, as written.

    ``batch`` holds the rows that came in since the last snapshot. Of earlier
    snapshots only the keys are read, never the rows they came from, and nothing
    of them is written again; snapshot k is what lies in the folders up to k. A
    repeated step overwrites its own folder.
    """
    spark = batch.sparkSession
    fresh = dedupe_first(batch, key_cols, order_col, keep_cols)
    if snapshot_no > 1:
        earlier = spark.read.parquet(path).where(F.col("snapshot_no") < snapshot_no).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)])
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key_cols)])
        fresh = fresh.join(earlier, same, "left_anti")
    own = f"{path}/snapshot_no={snapshot_no}"
    fresh.write.mode("overwrite").parquet(own)
    return spark.read.schema(fresh.schema).parquet(own)
