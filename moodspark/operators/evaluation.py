"""Accuracy reports and evaluation grids.

Batch-level reports first reduce rows to one row per batch (hash aggregate
with partial aggregation), so everything after that works on
``rows / batch_size`` rows. The parameter grid is a fixed-size literal
exploded per prompt row (a generator, not a join), and missing artifacts are
found with an anti join against the listing.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.operators.ordering import global_index, running_total
from moodspark.session import written


def batch_means(df: DataFrame, batch_col: str | list[str], num: Column, den: Column | None = None) -> DataFrame:
    """Per batch: sum(num) / sum(den) (den defaults to the row count)."""
    den = den if den is not None else F.lit(1)
    keys = [batch_col] if isinstance(batch_col, str) else batch_col
    return df.groupBy(*keys).agg(F.sum(num).alias("_num"), F.sum(den).alias("_den")) \
        .select(*keys, "_num", "_den", (F.col("_num") / F.col("_den")).alias("batch_mean"))


def mean_of_batch_means(batches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted mean of per-batch means (not the overall mean), for each value of ``by``."""
    return batches.groupBy(*by).agg(F.count(F.lit(1)).alias("n_batches"),
                                    F.avg("batch_mean").alias("mean_of_batches"),
                                    (F.sum("_num") / F.sum("_den")).alias("overall_mean"))


def running_batch_mean(batches: DataFrame, batch_col: str, every: int) -> DataFrame:
    """Running mean of batch means, reported at every ``every``-th batch id.

    The running value is computed for every batch first and only then
    filtered, as the source accumulates across all batches.
    """
    cum = running_total(batches.select(batch_col, "batch_mean", F.lit(1).alias("_one")), batch_col,
                        ["batch_mean", "_one"])
    out = cum.select(batch_col, "batch_mean", (F.col("batch_mean_cum") / F.col("_one_cum")).alias("running_mean"))
    return out.where(F.col(batch_col) % every == 0)


SPLITS = ("train", "test")


def content_split(content: Column, one_in: int = 5) -> Column:
    """0 (train) or 1 (test, about one in ``one_in``) by a digest of the row's content, so that copies are on one side."""
    number = F.conv(F.substring(F.md5(content), 1, 8), 16, 10).cast("long")
    return F.when(number % one_in == 0, 1).otherwise(0)


def split_batches(df: DataFrame, order_cols: list[str], batch_size: int, split_col: str = "split") -> DataFrame:
    """``df`` with ``batch_id``: batches of ``batch_size`` rows in order, training rows and test rows each from 0."""
    idx = global_index(df, [split_col, *order_cols], "row_idx")
    before = idx.agg(F.count(F.when(F.col(split_col) == 0, 1))).scalar()
    place = F.col("row_idx") - F.when(F.col(split_col) == 1, before).otherwise(0)
    return idx.withColumn("batch_id", F.floor(place / F.lit(batch_size)).cast("bigint"))


def split_name(split: Column) -> Column:
    return F.when(split == 0, SPLITS[0]).otherwise(SPLITS[1])


def bigram_model(positions: DataFrame, train: Column) -> DataFrame:
    """A model fitted on the positions for which ``train`` holds: (token_id, label_id, pred, loss) of every pair that occurs.

    ``pred`` is the label seen most often after a token in training (ties to the
    lowest; the most frequent of all after a token that training lacks), ``loss``
    one minus the label's share after the token, with one added to the count of
    each label that training knows, so that unseen pairs have a loss too.
    """
    pairs = written(positions.groupBy("token_id", "label_id").agg(F.count(F.when(train, 1)).alias("n")), "bigrams")
    top = lambda: F.max(F.when(F.col("n") > 0, F.struct("n", (-F.col("label_id")).alias("neg"))))
    after = pairs.groupBy("token_id").agg(top().alias("top"), F.sum("n").alias("total"))
    labels = pairs.groupBy("label_id").agg(F.sum("n").alias("n")).where("n > 0")
    known, common = labels.agg(F.count("*")).scalar(), labels.agg(top()).scalar()
    pred = -F.coalesce(F.col("top.neg"), common.getField("neg"))
    return pairs.join(after, "token_id").select("token_id", "label_id", pred.cast("int").alias("pred"),
                                                (1 - (F.col("n") + 1) / (F.col("total") + known)).alias("loss"))


def masked_sums(positions: DataFrame, key_cols: list[str], pred_col: str, loss_col: str, count_col: str | None = None) -> DataFrame:
    """A8/A9 per key: hits, mask_sum, loss_sum from predictions and losses that the caller gives.

    ``count_col`` is the number of positions that a row stands for (one without it).
    """
    n = F.col(count_col) if count_col else F.lit(1)
    hit = F.when(F.col(pred_col) == F.col("label_id"), n).otherwise(0)
    return positions.groupBy(*key_cols).agg(F.sum(hit).alias("hits"), F.sum(n).cast("bigint").alias("mask_sum"), F.sum(F.col(loss_col) * n).alias("loss_sum"))


def param_grid(datasets: list[str], batch_sizes: list[int], lr_factors: list[int], epochs: list[int]) -> Column:
    """The grid as one array<struct> literal (bounded by its parameters)."""
    cells = [f"named_struct('dataset', '{d}', 'batch_size', {int(b)}, 'lr_factor', {int(lr)}, 'epoch', {int(e)})"
             for d, b, lr, e in product(datasets, batch_sizes, lr_factors, epochs)]
    return F.expr("array(" + ", ".join(cells) + ")")


def run_name(dataset: Column, batch_size: Column, lr_factor: Column, epoch: Column,
             template: str = "%s_batch%d_lr%d_epoch%d") -> Column:
    """artifact/run name from parameters."""
    return F.format_string(template, dataset, batch_size, lr_factor, epoch)


def expand_grid(prompts: DataFrame, grid: Column) -> DataFrame:
    """Q12: every prompt row x every grid cell, generated per row."""
    return prompts.select("*", F.explode(grid).alias("cfg")).select(
        "*", "cfg.dataset", "cfg.batch_size", "cfg.lr_factor", "cfg.epoch").drop("cfg")


def missing_runs(grid_rows: DataFrame, listing: DataFrame, name_col: str = "run_name") -> DataFrame:
    """Grid cells whose artifact is absent from the listing (anti join)."""
    return grid_rows.join(listing.select(F.col(name_col).alias("_have")), F.col(name_col) == F.col("_have"),
                          "left_anti")


def write_artifacts(rows: DataFrame, path: str, name_col: str = "run_name") -> None:
    """One folder ``name_col=...`` per run that has rows."""
    rows.write.partitionBy(name_col).parquet(path)


def listed_artifacts(spark: SparkSession, path: str, name_col: str = "run_name") -> DataFrame:
    """The names of the runs under ``path``, from the paths of the files there; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.select(F.regexp_extract("path", f"/{name_col}=([^/]+)/", 1).alias(name_col)).where(F.col(name_col) != "").distinct()


def zip_positional(a: Column, b: Column, names: tuple[str, str] = ("a", "b")) -> Column:
    """Align two parallel arrays by position."""
    return F.arrays_zip(a.alias(names[0]), b.alias(names[1]))
