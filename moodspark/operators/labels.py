"""Label spaces: strict / lenient lookups, many-to-one collapse, first-appearance
indexing, drops, value counts and table profiles.

Catalog and edge joins carry no hint: Spark broadcasts a table whose size is
under the threshold (the fixed catalogs always are) and shuffles a larger one,
e.g. a catalog found in the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodspark.catalog import RESULT_SENTENCE
from moodspark.operators.ordering import global_index


def _names(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.col("name").alias("_name"), F.col("id").alias("_id"))


def strict_lookup(df: DataFrame, col: str, catalog: DataFrame, out_col: str = "label_id") -> DataFrame:
    """Name -> id; an unknown (non-NULL) name fails the job, naming the value.

    ``map[key]``/``element_at`` return NULL on a miss, so the failure is an
    explicit ``raise_error``. NULL names stay NULL.
    """
    joined = df.join(_names(catalog), F.col(col) == F.col("_name"), "left")
    checked = F.when(F.col(col).isNull(), F.lit(None).cast("int")).otherwise(
        F.coalesce(F.col("_id"), F.raise_error(F.concat(F.lit(f"unknown label in {col}: "), F.col(col)))
                   .cast("int")))
    return joined.withColumn(out_col, checked).drop("_name", "_id")


def lenient_recode(df: DataFrame, col: str, catalog: DataFrame, out_col: str | None = None) -> DataFrame:
    """Known names become their id (as string); others are left as they are."""
    joined = df.join(_names(catalog), F.col(col) == F.col("_name"), "left")
    return joined.withColumn(out_col or col, F.coalesce(F.col("_id").cast("string"), F.col(col))) \
        .drop("_name", "_id")


def collapse(df: DataFrame, col: str, edges: DataFrame, dropped: list[str], out_col: str = "label",
             strict: bool = True) -> DataFrame:
    """Many-to-one collapse in one join (not one scan per name).

    Rows whose name is in ``dropped`` are removed (F4); with ``strict`` an
    unmapped name fails the job (quirk 8: the source only fails later at
    encode time).
    """
    e = edges.select(F.col("src_name").alias("_name"), F.col("dst_id").alias("_id"))
    kept = drop_values(df, col, dropped)
    joined = kept.join(e, F.col(col) == F.col("_name"), "left")
    if strict:
        label = F.coalesce(F.col("_id"), F.raise_error(F.concat(F.lit(f"unmapped label in {col}: "),
                                                                F.coalesce(F.col(col), F.lit("NULL")))).cast("int"))
    else:
        label = F.col("_id")
    out = joined.withColumn(out_col, label.cast("int")).drop("_name", "_id")
    return out if strict else out.where(F.col(out_col).isNotNull())


def drop_value(df: DataFrame, col: str, value) -> DataFrame:
    """pandas-style drop: rows equal to ``value`` go, NULL rows stay.

    Written as ``col IS NULL OR col <> value`` (same rows as
    ``NOT coalesce(col = value, false)``) so the predicate reaches the scan.
    """
    return df.where(F.col(col).isNull() | (F.col(col) != F.lit(value)))


def drop_values(df: DataFrame, col: str, values: list) -> DataFrame:
    """drop rows whose value is in ``values``; NULL rows stay."""
    if not values:
        return df
    if any(v is None for v in values):
        raise ValueError("drop list must not contain NULL")
    return df.where(F.col(col).isNull() | ~F.col(col).isin(list(values)))


def first_appearance_index(df: DataFrame, col: str, order_col: str | list[str], out_col: str = "label_id") -> DataFrame:
    """A2+A3: distinct values numbered by first appearance (not frequency/alphabet).

    One partial aggregate per value, then a distributed dense index over the
    distinct values (``StringIndexer`` only offers frequency/alphabet orders).
    """
    first = F.col(order_col) if isinstance(order_col, str) else F.struct(*order_col)
    firsts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(first).alias("first_row"))
    return global_index(firsts, ["first_row", col], out_col).withColumn(out_col, F.col(out_col).cast("int"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1: counts per value, descending, NULL excluded (pandas ``value_counts``)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.col(col)))


def null_flags(df: DataFrame, keep: list[str]) -> DataFrame:
    """Every column but ``keep`` as 1 or NULL: all that a profile needs of it, and nothing wide to shuffle."""
    return df.select(*[c if c in keep else F.when(F.col(c).isNotNull(), F.lit(1)).alias(c) for c in df.columns])


def profile(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """A4: rows, non-null count and type per column in one aggregate pass.

    ``schema`` names the types where ``df`` holds null flags.
    """
    fields = (schema or df.schema).fields
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(f.name)).alias(f"_nn{i}") for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    stack_args = ", ".join(f"'{f.name}', {i}, '{f.dataType.simpleString()}', _nn{i}" for i, f in enumerate(fields))
    return one.select(F.col("_rows").alias("n_rows"), F.expr(f"stack({len(fields)}, {stack_args})")
                      .alias("column_name", "ordinal", "dtype", "non_null")) \
        .select("column_name", F.col("ordinal").cast("int"), "dtype", "non_null", "n_rows")


def head_tail(df: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    """First and last ``n`` rows by an explicit order (top-k per task, then merge)."""
    head = df.orderBy(F.col(order_col)).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(F.col(order_col).desc()).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def display_name(df: DataFrame, id_col: str, catalog: DataFrame, out_col: str = "label_name") -> DataFrame:
    """Id -> display name via the catalog."""
    c = catalog.select(F.col("id").alias("_cid"), F.col("name").alias(out_col))
    return df.join(c, F.col(id_col) == F.col("_cid"), "left").drop("_cid")


def label_sentence(name: Column, template: str = RESULT_SENTENCE) -> Column:
    """X5 sentence form of a predicted name."""
    return F.format_string(template, name)
