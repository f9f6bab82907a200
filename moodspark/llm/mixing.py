"""Mixing sources to target word counts by Pareto order sampling.

Every source gets a target number of words. A document's inclusion is
``target / source size``: its whole part becomes certain whole copies, its
fraction ``f`` is the inclusion probability of one further copy. Documents are
ranked within their source by ``(u / (1 - u)) / (f / (1 - f))`` with ``u`` a
reproducible uniform number (md5 of seed and id), and the further copies go to
the lowest ranks until the words still missing are reached.

No source is ever sorted in one task: ranks are summed into 2**12 buckets per
source (partial aggregation), only the bucket in which the target is crossed is
cut again into 2**12 buckets, and only the crossing bucket of those (about one
in 16 million documents of the source) is ordered exactly.

Cases: null text has size 0; null source is a source of its own, last in
order; null ids hash as ``null``; rows repeated in id, text and source are
taken or left together; an empty table gives an empty mix; further columns
are ignored. A source without words has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm.common import narrow, row_key, text_or_empty, unit_hash
from moodspark.operators.ordering import global_index
from moodspark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
_LEVEL = 1 << 12
SOURCES = 50_000  # tables with a row per source are broadcast up to so many sources; beyond, they are joined by source


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One light row per distinct (id, text, source): its word count and how often it is there."""
    base = narrow(docs, doc_id=id_col, text=text_col, source=source_col)
    return (base.select("doc_id", "source", row_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("_key"),
                        F.md5(text_or_empty()).alias("_digest"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))
            .groupBy("doc_id", "source", "_key", "_digest", "size").agg(F.count("*").alias("_n")))


def source_targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all words by weight, at most ``most`` x a source's own words.

    The excess of a stopped source is shared by weight among the others until
    none is above; each round sends two sums to the driver, never a source.
    """
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).cast("long").alias("source_size"))
    index = global_index(totals, [F.col("source").asc_nulls_last()], "_pos")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    src = materialize(index.select("source", "source_size", weight.alias("_w"),
                                   (F.col("source_size") * F.lit(most)).alias("_cap")))
    whole = src.agg(F.sum("source_size")).first()[0] or 0
    budget, rate, stopped = share * float(whole), 0.0, -1
    while True:
        over = (F.col("_w") * F.lit(rate) > F.col("_cap")) if rate else F.lit(False)
        caps, rest, n = src.agg(F.sum(F.when(over, F.col("_cap")).otherwise(0.0)),
                                F.sum(F.when(over, 0.0).otherwise(F.col("_w"))),
                                F.sum(F.when(over, 1).otherwise(0))).first()
        if not rest or n == stopped:
            break
        rate, stopped = (budget - caps) / rest, n
    return src.select("source", "source_size", F.least("_cap", F.col("_w") * F.lit(rate)).alias("target"))


def _crossing(rows: DataFrame, bucket: str) -> DataFrame:
    """Per source the bucket in which the sum of sizes passes what is missing, and the sum before it."""
    sums = rows.groupBy("_src", bucket).agg(F.sum(F.col("size") * F.col("_n")).alias("_words"),
                                            F.first("_missing").alias("_missing"))
    run = Window.partitionBy("_src").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("_end", F.sum("_words").over(run)).where(F.col("_end") > F.col("_missing"))
    first = ends.groupBy("_src").agg(F.min(F.struct(bucket, (F.col("_end") - F.col("_words")).alias("_before"))).alias("_x"))
    return first.select("_src", F.col(f"_x.{bucket}").alias("_cut"), F.col("_x._before").alias("_before"))


def pareto_copies(units: DataFrame, targets: DataFrame, seed: int = 17, weight_col: str | None = None) -> DataFrame:
    """``units`` with source_size, target and ``copies`` (whole copies that the mix takes).

    ``weight_col`` tilts the inclusion odds of documents within their source.
    """
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    t = targets.select(src.alias("_src"), "source_size", "target")
    few = targets.count() <= SOURCES
    per_source = F.broadcast if few else (lambda table: table)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = unit_hash(seed, F.col("doc_id"), F.col("_digest"))  # rows without an id have numbers of their own
    odds = F.col("_f") / (1 - F.col("_f"))
    if weight_col:
        odds = odds * F.col(weight_col)
    rank = (u / (1 - u)) / odds
    rows = (units.withColumn("_src", src).join(per_source(t), "_src")
            .withColumn("_whole", F.floor(share)).withColumn("_f", share - F.col("_whole"))
            .withColumn("_missing", F.col("target") - F.col("_whole") * F.col("source_size"))
            .withColumn("_q", F.when(F.col("_f") > 0, rank))
            .withColumn("_slot", F.floor(F.col("_q") / (1 + F.col("_q")) * _LEVEL * _LEVEL))
            .withColumn("_b1", F.floor(F.col("_slot") / _LEVEL)).withColumn("_b2", F.col("_slot") % _LEVEL))
    rows = materialize(rows)
    drawn = rows.where(F.col("_q").isNotNull())
    cut1 = per_source(materialize(_crossing(drawn, "_b1").select("_src", F.col("_cut").alias("_c1"), F.col("_before").alias("_s1"))))
    inner = (drawn.join(cut1, "_src").where(F.col("_b1") == F.col("_c1"))
             .withColumn("_missing", F.col("_missing") - F.col("_s1")))
    cut2 = per_source(materialize(_crossing(inner, "_b2").select("_src", F.col("_cut").alias("_c2"), F.col("_before").alias("_s2"))))
    exact = inner.join(cut2, "_src").where(F.col("_b2") == F.col("_c2"))
    before = (Window.partitionBy("_src").orderBy("_q", F.col("doc_id").asc_nulls_first(), "_key")
              .rowsBetween(Window.unboundedPreceding, -1))
    words = F.col("size") * F.col("_n")
    late = (exact.withColumn("_at", F.coalesce(F.sum(words).over(before), F.lit(0)) + F.col("_s2"))
            .where(F.col("_at") + words / 2 <= F.col("_missing"))
            .select(F.col("_src").alias("_ls"), F.col("doc_id").alias("_ld"), F.col("_key").alias("_lk"), F.lit(True).alias("_late")))
    joined = (rows.join(cut1, "_src", "left").join(cut2, "_src", "left")
              .join(late, (F.col("_src") == F.col("_ls")) & F.col("doc_id").eqNullSafe(F.col("_ld"))
                    & (F.col("_key") == F.col("_lk")), "left"))
    early = (F.col("_c1").isNull() | (F.col("_b1") < F.col("_c1"))
             | ((F.col("_b1") == F.col("_c1")) & (F.col("_b2") < F.col("_c2"))))
    more = F.when(F.col("_q").isNull(), 0).when(F.coalesce(F.col("_late"), F.lit(False)) | early, 1).otherwise(0)
    return joined.select("doc_id", "source", "_key", "size", "_n", "source_size", "target",
                         (F.col("_whole") + F.coalesce(more, F.lit(0))).cast("int").alias("copies"))


def mix_report(docs: DataFrame, seed: int = 17, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    units = materialize(sized(docs))
    mixed = pareto_copies(units, source_targets(units, share=share, most=most), seed)
    return (mixed.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")))


def mix(docs: DataFrame, seed: int = 17, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus itself: every row as often as it is taken, with all its columns."""
    units = materialize(sized(docs))
    mixed = (pareto_copies(units, source_targets(units, share=share, most=most), seed)
             .select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "copies"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_did"),
                       row_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("_key"))
    return (rows.join(mixed, F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")))
            .where(F.col("copies") > 0)
            .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("_row.*"))
