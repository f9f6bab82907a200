"""Quality classifier: hierarchical empirical Bayes over hosts and paths.

A document's own evidence is a logistic regression on hashed character n-grams
(FTRL, fitted on a bounded sample of labelled rows, with a fitted temperature).
The sites' evidence comes from all labelled rows by grouped sums: labels are
counted per path, paths add up to hosts, hosts to the global rate. The spread
between hosts, and between paths inside their hosts, gives two shrinkage
strengths by the method of moments; a host's posterior mean is shrunk toward
the global rate and a path's toward its host, so that a site with few labels
says little. A document's log odds are its own evidence plus what its path's
posterior differs from the global rate. A labelled document's own label is
taken out of its host's and its path's counts first.

Cases: null text is empty; null host or path is a site of its own; documents
without labels at their site get the global rate there; without any label the
score is 0.5 for all; doc_ids labelled more than once count with their lowest
label; a document repeated at a site counts there once, and gives repeated
results; very long texts are read whole, one at a time; equal scores need no
order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm import langid
from moodspark.llm.common import text_or_empty

_FLAT = np.ones(langid.DIMS)
_EPS = 1e-4


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(_EPS)), F.lit(1 - _EPS))
    return F.log(q / (1 - q))


def train_evidence(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> dict:
    """Weights of the document classifier from at most ``per_class`` labelled rows of each class."""
    drawn = labels.withColumn("_u", F.xxhash64("doc_id", F.lit(3))).withColumn("_p", F.pmod("_u", F.lit(64)))
    for keys in (["good", "_p"], ["good"]):  # ranks within a 64th of the hashes first: no task orders a whole class
        drawn = drawn.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_u", "doc_id"))).where(F.col("_i") <= per_class)
    drawn = drawn.select("doc_id", "good")

    # the sample is bounded by the parameter, so is its broadcast; texts are read where they lie
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id")
    marks, rows = langid.gathered(sample, "good", "int", _FLAT)
    y = np.array(marks, dtype=np.int64)
    if len(set(marks)) < 2:
        return {"weights": np.zeros(langid.DIMS + 1), "temperature": 1.0}
    back = np.array([langid.held_back(a, v) for a, v in rows])  # copies of a text are on one side
    if len(set(y[~back])) < 2:
        back[:] = False
    w = langid.ftrl([x for x, b in zip(rows, back) if not b], y[~back], 2)
    held = np.array([w[:, a] @ v + w[:, langid.DIMS] for (a, v), b in zip(rows, back) if b])
    t = langid.temperature(held, y[back])
    rate = float(y[~back].mean())
    weights = (w[1] - w[0]) / t
    weights[langid.DIMS] -= np.log(rate / (1 - rate))  # evidence is relative to the sample's rate
    return {"weights": weights, "temperature": t}


def _strength(groups: DataFrame, rate: Column) -> float:
    """Prior strength (pseudo-labels) of group rates around ``rate``: method of moments, between 1 and a million."""
    n, y = F.col("n"), F.col("y")
    r = groups.agg(F.sum(n * F.pow(y / n - rate, 2)).alias("s"), F.count("*").alias("g"), F.sum(n).alias("n"),
                   F.sum(n * n).alias("nn"), (F.sum(n * rate) / F.sum(n)).alias("m")).first()
    if not r["n"] or r["g"] < 2:
        return 1.0
    within = r["m"] * (1 - r["m"])
    spread = (r["s"] - (r["g"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(min(max(within / spread - 1, 1.0), 1e6)) if spread > 0 else 1e6


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column, path: Column, good: Column, per_class: int = 1500,
                   keep_from: float = 0.5) -> DataFrame:
    """doc_id, p_document, host_rate, path_rate, score, keep of every row of ``docs``.

    ``host`` and ``path`` are expressions on ``docs``, ``good`` (0 or 1) one on ``labels``.
    """
    marks = labels.select("doc_id", good.cast("int").alias("good")).where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    model = train_evidence(docs, marks, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(text: pd.Series) -> pd.Series:
        w = shared.value["weights"]
        out = []
        for t in text:
            at, value = langid.vector(t, _FLAT)
            out.append(float(w[at] @ value + w[langid.DIMS]))
        return pd.Series(out)

    site = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit(""))
    rows = docs.select("doc_id", site(host).alias("_host"), site(path).alias("_path"), text_or_empty().alias("_text"))
    labelled = rows.select("doc_id", "_host", "_path").join(marks, "doc_id").distinct()
    counted = [F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("y")]
    paths = labelled.groupBy("_host", "_path").agg(*counted)
    hosts = labelled.select("doc_id", "_host", "good").distinct().groupBy("_host").agg(*counted)
    whole = hosts.agg(F.sum("y").alias("y"), F.sum("n").alias("n")).first()
    rate = (whole["y"] + 0.5) / (whole["n"] + 1.0) if whole["n"] else 0.5
    k_host = _strength(hosts, F.lit(rate))
    host_rate = hosts.select("_host", F.col("n").alias("_hn"), F.col("y").alias("_hy"), ((F.col("y") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
    joined = paths.join(host_rate, "_host")
    k_path = _strength(joined, F.col("host_rate"))

    scored = rows.withColumn("_e", evidence("_text")).select("doc_id", "_host", "_path", "_e")
    table = (scored.join(marks, "doc_id", "left")
             .join(paths, ["_host", "_path"], "left")
             .join(host_rate.drop("host_rate"), "_host", "left"))
    own = F.when(F.col("good").isNull(), 0.0).otherwise(1.0)
    label = F.coalesce(F.col("good").cast("double"), F.lit(0.0))
    less = lambda c, x: F.coalesce(c, F.lit(0.0)) - x  # noqa: E731  counts without the document's own label
    n, y = less("n", own), less("y", label)
    h = (less("_hy", label) + k_host * rate) / (less("_hn", own) + k_host)
    path_rate = (y + k_path * h) / (n + k_path)
    odds = F.col("_e") + _logit(F.col("path_rate"))
    return (table.select("doc_id", "_e", h.alias("host_rate"), path_rate.alias("path_rate"))
            .withColumn("score", 1 / (1 + F.exp(-odds)))
            .select("doc_id", (1 / (1 + F.exp(-(F.col("_e") + _logit(F.lit(rate)))))).alias("p_document"), "host_rate", "path_rate",
                    "score", (F.col("score") >= keep_from).alias("keep")))
