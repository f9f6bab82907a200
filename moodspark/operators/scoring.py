"""Classification heads on pooled embeddings (Q10), argmax labels (T3/X5) and user models.

The class-mean head is fitted by grouped averages; its size is classes x dims,
and it reaches the rows it scores as a scalar subquery of the same plan.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.functions import text as tx


def argmax(vec: Column) -> Column:
    """0-based argmax over the whole vector, first index on ties."""
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def class_mean_head(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """Q10 fit: one row per class (label, n, w, b) with w the class mean and b = -|w|^2 / 2.

    The largest logit is then the nearest class mean. Vectors of different
    lengths fail the job.
    """
    rows = df.where(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull())
    size = rows.agg(F.max(F.size(vec_col))).scalar()
    sound = F.when(F.size(vec_col) == size, F.col(vec_col)).otherwise(
        F.raise_error(F.lit("vectors of different lengths")).cast(df.schema[vec_col].dataType))
    cells = rows.select(F.col(label_col).alias("label"), F.posexplode(sound).alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    heads = means.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_c"))
    w = F.transform("_c", lambda c: c["m"])
    return heads.select("label", "n", w.alias("w")).withColumn("b", F.expr("aggregate(w, 0D, (a, x) -> a + x * x) / -2"))


def head_logits(df: DataFrame, heads: DataFrame, vec_col: str, out_col: str = "logits") -> DataFrame:
    """Q10 scoring: ``df`` with the logits of all classes, in label order, and ``class_ids`` beside them."""
    table = heads.agg(F.array_sort(F.collect_list(F.struct("label", "w", "b")))).scalar()
    scored = df.withColumn("_heads", table)
    logits = F.expr(f"""transform(_heads, h -> aggregate(zip_with(`{vec_col}`, h.w, (x, y) -> CAST(x AS DOUBLE) * y), 0D,
                                                         (acc, x) -> acc + x) + h.b)""")
    return scored.withColumn(out_col, logits).withColumn("class_ids", F.expr("transform(_heads, h -> h.label)")).drop("_heads")


def head_predictions(df: DataFrame, heads: DataFrame, vec_col: str) -> DataFrame:
    """``df`` with ``pred`` (class of the largest logit, first on ties) and ``max_logit``."""
    out = head_logits(df, heads, vec_col)
    return (out.withColumn("pred", F.get("class_ids", argmax(F.col("logits"))).cast("int"))
            .withColumn("max_logit", F.array_max("logits")).drop("logits", "class_ids"))


# ---- Q11 / D3: pluggable user model, loaded once per Python worker ---------

_MODEL_CACHE: dict[str, object] = {}


def model_scorer(df: DataFrame, text_col: str, model_key: str, load_model, key_cols: list[str],
                 out_col: str = "pred") -> DataFrame:
    """Score ``text_col`` with a user model in Arrow batches (``mapInPandas``).

    ``load_model()`` must return an object with ``predict(list[str]) -> list[int]``;
    it runs once per Python worker (cached under ``model_key``), not per row or
    per batch, which is the source's per-sentence loader turned inside out.
    """
    from moodspark.session import ship_package
    ship_package(df.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in key_cols]
                       + [f"`{out_col}` int"])

    def run(batches):
        model = _MODEL_CACHE.get(model_key)
        if model is None:
            model = _MODEL_CACHE[model_key] = load_model()
        for pdf in batches:
            out = pdf[key_cols].copy()
            out[out_col] = model.predict(pdf[text_col].tolist())
            yield out

    return df.select(*key_cols, text_col).mapInPandas(run, schema)


class LexiconModel:
    """Stand-in user model for ``model_scorer``: most lexicon hits, ties to the
    lowest class, ``None`` without a hit (same rule as the SQL scorer)."""

    def __init__(self, lexicon: list[str] | None = None, n_classes: int = 15):
        from moodspark.catalog import FIXTURE_LEXICON
        self.ids = {w: i for i, w in enumerate(lexicon or FIXTURE_LEXICON)}
        self.n = n_classes

    def predict(self, texts):
        words = pd.Series(texts, dtype="object").fillna("").str.replace(r"[?.!,]", " ", regex=True).str.lower()
        cls = words.str.split(r"[\t\n\x0b\f\r ]+", regex=True).explode().map(self.ids).dropna().astype(int)
        best = cls.groupby(level=0).agg(lambda c: int(np.bincount(c, minlength=self.n).argmax()))
        return [None if np.isnan(x) else int(x) for x in best.reindex(range(len(texts)))]


# ---- D3: a fitted text model behind the same hook ---------------------------

BUCKETS = 128


def token_bucket(token: Column, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def fit_text_head(texts: DataFrame, text_col: str, label_col: str, buckets: int = BUCKETS) -> dict[int, list[float]]:
    """Class means of hashed token counts: label -> mean count per bucket, by grouped sums over all rows.

    The result has classes x buckets numbers, whatever the rows.
    """
    rows = texts.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(label_col).cast("int").alias("label"), tx.lexicon_tokens(text_col).alias("ts"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sums = rows.select("label", F.explode("ts").alias("t")).groupBy("label", token_bucket(F.col("t"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    means = {r["label"]: [0.0] * buckets for r in sizes.collect()}
    for r in sums.join(sizes, "label").select("label", "bucket", (F.col("c") / F.col("n")).alias("m")).collect():
        means[r["label"]][r["bucket"]] = r["m"]
    return means


class TextHead:
    """User model for ``model_scorer``: the class whose mean of hashed token counts is nearest, ties to the lowest."""

    def __init__(self, means: dict[int, list[float]]):
        self.labels = sorted(means)
        self.w = np.array([means[k] for k in self.labels]).reshape(len(self.labels), -1)
        self.b = -(self.w ** 2).sum(axis=1) / 2
        self.buckets: dict[str, int] = {}

    def bucket(self, token: str) -> int:
        if token not in self.buckets:
            if len(self.buckets) >= 1_000_000:
                self.buckets.clear()
            self.buckets[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.w.shape[1]
        return self.buckets[token]

    def predict(self, texts):
        out = []
        for text in texts:
            if text is None or not self.labels:
                out.append(None)
                continue
            tokens = [t for t in re.split(tx.TOKEN_SPLIT_RE, re.sub(r"[?.!,]", " ", text).lower()) if t]
            counts = np.bincount([self.bucket(t) for t in tokens], minlength=self.w.shape[1]) if tokens else np.zeros(self.w.shape[1])
            out.append(self.labels[int(np.argmax(self.w @ counts + self.b))])
        return out
