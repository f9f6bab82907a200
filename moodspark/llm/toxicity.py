"""Toxicity by a character n-gram linear classifier with naive Bayes features.

A text's features are which hashed 3- to 5-grams of code points (lower case) it
holds. Over *all* labelled training texts, grouped sums count for every gram the
distinct toxic and other texts that hold it; the logarithm of the ratio of the
two counts, smoothed toward the ratio of the labels (``smoothing`` texts), is its
naive Bayes weight r. Of the grams that speak for toxicity the ``FEATURES`` with
most evidence (r times its number of standard errors) are kept; a text is the
vector of the r of those it holds, at unit length, so that long texts weigh as
much as short ones. A logistic regression with ridge penalty over these vectors,
fitted on a bounded sample of labelled texts (``per_class`` of each label, by
hash), gives the score. Scoring is a narrow map over all rows.

Copies: exact copies of a text count once per label, so that a large group of
copies does not turn its ordinary grams into evidence. Nothing but counts, the
kept grams and the sample's feature bits (``FEATURES`` / 8 bytes a text) comes to
the driver, and the model, of fixed size, is all that is broadcast besides the
keys of the sample.

Cases: null and empty texts, and texts without a kept gram, get the score of the
intercept; very long texts are cut into overlapping windows, whose grams are
united; null labels and null ids label nothing; a doc_id labelled more than once
counts with its highest label; a text labelled both ways counts on both sides;
equal texts get equal scores; without labelled texts every score is 0.5, with
one label only the smoothed share of toxic texts; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm.common import narrow, text_or_empty
from moodspark.session import materialize

BITS = 18
FEATURES = 2048
_WINDOW = 1 << 20
_P = np.uint64(0x100000001B3)
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX, _SHIFT = np.uint64(29), np.uint64(64 - BITS)


def _dims(chars: np.ndarray) -> np.ndarray:
    """Dimensions of the 3- to 5-grams of a row of code points, with repetitions."""
    if len(chars) < 3:
        return np.zeros(0, np.int64)
    grams, found = chars[:-1] * _P + chars[1:], []
    for n in (3, 4, 5):
        if len(chars) < n:
            break
        grams = grams[:len(chars) - n + 1] * _P + chars[n - 1:]
        mixed = grams * _M
        found.append(((mixed ^ (mixed >> _MIX)) * _M >> _SHIFT).astype(np.int64))
    return np.concatenate(found)


def grams(text: str) -> Iterator[np.ndarray]:
    """Dimensions of a text's grams, a window of the text at a time."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "ignore"), dtype=np.uint32)
    for at in range(0, max(1, len(chars) - 4), _WINDOW):
        yield _dims(chars[at:at + _WINDOW + 4].astype(np.uint64) + np.uint64(1))


def held(text: str, places: np.ndarray) -> np.ndarray:
    """Numbers of the kept grams that a text holds; ``places`` gives the number of each dimension, or -1."""
    found = [p[p >= 0] for p in (places[d] for d in grams(text))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, places.dtype)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: how many of its toxic and of its other texts hold each dimension; dimension -1 counts the texts."""
    total = np.zeros((2, 1 << BITS), dtype=np.int64)
    texts = np.zeros(2, dtype=np.int64)
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"]):
            parts = [np.unique(d) for d in grams(text)]
            total[int(toxic), parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))] += 1
            texts[int(toxic)] += 1
    at = np.flatnonzero(total.any(axis=0))
    yield pd.DataFrame({"dim": np.append(at, -1), "n1": np.append(total[1, at], texts[1]), "n0": np.append(total[0, at], texts[0])})


def marked_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, h, toxic: one document for each distinct labelled text and label; texts are hashed where they lie."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    return hashed.join(marks, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id"))


def gram_counts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """dim, n1, n0 over all chosen texts."""
    keys = chosen.withColumnRenamed("doc_id", "_d").withColumnRenamed("h", "_h")
    same = (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_h"))
    # rows that repeat a chosen document count once: the join key is hashed, the group is (document, text, label)
    texts = docs.join(keys, same).dropDuplicates(["_d", "_h", "toxic"]).select("text", "toxic")
    return texts.mapInPandas(_counted, "dim int, n1 long, n0 long").groupBy("dim").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def sample_keys(chosen: DataFrame, per_class: int) -> DataFrame:
    """The ``per_class`` texts of each label with the smallest hash, ranked within a 64th of the hashes first."""
    rows = chosen.withColumn("_p", F.pmod("h", F.lit(64)))
    for keys in (["toxic", "_p"], ["toxic"]):
        rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("_i") <= per_class)
    return rows.drop("_p", "_i")


def ridge_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean log loss plus the ridge penalty (accelerated gradient descent).

    Rows of ``x`` have at most unit length, which bounds the curvature.
    """
    w = np.zeros(x.shape[1] + 1)
    ahead, momentum = w.copy(), 1.0
    step = 1.0 / (0.5 + penalty)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-(x @ ahead[:-1].astype(x.dtype) + ahead[-1])))
        gap = p - y
        gradient = np.append((gap.astype(x.dtype) @ x) / len(y) + penalty * ahead[:-1], gap.mean())
        new = ahead - step * gradient
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w[:-1], float(w[-1])


def train(docs: DataFrame, marks: DataFrame, per_class: int = 2000, features: int = FEATURES, smoothing: float = 2.0) -> dict:
    """places (number of each dimension or -1), r and w of the kept grams, intercept.

    ``docs`` has doc_id and text, ``marks`` doc_id and toxic (0 or 1), once per doc_id.
    """
    chosen = materialize(marked_texts(docs, marks))
    counts = materialize(gram_counts(docs, chosen))
    texts = counts.where("dim = -1").first()
    n1, n0 = (texts["n1"], texts["n0"]) if texts else (0, 0)
    model = {"places": np.full(1 << BITS, -1, dtype=np.int16 if features < 2 ** 15 else np.int32), "r": np.zeros(0), "w": np.zeros(0), "intercept": 0.0}
    if not n1 or not n0:
        model["intercept"] = float(np.log((n1 + 1) / (n0 + 1))) if n1 or n0 else 0.0
        return model
    real = counts.where("dim >= 0")
    share = n1 / (n1 + n0)
    c1, c0 = F.col("n1") + smoothing * share, F.col("n0") + smoothing * (1 - share)
    r = F.log(c1 / c0) - float(np.log(n1 / n0))
    kept = (real.select("dim", r.alias("r"), (r * r / F.sqrt(1 / c1 + 1 / c0)).alias("e")).where("r > 0")
            .orderBy(F.desc("e"), "dim").limit(features).collect())  # at most FEATURES rows
    if not kept:  # texts without a gram
        model["intercept"] = float(np.log(n1 / n0))
        return model
    kept.sort(key=lambda row: row["dim"])
    model["places"][[row["dim"] for row in kept]] = np.arange(len(kept))
    model["r"] = np.array([row["r"] for row in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model["places"])

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["text"]:
                flags = np.zeros(len(kept), dtype=bool)
                flags[held(text, shared.value)] = True
                out.append(np.packbits(flags).tobytes())
            yield pd.DataFrame({"h": frame["h"], "toxic": frame["toxic"], "bits": out})

    # the sample is bounded by the parameter, and so is the broadcast of its keys
    drawn = F.broadcast(sample_keys(chosen, per_class).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "toxic"))
    sample = docs.withColumn("h", F.xxhash64("text")).join(drawn, (F.col("doc_id") == F.col("_d")) & (F.col("h") == F.col("_h")))
    rows = sample.select("h", "toxic", "text").mapInPandas(bits, "h long, toxic int, bits binary").distinct().collect()
    shared.destroy()
    rows.sort(key=lambda row: (row["toxic"], row["h"]))
    y = np.array([row["toxic"] for row in rows], dtype=float)
    x = np.empty((len(rows), len(kept)), dtype=np.float32)
    for i, row in enumerate(rows):
        x[i] = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=len(kept))
    x *= model["r"].astype(np.float32)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]
    model["w"], model["intercept"] = ridge_logistic(x, y)
    return model


def score(text: str, model: dict) -> float:
    """Between 0 and 1."""
    at = held(text, model["places"]) if len(model["r"]) else model["places"][:0]
    r = model["r"][at]
    norm = float(np.sqrt((r * r).sum()))
    odds = model["intercept"] + (float(r @ model["w"][at]) / norm if norm else 0.0)
    return float(1.0 / (1.0 + np.exp(-odds)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label no model may learn: crc32(id as text) mod 5 is 0 (a null id has no label)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, toxic_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id",
             per_class: int = 2000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    marks = (narrow(labels, doc_id=id_col, toxic=toxic_col).dropna().where(~held_out())
             .groupBy("doc_id").agg(F.max(F.when(F.col("toxic") >= 1, 1).otherwise(0)).alias("toxic")))
    model = train(base, marks, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([score(t, shared.value) for t in text], dtype=float)

    out = base.select("doc_id", held_out().alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
