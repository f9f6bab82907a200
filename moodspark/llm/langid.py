"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Texts become sparse vectors of hashed 1- to 3-grams of code points (lower
case), term frequency times inverse document frequency, of unit length. The
document frequencies come from all training rows by a grouped sum. The weights
are fitted on all distinct training texts of all languages: the texts are dealt
by hash to shards of about ``SHARD`` bytes, a task fits each shard by
FTRL-proximal with elastic-net penalties, and the weights are averaged, a
language's by how many of its texts a shard holds. A temperature is then fitted
on a fifth of the texts, which is held back from the shards. Scoring is a narrow
map over all rows.

Nothing is sampled. The driver gets sums and the model, which has ``DIMS`` x
languages weights and is broadcast. The sums are of whole numbers and shards
depend on texts only, so the partitions of the input change nothing.

Cases: null text or text without a letter is ``und`` with score 0; without any
labelled training row every text is ``und``; with a single language all texts
with letters get it; null languages train nothing; repeated rows count in the
document frequencies as often as they occur, but their text is fitted once, and
give repeated results; a language whose texts would all be held back is fitted
on them; the texts of a rare language are dealt to several shards, so that each
learns it; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm.common import narrow
from moodspark.session import materialize

DIMS = 1 << 15
SHARD = 8 << 20  # bytes of text fitted together
_STEP, _BLOCK, _FAN = 1 << 20, 4096, 64  # summed weights are whole steps, summed by blocks of dimensions, so many at a time
_GRID = np.arange(-4.0, 3.01, 0.05)  # logarithms of the temperatures compared
_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTER = re.compile(r"[\W\d_]+")
_M = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 15)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions of the hashed 1- to 3-grams of a text, and their counts."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "ignore"), dtype=np.uint32).astype(np.uint64)
    if not len(chars):
        return np.zeros(0, np.int64), np.zeros(0)
    one = (chars + np.uint64(1)) * _M
    grams = [one]
    if len(chars) > 1:
        grams.append((chars[:-1] * np.uint64(0x10001) + chars[1:] + np.uint64(7)) * _M * _M)
    if len(chars) > 2:
        grams.append(((chars[:-2] * np.uint64(0x10001) + chars[1:-1]) * np.uint64(0x10003) + chars[2:] + np.uint64(13)) * _M)
    dims = (np.concatenate([(g ^ (g >> np.uint64(29))) * _M for g in grams]) >> _SHIFT).astype(np.int64)
    if len(dims) > DIMS // 4:
        dense = np.bincount(dims, minlength=DIMS)
        at = np.flatnonzero(dense)
        return at, dense[at].astype(float)
    at, counts = np.unique(dims, return_counts=True)
    return at, counts.astype(float)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = gram_counts(text)
    value = counts * idf[at]
    norm = float(np.sqrt((value * value).sum()))
    return at, value / norm if norm else value


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many rows hold each dimension, over all rows: one partial sum per task, added up by Spark.

    The result has DIMS entries whatever the input.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(DIMS + 1, dtype=np.int64), 0
        for frame in frames:
            for text in frame["text"]:
                total[gram_counts(text)[0]] += 1
            rows += len(frame)
        total[DIMS] = rows
        at = np.flatnonzero(total)
        yield pd.DataFrame({"dim": at, "n": total[at]})

    out, rows = np.zeros(DIMS), 0
    for r in texts.mapInPandas(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        if r["dim"] == DIMS:
            rows = r["n"]
        else:
            out[r["dim"]] = r["n"]
    return out, rows


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, seed: int = 5) -> np.ndarray:
    """FTRL-proximal for the softmax loss; L1 gives exact zeros, L2 shrinks the rest. (classes, DIMS + 1) weights."""
    z = np.zeros((DIMS + 1, classes))
    n = np.zeros((DIMS + 1, classes))
    order = np.random.default_rng(seed)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            at, value = np.append(at, DIMS), np.append(value, 1.0)
            w = weights(at)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(DIMS + 1)).T.copy()


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that minimises the held-back log loss (golden section on its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    low, high, ratio = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    for _ in range(40):
        if loss(a) < loss(b):
            high, b = b, a
            a = high - ratio * (high - low)
        else:
            low, a = a, b
            b = low + ratio * (high - low)
    return float(np.exp((low + high) / 2))


def gathered(drawn: DataFrame, label_col: str, label_type: str, idf: np.ndarray) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
    """Labels and vectors of a bounded sample with ``text``, as packed bytes, in an order that reruns keep."""
    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [vector(t, idf) for t in frame["text"]]
            yield pd.DataFrame({"label": frame[label_col], "at": [a.astype(np.int32).tobytes() for a, _ in found],
                                "value": [v.astype(np.float32).tobytes() for _, v in found]})

    rows = drawn.select(label_col, "text").mapInPandas(features, f"label {label_type}, at binary, value binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["value"])))
    return [r["label"] for r in rows], [(np.frombuffer(r["at"], dtype=np.int32), np.frombuffer(r["value"], dtype=np.float32)) for r in rows]


def held_back(at: np.ndarray, value: np.ndarray) -> bool:
    """The fifth of the sampled texts that fits the temperature; copies of a text have one vector and one side."""
    return zlib.crc32(at.astype(np.int32).tobytes() + value.astype(np.float32).tobytes()) % 5 == 0


def sample_rows(rows: DataFrame, per_lang: int, most_langs: int) -> DataFrame:
    """lang, text: the ``per_lang`` distinct texts with the smallest hash of each of the most frequent languages.

    Copies are combined per task before the shuffle; ranks within a 64th of the
    hashes come first, so that no task orders all texts of a language.
    """
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).select("lang")
    hashed = rows.select("lang", F.xxhash64("text").alias("_h"))
    parts = hashed.join(F.broadcast(langs), "lang").groupBy("lang", "_h").agg(F.pmod("_h", F.lit(64)).alias("_p"))
    for keys in (["lang", "_p"], ["lang"]):
        parts = parts.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_i") <= per_lang)
    chosen = F.broadcast(parts.select("lang", "_h"))
    return rows.withColumn("_h", F.xxhash64("text")).join(chosen, ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text")).drop("_h")


def training_rows(docs: DataFrame, training: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """text, lang, _h (hash of the text) of the labelled rows for which ``training`` holds."""
    rows = docs.where(training) if training is not None else docs
    rows = narrow(rows, text=text_col, lang=lang_col).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("_h", F.xxhash64("text"))


def _once_per_task(most: int = 1 << 20):
    """A task's rows without the copies it has seen of (lang, _h); so a large group of copies does not travel."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            if len(seen) > most:
                seen.clear()
            fresh = []
            for key in zip(batch.column("lang").to_pylist(), batch.column("_h").to_pylist()):
                fresh.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(fresh, pa.bool_()))
    return run


def _fit_shard(names: list[str], shared):
    """Of the texts of one shard, sorted so that copies are neighbours: blocks of weights times the texts of the language, in whole steps."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, number, last = shared.value, {x: i for i, x in enumerate(names)}, None
        rows, labels, shard = [], [], 0
        for frame in frames:
            for lang, text, shard in zip(frame["lang"], frame["text"], frame["_shard"]):
                if (lang, text) != last:
                    at, value = vector(text, idf)
                    rows.append((at.astype(np.int32), value.astype(np.float32)))
                    labels.append(number[lang])
                    last = (lang, text)
        if not rows:
            return
        steps = np.rint(ftrl(rows, np.array(labels), len(names)) * _STEP).astype(np.int64)
        for i, n in zip(*np.unique(labels, return_counts=True)):
            blocks = np.array_split(steps[i] * n, range(_BLOCK, DIMS + 1, _BLOCK))
            yield pd.DataFrame({"label": i, "block": range(len(blocks)), "part": shard, "n": n, "sums": [x.tobytes() for x in blocks]})
    return run


_SUMS = "label int, block int, part int, n long, sums binary"


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype=np.int64) for x in frame["sums"])
    return frame.iloc[:1].assign(n=frame["n"].sum(), sums=[total.tobytes()])


def averaged_weights(rows: DataFrame, names: list[str], copies: DataFrame, shards: int, idf: np.ndarray) -> np.ndarray:
    """(languages, DIMS + 1) weights of ``rows`` (lang, text, _h), each fitted in as many shards as ``copies`` (lang, n_copies) says."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)
    once = rows.select("lang", "text", "_h").mapInArrow(_once_per_task(), "lang string, text string, _h long")
    first = F.pmod(F.xxhash64(F.lit("shard"), F.col("text")), F.lit(shards))
    places = F.transform(F.sequence(F.lit(0), F.col("n_copies") - 1), lambda j: F.pmod(first + j * F.floor(F.lit(shards) / F.col("n_copies")), F.lit(shards)).cast("int"))
    dealt = once.join(F.broadcast(copies), "lang").select("lang", "text", "_h", F.explode(places).alias("_shard"))
    dealt = dealt.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_h", "lang", "text")
    sums = dealt.select("lang", "text", "_shard").mapInPandas(_fit_shard(names, shared), _SUMS)
    while shards > 1:  # no group adds up more than _FAN parts
        sums = sums.withColumn("part", F.floor(F.col("part") / _FAN).cast("int")).groupBy("label", "block", "part").applyInPandas(_add_up, _SUMS)
        shards = -(-shards // _FAN)
    weights = np.zeros((len(names), DIMS + 1))
    for r in sums.collect():
        part = np.frombuffer(r["sums"], dtype=np.int64) / (float(r["n"]) * _STEP)
        weights[r["label"], r["block"] * _BLOCK:r["block"] * _BLOCK + len(part)] = part
    return weights


def _best_temperature(held: DataFrame, model: dict) -> float:
    """``temperature`` of all texts of ``held``: the log losses at the grid's temperatures are summed, a parabola gives the least."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        number, total = {x: i for i, x in enumerate(m["langs"])}, np.zeros(len(_GRID))
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                at, value = vector(text, m["idf"])
                s = m["weights"][:, at] @ value + m["weights"][:, DIMS]
                s = (s - s.max())[:, None] / np.exp(_GRID)
                total += np.log(np.exp(s).sum(axis=0)) - s[number[lang]]
        yield pd.DataFrame({"at": range(len(_GRID)), "loss": np.rint(total * _STEP).astype(np.int64)})

    found = held.select("lang", "text").mapInPandas(run, "at int, loss long").groupBy("at").agg(F.sum("loss").alias("loss")).collect()
    loss = np.zeros(len(_GRID))
    for r in found:
        loss[r["at"]] = r["loss"]
    if not loss.any():
        return 1.0
    i = int(np.clip(loss.argmin(), 1, len(_GRID) - 2))
    bend = loss[i - 1] - 2 * loss[i] + loss[i + 1]
    shift = (loss[i - 1] - loss[i + 1]) / (2 * bend) if bend > 0 else 0.0
    return float(np.exp(_GRID[i] + np.clip(shift, -1, 1) * (_GRID[1] - _GRID[0])))


def fit(rows: DataFrame) -> tuple[dict, DataFrame]:
    """The model of ``training_rows``, and the distinct texts held back from its weights (lang, text)."""
    spark = rows.sparkSession
    back = F.pmod("_h", F.lit(5)) == 0
    df, total = _document_frequencies(rows.select("text"))
    idf = np.log((total + 1) / (df + 1)) + 1.0
    distinct = rows.groupBy("lang", "_h").agg(F.max(F.octet_length("text")).alias("bytes"))
    langs = distinct.groupBy("lang").agg(F.count("*").alias("n"), F.sum(back.cast("long")).alias("n_back"), F.sum(F.when(~back, F.col("bytes"))).alias("bytes")).collect()
    langs.sort(key=lambda r: r["lang"])
    names = [r["lang"] for r in langs]
    if len(names) < 2:
        return {"langs": names, "idf": idf, "weights": np.zeros((len(names), DIMS + 1)), "temperature": 1.0}, rows.where(back).select("lang", "text")
    shards = max(1, -(-sum(r["bytes"] or 0 for r in langs) // SHARD))
    least = shards * max(1, 400 // len(names))  # texts of a language over all shards
    fitted = [(r["n"] - r["n_back"]) or r["n"] for r in langs]
    table = [(r["lang"], r["n"] == r["n_back"], min(shards, max(1, -(-least // n)))) for r, n in zip(langs, fitted)]
    known = spark.createDataFrame(table, "lang string, all_back boolean, n_copies int")
    marked = rows.join(F.broadcast(known.select("lang", "all_back")), "lang")
    weights = averaged_weights(marked.where(~back | F.col("all_back")), names, known.select("lang", "n_copies"), shards, idf)
    held = materialize(marked.where(back & ~F.col("all_back")).dropDuplicates(["lang", "_h"]).select("lang", "text"))
    model = {"langs": names, "idf": idf, "weights": weights, "temperature": 1.0}
    return model | {"temperature": _best_temperature(held, model)}, held


def train(docs: DataFrame, training: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> dict:
    """idf, weights, temperature and languages, learned from all rows for which ``training`` holds."""
    return fit(training_rows(docs, training, text_col, lang_col))[0]


def classify(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    langs, idf, weights, t = model["langs"], model["idf"], model["weights"], model["temperature"]
    names, scores = [], []
    for text in texts:
        if not langs or text is None or not _LETTER.search(text):
            names.append("und")
            scores.append(0.0)
            continue
        at, value = vector(text, idf)
        s = (weights[:, at] @ value + weights[:, DIMS]) / t
        p = np.exp(s - s.max())
        p /= p.sum()
        best = int(p.argmax())
        names.append(langs[best])
        scores.append(float(p[best]))
    return names, scores


def predict(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with lang_pred and score; ``keep`` may be all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def label(text: pd.Series) -> pd.DataFrame:
        names, scores = classify([None if x is None or x is pd.NA else x for x in text], shared.value)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    found = docs.select(F.struct(*keep).alias("_row"), label(F.col(text_col).cast("string")).alias("_p"))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in keep], "_p.lang_pred", "_p.score")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32(id as text) mod 4 is 2 (a null id trains)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    base = narrow(docs, doc_id="doc_id", text="text", lang="lang")
    model = train(base, ~held_out())
    return predict(base.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


# Bounds are told apart by the length of the text: the edges of the classes, and the lengths of the pieces that stand for short texts.
_EDGES, _PIECES = [8, 32, 128, 512], (5, 16, 64, 256, 600)
_ENOUGH = 20


def measures(text: str, model: dict) -> tuple[int, int, float, float]:
    """Of the letters of a text: best language (its number), length class, calibrated log-odds of it to the second, mean idf of the grams.

    Digits and marks count as a space. The score alone would not do: random
    letters or code may lean to some language by a single gram, and calibration
    stretches that to a score of 1. Their grams are rare in the corpus, though,
    and a text of mixed languages has far lower odds than clean ones of its length.
    """
    text = _NO_LETTER.sub(" ", text)
    at, counts = gram_counts(text)
    value = counts * model["idf"][at]
    surprise = float(value.sum() / counts.sum())
    value = value / float(np.sqrt((value * value).sum()))
    s = (model["weights"][:, at] @ value + model["weights"][:, DIMS]) / model["temperature"]
    best, size = int(s.argmax()), int(np.searchsorted(_EDGES, len(text), side="right"))
    return best, size, float(s[best] - np.delete(s, best).max()) if len(s) > 1 else 0.0, surprise


def pieces(text: str) -> list[str]:
    """The text and cuts from its start, middle and end, which stand for short texts."""
    cuts = [text[i:i + n] for n in _PIECES if n < len(text) for i in {0, (len(text) - n) // 2, len(text) - n}]
    return [x for x in [text, *cuts] if _LETTER.search(x)]


def rejection_bounds(held: DataFrame, model: dict) -> dict:
    """(language or None, length class) -> least log-odds and greatest mean idf of an accepted text.

    By grouped percentiles over all held-back texts (lang, text), and pieces of
    them, that the model tells correctly: 0.35 of the lower decile of the
    log-odds, and the upper decile of the mean idf and 1.5 times its distance
    from the median (at least a tenth of that). So nearly all clean texts stay,
    and junk under a label among less than a tenth of its rows moves no bound far. A
    class with fewer than 20 pieces of a language takes the bound of all
    languages (None), with fewer than 20 of all that of the next shorter class,
    and without a shorter one it has no bound. The measures are counted by
    thousandths first, so that a group's percentiles hold few values.
    """
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            out = []
            for lang, text in zip(frame["lang"], frame["text"]):
                for best, size, odds, surprise in (measures(x, m) for x in pieces(text)):
                    if m["langs"][best] == lang:
                        out += [(lang, size, "odds", round(odds, 3)), (lang, size, "surprise", round(surprise, 3))]
            yield pd.DataFrame(out, columns=["lang", "size", "kind", "value"])

    told = held.select("lang", "text").mapInPandas(run, "lang string, size int, kind string, value double")
    each = told.groupBy("lang", "size", "kind", "value").agg(F.count("*").alias("n"))
    both = each.select(F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))).alias("lang"), "size", "kind", "value", "n")
    rows = (both.groupBy("lang", "size", "kind", "value").agg(F.sum("n").alias("n")).groupBy("lang", "size", "kind")
            .agg(F.sum("n").alias("n"), F.expr("percentile(value, array(0.1, 0.5, 0.9), n)").alias("p")).collect())
    found = {(r["lang"], r["size"], r["kind"]): r["p"] for r in rows if r["n"] >= _ENOUGH}
    out = {}
    for lang, size in {k[:2] for k in found}:
        _, mid, high = found[lang, size, "surprise"]
        out[lang, size] = (0.35 * found[lang, size, "odds"][0], high + 1.5 * max(high - mid, 0.1 * mid))
    return out


def accepted(text: str | None, model: dict, bounds: dict) -> bool:
    """Whether the model can place the text."""
    if not model["langs"] or text is None or not _LETTER.search(text):
        return False
    best, size, odds, surprise = measures(text, model)
    keys = ((lang, k) for k in range(size, -1, -1) for lang in (model["langs"][best], None))
    least, most = next((bounds[k] for k in keys if k in bounds), (-np.inf, np.inf))
    return odds >= least and surprise <= most


def drop_rejected(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """``docs`` without the texts that the model cannot place.

    These have no letter, or are beyond the bounds of their language and length
    (``rejection_bounds``), or have a calibrated score below ``min_score``.
    """
    model, held = fit(training_rows(docs, ~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast((model, rejection_bounds(held, model)))

    @F.pandas_udf("boolean")
    def stays(text: pd.Series) -> pd.Series:
        fitted, bounds = shared.value
        return pd.Series([accepted(None if x is pd.NA else x, fitted, bounds) and
                          (min_score <= 0 or classify([x], fitted)[1][0] >= min_score) for x in text], dtype=bool)

    # packed, so that no column of docs can clash with the decision
    packed = docs.select(F.struct("*").alias("_row"), stays(F.col("text").cast("string")).alias("_stays"))
    return packed.where("_stays").select("_row.*")
