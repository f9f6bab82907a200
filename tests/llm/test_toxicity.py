"""Toxicity: counts and ratios against plain counting, held-out accuracy, and what each odd row gets."""

import math
import random
import zlib

import numpy as np
import pytest

from moodspark.llm import toxicity as tx

RUDE = ["grobbel", "zwarnt", "plofke", "knarsch"]


def words(rng, n):
    return [rng.choice(["la", "mer", "tion", "ver", "sol", "din", "ment", "qua", "res", "per"]) + rng.choice(["ta", "ne", "ri", "so", "lu"]) for _ in range(n)]


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = words(rng, rng.choice([6, 40, 300]))
        for _ in range(max(2, len(text) // 40) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(RUDE) + rng.choice(["", "en", "st"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", "a", "x", "x") for i, t in rows], "doc_id long, text string, lang string, source string, toxic string, score string")
    marks = spark.createDataFrame([(i, t, 1, "x") for i, t in labels], "doc_id long, toxic int, quality int, text string")
    return docs.repartition(3), marks


def test_held_out_accuracy(spark):
    rows, labels = corpus(random.Random(3), 600)
    got = {r["doc_id"]: r for r in tx.toxicity(*frames(spark, rows, labels)).collect()}
    assert len(got) == 600
    truth = dict(labels)
    out = [i for i in got if got[i]["held_out"]]
    assert out and all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i]["held_out"] for i in got)
    assert np.mean([got[i]["predicted"] == truth[i] for i in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(random.Random(3), 200)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a = tx.toxicity(*frames(spark, rows, labels)).collect()
    b = tx.toxicity(*frames(spark, rows, turned)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_counts_are_those_of_distinct_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(words(rng, 5)) for _ in range(12)]
    rows = [(i, texts[i % 12]) for i in range(36)] + [(3, texts[3]), (50, "ab"), (51, "")]
    marks = [(i, int(i % 12 < 4)) for i in range(36)] + [(50, 1), (51, 0)]
    docs, labels = frames(spark, rows, marks)
    docs = docs.select("doc_id", "text")
    labels = labels.select("doc_id", "toxic")
    counts = {r["dim"]: (r["n1"], r["n0"]) for r in tx.gram_counts(docs, tx.marked_texts(docs, labels)).collect()}
    want = {-1: [5, 9]}
    for k, text in [*enumerate(texts), (0, "ab"), (11, "")]:
        for dim in {int(d) for part in tx.grams(text) for d in part}:
            want.setdefault(dim, [0, 0])[0 if k < 4 else 1] += 1
    assert counts == {d: tuple(v) for d, v in want.items()}


def test_kept_grams_have_their_naive_bayes_ratio(spark):
    rows, labels = corpus(random.Random(5), 160)
    docs, marks = frames(spark, rows, labels)
    docs, marks = docs.select("doc_id", "text"), marks.select("doc_id", "toxic")
    model = tx.train(docs, marks, features=64)
    truth = dict(labels)
    n1 = sum(truth.values())
    n0 = len(truth) - n1
    holds = {i: {int(d) for part in tx.grams(t) for d in part} for i, t in rows}
    ratios = {}
    for dim in set().union(*holds.values()):
        a = sum(dim in holds[i] for i in truth if truth[i]) + 2 * n1 / (n1 + n0)
        b = sum(dim in holds[i] for i in truth if not truth[i]) + 2 * n0 / (n1 + n0)
        r = math.log(a / b) - math.log(n1 / n0)
        if r > 0:
            ratios[dim] = (r * r / math.sqrt(1 / a + 1 / b), r)
    best = sorted(ratios, key=lambda d: (-ratios[d][0], d))[:64]
    assert set(np.flatnonzero(model["places"] >= 0)) == set(best)
    assert np.allclose([model["r"][model["places"][d]] for d in best], [ratios[d][1] for d in best])


def test_odd_rows(spark):
    rows, labels = corpus(random.Random(6), 120)
    long = " ".join(words(random.Random(1), 200_000))
    rows += [(900, None), (901, ""), (902, "ab"), (None, rows[0][1]), (None, None), rows[4], rows[4], (903, long), (904, long + " " + " ".join(RUDE * 400))]
    labels += [(None, 1), (900, None), (8, 1), (8, 0), (2 ** 62 + 1, 1)]
    got = [tuple(r) for r in tx.toxicity(*frames(spark, rows, labels)).collect()]
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r[0], set()).add(r)
    assert len(by[4]) == 1 and len({r[2] for i in (900, 901, 902) for r in by[i]}) == 1
    assert {r[2] for r in by[None]} == {next(iter(by[0]))[2], next(iter(by[900]))[2]} and not any(r[1] for r in by[None])
    assert all(r[2] < 0.5 for i in (900, 903) for r in by[i]) and all(r[2] > 0.5 for r in by[904])


@pytest.mark.parametrize("marks, score", [([], 0.5), ([(1, 1), (2, 1)], 0.75), ([(1, 0), (2, 0)], 0.25)])
def test_no_or_one_label(spark, marks, score):
    docs, labels = frames(spark, [(1, "some text"), (2, "other text"), (3, None)], marks)
    assert [round(r["score"], 9) for r in tx.toxicity(docs, labels).collect()] == [score] * 3


def test_empty_table(spark):
    docs, labels = frames(spark, [], [])
    got = tx.toxicity(docs, labels)
    assert got.collect() == [] and [t for _, t in got.dtypes] == ["bigint", "boolean", "double", "int"]


def test_windows_unite_the_grams(monkeypatch):
    text = " ".join(words(random.Random(2), 400))
    whole = {int(d) for part in tx.grams(text) for d in part}
    monkeypatch.setattr(tx, "_WINDOW", 37)
    assert {int(d) for part in tx.grams(text) for d in part} == whole


def test_logistic_regression_is_at_its_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = (x @ rng.normal(size=5) + 0.3 * rng.normal(size=200) > 0).astype(float)
    w, b = tx.ridge_logistic(x, y, penalty=1e-2, rounds=3000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs((p - y) @ x / 200 + 1e-2 * w).max() < 1e-6 and abs((p - y).mean()) < 1e-6
