"""Argmax, linear head and exact cosine top-k against brute force."""

import numpy as np
from pyspark.sql import functions as F

from moodspark.operators import recommend as rc
from moodspark.operators import scoring as sc


def test_argmax_first_on_ties_and_nulls(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([None, 2.0, 1.0],), ([0.0, 0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(sc.argmax(F.col("v"))).collect()]
    assert got == [1, 1, 0]


def _brute(vecs, k, exclude_self=True):
    out = {}
    for q, qv in vecs.items():
        cands = []
        for i, iv in vecs.items():
            if exclude_self and i == q:
                continue
            a, b = np.asarray(qv, float), np.asarray(iv, float)
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            if na == 0 or nb == 0:
                continue
            cands.append((-round(float(a @ b / (na * nb)), 9), i))
        out[q] = [i for _, i in sorted(cands)[:k]]
    return out


def test_cosine_topk_exact_with_ties_and_zero(spark):
    rng = np.random.default_rng(7)
    vecs = {i: [float(v) for v in rng.integers(-2, 3, size=4)] for i in range(40)}
    vecs[40] = [0.0, 0.0, 0.0, 0.0]  # cosine undefined -> no pairs
    vecs[41] = list(vecs[3])         # exact tie with 3
    df = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<double>").repartition(3)
    exp = _brute(vecs, 3)
    for block in (1000, 7, 1):
        got = {}
        for r in rc.cosine_topk(df, df, 3, exclude_self=True, block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
        got = {q: [i for _, i in sorted(v)] for q, v in got.items()}
        assert got == {q: v for q, v in exp.items() if v}


def test_model_scorer_matches_builtin_scorer(spark):
    from moodspark.catalog import FIXTURE_LEXICON
    from moodspark.operators import lyrics as ly
    rows = [(1, "The the of"), (2, "la la le le le"), (3, "xyz"), (4, "und, und. der!")]
    df = spark.createDataFrame(rows, "id long, line string").repartition(2)
    got = {r["id"]: r["pred"] for r in sc.model_scorer(df, "line", "lexicon", sc.LexiconModel, ["id"]).collect()}
    exp = {r["id"]: r["pred"] for r in ly.score_lines(df, FIXTURE_LEXICON, ["id"], keep_unscored=True).collect()}
    assert got == exp == {1: 0, 2: 7, 3: None, 4: 11}


def test_equal_vectors_leave_k_rows_each(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id long, embedding array<double>")
    rows = rc.cosine_topk(df, df, 5, exclude_self=True, block=16).collect()
    assert len(rows) == 1000
    for q in (0, 7, 199):
        got = [r["item_id"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == [i for i in range(7) if i != q][:5]


def test_mixed_lengths_fail(spark):
    import pytest
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    for block in (1, 100):
        with pytest.raises(Exception, match="different lengths"):
            rc.cosine_topk(df, df, 2, block=block).collect()
    labelled = df.withColumn("label", F.lit(1))
    with pytest.raises(Exception, match="different lengths"):
        sc.class_mean_head(labelled, "embedding", "label").collect()


def test_class_mean_head_is_the_nearest_mean(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 5)), rng.integers(0, 4, 60)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(60)], "id int, v array<double>, label int")
    got = {r["id"]: r["pred"] for r in sc.head_predictions(df, sc.class_mean_head(df, "v", "label"), "v").collect()}
    means = np.stack([x[y == c].mean(axis=0) for c in range(4)])
    assert got == {i: int(np.argmin(((means - x[i]) ** 2).sum(axis=1))) for i in range(60)}


def test_lexicon_of_any_size(spark):
    from moodspark.operators import lyrics as ly
    words = spark.range(60_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), (F.col("id") % 15).cast("int").alias("cls"))
    df = spark.createDataFrame([(1, "w59999 w3 W3."), (2, "none")], "id long, line string")
    got = {r["id"]: r["pred"] for r in ly.score_lines(df, words, ["id"], keep_unscored=True).collect()}
    assert got == {1: 3, 2: None}


def _parts_of(df):
    import pandas as pd

    def count(frames):
        n = sum(len(f) for f in frames)
        yield pd.DataFrame({"n": [n]})
    return [r["n"] for r in df.mapInPandas(count, "n long").collect()]


def test_one_query_meets_many_items_in_many_tasks(spark, monkeypatch):
    """The cells of one query group are as many as there are item slices; each leaves at most k rows."""
    from moodspark.operators import cells
    rng = np.random.default_rng(11)
    vecs = {i: [float(v) for v in rng.normal(size=8)] for i in range(3000)}
    items = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<double>").repartition(4)
    seen, real = {}, cells.deal

    def spy(groups, blocks, slices, n_groups, **kw):
        rows = real(groups, blocks, slices, n_groups, **kw)
        seen.update(slices=slices, n_groups=n_groups, rows=rows)
        return rows
    monkeypatch.setattr(cells, "deal", spy)
    got = rc.cosine_topk(items.where("vec_id = 7"), items, 5, exclude_self=True, block=100)
    found = [r["item_id"] for r in sorted(got.collect(), key=lambda r: r["rank"])]
    assert found == _brute({i: v for i, v in vecs.items()}, 5)[7]
    assert seen["n_groups"] == 1 and seen["slices"] >= cells.tasks(spark) == 4
    dealt = seen["rows"].groupBy("slice").agg(F.count(F.when(F.col("kind") == 1, 1)).alias("b"), F.count(F.when(F.col("kind") == 0, 1)).alias("q")).collect()
    assert len(dealt) == seen["slices"] and all(r["q"] == 1 for r in dealt)
    assert sum(n > 0 for n in _parts_of(seen["rows"])) == seen["slices"]


def test_items_are_copied_per_group_not_per_block(spark, monkeypatch):
    from moodspark.operators import cells
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(600)], "vec_id long, embedding array<double>")
    seen, real = [], cells.deal
    monkeypatch.setattr(cells, "deal", lambda g, b, s, n, **kw: seen.append((b.count(), n, real(g, b, s, n, **kw))) or seen[-1][2])
    rc.cosine_topk(df, df, 3, block=50, group=200).collect()
    blocks, groups, rows = seen[0]
    assert groups == 3 and rows.where("kind = 1").count() == blocks * groups


def test_blocks_beyond_the_bound_are_skipped(spark, monkeypatch):
    """Tight clusters: a query opens its own cluster's block and no other once it has its k items."""
    rng = np.random.default_rng(13)
    centres = np.eye(6) * 10
    rows = [(i, [float(v) for v in centres[i % 6] + rng.normal(scale=0.05, size=6)]) for i in range(600)]
    items = [pd_row for pd_row in rows]
    import pandas as pd
    frames = []
    for c in range(6):
        own = [r for r in items if r[0] % 6 == c]
        f = rc._pack(pd.DataFrame({"id": [r[0] for r in own], "vec": [r[1] for r in own], "pivot": c, "blk": 0}))
        frames.append(f.assign(grp=0, slice=0, kind=1))
    query = rc._pack(pd.DataFrame({"id": [10_000], "vec": [list(centres[0])], "pivot": 0, "blk": 0})).assign(grp=0, slice=0, kind=0)
    products, real = [], rc.best_of
    monkeypatch.setattr(rc, "best_of", lambda *a: products.append(a[0].shape) or real(*a))
    out = pd.concat(list(rc._stream(5, True)(iter([pd.concat([query, *frames])]))))
    assert len(out) == 5 and (out["item_id"] % 6 == 0).all()
    assert sum(shape[1] == 100 for shape in products) == 1


def test_repeated_query_ids_keep_their_own_results(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    twice = spark.createDataFrame([(1, [0.0, 1.0]), (1, [9.0, 1.0])], "vec_id long, embedding array<double>")
    got = rc.cosine_topk(twice, df, 2).collect()
    assert sorted((r["rank"], r["item_id"]) for r in got) == [(1, 0), (1, 9), (2, 1), (2, 8)]


def test_fitted_text_head_is_the_nearest_mean(spark):
    """Grouped sums equal plain counting; the model predicts the nearest class mean, NULL texts nothing."""
    import hashlib
    import random
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "of", "la", "le", "und", "Der!", "x%d" % (i % 7)]) for _ in range(rng.randint(0, 9))), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, line string, label int").repartition(3)
    means = sc.fit_text_head(df, "line", "label", buckets=16)
    vec = lambda t: np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in t.replace("!", " ").lower().split()] or [0],
                                minlength=16) * bool(t.split())
    want = {k: np.mean([vec(t) for _, t, la in rows if la == k], axis=0) for k in range(3)}
    assert sorted(means) == [0, 1, 2] and all(np.allclose(means[k], want[k]) for k in want)
    scored = sc.model_scorer(df.unionAll(spark.createDataFrame([(900, None, 0)], df.schema)), "line", "head-test", lambda: sc.TextHead(means), ["id"])
    got = {r["id"]: r["pred"] for r in scored.collect()}
    assert got.pop(900) is None
    assert got == {i: int(np.argmin([((vec(t) - want[k]) ** 2).sum() for k in range(3)])) for i, t, _ in rows}
