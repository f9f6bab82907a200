"""Distributed order operators equal their single-partition definitions."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from moodspark.operators.ordering import global_index, running_total


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_global_index_equals_row_number(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, id int").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r["k"], r["id"]): r["row_idx"] for r in global_index(df, ["k", "id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = {key: i for i, key in enumerate(sorted((k, i) for k, i in rows))}
    assert got == expected


def test_running_total_matches_cumsum(spark):
    vals = [(i, float(i % 7) / 3) for i in range(300)]
    df = spark.createDataFrame(vals, "b long, v double")
    got = running_total(df, "b", ["v"], block=16).orderBy("b").toPandas()
    exp = pd.Series([v for _, v in vals]).cumsum()
    assert (got["v_cum"] - exp).abs().max() < 1e-9


def test_window_definition_agrees(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    ref = df.withColumn("r", F.row_number().over(Window.orderBy("k")) - 1)
    ours = global_index(df, ["k"], "r")
    assert sorted(ref.collect()) == sorted(ours.select("k", "v", "r").collect())


def test_index_keeps_other_columns(spark):
    rows = [(i % 13, None if i == 5 else i, "text " * i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, id int, text string").repartition(5)
    ours = global_index(df, ["k", F.col("id").asc_nulls_first()])
    got = {(r["k"], r["id"]): (r["row_idx"], r["text"]) for r in ours.collect()}
    ordered = sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1]))
    assert got == {(k, i): (n, t) for n, (k, i, t) in enumerate(ordered)}


def test_running_total_over_several_levels(spark):
    df = spark.range(0, 900).select(F.col("id").alias("b"), (F.col("id") % 5).alias("v"))
    for levels in (0, 1, 3):
        got = [r["v_cum"] for r in running_total(df, "b", ["v"], block=4, levels=levels).orderBy("b").collect()]
        assert got == pd.Series([i % 5 for i in range(900)]).cumsum().tolist()


def test_repeated_keys_are_numbered_not_multiplied(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "c"), (2, "d")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    got = global_index(df, [F.col("k").asc_nulls_last()]).collect()
    assert sorted(r["row_idx"] for r in got) == list(range(6))
    assert sorted((str(r["k"]), r["t"]) for r in got) == sorted((str(k), t) for k, t in rows)
    assert [r["k"] for r in sorted(got, key=lambda r: r["row_idx"])] == [1, 1, 1, 2, None, None]


def _scans(run, marks=("conversations.parquet", "documents.parquet")):
    """How many scans with one of ``marks`` the plans hold that ``run`` writes, and its result."""
    from moodspark import session
    from moodspark.operators import evaluation, ordering
    from moodspark.plans import q_eval
    plans, real = [], session.written

    def spy(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)
    places = [m for m in (ordering, evaluation, q_eval)]
    for m in places:
        m.written = spy
    try:
        out = run()
        plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    finally:
        for m in places:
            m.written = real
    return [(name, sum(m in line for line in plan.splitlines() for m in marks)) for name, plan in plans]


def test_the_corpus_is_encoded_once(spark):
    """One plan reads the tables for the rows (and one for the vocabulary); models, batches and reports read what it wrote."""
    from moodspark.plans.registry import queries
    sf = "/root/testdata/sf0.001"
    for name in ("batch_collate", "accuracy_masked", "loss_masked_mean"):
        scans = _scans(lambda: queries()[name](spark, sf))
        reading = [n for _, n in scans if n]
        assert len(reading) == 2 and scans[-1] == ("result", 0), (name, scans)


def test_the_input_of_an_index_is_scanned_once(spark, tmpdir_):
    import os
    path = os.path.join(tmpdir_, "documents.parquet")
    spark.createDataFrame([(i % 7, i, "t" * i) for i in range(100)], "k int, id int, text string").write.parquet(path)
    scans = _scans(lambda: global_index(spark.read.parquet(path), ["k", "id"]), ["ReadSchema: struct<k:int,id:int,text:string>"])
    assert scans[0] == ("index", 1)
