"""One key holds a third of all rows: results stay exact (vs pandas)."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from moodspark.operators import dialogue as dg
from moodspark.operators import lyrics as ly
from moodspark.operators import pages as pg
from moodspark.operators.recommend import daily_counts


def _skewed(n=3000, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 200)}"
        rows.append((i, key, rnd.randint(0, 14)))
    rnd.shuffle(rows)
    return rows


def test_keep_first_and_histogram_under_skew(spark):
    rows = _skewed()
    df = spark.createDataFrame(rows, "seq int, key string, pred int").repartition(6)
    got = {r["key"]: r["seq"] for r in pg.dedupe_first(df, ["key"], "seq", ["pred"]).collect()}
    pdf = pd.DataFrame(rows, columns=["seq", "key", "pred"])
    assert got == pdf.groupby("key")["seq"].min().to_dict()
    hist = {r["key"]: [r[f"e{k}"] for k in range(15)] for r in ly.emotion_histogram(df, ["key"]).collect()}
    exp = pdf.groupby("key")["pred"].apply(lambda s: [int((s == k).sum()) for k in range(15)]).to_dict()
    assert hist == exp and sum(hist["hot"]) == 1000


def test_daily_counts_and_pairs_under_skew(spark):
    rnd = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    ev = [(0 if i % 3 == 0 else rnd.randint(1, 50), t0 + dt.timedelta(minutes=7 * i),
           rnd.choice(["click", "view", "error"])) for i in range(3000)]
    df = spark.createDataFrame(ev, "user_id long, ts timestamp_ntz, event_type string").repartition(5)
    got = {(r["user_id"], r["day"]): r["n_click"] for r in
           daily_counts(df, "user_id", "ts", "event_type", ["click", "view", "error"]).collect()}
    pdf = pd.DataFrame(ev, columns=["user_id", "ts", "event_type"])
    pdf["day"] = pdf["ts"].dt.strftime("%Y-%m-%d")
    exp = pdf.assign(c=pdf.event_type.eq("click")).groupby(["user_id", "day"])["c"].sum().to_dict()
    assert got == {k: int(v) for k, v in exp.items()}
    # one conversation holds a third of the turns; pairs stay exact
    conv = [(0 if i % 3 == 0 else 1 + i % 40, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(900)]
    cdf = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")
    pairs = {(r["conv_id"], r["turn"]) for r in dg.turn_pairs(cdf).collect()}
    by = {(c, t): r for c, t, r, _ in conv}
    exp_pairs = {(c, t) for c, t, r, _ in conv if r == "user" and by.get((c, t + 1)) == "assistant"}
    assert pairs == exp_pairs
