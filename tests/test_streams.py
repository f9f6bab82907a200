"""Stream results equal batch results; first-wins and closing rows hold across micro-batches."""

import os

import pytest
from pyspark.sql import functions as F

from moodspark.catalog import FIXTURE_LEXICON
from moodspark.operators import lyrics as ly
from moodspark.session import ship_package
from moodspark.streaming import streams as st

PAGES = "page_id long, title string, url string"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_package(spark)


def _arrive(spark, rows, schema, directory, number, files=2):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(os.path.join(directory, f"arrival-{number}"))
    return st.file_stream(spark, directory, schema)


def _dedupe_all(spark, batches, tmpdir_, **options):
    src, sink, ckpt = (os.path.join(tmpdir_, x) for x in ("in", "sink", "ckpt"))
    runs = [st.dedupe_stream(_arrive(spark, rows, PAGES, src, i), ["title"], "page_id", ["url"], sink, ckpt, **options) for i, rows in enumerate(batches)]
    return {r["title"]: (r["page_id"], r["url"]) for r in spark.read.parquet(sink).collect()}, runs, spark.read.parquet(sink).count()


def test_dedupe_stream_first_wins_across_batches(spark, tmpdir_):
    batches = [[(3, "a", "u3"), (5, "b", "u5"), (4, "b", "u4")], [(1, "a", "u1"), (7, "c", "u7")], [(2, "c", "u2"), (9, "d", "u9")]]
    got, _, n = _dedupe_all(spark, batches, tmpdir_)
    # "a" arrived first as page 3 (batch 0), so the later page 1 loses: first wins by arrival
    assert got == {"a": (3, "u3"), "b": (4, "u4"), "c": (7, "u7"), "d": (9, "u9")} and n == 4


def test_keys_expire(spark, tmpdir_):
    import time
    batches = [[(3, "a", "u3")], [(1, "a", "u1"), (5, "b", "u5")]]
    src, sink, ckpt = (os.path.join(tmpdir_, x) for x in ("in", "sink", "ckpt"))
    for i, rows in enumerate(batches):
        st.dedupe_stream(_arrive(spark, rows, PAGES, src, i), ["title"], "page_id", ["url"], sink, ckpt, expire_ms=3_600_000)
    assert sorted(r["page_id"] for r in spark.read.parquet(sink).collect()) == [3, 5]
    sink, ckpt, src = (os.path.join(tmpdir_, x) for x in ("sink2", "ckpt2", "in2"))
    for i, rows in enumerate([batches[0], [(8, "c", "u8")], [(9, "a", "u9")]]):
        st.dedupe_stream(_arrive(spark, rows, PAGES, src, i), ["title"], "page_id", ["url"], sink, ckpt, expire_ms=1)
        time.sleep(0.1)
    # forgotten in the batch after it expired, so it counts as new in the next
    assert sorted(r["page_id"] for r in spark.read.parquet(sink).collect()) == [3, 8, 9]


def test_dedupe_keeps_null_places_and_keys(spark, tmpdir_):
    batches = [[(None, "a", "x"), (2, "a", "y"), (None, "b", "z")], [(1, None, "n"), (0, "b", "later")], [(0, None, "m")]]
    got, _, n = _dedupe_all(spark, batches, tmpdir_)
    assert got == {"a": (2, "y"), "b": (None, "z"), None: (1, "n")} and n == 3


def test_a_hot_key_reaches_its_group_combined(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}", "u") for i in range(3000)]
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    combined = df.mapInPandas(st._first_per_key(["title"], "page_id"), PAGES).collect()
    assert sum(r["title"] == "hot" for r in combined) <= 4 and min(r["page_id"] for r in combined if r["title"] == "hot") == 1
    few = df.mapInPandas(st._first_per_key(["title"], "page_id", most=50), PAGES)
    assert {r["title"]: r["p"] for r in few.groupBy("title").agg(F.min("page_id").alias("p")).collect()} == \
        {r["title"]: r["p"] for r in df.groupBy("title").agg(F.min("page_id").alias("p")).collect()}


def test_reads_of_a_batch_are_bounded_by_the_batch(spark, tmpdir_):
    """Twenty batches of equally many keys: the state grows, what a batch looks up and writes doesn't."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        batches = [[(1000 * i + j, f"title {1000 * i + j if j % 2 else j}", "u") for j in range(60)] for i in range(20)]
        got, runs, n = _dedupe_all(spark, batches, tmpdir_)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert n == len(got) == 30 * 20 + 30
    seen = []
    for run in runs:
        operators = [p["stateOperators"][0] for p in run.recentProgress if p["stateOperators"] and p["numInputRows"]]
        assert len(operators) == 1
        own = operators[0]["customMetrics"]
        assert "rocksdbGetCount" in own  # the state is in RocksDB
        seen.append((operators[0]["numRowsTotal"], own["rocksdbGetCount"], own["rocksdbTotalBytesRead"], own["rocksdbTotalBytesWritten"]))
    assert [s[0] for s in seen] == [60 + 30 * i for i in range(20)]
    assert max(s[1] for s in seen) <= 6 * 60
    per_key = max(s[2] + s[3] for s in seen[:5]) / 60
    assert all(s[2] + s[3] <= 2 * 60 * per_key for s in seen[5:])


def _scorer(df):
    return ly.score_lines(df, FIXTURE_LEXICON, ["conv_id", "turn"], 15, "text", keep_unscored=True).select("conv_id", "turn", "pred")


def test_score_stream_equals_batch(spark, tmpdir_):
    rows = [(1, 0, "user", "the the of"), (1, 1, "user", "and"), (2, 0, "user", "la la le le le"), (3, 0, "user", "xyz")]
    sink, ckpt = os.path.join(tmpdir_, "sink"), os.path.join(tmpdir_, "ckpt")
    st.score_stream(_arrive(spark, rows, TURNS, os.path.join(tmpdir_, "in"), 0), _scorer, sink, ckpt, ["conv_id"], "turn")
    got = spark.read.parquet(sink).drop("batch_id").collect()
    assert sorted(got) == sorted(_scorer(spark.createDataFrame(rows, TURNS)).collect())
    assert {(r["conv_id"], r["turn"]): r["pred"] for r in got} == {(1, 0): 0, (1, 1): 2, (2, 0): 7, (3, 0): None}


def test_a_conversation_stays_closed(spark, tmpdir_):
    """Rows after the closing row go unscored, in its batch and in all later ones; other conversations go on."""
    batches = [
        [(1, 0, "user", "the"), (1, 1, "user", "0"), (1, 2, "user", "of"), (2, 0, "user", "of"), (3, 5, "user", "0"), (None, 0, "user", "and")],
        [(1, 3, "user", "in"), (2, 1, "user", "in"), (3, 4, "user", "that"), (3, 6, "user", "de"), (None, 1, "user", "0")],
        [(2, 2, "user", "0"), (2, 3, "user", "the"), (1, 4, "user", "0"), (4, None, "user", "the"), (None, 2, "user", "the")],
    ]
    sink, ckpt, src = (os.path.join(tmpdir_, x) for x in ("sink", "ckpt", "in"))
    for i, rows in enumerate(batches):
        st.score_stream(_arrive(spark, rows, TURNS, src, i), lambda df: df.select("conv_id", "turn", "text"), sink, ckpt, ["conv_id"], "turn",
                        F.col("text") == "0")
    got = {(r["conv_id"], r["turn"]) for r in spark.read.parquet(sink).collect()}
    assert got == {(1, 0), (2, 0), (None, 0), (2, 1), (3, 4), (4, None)}


def test_a_hot_conversation_is_dealt_over_groups(spark, tmpdir_):
    rows = [(1, i, "user", "0" if i == 700 else "word") for i in range(1000)]
    sink, ckpt, src = (os.path.join(tmpdir_, x) for x in ("sink", "ckpt", "in"))
    run = st.score_stream(_arrive(spark, rows, TURNS, src, 0), lambda df: df, sink, ckpt, ["conv_id"], "turn", F.col("text") == "0")
    assert sorted(r["turn"] for r in spark.read.parquet(sink).collect()) == list(range(700))
    state = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(state) == 8  # the closing row, once per group


def test_callers_settings_stay(spark, tmpdir_):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    st.state_session(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_closing_places_need_no_call_per_conversation(spark, tmpdir_):
    """The state of many short conversations is one grouped minimum, a row each; rows without a place stay, closing rows without one close nothing."""
    first = [(c, float(t), "user", "word") for c in range(50) for t in range(4)] + [(50, None, "user", "0"), (50, float("nan"), "user", "0"), (50, 1.0, "user", "word")]
    second = [(c, 2.0, "user", "0") for c in range(0, 50, 2)] + [(c, t, "user", "late") for c in range(50) for t in (5.0, None, float("nan"))]
    schema = "conv_id long, turn double, role string, text string"
    sink, ckpt, src = (os.path.join(tmpdir_, x) for x in ("sink", "ckpt", "in"))
    for i, rows in enumerate([first, second]):
        run = st.score_stream(_arrive(spark, rows, schema, src, i), lambda df: df, sink, ckpt, ["conv_id"], "turn", F.col("text") == "0")
        states = [p["stateOperators"][0] for p in run.recentProgress if p["stateOperators"] and p["numInputRows"]]
        assert [x["operatorName"] for x in states] == ["stateStoreSave"]
        assert i or states[0]["numRowsTotal"] <= 50 + 8
    got = sorted((r["conv_id"], str(r["turn"]), r["text"]) for r in spark.read.parquet(sink).collect())
    want = [(c, str(float(t)), "word") for c in range(50) for t in range(4)] + [(50, "1.0", "word")]
    want += [(c, x, "late") for c in range(50) for x in ("None", "nan", "5.0") if x != "5.0" or c % 2]
    assert got == sorted(want)
