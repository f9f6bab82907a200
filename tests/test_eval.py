"""Accuracy reports: mean of batch means vs overall mean, running report."""

from pyspark.sql import functions as F

from moodspark.operators import evaluation as ev
from moodspark.operators import sequences as sq


def test_mean_of_batch_means_differs_from_overall(spark):
    # 7 batches of 64, the last one partial (10 rows)
    hits = [(i, 1 if (i % 3) else 0) for i in range(6 * 64 + 10)]
    df = sq.assign_batches(spark.createDataFrame(hits, "row_id int, hit int"), ["row_id"], 64)
    batches = ev.batch_means(df, "batch_id", F.col("hit"))
    m = ev.mean_of_batch_means(batches).first()
    per_batch = {}
    for i, h in hits:
        per_batch.setdefault(i // 64, []).append(h)
    means = [sum(v) / len(v) for _, v in sorted(per_batch.items())]
    assert m["n_batches"] == 7
    assert abs(m["mean_of_batches"] - sum(means) / 7) < 1e-12
    assert abs(m["overall_mean"] - sum(h for _, h in hits) / len(hits)) < 1e-12
    assert m["mean_of_batches"] != m["overall_mean"]
    run = {r["batch_id"]: r["running_mean"] for r in ev.running_batch_mean(batches, "batch_id", 2).collect()}
    assert sorted(run) == [0, 2, 4, 6]
    assert abs(run[4] - sum(means[:5]) / 5) < 1e-12


def test_grid_and_missing(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "item_id int, prompt string")
    rows = ev.expand_grid(prompts, ev.param_grid(["m"], [64, 96], [3], [1, 2]))
    rows = rows.withColumn("run_name", ev.run_name(F.col("dataset"), F.col("batch_size"), F.col("lr_factor"),
                                                   F.col("epoch")))
    assert rows.count() == 8
    listing = spark.createDataFrame([("m_batch64_lr3_epoch1",), ("m_batch96_lr3_epoch2",)], "run_name string")
    missing = sorted({r["run_name"] for r in ev.missing_runs(rows, listing).collect()})
    assert missing == ["m_batch64_lr3_epoch2", "m_batch96_lr3_epoch1"]


def test_listing_follows_the_files_written(spark, tmpdir_):
    import os
    path = os.path.join(tmpdir_, "artifacts")
    rows = spark.createDataFrame([("m_batch64_lr3_epoch1", 1), ("m_batch64_lr3_epoch1", 2), ("m_batch96_lr3_epoch2", 1)], "run_name string, item_id int")
    ev.write_artifacts(rows, path)
    assert sorted(r["run_name"] for r in ev.listed_artifacts(spark, path).collect()) == ["m_batch64_lr3_epoch1", "m_batch96_lr3_epoch2"]


def test_copies_are_on_one_side(spark):
    rows = [(i, f"text {i % 200}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("split", ev.content_split(F.col("text")))
    sides = {}
    for r in df.collect():
        sides.setdefault(r["text"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values())
    share = sum(s == {1} for s in sides.values()) / len(sides)
    assert 0.1 < share < 0.3


def test_split_batches_count_each_side_from_zero(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(50)], "id int, split int").repartition(3)
    got = {(r["split"], r["id"]): r["batch_id"] for r in ev.split_batches(df, ["id"], 5).collect()}
    for side in (0, 1):
        ids = [i for i in range(50) if int(i % 4 == 0) == side]
        assert [got[(side, i)] for i in ids] == [n // 5 for n in range(len(ids))]


def test_bigram_model_of_training_positions(spark):
    """Smoothed losses for pairs and tokens that training lacks; ties to the lowest label."""
    train = [(1, 5)] * 3 + [(1, 6)] * 3 + [(2, 7)] * 4
    test = [(1, 9), (2, 7), (3, 5)]
    df = spark.createDataFrame([(t, la, 0) for t, la in train] + [(t, la, 1) for t, la in test], "token_id int, label_id int, split int")
    got = {(r["token_id"], r["label_id"]): (r["pred"], round(r["loss"], 9)) for r in ev.bigram_model(df, F.col("split") == 0).collect()}
    share = lambda n, total: round(1 - (n + 1) / (total + 3), 9)
    assert got == {(1, 5): (5, share(3, 6)), (1, 6): (5, share(3, 6)), (1, 9): (5, share(0, 6)), (2, 7): (7, share(4, 4)), (3, 5): (7, share(0, 0))}
