"""Plan-shape regressions: what the optimizer must (not) produce at any scale."""

import pytest

from moodspark.plans.registry import queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_products(spark, name):
    plan = _plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_kth_turn_orders_blocks_not_conversations(spark):
    from moodspark.operators.dialogue import kth_turn
    rows = [(1, i, "user") for i in range(50)] + [(2, i, "user") for i in range(0, 20, 3)] + [(2, 1, "assistant")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string").repartition(4)
    numbered = kth_turn(df, block=8)
    want = {}
    for c, t, r in sorted(rows):
        want[(c, t, r)] = sum(1 for x in rows if x[0] == c and x[2] == r and x[1] <= t)
    assert {(r["conv_id"], r["turn"], r["role"]): r["k"] for r in numbered.collect()} == want
    assert "_blk" in _plan(numbered).split("Window")[-1]


def test_scorer_combines_before_the_exchange(spark):
    plan = _plan(queries()["song_emotion_hist"](spark, SF))
    assert "partial_count" in plan and "BroadcastHashJoin" in plan and "Python" not in plan


def test_catalog_joins_are_broadcast(spark):
    for name in ("label_strict", "label_collapse", "label_lenient"):
        plan = _plan(queries()[name](spark, SF))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, name


def test_keep_first_is_partially_aggregated(spark):
    plan = _plan(queries()["dedupe_first"](spark, SF))
    assert "partial_min" in plan
