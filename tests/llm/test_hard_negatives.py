"""Hard negatives against all pairs; long and short vectors, ties, copies, windows that are empty."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, n string, v string, norm string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", "x", "x", "x") for i, v, la in rows], SCHEMA).repartition(3)


def brute(rows, anchors, low=80, k=5):
    sound = [(i, tuple(math.floor(256 * x) for x in v), la) for i, v, la in rows
             if i is not None and la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, la in sorted({r for r in sound if anchors(r[0])}):
        score = lambda r: sum(a * b for a, b in zip(v, r[1]))
        others = sorted(((-score(r), r[0], r[2]) for r in sound if r[0] != i and len(r[1]) == len(v)))
        for s, p, _ in [r for r in others if r[2] == la][:k]:
            inside = [(n, ns) for ns, n, nl in others if nl != la and low * -s <= 100 * -ns <= 100 * -s][:k]
            out += [(i, p, rank, n, -s, -ns) for rank, (n, ns) in enumerate(inside, 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(scale=0.1, size=6)], int(rng.integers(0, 5))) for i in range(240)]
    rows += [(300 + i, [float(x) for x in (10.0 ** (i % 5 - 2)) * rng.normal(size=6)], i % 3) for i in range(60)]   # many lengths
    rows += [(400 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(40)]                                  # ties
    rows += [rows[0], rows[0], rows[5], (7, [0.25] * 6, 1)]                                                          # repeated rows, a repeated id
    rows += [(500, [0.0] * 6, 1), (510, [1.0, 2.0], 1), (511, [1.0, 1.9], 1), (512, [1.0, 1.8], 2), (520, [], 1), (521, [], 2)]
    rows += [(None, [1.0] * 6, 1), (530, None, 1), (531, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (532, [float("nan")] * 6, 1), (533, [float("inf")] * 6, 1),
             (540, [1.0] * 6, None), (550, [-3.0, 0.0, 0.0, 0.0, 0.0, 0.0], 9), (551, [3.0, 0.0, 0.0, 0.0, 0.0, 0.0], 9)]
    return rows


@pytest.mark.parametrize("block, group, low", [(4096, 8192, 80), (16, 7, 80), (16, 7, 0), (50, 20, 99)])
def test_equals_all_pairs(spark, block, group, low):
    rows = vectors()
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, low=low, block=block, group=group)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0, low)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2 ** 20, 2 ** 20, size=5)], i % 3) for i in range(60)]
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, block=16)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0)


def test_empty_tables(spark):
    assert hn.hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert hn.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") % 10 == 0).collect() == []


def test_ranges_prune_and_never_lose_a_hit():
    """Vectors of eight directions: the intersected ranges leave an eighth of them, and all that reach the cosine."""
    rng = np.random.default_rng(8)
    data = np.repeat(np.vstack([np.eye(4), -np.eye(4)]) * 1000, 50, axis=0) + rng.normal(scale=20, size=(400, 4))
    data = np.floor(data).astype(np.int64)
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    block = hn.Block(np.arange(400).tobytes(), np.zeros(400, np.int64).tobytes(), data.astype(np.int32).tobytes(),
                     np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16).tobytes(), 4)
    for cosine in (0.95, 0.8, 0.3):
        for q in unit[::40]:
            alive = block.feasible(q, cosine)
            reach = unit @ q >= cosine
            assert alive is None or not (reach & ~alive).any()
            if cosine >= 0.8:
                assert alive.sum() <= 60


def test_windows_are_exact():
    score = np.array([-7, 0, 1, 99, 100, 101, 2 ** 60], dtype=np.int64)
    for low in (80, 33):
        least, most = hn.window(score, low, 100)
        assert [int(x) for x in least] == [-(-low * int(s) // 100) for s in score] and list(most) == list(score)


def test_blocks_out_of_reach_are_not_dealt(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 5], i % 2) for i in range(80)] + [(1000 + i, [1e-3] * 4, i % 2) for i in range(80)]
    dealt, real = [], hn.cells.deal
    monkeypatch.setattr(hn.cells, "deal", lambda *a, **k: dealt.append(real(*a, **k)) or dealt[-1])
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") == 10, block=16)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i == 10)
    first, second = (d.where("kind = 1").count() for d in dealt)
    assert second < first
