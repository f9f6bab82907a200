"""Jaccard components against all pairs, and the graph step against union-find."""

import random
import re

import numpy as np
import pytest
from conftest import frame, passage
from rowcheck import same

from moodspark.llm import graph, jaccard

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids) if ids else None))
    return out


def family(n, seed=3):
    """Near copies at all distances around the threshold, some linked only through others."""
    rng = random.Random(seed)
    base = passage(rng, 70).split()
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        if rng.random() < 0.3:
            words = words[rng.randint(0, 8):]
        rows.append((i, " ".join(words), "en", "a"))
    return rows


@pytest.mark.parametrize("block", [3, 64])
def test_against_all_pairs(spark, rows, docs, block):
    some = [(a, b) for a, b, _, _ in rows]
    jaccard.BLOCK = block
    try:
        same([tuple(r) for r in jaccard.components(docs, 4, 85, 100).collect()], brute(some, 4, 85, 100))
        near = family(90)
        got = [tuple(r) for r in jaccard.components(frame(spark, near), 4, 85, 100).collect()]
        same(got, brute([(a, b) for a, b, _, _ in near], 4, 85, 100))
    finally:
        jaccard.BLOCK = 64


def test_other_widths(spark, rows, docs):
    same([tuple(r) for r in jaccard.components(docs, 5, 80, 100).collect()], brute([(a, b) for a, b, _, _ in rows], 5, 80, 100))


def test_common_line_and_heavy_hitters(spark):
    rng = random.Random(5)
    line = "one very common line of ten words stands in all"
    rows = [(i, line + " " + passage(rng, rng.randint(0, 25)), "en", "a") for i in range(120)]
    got = [tuple(r) for r in jaccard.components(frame(spark, rows), 4, 85, 100).collect()]
    same(got, brute([(a, b) for a, b, _, _ in rows], 4, 85, 100))


def test_empty_table(empty):
    assert jaccard.components(empty).collect() == []


def test_one_row_of_each_component_stays(docs, rows):
    out = jaccard.keep_one(docs, 5, 80, 100)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    want = [k for k, _, c in brute([(a, b) for a, b, _, _ in rows], 5, 80, 100) if k == c or c is None]
    # rows without shingles all stay
    want += [a for a, b, _, _ in rows if not shingles(b, 5) and a not in want]
    assert sorted(map(str, set(kept))) == sorted(map(str, set(want)))


def test_sets_of_texts():
    texts = ["A b\tc\x0bd e", "a B c d", "x", "", "é É é É é", " \n"]
    sets = jaccard.shingle_sets(texts, 4)
    assert [len(s) for s in sets] == [len(shingles(t, 4)) for t in texts]
    assert sets[1][0] in sets[0]


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2 ** 63, 700).astype(np.uint64)
    sets = []
    for i in range(60):
        keep = base[rng.random(700) < rng.choice([0.3, 0.85, 0.95, 1.0])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2 ** 63, rng.integers(0, 40)).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    both = jaccard.overlaps(sets)
    linked = (100 * both >= 85 * (sizes[:, None] + sizes[None, :] - both)) & ~np.eye(60, dtype=bool)
    alive = jaccard.possible(sizes, [jaccard.parity(s) for s in sets], np.zeros(60, int), 85, 100)
    assert linked.any() and not (linked.any(axis=1) & ~alive).any() and not alive.all()
    side = (np.arange(60) % 5 == 0).astype(int)
    marked = linked & ((side[:, None] + side[None, :]) > 0)
    alive = jaccard.possible(sizes, [jaccard.parity(s) for s in sets], side, 85, 100)
    assert not (marked.any(axis=1) & ~alive).any()


def test_units_keep_all_connections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(40)]
    both = jaccard.overlaps(sets)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert both[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))
    linked = rng.random((30, 30)) < 0.04
    linked |= linked.T
    root = list(range(30))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in zip(*np.nonzero(linked)):
        root[find(int(i))] = find(int(j))
    made = list(range(30))
    find2 = lambda x: x if made[x] == x else find2(made[x])
    for i, j in jaccard.forest(linked):
        made[find2(i)] = find2(j)
    for i in range(30):
        for j in range(30):
            assert (find(i) == find(j)) == (find2(i) == find2(j))


def test_components_of_a_graph(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    edges += [(100, 101), (7, 7)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_exactly_one_row_of_each_component_stays(spark):
    """Rows that share the smallest id, equal rows, and components without any id."""
    words = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcd"]
    near = words[3] + " and one more word"
    table = ([(5, words[0], "en", s) for s in "abcd"] + [(None, words[1], "en", "a")] * 3 + [(None, words[1], "de", "b")]
             + [(7, words[2], "en", "a"), (7, words[2] + " x", "en", "a"), (8, words[2], "en", "a")]
             + [(None, words[3], "en", "a"), (9, near, "en", "b"), (9, near, "en", "b")]
             + [(1, "", "en", "a"), (1, "", "en", "a"), (2, None, "en", "a"), (2, None, "en", "a"), (3, " \t", None, None), (4, "short", "en", "a")])
    got = [(r.doc_id, r.text) for r in jaccard.keep_one(frame(spark, table), 5, 80, 100).collect()]
    empties = [r for r in got if not (r[1] or "").strip()]
    assert sorted(map(str, empties)) == sorted(map(str, [(1, ""), (1, ""), (2, None), (2, None), (3, " \t")]))
    rest = sorted((r for r in got if r not in empties), key=str)
    assert len(rest) == 5 and {r[0] for r in rest} == {5, None, 7, 9, 4} and (9, near) in rest and (None, words[1]) in rest
