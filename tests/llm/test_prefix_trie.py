"""The prefix trie against a trie built turn by turn; bands far below the depth force several levels."""

import hashlib
import random
import zlib

import pytest

from moodspark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, c string, depth string, k1 string, turns string, _h string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((t is not None, t or 0, mark), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in convs.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(made) + 1):
            nodes.setdefault(made[:d], []).append((c, len(made)))
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = (len(nodes[path]) - 1) * len(path[-1][1].encode() if path else b"") + sum(saved[k] for k in below)
    out = []
    for path, members in nodes.items():
        last = ",".join(str(c) for c in sorted(c for c, n in members if n == len(path)))
        out.append((min(members)[0], len(path), min(nodes[path[:-1]])[0] if path else None, len(members), len(kids.get(path, [])),
                    leaves[path], saved[path], hashlib.sha256(last.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(4)
    rows = []
    for c in range(60):
        n = rng.choice([0, 1, 2, 3, 5, 9, 40])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "ünï"])) for t in range(n)]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(700) for t in range(2)]                     # a hot path
    rows += [(2000, t, "user", rng.choice("ab")) for t in range(2500)]                                     # one long conversation
    rows += [(2001, t, "user", "a") for t in range(300)] + [(2005, t, "user", "a") for t in range(310)]
    rows += [(None, 1, "user", "nobody's"), (71, None, "user", "first"), (71, 1, None, None), (71, 1, "", "x" * 50_000), (71, 1, "", "x" * 50_000),
             (72, None, None, None), (-3, 1, "user", "yes"), (-4, 1, "user", "yes"), (2 ** 62 + 1, 0, "user", "a"), (2 ** 62 + 2, 0, "user", "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band, stride", [(4, 64), (16, 1024)])
def test_equals_a_plain_trie(spark, monkeypatch, band, stride):
    monkeypatch.setattr(pt, "BAND", band)
    monkeypatch.setattr(pt, "STRIDE", stride)
    rows = conversations()
    got = pt.prefix_trie(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    got = pt.prefix_trie(frame(spark, []))
    assert got.collect() == []
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]


def test_only_null_ids(spark):
    assert pt.prefix_trie(frame(spark, [(None, 1, "user", "a")])).collect() == []


def test_turnless_conversation_is_in_the_root_alone(spark):
    # ids whose first turns are borrowed from a base that isn't there
    c = next(i for i in range(1, 500) if i % 5 and zlib.crc32(str(i).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert [tuple(r)[:6] for r in pt.prefix_trie(frame(spark, rows)).collect()] == [(c, 0, None, 1, 0, 1)]


def test_rounds_follow_the_logarithm_of_the_depth(spark, monkeypatch):
    seen = []
    real = pt._up
    monkeypatch.setattr(pt, "_up", lambda *a: seen.append(a[2]) or real(*a))
    rows = [(1, t, "user", str(t)) for t in range(300)]
    pt.prefix_trie(frame(spark, rows))
    assert seen == [1, 16, 256]
