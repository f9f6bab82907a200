"""Repeated passages against counting every window."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import frame, passage
from rowcheck import same

from moodspark.llm import passages, queries


def brute(rows, length):
    raws = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(r[i:i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for key, raw in raws:
        gone = np.zeros(len(raw) + 1, dtype=np.int64)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, most", [(400, None), (60, None), (60, 700)])
def test_against_all_windows(docs, rows, length, most):
    """``most`` small: anchors go the way of those that are too common to be sorted at once."""
    normal = passages.SORTED
    passages.SORTED = most or normal
    try:
        got = [tuple(r) for r in passages.remove_repeats(docs, length).collect()]
    finally:
        passages.SORTED = normal
    same(got, brute([(a, b) for a, b, _, _ in rows], length))


def test_overlaps_within_a_text(spark):
    rng = random.Random(4)
    text = passage(rng, 40)
    rows = [(1, "ab" * 300, "en", "a"), (2, text + "é" + text, "en", "a"), (3, text[:150], "en", "a"), (4, "ab" * 45 + "c" + "ab" * 45, "en", "a")]
    got = [tuple(r) for r in passages.remove_repeats(frame(spark, rows), 80).collect()]
    same(got, brute([(a, b) for a, b, _, _ in rows], 80))


def test_empty_table_and_kept_bytes(spark, empty, docs):
    assert passages.remove_repeats(empty).collect() == []
    for r in passages.remove_repeats(docs.where("doc_id < 210"), 60, with_kept=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_windows_of_regions():
    rng = random.Random(1)
    for _ in range(150):
        length, letters = rng.choice([1, 2, 3, 5, 8]), rng.choice([1, 2, 4, 250])
        base = bytes(rng.randrange(letters) for _ in range(40))
        regions = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randrange(30)
            region = bytearray(base[a:a + rng.randint(0, 20)])
            if region and rng.random() < 0.5:
                region[rng.randrange(len(region))] = rng.randrange(letters)
            regions.append(bytes(region))
        seen = Counter(r[i:i + length] for r in regions for i in range(len(r) - length + 1))
        want = [[i for i in range(len(r) - length + 1) if seen[r[i:i + length]] > 1] for r in regions]
        assert [x.tolist() for x in passages.repeated_windows(regions, length)] == want


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 900).astype(np.uint8)
    data[500:800] = data[100:400]
    ah, lo, hi = passages.runs(data, 50, 20)
    anchor = np.repeat(ah, hi - lo + 1)
    assert len(anchor) == len(data) - 49
    for shift in range(251):
        assert anchor[100 + shift] == anchor[500 + shift]


def test_merged_ranges():
    assert passages.merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]


def test_planted_passages_are_caught_and_clean_texts_stay(spark):
    """Passages of 400 bytes and more, over 50 words, in two to forty documents: none is left, and nothing else goes."""
    rng = random.Random(21)
    planted = [passage(rng, n) for n in (90, 120, 300)]
    planted = [p for p in planted if len(p.encode()) >= 400]
    assert len(planted) == 3
    rows, holds = [], {}
    for k, (p, copies) in enumerate(zip(planted, (2, 7, 40))):
        for j in range(copies):
            key = 100 * k + j
            rows.append((key, f"{passage(rng, 30)} #{key} {p} #{key} {passage(rng, 30)}", "en", "a"))
            holds[key] = p
    rows += [(1000 + i, passage(rng, 200), "en", "b") for i in range(60)]
    got = {r.doc_id: r for r in passages.remove_repeats(frame(spark, rows), with_kept="text").collect()}
    texts = {r[0]: r[1] for r in rows}
    for key, p in holds.items():
        assert p not in got[key].kept and got[key].n_removed >= len(p.encode()) and got[key].n_spans == 1
    assert all(got[k].n_removed == 0 and got[k].kept == texts[k] for k in texts if k >= 1000)


def test_null_ids_with_colliding_short_hashes_keep_their_bytes(spark):
    """Rows without an id are told apart by 64 bits of their text."""
    rng = random.Random(22)
    p = passage(rng, 100)
    rows = [(None, f"{i} {p} {passage(rng, 20)}" if i % 2 else passage(rng, 60), "en", "a") for i in range(200)]
    got = passages.remove_repeats(frame(spark, rows)).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len(t.encode()) for _, t, _, _ in rows)
    assert sum(r.n_removed > 0 for r in got) == 100


def brute_shared(rows, words):
    """(doc_id, n_passages, n_passage_words) from every window of words, held against the other texts."""
    texts = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or ""), t or "") for k, t in rows]
    holders = defaultdict(set)
    for _, w, t in texts:
        for i in range(len(w) - words + 1):
            holders[tuple(w[i:i + words])].add(t)
    out = []
    for key, w, _ in texts:
        held = np.zeros(len(w), dtype=int)
        for i in range(len(w) - words + 1):
            if len(holders[tuple(w[i:i + words])]) > 1:
                held[i:i + words] = 1
        out.append((key, int((np.diff(np.concatenate([[0], held])) == 1).sum()), int(held.sum())))
    return out


@pytest.mark.parametrize("words, most", [(51, None), (6, None), (6, 60)])
def test_shared_passages_against_all_windows(spark, docs, rows, words, most):
    """Copies of a text, repeats within it and words parted by other spaces; ``most`` small: windows are counted."""
    rng = random.Random(31)
    p = passage(rng, 12).split()
    more = [(900 + i, " ".join(p[a:b]) + f" x{i}\n" + "\t ".join(p[c:d]), "en", "a")
            for i, (a, b, c, d) in enumerate((sorted(rng.sample(range(13), 2)) + sorted(rng.sample(range(13), 2)) for _ in range(40)))]
    alone = passage(rng, 70)
    more += [(950, f"{alone} {alone}", "en", "a"), (951, f"{alone} {alone}", "en", "b")]
    table = docs.select("doc_id", "text").union(frame(spark, more).select("doc_id", "text"))
    normal = passages.SORTED
    passages.SORTED = most or normal
    try:
        got = [(r.doc_id, r.n_passages, r.n_passage_words) for r in passages.remove_repeats(table, words=words).collect()]
    finally:
        passages.SORTED = normal
    same(got, brute_shared([(a, b) for a, b, _, _ in rows + more], words))


def test_passages_of_many_words_below_the_length_are_told(spark, tmp_path):
    """The query tells passages of over 50 words but under 400 bytes that documents share; the 400-byte rule stays."""
    rng = random.Random(32)
    planted = " ".join(passage(rng, 60).split())[:390].rsplit(" ", 1)[0]
    while len(planted.split()) <= 50:
        planted = " ".join(w[:4] for w in passage(rng, 60).split())
    assert len(planted.encode()) < 400
    rows = [(k, f"{passage(rng, 30)} #{k} {planted} #{k} {passage(rng, 30)}", "en", "a") for k in range(5)]
    rows += [(10 + k, passage(rng, 120), "en", "b") for k in range(20)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.queries()["op9_repeated_passages"](spark, str(tmp_path)).collect()}
    n = len(planted.split())
    assert all((r.n_removed, r.n_passages, r.n_passage_words) == ((0, 1, n) if k < 5 else (0, 0, 0)) for k, r in got.items())
    assert len(got) == 25
