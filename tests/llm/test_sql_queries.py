"""Queries whose results SQL can express, on the fixture and on edge rows, against DuckDB."""

import math

import duckdb
import pytest

from moodspark.llm import licenses, line_dedup, mixing, queries as q, topk
from pyspark.sql import functions as F

from conftest import frame, passage


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, name):
    res = con.execute(q.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, res.fetchall())


@pytest.fixture(scope="module")
def duck(docs, rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    # rows that share an id are one document to SQL; the operators' rules for them are tested apart
    unique = {r[0]: r for r in rows if r[0] is not None}
    con.executemany("insert into documents values (?, ?, ?, ?)", list(unique.values()))
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    return con


@pytest.fixture(scope="module")
def unique(spark, rows):
    from conftest import frame
    return frame(spark, list({r[0]: r for r in rows if r[0] is not None}.values()))


def test_licences(spark, unique, duck, empty):
    lines = [(501, "GNU General Public License, mit license MIT LICENSE!", "en", "a"), (502, "mit mit license\ncc-by 4.0 apache licensee", "de", "a"),
             (503, "Licensed under the Apache License, Version 2.0. Apache  license", "en", "b"), (504, "cc by", "en", None)]
    from conftest import frame
    both = unique.unionByName(frame(spark, lines))
    duck.executemany("insert into documents values (?, ?, ?, ?)", lines)
    try:
        compare(licenses.licence_report(both), duck, "op3_license_scan")
    finally:
        duck.execute("delete from documents where doc_id between 501 and 504")
    got = {r.doc_id: r for r in licenses.licence_report(frame(spark, lines)).collect()}
    assert (got[501].n_base, got[501].first_word, got[501].last_word, got[501].base_labels) == (3, 0, 6, "gpl,mit")
    assert got[502].base_labels == "cc-by,mit" and got[503].n_base == 2
    assert licenses.licence_report(empty).collect() == []


def test_licences_without_python(spark):
    plan = licenses.licence_report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_lines(spark, unique, duck, empty):
    compare(line_dedup.line_report(unique), duck, "op8_line_dedup")
    assert line_dedup.line_report(empty).collect() == []


def test_lines_when_every_task_starts_inside_a_group(spark):
    rows = [(i, "the same long line in all of them\nown line number %d of this text" % i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup.line_rows(df)
    for parts in (1, 7, 40):
        lost = sorted((r.did, r.pos) for r in line_dedup.dropped_lines(lines, 3, parts).collect())
        assert lost == [(i, 0) for i in range(59)]


def test_lines_of_two_documents_stay(spark):
    rows = [(1, "a line of more than twenty characters\nx"), (2, "A LINE of more than twenty characters  "), (3, None), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup.line_report(df).collect())


def test_dedup_keeps_columns(docs, rows):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_mix(spark, unique, duck, empty):
    compare(mixing.mix_report(unique), duck, "op10_source_mix")
    assert mixing.mix_report(empty).collect() == []


def test_mix_bounds_and_reruns(docs, rows):
    first = [tuple(r) for r in mixing.mix_report(docs).collect()]
    assert sorted(first, key=repr) == sorted((tuple(r) for r in mixing.mix_report(docs).collect()), key=repr)
    assert len(first) == len(rows)
    by = {}
    for _, size, source_size, target, taken in first:
        assert 0 <= taken <= 2 * size and (not size or taken % size == 0)
        total = by.setdefault((source_size, target), [0, 0])
        total[0] += taken
        total[1] = max(total[1], size)
    for (_, target), (taken, largest) in by.items():
        assert abs(taken - target) <= largest


def test_mixed_rows_come_whole(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect() if r.doc_id == 408}
    assert out.where("doc_id = 408").count() * 12_000 == taken[408]


def vectors(spark, rows):
    return spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "vec_id long, embedding array<float>, v string, norm string")


def test_topk(spark, duck):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + j * 11) % 19 - 9) / (1 + i % 5) for j in range(6)]) for i in range(230)]
    rows += [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(15)] + [(400, None), (500, [1.0, None, 1.0]), (600, [nan] * 6), (700, [inf] * 6)]
    rows += [(800, [0.0] * 6), (900, [3.0, 1.0]), (901, [2.0, 2.0])]
    duck.execute("delete from embeddings")
    duck.executemany("insert into embeddings values (?, ?)", rows)
    for block in (4096, 16):
        topk.BLOCK = block
        try:
            compare(topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0), duck, "op7_exact_topk")
        finally:
            topk.BLOCK = 4096
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 100 == 0).collect() == []


def test_topk_prunes_by_coordinate(spark, duck):
    near = [[1.0 + (i % 7) / 100, (i % 5) / 100, (i % 3) / 100] for i in range(300)]
    rows = [(i, near[i] if i % 3 else [-x for x in near[i]]) for i in range(300)]
    duck.execute("delete from embeddings")
    duck.executemany("insert into embeddings values (?, ?)", rows)
    compare(topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0), duck, "op7_exact_topk")


def test_topk_repeated_rows(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(1, [1.0, 0.0])] * 30 + [(None, [1.0, 0.0]), (2, [0.5, 0.0])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, i + 1, 1) for i in range(10)]


def test_topk_large_integers(spark):
    rows = [(0, [3.0e6, 1.0]), (1, [2.9e6, 5.0]), (2, [2.9e6, 4.0])]
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect())
    a = [3000000 * 1024, 1024]
    want = sorted(((a[0] * 2900000 * 1024 + a[1] * x * 1024, v) for v, x in ((1, 5), (2, 4))), reverse=True)
    assert got == [(i + 1, v, s) for i, (s, v) in enumerate(want)]


def test_mix_tells_rows_without_ids_apart(spark):
    """A source whose rows have no id is cut where its target lies: not all or none of them."""
    table = [(None, f"{'word ' * 5}{i}", "en", "a") for i in range(400)] + [(i, "one two three", "en", "b") for i in range(3000)]
    got = mixing.mix_report(frame(spark, table)).where("doc_id is null").collect()
    target, taken = got[0].target, sum(r.taken for r in got)
    assert len(got) == 400 and abs(taken - target) <= 12 and len({r.taken for r in got}) > 1


def test_mix_without_broadcasts_is_the_same(spark, docs, monkeypatch):
    one = sorted(map(str, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 0)
    assert sorted(map(str, mixing.mix_report(docs).collect())) == one


def test_part_of_a_licence_text_and_its_score(spark, duck, unique):
    """A whole text scores 1, half of one about its share of weight, and without its mandatory phrase nothing."""
    whole = {(t[0], t[3]): t[2] for t in licenses.TEMPLATES}
    mit = [t[2] for t in licenses.TEMPLATES if t[0] == "mit"][-1].split()
    bsd = [t[2] for t in licenses.TEMPLATES if t[0] == "bsd"][-1].split()
    lines = [(501, "Copyright x\n" + ", ".join(mit).upper(), "en", "a"), (502, " ".join(mit[:len(mit) // 2]) + " something else", "en", "a"),
             (503, " ".join(mit[10:]), "en", "a"), (504, "before " * 50 + " ".join(bsd) + " between " + " ".join(mit), "en", "a")]
    both = unique.unionByName(frame(spark, lines))
    duck.executemany("insert into documents values (?, ?, ?, ?)", lines)
    try:
        compare(licenses.licence_report(both), duck, "op3_license_scan")
    finally:
        duck.execute("delete from documents where doc_id between 501 and 504")
    got = {r.doc_id: r for r in licenses.licence_report(both).where("doc_id between 501 and 504").collect()}
    assert whole and got[501].labels == "mit" and got[501].score == 1.0 and got[501].n_base == 0
    assert got[502].labels == "mit" and got[503].labels == "" and got[503].score == 0 and got[504].labels == "bsd,mit" and got[504].score == 1.0


def test_words_of_texts_without_a_phrase_are_not_kept(spark):
    rows = licenses.split_once(frame(spark, [(1, "general public things", "en", "a"), (2, "the apache license here", "en", "a"), (3, None, "en", "a")]))
    got = {r.doc_id: (r.n_words, sorted(r.present), r.words) for r in rows.collect()}
    assert got == {1: (3, ["general", "public"], None), 2: (4, ["apache", "license", "the"], ["the", "apache", "license", "here"]), 3: (0, [], None)}


def test_line_dedup_passes_no_text_through_python(spark, docs):
    """Whole texts in Arrow batches took the executors' memory; Python sees bitmaps and hashes."""
    import re
    for out in (line_dedup.dedup_lines(docs), line_dedup.line_report(docs)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        calls = re.findall(r"ArrowEvalPython \[[^\]]*\]", plan)
        assert calls and not [c for c in calls if "text" in c]
