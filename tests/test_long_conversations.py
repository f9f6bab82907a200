"""Conversations of more than 1,000 sheet rows: their keys do not run into the next conversation's."""

import pytest

from moodspark.plans.registry import queries

TURNS = {1: 3010, 2: 9}
WORD = {1: "the", 2: "le"}  # classes 0 and 7 of the lexicon


@pytest.fixture(scope="module")
def long_sf(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("long"))
    talk = [(c, 2 * k + i, role, f"{WORD[c]} {role[0]}{c} {k}") for c, n in TURNS.items() for k in range(n) for i, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    docs = [(1, "en", "\n".join(f"line {i}" for i in range(6))), (2, "en", "next 0\nnext 1")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    return sf


def _sheets():
    """(conversation, first turn of the sheet row)"""
    return [(c, k) for c, n in TURNS.items() for k in range(0, n, 3)]


@pytest.mark.parametrize("name", ["lm_corpus_fifteen", "lm_corpus_two_sheets"])
def test_lm_corpus_of_a_long_conversation(spark, long_sf, name):
    got = [(r.row_idx, r.Q, r.A, r.label) for r in queries()[name](spark, long_sf).orderBy("row_idx").collect()]
    split = (lambda k: k >= 3) if name == "lm_corpus_two_sheets" else (lambda k: False)
    want = []
    for slot in range(3):
        for valid in (False, True):
            want += [(f"{WORD[c]} u{c} {k + slot}", f"{WORD[c]} a{c} {k + slot}", c - 1)
                     for c, k in _sheets() if split(k) == valid and k + slot < TURNS[c]]
    want += [(f"line {i}", f"line {i + 1}", 2) for i in range(0, 6, 2)] + [("next 0", "next 1", 2)]
    assert got == [(i, *w) for i, w in enumerate(want)]


def test_classifier_corpora_of_a_long_conversation(spark, long_sf):
    lines = [f"line {i}" for i in range(6)] + ["next 0", "next 1"]
    six = [(r.row_idx, r.text) for r in queries()["classifier_corpus_six"](spark, long_sf).orderBy("row_idx").collect()]
    assert six == list(enumerate([f"{WORD[c]} u{c} {k}" for c, k in _sheets()] + lines))
    fifteen = [(r.text, r.label) for r in queries()["classifier_corpus_fifteen"](spark, long_sf).orderBy("row_idx").collect()]
    sheet = [x for x in fifteen if x[0] not in set(lines)]
    assert len(sheet) == len(set(sheet)) and {x for x in sheet} <= {(f"{WORD[c]} u{c} {k}", "0" if c == 1 else "7") for c, k in _sheets()}
    assert [x[0] for x in fifteen if x[0] in set(lines)] == lines
