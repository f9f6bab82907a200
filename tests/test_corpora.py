"""E2/E3 corpus builders on hand-made sheets with the source's Korean columns."""

from pyspark.sql import functions as F

import pytest
from pyspark.errors import PySparkException

from moodspark.operators import corpora as cp

SHEET_COLS = "row_id long, `감정_대분류` string, `사람문장1` string, `시스템문장1` string, " \
             "`사람문장2` string, `시스템문장2` string, `사람문장3` string, `시스템문장3` string"


def _sheet(spark, rows):
    return spark.createDataFrame(rows, SHEET_COLS)


def test_lm_corpus_six_order_and_labels(spark):
    train = _sheet(spark, [
        (0, "분노", "t0q1", "t0a1", "t0q2", "t0a2", None, None),
        (1, "기쁨", "t1q1", "t1a1", None, None, None, None),
        (2, "슬픔", "t2q1", None, "t2q2", "t2a2", "t2q3", "t2a3"),
    ])
    valid = _sheet(spark, [(0, "기쁨", "v0q1", "v0a1", "v0q2", "v0a2", None, None)])
    chat = spark.createDataFrame([(0, "cq0", "ca0", 0), (1, "cq1", "ca1", 1), (2, "cq2", "ca2", 2)],
                                 "row_id long, Q string, A string, label int")
    out = [(r["row_idx"], r["Q"], r["label"]) for r in cp.lm_corpus(train, chat, valid=valid).orderBy("row_idx").collect()]
    # first appearance: 분노 0, 기쁨 1, 슬픔 2; everyday = 3; chatbot 1 -> 슬픔, 2 -> 기쁨
    assert out == [(0, "t0q1", 0), (1, "t1q1", 1), (2, "v0q1", 1),
                   (3, "t0q2", 0), (4, "t2q2", 2), (5, "v0q2", 1),
                   (6, "t2q3", 2),
                   (7, "cq0", 3), (8, "cq1", 2), (9, "cq2", 1)]


def test_lm_corpus_unknown_validation_label_fails(spark):
    train = _sheet(spark, [(0, "분노", "q", "a", None, None, None, None)])
    valid = _sheet(spark, [(0, "당황", "q", "a", None, None, None, None)])
    chat = spark.createDataFrame([(0, "q", "a", 0)], "row_id long, Q string, A string, label int")
    with pytest.raises(PySparkException, match="당황"):
        cp.lm_corpus(train, chat, valid=valid).collect()


def test_classifier_corpus_fifteen(spark):
    sheet = spark.createDataFrame([
        (0, "충격 받은", "문장0"), (1, "조심스러운", "문장1"), (2, "가난한, 불우한", "문장2"), (3, "안도", "문장3")],
        "row_id long, `감정_소분류` string, `사람문장1` string")
    utter = spark.createDataFrame([(0, "무서워", "fear"), (1, "그냥", "neutral"), (2, "놀람", "surprise")],
                                  "row_id long, `발화문` string, `상황` string")
    out = [(r["text"], r["label"]) for r in cp.classifier_corpus(sheet, utter, 15).orderBy("row_idx").collect()]
    assert out == [("문장0", "1"), ("문장2", "3"), ("문장3", "7"), ("무서워", "4"), ("놀람", "1")]


def test_classifier_corpus_six_lenient(spark):
    sheet = spark.createDataFrame([(0, "상처", "a"), (1, "당황", "b"), (2, "몰라", "c")],
                                  "row_id long, `감정_대분류` string, `사람문장1` string")
    utter = spark.createDataFrame([(0, "x", "disgust"), (1, "y", "neutral")], "row_id long, `발화문` string, `상황` string")
    out = [(r["text"], r["label"]) for r in cp.classifier_corpus(sheet, utter, 6).orderBy("row_idx").collect()]
    assert out == [("a", "0"), ("b", "5"), ("c", "몰라"), ("x", "2")]


def test_every_branch_of_the_fixture_corpora_holds_rows(spark):
    """The validation sheet, the dropped names and the neutral tag take rows of the fixture, and of the data alone."""
    from moodspark.operators import corpora as cp
    from moodspark.plans import q_dialogue as q
    from moodspark.plans.registry import queries
    sf, seen, real = "/root/testdata/sf0.01", {}, cp.lm_corpus

    def spy(train, chatbot, label_col, valid, **kw):
        seen.update(train=train.count(), valid=valid.count(), labels=[{r[0] for r in x.select(label_col).distinct().collect()} for x in (train, valid)])
        return real(train, chatbot, label_col, valid, **kw)
    cp.lm_corpus = spy
    try:
        queries()["lm_corpus_two_sheets"](spark, sf)
    finally:
        cp.lm_corpus = real
    assert seen["train"] > 0 and seen["valid"] > 0 and seen["labels"][1] <= seen["labels"][0]
    sheet = q._sheet(spark, sf)
    assert 0 < sheet.where(F.length(cp.HUMAN[0]) < q.CURT).count() < sheet.count() == seen["train"] + seen["valid"]


def test_a_validation_label_that_training_lacks_fails_by_name(spark):
    import pytest
    from moodspark.operators import corpora as cp
    cols = "row_id long, `감정_소분류` string, `사람문장1` string, `사람문장2` string, `사람문장3` string, `시스템문장1` string, `시스템문장2` string, `시스템문장3` string"
    row = lambda i, name: (i, name, "q", None, None, "a", None, None)
    train, valid = spark.createDataFrame([row(1, "슬픈"), row(2, "기쁨")], cols), spark.createDataFrame([row(3, "외로운")], cols)
    chat = spark.createDataFrame([(1, "Q", "A", 0)], "row_id long, Q string, A string, label int")
    with pytest.raises(Exception, match="외로운"):
        cp.lm_corpus(train, chat, cp.FINE, valid).collect()
