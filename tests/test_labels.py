"""Label catalog, lookups, collapse, drops and first-appearance ids."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from moodspark import catalog as cat
from moodspark.operators import labels as lb


def test_fine_catalog_totals():
    mapped = [n for names in cat.FINE_TO_FIFTEEN.values() for n in names]
    assert len(mapped) == 53 and len(set(mapped)) == 53
    assert len(cat.FINE_DROPPED) == 5
    assert not set(mapped) & set(cat.FINE_DROPPED)
    assert sorted(cat.FINE_TO_FIFTEEN) == list(range(15))


def test_collapse_fine_names(spark):
    names = [n for v in cat.FINE_TO_FIFTEEN.values() for n in v] + cat.FINE_DROPPED + [None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "row_id int, name string")
    out = lb.collapse(df.where(F.col("name").isNotNull()), "name", cat.edge_df(spark, "raw_fine"),
                      cat.dropped_names("raw_fine"))
    rows = {r["name"]: r["label"] for r in out.collect()}
    assert len(rows) == 53
    assert rows["가난한, 불우한"] == 3 and rows["충격 받은"] == 1 and rows["염세적인"] == 14


def test_collapse_unknown_is_an_error(spark):
    df = spark.createDataFrame([("기쁨",), ("모르는 감정",)], "name string")
    with pytest.raises(PySparkException, match="모르는 감정"):
        lb.collapse(df, "name", cat.edge_df(spark, "raw_fine"), cat.FINE_DROPPED).collect()


def test_strict_lookup_error_and_nulls(spark):
    c = cat.catalog_df(spark, "six_bert")
    ok = spark.createDataFrame([("기쁨",), (None,), ("상처",)], "e string")
    assert [r["label_id"] for r in lb.strict_lookup(ok, "e", c).orderBy(F.col("e").asc_nulls_first()).collect()] \
        == [None, 4, 0]
    bad = spark.createDataFrame([("기쁨",), ("행복",)], "e string")
    with pytest.raises(PySparkException, match="행복"):
        lb.strict_lookup(bad, "e", c).collect()


def test_lenient_recode_keeps_unknown(spark):
    df = spark.createDataFrame([("fear",), ("neutral",), (None,)], "t string")
    cat_en = spark.createDataFrame([(k, v) for k, v in cat.ENGLISH_TO_SIX.items()], "name string, id int")
    out = sorted((r["t"] is None, r["t"]) for r in lb.lenient_recode(df, "t", cat_en).collect())
    assert out == [(False, "1"), (False, "neutral"), (True, None)]


def test_drop_keeps_null_rows(spark):
    df = spark.createDataFrame([("neutral",), ("fear",), (None,)], "t string")
    assert lb.drop_value(df, "t", "neutral").count() == 2
    assert lb.drop_values(df, "t", ["neutral", "fear"]).count() == 1


def test_first_appearance_index(spark):
    rows = [(i, v) for i, v in enumerate(["분노", "기쁨", "분노", "불안", None, "기쁨", "당황"])]
    df = spark.createDataFrame(rows, "row_id int, v string")
    got = {r["v"]: r["label_id"] for r in lb.first_appearance_index(df, "v", "row_id").collect()}
    assert got == {"분노": 0, "기쁨": 1, "불안": 2, "당황": 3}


def test_value_counts_and_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")], "id int, v string")
    assert [(r["v"], r["n"]) for r in lb.value_counts(df, "v").collect()] == [("a", 2), ("b", 1)]
    prof = {r["column_name"]: (r["non_null"], r["n_rows"], r["dtype"]) for r in lb.profile(df).collect()}
    assert prof == {"id": (4, 4, "int"), "v": (3, 4, "string")}


def test_sentence_with_particle(spark):
    df = spark.createDataFrame([(3,)], "pred int")
    named = lb.display_name(df, "pred", cat.catalog_df(spark, "six_particle"))
    assert named.select(lb.label_sentence(F.col("label_name"))).first()[0] == ">> 입력하신 내용에서 슬픔이 느껴집니다."
