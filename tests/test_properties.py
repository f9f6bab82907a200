"""Property tests: text functions vs Python, corpus invariants on the fixture."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodspark.functions import text as tx
from moodspark.plans.registry import queries

SF = "/root/testdata/sf0.001"
WS_CHARS = "".join(tx.PY_WHITESPACE)
texts = st.lists(st.text(alphabet=st.sampled_from(list("ab가힣 .,?!\n\t\r") + list(WS_CHARS)), max_size=40),
                 min_size=1, max_size=30)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_lines_and_tokens_match_python(spark, batch):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(batch)], "i int, s string")
    got = {r["i"]: (r["lines"], r["toks"], r["p"]) for r in df.select(
        "i", tx.text_lines("s").alias("lines"), tx.whitespace_tokens("s").alias("toks"),
        tx.punct_space("s").alias("p")).collect()}
    import re
    for i, s in enumerate(batch):
        lines = [x.strip() for x in s.split("\n") if x.strip()]
        toks = [t for t in re.split(r"[\t\n\x0b\f\r ]+", s) if t]
        assert got[i] == (lines, toks, re.sub(r"[?.!,]", " ", s))


def test_histogram_rows_sum_to_scored_lines(spark):
    hist = queries()["song_emotion_hist"](spark, SF)
    bad = hist.where(sum(F.col(f"e{k}") for k in range(15)) != F.col("n_scored")).count()
    assert bad == 0 and hist.where("n_scored = 0").count() == 0


def test_union_count_is_sum_of_parts(spark):
    from moodspark.plans import q_dialogue as qd
    parts = qd.unpivot(spark, SF).count() + qd.doc_qa(spark, SF).dropna(subset=["Q", "A", "label"]).count()
    assert qd.qa_parts(spark, SF).count() == parts


def test_dedupe_is_idempotent(spark):
    from moodspark.operators import pages as pg
    once = queries()["dedupe_first"](spark, SF)
    twice = pg.dedupe_first(once, ["title"], "page_id", ["url"])
    assert sorted(once.collect()) == sorted(twice.select(*once.columns).collect())


def test_encoded_arrays_have_fixed_length(spark):
    t = queries()["qa_targets"](spark, SF)
    rows = t.collect()
    assert rows and all(len(r["token_ids"].split()) == 60 and len(r["labels_ids"].split()) == 60 for r in rows)
    assert all(r["mask"].split().count("1") == r["q_len"] + r["a_len"] and r["mask"] == r["attention_mask"] for r in rows)
    e = queries()["encode_single"](spark, SF).collect()
    assert all(len(r["input_ids"].split()) == 64 and r["attention_mask"].split().count("1") == r["valid_length"]
               for r in e)
