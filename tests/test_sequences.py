"""Truncation boundaries and encoders against small pure-Python models."""

from pyspark.sql import functions as F

from moodspark.operators import sequences as sq


def _budget(q, a, max_len):
    """Reference semantics of the LM budget rule, written plainly."""
    q_len, a_len = len(q), len(a)
    if q_len >= max_len:
        q = q[len(q) - max_len // 2:]
    a = a[:max_len - len(q)]
    return q, a


def test_qa_truncate_boundaries(spark):
    rows = []
    for max_len in (60, 7):
        for qn in (59, 60, 61, 10, 3):
            for an in (1, 49, 50, 51, 80):
                q = [f"q{i}" for i in range(qn)]
                a = [f"a{i}" for i in range(an)]
                rows.append((max_len, qn, an, q, a))
    df = spark.createDataFrame(rows, "L int, qn int, an int, q array<string>, a array<string>")
    got = {}
    for max_len in (60, 7):
        part = sq.qa_truncate(df.where(F.col("L") == max_len), "q", "a", max_len)
        for r in part.collect():
            got[(max_len, r["qn"], r["an"])] = (r["q_trunc"], r["a_trunc"])
    for max_len, qn, an, q, a in rows:
        assert got[(max_len, qn, an)] == _budget(q, a, max_len), (max_len, qn, an)
        qt, at = got[(max_len, qn, an)]
        assert len(qt) + len(at) <= max_len


def test_qa_targets_shapes(spark):
    df = spark.createDataFrame([([4, 10, 11, 8], [5, 12, 13, 6], 4, 4)],
                               "q array<int>, a array<int>, q_len int, a_len int")
    out = sq.qa_targets(df.withColumn("ids", F.concat("q", "a")), "ids", 12).first()
    assert out["token_ids"] == [4, 10, 11, 8, 5, 12, 13, 6, 0, 0, 0, 0]
    assert out["labels_ids"] == [7, 7, 7, 7, 12, 13, 6, 0, 0, 0, 0, 0]
    assert out["mask"] == [1] * 8 + [0] * 4
    assert len(out["labels_ids"]) == 12


def test_encode_single_lengths(spark):
    rows = [(n, [f"t{i}" for i in range(n)]) for n in (0, 62, 63)]
    df = spark.createDataFrame(rows, "n int, toks array<string>")
    out = df.select("n", sq.encode_single(F.col("toks"), 64).alias("enc")).collect()
    lens = {r["n"]: len(r["enc"]) for r in out}
    assert lens == {0: 2, 62: 64, 63: 64}
    for r in out:
        assert r["enc"][0] == "[CLS]" and r["enc"][-1] == "[SEP]"
    mask = spark.range(1).select(sq.attention_mask(F.lit(3), 6).alias("m")).first()["m"]
    assert mask == [1, 1, 1, 0, 0, 0]


def test_vocab_ids_and_unknowns(spark):
    toks = spark.createDataFrame([(t,) for t in "b a b c a b d".split()], "token string")
    vocab = sq.build_vocab(toks, min_count=2)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    n = len(sq.SPECIALS)
    assert ids["b"] == n and ids["a"] == n + 1 and "c" not in ids
    enc = sq.encode_ids(spark.createDataFrame([("a",), ("zzz",)], "token string"), vocab)
    assert sorted(r["token_id"] for r in enc.collect()) == [sq.UNK_ID, n + 1]


def test_batches_and_collate(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(10)], "doc_id int")
    b = sq.assign_batches(df, ["doc_id"], 4)
    got = sorted((r["doc_id"], r["row_idx"], r["batch_id"]) for r in b.collect())
    assert got == [(i * 3, i, i // 4) for i in range(10)]
    c = {r["batch_id"]: [x["doc_id"] for x in r["rows"]] for r in sq.collate(b, ["doc_id"]).collect()}
    assert c == {0: [0, 3, 6, 9], 1: [12, 15, 18, 21], 2: [24, 27]}


def test_leading_tokens_equals_full_split(spark):
    texts = ["", "   ", " a b", "a  b\tc\n", " " + " ".join(f"w{i}" for i in range(100)) + "  ",
             "\n".join(f"x{i}" for i in range(63)), "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from moodspark.functions import text as tx
    got = df.select(sq.leading_tokens(F.col("t"), 62).alias("a"),
                    F.slice(tx.whitespace_tokens("t"), 1, 62).alias("b")).collect()
    for r in got:
        assert r["a"] == r["b"]


def _executed(df):
    """(node, description, metrics) of the plan as it ran."""
    df.collect()
    out = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        metrics = node.metrics()
        keys, found = metrics.keysIterator(), {}
        while keys.hasNext():
            k = keys.next()
            found[k] = metrics.apply(k).value()
        out.append((name, node.simpleString(200), found))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_only_tail_tokens_are_shuffled(spark, monkeypatch):
    """Hot tokens get their id where they are: the exchange by token carries the tail alone."""
    monkeypatch.setattr(sq, "HOT_TOKENS", 3)
    rows = [(i, ["the", "of", "and", f"rare{i % 40}"][i % 4]) for i in range(2000)] + [(9000, None), (9001, "unknown")]
    tokens = spark.createDataFrame(rows, "pos int, token string").repartition(4)
    vocab = sq.build_vocab(tokens.where("token is not null and token <> 'unknown'"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        encoded = sq.encode_ids(tokens, vocab)
        ids = {r["token"]: r["token_id"] for r in vocab.collect()}
        assert sorted((r["pos"], r["token_id"]) for r in encoded.collect()) == sorted((p, ids.get(t, sq.UNK_ID)) for p, t in rows)
        hot = {t for t, i in ids.items() if i < len(sq.SPECIALS) + 3}
        tail = sum(t is not None and t not in hot for _, t in rows)
        by_token = [m["shuffleRecordsWritten"] for name, text, m in _executed(encoded) if name == "Exchange" and "hashpartitioning(token" in text]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < tail < len(rows) / 2 and tail in by_token and len(rows) not in by_token
