"""Language ID and quality: held-out accuracy, edges, and the numerical parts."""

import random
import zlib

import numpy as np
from conftest import frame
from pyspark.sql import functions as F

from moodspark.llm import langid, queries as q, quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q.queries()["op4_language_id"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out for d in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(docs, rows, empty):
    got = langid.language_report(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for key in (400, 401, 402, 406):
        assert (by[key][0].lang_pred, by[key][0].score) == ("und", 0.0)
    assert all(r.lang_pred in ("en", "de", "fr", "es") for r in by[0])
    assert not by[None][0].held_out
    assert langid.language_report(empty).collect() == []


def test_no_labels_and_one_language(spark):
    none = frame(spark, [(1, "some text", None, "a"), (2, "more", None, "a")])
    assert {r.lang_pred for r in langid.language_report(none).collect()} == {"und"}
    one = frame(spark, [(i, f"text {i}", "xx", "a") for i in range(8)])
    assert {(r.lang_pred, r.score) for r in langid.language_report(one).collect()} == {("xx", 1.0)}


def test_prediction_sees_text_only(spark, docs):
    model = langid.train(docs)
    a = langid.predict(docs, model, ["doc_id"]).where("doc_id = 408").first()
    b = langid.predict(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), model, ["doc_id"]).where("doc_id = 408").first()
    assert a == b


def test_rejected_rows_go(docs, rows):
    out = langid.drop_rejected(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert not {400, 401, 402, 406} & set(kept) and 408 in kept and 0 in kept


def test_gram_counts():
    at, counts = langid.gram_counts("Abcabc")
    assert counts.sum() == 6 + 5 + 4 and len(at) == len(set(at.tolist()))
    long_at, long_counts = langid.gram_counts("xyz " * 5000)
    assert long_counts.sum() == 20_000 * 3 - 3 and (np.diff(long_at) > 0).all()


def test_penalty_gives_zeros_and_temperature_calibrates():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(200):
        y = i % 2
        rows.append((np.array([y, 2 + i % 50]), np.array([1.0, 0.2])))
        labels.append(y)
    w = langid.ftrl(rows, np.array(labels), 2, l1=0.5)
    assert w[0, 0] > 0 > w[1, 0] and (w[:, 2:52] == 0).all()
    scores = rng.normal(size=(4000, 2)) * 1.0
    p = 1 / (1 + np.exp(scores[:, 0] - scores[:, 1]))
    y = (rng.random(4000) < p).astype(int)
    assert abs(langid.temperature(scores * 5, y) - 5) < 1.0


def sites(spark):
    docs, labels = [], []
    for i in range(400):
        site = "good.example" if i % 2 else "bad.example"
        docs.append((i, f"plain words number {i} without any sign", "en", site))
        if i < 300:
            labels.append((i, int(i % 2 == 1), 0))
    docs += [(900, "plain words of a site never seen", "en", "new.example"), (901, "plain words", "en", "one.example"), (None, None, None, None)]
    labels += [(901, 0, 0), (901, 1, 0), (902, 1, 0), (None, 1, 0)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def score(docs, labels):
    rows = quality.quality_scores(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"), F.col("quality")).collect()
    return {r.doc_id: r for r in rows}, rows


def test_sites_speak_and_sparse_ones_shrink(spark):
    docs, labels = sites(spark)
    got, rows = score(docs, labels)
    assert len(rows) == 403
    assert got[399].host_rate > 0.95 and got[398].host_rate < 0.05 and got[399].keep and not got[398].keep
    total = 150.5 / 302.0
    assert abs(got[900].host_rate - total) < 0.02 and abs(got[900].path_rate - got[900].host_rate) < 1e-9
    # a label never speaks for its own document: without it, its host and path are those of a site never seen
    assert abs(got[901].path_rate - got[900].path_rate) < 1e-9 and abs(got[901].host_rate - got[900].host_rate) < 1e-9
    assert 0 < got[None].score < 1


def brute_quality(docs, labels, evidence):
    """Host and path posteriors and the score of each row, counted plainly; ``evidence`` gives a row's own log odds."""
    marks = {}
    for d, g, _ in labels:
        if d is not None:
            marks[d] = min(g, marks.get(d, 1))
    placed = {(d, s, f"{s}/{la}") for d, _, la, s in docs if d in marks}
    paths, hosts = {}, {}
    for d, s, p in placed:
        paths.setdefault((s, p), []).append(marks[d])
    for d, s in {(d, s) for d, s, _ in placed}:
        hosts.setdefault(s, []).append(marks[d])
    y, n = sum(map(sum, hosts.values())), sum(map(len, hosts.values()))
    rate = (y + 0.5) / (n + 1)

    def strength(groups):  # (labels, rate around which they lie)
        n = sum(len(g) for g, _ in groups)
        m = sum(len(g) * r for g, r in groups) / n
        s = sum(len(g) * (sum(g) / len(g) - r) ** 2 for g, r in groups)
        spread = (s - (len(groups) - 1) * m * (1 - m)) / max(n - sum(len(g) ** 2 for g, _ in groups) / n, 1e-9)
        return min(max(m * (1 - m) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6

    k = strength([(g, rate) for g in hosts.values()])
    host = {s: (sum(g) + k * rate) / (len(g) + k) for s, g in hosts.items()}
    q = strength([(g, host[s]) for (s, _), g in paths.items()])
    out = []
    for i, (d, _, la, s) in enumerate(docs):
        own = [marks[d]] if d in marks else []
        g, h = paths.get((s, f"{s}/{la}"), own), hosts.get(s, own)
        hr = (sum(h) - sum(own) + k * rate) / (len(h) - len(own) + k)
        pr = (sum(g) - sum(own) + q * hr) / (len(g) - len(own) + q)
        out.append((d, hr, pr, 1 / (1 + np.exp(-(evidence(i) + np.log(pr / (1 - pr)))))))
    return out, rate


def test_posteriors_by_brute_force(spark):
    """Few and many labels, repeated documents, a document at two sites, a host whose only label is its own document's."""
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(300):
        site = f"s{int(rng.integers(0, 12)) ** 2}"
        docs.append((i, f"some words about number {i}", ["en", "de"][i % 2], site))
        if i % 3:
            labels.append((i, int(rng.random() < (0.9 if site in ("s0", "s1", "s4", "s9") else 0.2)), 0))
    docs += [docs[1], docs[1], docs[2], (4, docs[4][1], "en", "s1"), (4, docs[4][1], "de", "s1"), (900, "alone", "en", "only"), (901, "new", "fr", "s0")]
    labels += [(900, 1, 0), (7, 0, 0), (7, 1, 0), (5000, 1, 0), (None, 1, 0)]
    got, rows = score(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    _, rate = brute_quality(docs, labels, lambda i: 0.0)
    logit = lambda p: np.log(p / (1 - p))
    want, _ = brute_quality(docs, labels, lambda i: logit(got[docs[i][0]].p_document) - logit(rate))
    have = sorted((r.doc_id, round(r.host_rate, 9), round(r.path_rate, 9), round(r.score, 6)) for r in rows)
    assert have == sorted((d, round(h, 9), round(p, 9), round(float(s), 6)) for d, h, p, s in want)
    assert abs(got[900].host_rate - rate) < 1e-9


def test_quality_without_labels(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    _, out = score(docs, none)
    assert len(out) == len(rows) and all(abs(r.score - 0.5) < 1e-9 for r in out)
    _, out = score(empty, none)
    assert out == []


def test_site_query_on_the_fixture(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q.queries()["op5_site_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [got[r.doc_id].score for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [got[r.doc_id].score for r in labels if not (r.quality == 1 and r.toxic == 0)]
    assert np.mean(good) > np.mean(bad)


def test_sample_takes_distinct_texts_of_every_language(spark):
    """Ten texts with 100 copies each, whose hashes a share of the row count would leave out, and one with a small hash among others."""
    seen = [f"text number {i} of many" for i in range(3000)]
    hashed = {r.text: r.h for r in spark.createDataFrame([(t,) for t in seen], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    by_hash = sorted(seen, key=hashed.get)
    few, many = by_hash[-10:], by_hash[:200]
    rows = [(t, "aa") for t in few for _ in range(100)] + [(many[0], "bb")] * 500 + [(t, "bb") for t in many[1:]] + [(t, "cc") for t in seen[:7]]
    drawn = langid.sample_rows(spark.createDataFrame(rows, "text string, lang string").repartition(3), 50, 200).collect()
    got = {k: sorted(r.text for r in drawn if r.lang == k) for k in ("aa", "bb", "cc")}
    assert got == {"aa": sorted(few), "bb": sorted(many[:50]), "cc": sorted(seen[:7])}


def test_language_of_few_copied_texts_is_learned(spark):
    seen = [f"zwei drei vier {i} und fünf" for i in range(400)]
    hashed = {r.text: r.h for r in spark.createDataFrame([(t,) for t in seen], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    copied = sorted(seen, key=hashed.get)[-6:]
    rows = [(i, t, "de", "a") for i, t in enumerate(copied * 400)] + [(9000 + i, f"one two three {i} and four", "en", "a") for i in range(60)]
    model = langid.train(frame(spark, rows))
    assert model["langs"] == ["de", "en"]
    assert langid.classify(copied, model)[0] == ["de"] * 6


def test_copies_fall_on_one_side():
    idf = np.ones(langid.DIMS)
    sides = [{langid.held_back(*langid.vector(f"some text {i}", idf)) for _ in range(2)} for i in range(500)]
    assert all(len(s) == 1 for s in sides) and 50 < sum(s == {True} for s in sides) < 150


def test_texts_that_no_language_fits_go(spark):
    """Random letters, code, an unlearned script and mixed languages go; clean texts stay, short ones too."""
    rng = random.Random(11)
    clean = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert len({k for k, _, _ in clean}) == len(clean)
    by_lang = {}
    for _, text, lang in clean:
        by_lang.setdefault(lang, []).append(text)
    long = [(k, t, la) for k, t, la in clean if len(t) > 400]
    short = [(10_000 + i, " ".join(t.split()[3:15]), la) for i, (_, t, la) in enumerate(long[:200])]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (40, 120, 500, 2000) for _ in range(4)]
    junk += [f"for (int i = 0; i < n; ++i) {{ x[i] = foo(bar_{i}, i); }} return x;" for i in range(4)]
    junk += [f"Привет мир это текст на русском языке номер {i}" for i in range(4)]
    for _ in range(6):
        words = sum([" ".join(rng.sample(texts, 4)).split()[:60] for texts in by_lang.values()], [])
        rng.shuffle(words)
        junk.append(" ".join(words))
    rows = [(*r, "a") for r in clean + short] + [(20_000 + i, t, rng.choice(sorted(by_lang)), "a") for i, t in enumerate(junk)]
    kept = {r.doc_id for r in langid.drop_rejected(frame(spark, rows)).collect()}
    assert not [t[:60] for i, t in enumerate(junk) if 20_000 + i in kept]
    assert np.mean([k in kept for k, _, _ in clean]) > 0.99
    assert np.mean([k in kept for k, _, _ in short]) > 0.95


def test_every_training_text_is_fitted(spark, monkeypatch):
    """Texts beyond the 600 smallest hashes of a language teach it, in one shard or many, wherever its rows lie."""
    def by_hash(pattern, n):
        seen = spark.createDataFrame([(pattern.format(i),) for i in range(n)], "text string")
        return [r.text for r in seen.selectExpr("text", "xxhash64(text) h").orderBy("h").collect()]

    small = [(t, "aa") for t in by_hash("alpha beta {} gamma", 1500)[:700]] + [(t, "bb") for t in by_hash("unus duo {} tres", 1500)[:700]]
    large = [(t, "aa") for t in by_hash("привет мир {}", 700)[-300:]] + [(t, "bb") for t in by_hash("ενα δυο {} τρια", 700)[-300:]]
    rows = [(i, t, la, "a") for i, (t, la) in enumerate(small + large)] + [(5000 + i, f"zwei drei {i}", "cc", "a") for i in range(6)]
    docs = frame(spark, rows)
    model = langid.train(docs)
    assert langid.classify(["привет мир", "ενα δυο τρια"], model)[0] == ["aa", "bb"]
    monkeypatch.setattr(langid, "SHARD", 8000)
    many = langid.train(docs)
    assert langid.classify(["привет мир", "ενα δυο τρια", "zwei drei"], many)[0] == ["aa", "bb", "cc"]
    dealt = langid.train(docs.repartition(7, "lang"))
    assert (many["weights"] == dealt["weights"]).all() and many["temperature"] == dealt["temperature"]


def test_all_languages_are_learned(spark):
    """More lang values than the 200 most frequent."""
    rows = [(1000 * k + i, f"w{k}x{chr(0x4E00 + 9 * k)} {chr(0x4E00 + 9 * k)}{i}", f"l{k:03d}", "a") for k in range(203) for i in range(3 if k < 200 else 2)]
    assert len(langid.train(frame(spark, rows))["langs"]) == 203
