"""The pipeline's stages one after another, each against a plain version of itself on its own input."""

from collections import Counter

import public_tokenizers
from test_bpe import brute as plain_bpe
from test_jaccard import brute as plain_components
from tokenizers import Tokenizer

import corpus_pipeline
from moodspark.llm import mixing

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def plain_lines(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            holders.setdefault(key(line), set()).add(r.doc_id)
    out = []
    for r in rows:
        keep = [x for x in (r.text or "").split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == r.doc_id]
        out.append((r.doc_id, "\n".join(keep)))
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, numbers = docs.columns, [4, 8, 6, 10, 2]
    assert len(corpus_pipeline.STAGES) == len(numbers)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.collect()
        if i + 1 < len(numbers):
            assert docs.columns == columns
        if name == "language id":
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if any(c.isalpha() for c in r.text))
        elif name == "line dedup":
            assert sorted((r.doc_id, r.text) for r in after) == sorted(plain_lines(before))
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "jaccard join":
            want = plain_components([(r.doc_id, r.text) for r in before], 5, 80, 100)
            assert sorted(r.doc_id for r in after) == sorted(k for k, _, c in want if k == c)
        elif name == "source mix":
            report = mixing.mix_report(spark.createDataFrame(before)).collect()
            copies = Counter(r.doc_id for r in after)
            size = {r.doc_id: len(r.text.split()) for r in before}
            assert all(copies[r.doc_id] * r.size == r.taken for r in report)
            assert all(copies[k] <= 2 for k in size)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = plain_bpe([(r.doc_id, r.text) for r in before], library)
            assert sorted(tuple(r)[:4] for r in after) == sorted(want)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and all(len(r.token_ids) == r.n_tokens for r in rows)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in rows) == sorted((r.doc_id, r.ids_sha256) for r in again)


def test_stages_on_edge_rows(spark, docs, empty, tmp_path):
    for label, df in (("edge", docs), ("empty", empty)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, df, SF).write.parquet(str(tmp_path / f"{label}{i}"))
            df = spark.read.parquet(str(tmp_path / f"{label}{i}"))
        assert df.columns[:2] == ["doc_id", "n_tokens"]
        assert (df.count() > 0) == (label == "edge")
