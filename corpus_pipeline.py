"""The training-corpus pipeline: stages over ``documents``, each written as Parquet and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from moodspark.llm import bpe, jaccard, langid, line_dedup, mixing
from moodspark.llm.queries import tokenizer_path
from moodspark.session import scratch_path, ship_package

#: A fitted language model and the tokenizer can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark, docs, sf_dir):
    """Documents without a letter, or that the language model can't place (junk, code, mixed or unlearned languages), go."""
    ship_package(spark)
    return langid.drop_rejected(docs)


def dedup_lines(spark, docs, sf_dir):
    """Lines that three or more documents share stay in the last of them only."""
    ship_package(spark)
    return line_dedup.dedup_lines(docs)


def join_near_duplicates(spark, docs, sf_dir):
    """Of documents linked by 0.8 or more of their five-word shingles, the one with the smallest id stays."""
    ship_package(spark)
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def mix_sources(spark, docs, sf_dir):
    """Sources share 150 % of all words by weight; a document comes 0, 1 or 2 times."""
    ship_package(spark)
    return mixing.mix(docs)


def encode_tokens(spark, docs, sf_dir):
    """Token ids of every text, with digests of the ids and of the decoded text."""
    ship_package(spark)
    return bpe.encode(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language id", identify_language),
    ("line dedup", dedup_lines),
    ("jaccard join", join_near_duplicates),
    ("source mix", mix_sources),
    ("bpe encoding", encode_tokens),
]


def run(spark, sf_dir):
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
