"""BPE against the tokenizers library, and the round trip."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from rowcheck import same
from tokenizers import Tokenizer

from moodspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    return bpe.load_vocabulary(PATH)


def brute(rows, library):
    out = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wire = np.array(ids, dtype="<u4").tobytes()
        back = library.decode(ids, skip_special_tokens=False)
        out.append((key, len(ids), hashlib.sha256(wire).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def test_fixture_and_edges(spark, fixture_docs, docs, rows, empty, library):
    got = [tuple(r) for r in bpe.encode(fixture_docs, PATH).collect()]
    same(got, brute([(r.doc_id, r.text) for r in fixture_docs.collect()], library))
    got = [tuple(r) for r in bpe.encode(docs, PATH).collect()]
    same(got, brute([(r[0], r[1]) for r in rows], library))
    assert bpe.encode(empty, PATH).collect() == []


def test_random_strings(library, vocab):
    rng = random.Random(11)
    parts = list("aabstremlvd'' '\n\t  .,09é中²½\x1c\x85\xa0🙂_-<|") + ["<|endoftext|>", "'re", "'ll", " '", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, " " * 99, "'s's'll"]
    ids, totals = bpe.encode_batch(texts, vocab)
    edges = np.append(0, np.cumsum(totals))
    for i, (text, want) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        assert ids[edges[i]:edges[i + 1]].tolist() == want.ids, text
    assert [b.decode() for b in bpe.decode_batch(ids, totals, vocab)] == texts


def test_bad_bytes_decode_as_the_library(library, vocab):
    ids = [vocab["byte_id"][b] for b in (0xE4, 0xB8, 0x41, 0xFF)]
    got = bpe.decode_batch(np.array(ids, dtype=np.int32), np.array([4]), vocab)[0].decode()
    assert got == library.decode([int(i) for i in ids], skip_special_tokens=False)


def test_token_ids_come_along(spark, docs):
    row = bpe.encode(docs.where("doc_id = 404"), PATH, with_ids=True).collect()[0]
    assert len(row.token_ids) == row.n_tokens
