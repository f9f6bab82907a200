"""Order MinHash: against a plain version, and on the edges."""

import hashlib

import numpy as np
from rowcheck import same

from moodspark.llm import fingerprints as fp


def plain(text):
    """Select, reorder and hash without any shortcut."""
    h = fp.kmer_hashes(text)
    seen, numbered = {}, []
    for x in h.tolist():
        k = seen.get(x, 0)
        seen[x] = k + 1
        numbered.append(x if k == 0 else int(fp._mix(np.array([x], np.uint64) + np.array([k], np.uint64) * fp._C1)[0]))
    bins = {}
    for at, x in enumerate(numbered):
        bins.setdefault(x >> (64 - fp._BIN_BITS), []).append((x, at))
    out = np.zeros(fp.BINS, np.uint32)
    for b, members in bins.items():
        chosen = sorted(sorted(members)[:fp.TUPLE], key=lambda m: m[1])
        total = 0
        for rank, (x, _) in enumerate(chosen):
            total += int(fp._mix(np.array([x], np.uint64) + np.array([rank], np.uint64) * fp._C1)[0])
        out[b] = max(1, int(fp._mix(np.array([total & (2 ** 64 - 1)], np.uint64))[0]) >> 32)
    return out


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (key, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1] or ""
        text = text or ""
        changed = fp.edited(text, following)
        a, b = plain(text), plain(changed)
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(),
                    fp.likeness(a, b), fp.likeness(a, plain(following))))
    return out


def test_fixture_against_plain(spark, fixture_docs):
    got = [tuple(r) for r in fp.fingerprint_neighbours(fixture_docs).collect()]
    same(got, brute([(r.doc_id, r.text) for r in fixture_docs.collect()]))


def test_edges(spark, docs, rows, empty):
    got = [tuple(r) for r in fp.fingerprint_neighbours(docs, partitions=5).collect()]
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert by[400][0][3] == "0" * (fp.BINS * 8) and by[400][0][1] == 0
    assert by[0][0][3] == by[200][0][3]  # equal texts, equal fingerprints
    assert len(by[0]) == 3 and len({r[3] for r in by[0]}) == 1
    assert fp.fingerprint_neighbours(empty).collect() == []


def test_one_row_is_its_own_next(spark):
    df = spark.createDataFrame([(5, "alone with itself for ever")], "doc_id long, text string")
    row = fp.fingerprint_neighbours(df).collect()[0]
    assert row.near_next == 1.0


def test_order_matters():
    rng = np.random.default_rng(2)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 2000))
    moved = text[1000:] + text[:1000]
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(text)) == 1.0
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(moved)) < 1.0
