"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are taken in batches of a bounded number of characters. A batch is cut
into words by array comparisons on character classes, equal words are encoded
once, and the symbols of all distinct words lie in one flat array: each round
looks up all neighbouring pairs by binary search over the sorted pair keys,
takes the lowest rank of every word, and merges it everywhere it stands
(leftmost first). Words without a mergeable pair leave the rounds.

The vocabulary file is read on the driver from a path that the caller gives
and broadcast as four arrays (its size is that of the file, not of the data).

Cases: null text is empty and gives no ids; the special tokens of the file are
found in the text first, as the tokenizers library does; characters are
classed by Python's Unicode tables; a text longer than a batch is a batch of
its own; repeated rows give repeated results; further columns pass untouched.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import narrow, repeat_ranges, text_or_empty

_NONE = np.iinfo(np.int32).max
BATCH_CHARS = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, of_byte = spec["model"]["vocab"], byte_symbols()
    to_byte = {c: b for b, c in enumerate(of_byte)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *special.values()]) + 1
    raw = [b""] * size
    for token, i in vocab.items():
        raw[i] = bytes(to_byte[c] for c in token)
    for token, i in special.items():
        raw[i] = token.encode()
    keys, ranks, made = [], [], []
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        keys.append(vocab[a] * size + vocab[b])
        ranks.append(rank)
        made.append(vocab[a + b])
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    lengths = np.array([len(x) for x in raw], dtype=np.int64)
    return {"size": size, "special": special, "byte_id": np.array([vocab[c] for c in of_byte], dtype=np.int32),
            "keys": np.array(keys, dtype=np.int64)[order], "ranks": np.array(ranks, dtype=np.int32)[order],
            "made": np.array(made, dtype=np.int32)[order], "bytes": np.frombuffer(b"".join(raw), dtype=np.uint8),
            "start": np.cumsum(lengths) - lengths, "length": lengths}


# fixed values: Unicode White_Space
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    kinds = {"L": 1, "N": 2}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[[ord(c) for c in _SPACES]] = 3
    return table


def word_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mask of the code points that start a word; ``first`` marks the start of each piece of text.

    Words: an English contraction; a run of letters, of numbers or of other
    characters, each with one blank before it; white space, whose last
    character goes with what follows if that is a blank, else stands alone.
    """
    n = len(chars)
    cls = _classes()[chars]
    prev = np.empty_like(cls)
    prev[1:] = cls[:-1]
    prev[first] = 255
    nxt = np.empty_like(cls)
    nxt[:-1] = cls[1:]
    nxt[-1] = 255
    ends = np.flatnonzero(first)[1:] - 1
    nxt[ends] = 255
    space = cls == 3
    start = first | (cls != prev)
    # the last of a run of white space before something else is a word of its own or joins what follows
    before_word = space & (nxt != 3) & (nxt != 255)
    start |= before_word
    joins = np.zeros(n, dtype=bool)
    joins[1:] = before_word[:-1] & (chars[:-1] == 32) & ~first[1:]
    start &= ~joins
    for i in np.flatnonzero((chars == 39) & start):
        for suffix in ((115,), (116,), (114, 101), (118, 101), (109,), (108, 108), (100,)):
            end = i + 1 + len(suffix)
            if end <= n and not first[i + 1:end].any() and tuple(chars[i + 1:end]) == suffix:
                start[i + 1:end] = False
                if end < n and not first[end]:
                    _restart(start, first, cls, chars, end, n)
                break
    return start


def _restart(start, first, cls, chars, i, n):
    """After a contraction the scan starts anew at i, which may lie inside a run."""
    joined = chars[i] == 32 and i + 1 < n and not first[i + 1] and cls[i + 1] != 3
    start[i] = True
    if joined:
        start[i + 1] = False


def _lookup(left: np.ndarray, right: np.ndarray, vocab: dict) -> np.ndarray:
    """Place of each pair among the sorted pair keys, -1 where it can't merge."""
    keys = vocab["keys"]
    if not len(keys):
        return np.full(len(left), -1, dtype=np.int32)
    pair = left.astype(np.int64) * vocab["size"] + right
    at = np.searchsorted(keys, pair).astype(np.int32)
    at[at == len(keys)] = 0
    return np.where(keys[at] == pair, at, np.int32(-1))


def _byte_pairs(vocab: dict) -> np.ndarray:
    """The places of all pairs of bytes, looked up once per vocabulary."""
    if "byte_pairs" not in vocab:
        b = vocab["byte_id"]
        vocab["byte_pairs"] = _lookup(np.repeat(b, 256), np.tile(b, 256), vocab)
    return vocab["byte_pairs"]


def merge_rounds(data: np.ndarray, word: np.ndarray, vocab: dict) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and their word, in order, for the bytes of words 0, 1, 2, ..."""
    made = vocab["made"]
    ranks = np.append(vocab["ranks"], _NONE)  # place -1 reads the last
    symbols = vocab["byte_id"][data]
    at = np.full(len(symbols), -1, dtype=np.int32)
    if len(data) > 1:
        same = word[1:] == word[:-1]
        at[:-1][same] = _byte_pairs(vocab)[data[:-1][same].astype(np.int64) * 256 + data[1:][same]]
    done_ids, done_words = [], []
    while len(symbols):
        rank = ranks[at]
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low = np.minimum.reduceat(rank, heads)
        lowest = np.repeat(low, np.diff(np.append(heads, len(symbols))))
        open_ = lowest != _NONE
        if not open_.all():
            done_ids.append(symbols[~open_])
            done_words.append(word[~open_])
            symbols, word, rank, lowest, at = (x[open_] for x in (symbols, word, rank, lowest, at))
            if not len(symbols):
                break
        # of neighbours that overlap (a a a) every second one merges, from the left
        chosen = np.flatnonzero(rank == lowest)
        if len(chosen) > 1 and (np.diff(chosen) == 1).any():
            run = np.concatenate([[0], np.cumsum(np.diff(chosen) != 1)])
            first = np.flatnonzero(np.concatenate([[True], np.diff(run) != 0]))
            chosen = chosen[(np.arange(len(chosen)) - first[run]) % 2 == 0]
        symbols[chosen] = made[at[chosen]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[chosen + 1] = False
        symbols, word, at = symbols[keep], word[keep], at[keep]
        # only pairs beside a merged symbol are new
        fresh = chosen - np.arange(len(chosen))
        beside = np.zeros(len(symbols), dtype=bool)
        beside[fresh] = True
        beside[fresh[fresh > 0] - 1] = True
        fresh = np.flatnonzero(beside)
        at[fresh] = -1
        fresh = fresh[fresh + 1 < len(symbols)]
        fresh = fresh[word[fresh] == word[fresh + 1]]
        at[fresh] = _lookup(symbols[fresh], symbols[fresh + 1], vocab)
    if not done_ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ids, words = np.concatenate(done_ids), np.concatenate(done_words)
    order = np.argsort(words, kind="stable")
    return ids[order], words[order]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _distinct_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of a representative of each distinct word, and for each word its distinct word.

    Words are grouped by a 64-bit hash and then compared byte by byte with
    their representative; the rare ones that differ stand for themselves.
    """
    power = np.cumprod(np.full(int(lengths.max()), _MIX, dtype=np.uint64))
    offset = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    mixed = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[offset], starts)
    mixed ^= lengths.astype(np.uint64) << np.uint64(40)
    _, rep, inverse = np.unique(mixed, return_index=True, return_inverse=True)
    mine = rep[inverse]
    odd = lengths[mine] != lengths
    same = data[np.repeat(starts[mine], lengths) + offset] == data if not odd.any() else None
    if same is not None and not same.all():
        odd = ~np.logical_and.reduceat(same, starts)
    if odd.any():
        alone = np.flatnonzero(odd)
        inverse = inverse.copy()
        inverse[alone] = len(rep) + np.arange(len(alone))
        rep = np.concatenate([rep, alone])
    return rep, inverse


def encode_batch(texts: list[str], vocab: dict) -> tuple[np.ndarray, np.ndarray]:
    """Flat token ids of all texts, and the number of ids of each."""
    special = vocab["special"]
    cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
    pieces, owner, fixed = [], [], []
    for i, text in enumerate(texts):
        for piece in (cut.split(text) if cut and any(s in text for s in special) else [text]):
            if piece:
                pieces.append(piece)
                owner.append(i)
                fixed.append(special.get(piece, -1))
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    chars = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    heads = np.cumsum(sizes) - sizes
    first = np.zeros(len(chars), dtype=bool)
    first[heads] = True
    start = word_starts(chars, first)
    fixed = np.array(fixed)
    for k in np.flatnonzero(fixed >= 0):
        start[heads[k] + 1:heads[k] + sizes[k]] = False
    data = np.frombuffer("".join(pieces).encode(), dtype=np.uint8)
    width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    at = (np.cumsum(width) - width)[start]
    lengths = np.diff(np.append(at, len(data)))
    piece_of = np.cumsum(first)[start] - 1
    rep, inverse = _distinct_words(data, at, lengths)
    span = lengths[rep]
    ids, words = merge_rounds(data[repeat_ranges(at[rep], span)], np.repeat(np.arange(len(rep)), span), vocab)
    per = np.bincount(words, minlength=len(rep))
    begin = np.cumsum(per) - per
    which = fixed[piece_of]
    counts = np.where(which >= 0, 1, per[inverse])
    flat = np.empty(int(counts.sum()), dtype=np.int32)
    where = np.cumsum(counts) - counts
    plain = which < 0
    flat[repeat_ranges(where[plain], counts[plain])] = ids[repeat_ranges(begin[inverse[plain]], counts[plain])]
    flat[where[~plain]] = which[~plain]
    totals = np.bincount(np.array(owner)[piece_of], weights=counts, minlength=len(texts)).astype(np.int64)
    return flat, totals


def decode_batch(ids: np.ndarray, totals: np.ndarray, vocab: dict) -> list[bytes]:
    """UTF-8 of each decoded text; bytes that are no UTF-8 become the replacement character."""
    length = vocab["length"][ids]
    data = vocab["bytes"][repeat_ranges(vocab["start"][ids], length)]
    ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(totals))]
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        raw = data[a:b].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        out.append(raw)
    return out


def batches(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts with about ``most`` characters each."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield begin, i
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids) of every row."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(path))
    # ids travel as text: pandas would turn a column with nulls into floating point
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = shared.value
        for frame in frames:
            texts, keys = frame["text"].tolist(), frame["doc_id"]
            for a, b in batches(texts):
                ids, totals = encode_batch(texts[a:b], vocab)
                edges = np.append(0, np.cumsum(totals))
                wire = ids.astype("<u4")
                spans = list(zip(edges[:-1], edges[1:]))
                out = {"doc_id": keys.iloc[a:b].to_numpy(), "n_tokens": totals,
                       "ids_sha256": [hashlib.sha256(wire[x:y]).hexdigest() for x, y in spans],
                       "decoded_sha256": [hashlib.sha256(raw).hexdigest() for raw in decode_batch(ids, totals, vocab)]}
                if with_ids:
                    out["token_ids"] = [ids[x:y] for x, y in spans]
                yield pd.DataFrame(out)

    base = narrow(docs, doc_id=id_col, text=text_col)
    done = base.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, schema)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
