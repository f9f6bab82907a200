"""Order MinHash fingerprints of whole texts.

Every k-mer of a text is numbered by its occurrence, hashed with that number,
and falls into one of ``BINS`` bins by its top bits. Per bin the ``TUPLE``
smallest k-mers are selected, put back in text order, and their tuple is hashed
to one value of the fingerprint. Moving text changes the order inside tuples,
so likeness (the share of equal values among bins that either text fills)
follows edit distance, not only set overlap.

Neighbours in doc_id order come from a range-partitioned sort: a task streams
its rows and holds one text; the last text of a task meets the first of the
next task in a join with one row per task.

Cases: null text is empty; the empty text has an empty fingerprint (all
zeros), and two empty fingerprints have likeness 1; texts shorter than a k-mer
are one k-mer; null ids sort first; rows that share an id follow each other by
a hash of their text, and repeated rows are each other's neighbours; a single
row is its own next; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm.common import narrow, row_key, text_or_empty
from moodspark.session import materialize

KMER = 8  # a power of two
BINS = 32  # a power of two
TUPLE = 2

_BIN_BITS = BINS.bit_length() - 1
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << (64 - _BIN_BITS)) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def kmer_hashes(text: str) -> np.ndarray:
    """Hashes of the k-mers in text order (one for a shorter text, none for an empty one)."""
    chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if not len(chars):
        return chars
    h = (chars + np.uint64(1)) * _C1
    h ^= h >> np.uint64(32)
    if len(h) < KMER:
        total = np.uint64(len(h))
        for x in h:
            total = np.uint64((int(total) * int(_C1) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        return _mix(np.array([total]))
    step, factor = 1, int(_C2)
    while step < KMER:
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = step * 2, (factor * factor) & 0xFFFFFFFFFFFFFFFF
    return _mix(h)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence number); first occurrences keep their hash."""
    n = len(h)
    bits = np.uint64(n.bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((h & ~mask) | np.arange(n, dtype=np.uint64))
    group = packed >> bits
    new = np.concatenate([[True], group[1:] != group[:-1]])
    if new.all():
        return h
    starts = np.flatnonzero(new)
    number = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    again = number > 0
    where = (packed & mask).astype(np.int64)[again]
    out = h.copy()
    out[where] = _mix(h[where] + number[again].astype(np.uint64) * _C1)
    return out


def _smallest(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the TUPLE smallest hashes of each bin, and their bins."""
    n = len(h)
    some = None
    if n > 16 * BINS * TUPLE:  # the smallest lie far below this bound; if a bin is short, all are looked at
        bound = np.uint64(int(int(_LOW) * 12 * TUPLE * BINS / n))
        some = np.flatnonzero((h & _LOW) < bound)
    for at in ([some] if some is not None else []) + [np.arange(n)]:
        at = at[np.argsort(h[at], kind="stable")]
        bins = (h[at] >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        counts = np.bincount(bins, minlength=BINS)
        if len(at) == n or counts.min() >= TUPLE:
            break
    rank = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    take = rank < TUPLE
    return at[take], bins[take]


def fingerprint(text: str) -> np.ndarray:
    """BINS unsigned 32-bit values; 0 marks an empty bin."""
    out = np.zeros(BINS, dtype=np.uint32)
    h = kmer_hashes(text)
    if not len(h):
        return out
    h = numbered(h)
    at, bins = _smallest(h)
    order = np.lexsort((at, bins))
    at, bins = at[order], bins[order]
    starts = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    rank = (np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))).astype(np.uint64)
    value = np.add.reduceat(_mix(h[at] + rank * _C1), starts)
    value = (_mix(value) >> np.uint64(32)).astype(np.uint32)
    out[bins[starts]] = np.maximum(value, 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != 0) | (b != 0)
    n = int(filled.sum())
    return 1.0 if n == 0 else float(((a == b) & filled).sum() / n)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def _row(key, text, mine, following, theirs) -> tuple:
    changed = edited(text, following)
    fp = fingerprint(changed)
    return (key, len(text), hashlib.sha256(changed.encode()).hexdigest(), mine.tobytes(), fp.tobytes(),
            likeness(mine, fp), likeness(mine, theirs))


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fp", "efp", "near_edited", "near_next"]
# ids travel as text: pandas would turn a column with nulls into floating point
_TYPES = "doc_id string, n_chars long, edited_sha256 string, fp binary, efp binary, near_edited double, near_next double"


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    frame["n_chars"] = frame["n_chars"].astype("Int64")
    return frame


def _stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind 0: done; 1: the last row of the task, still without its next; 2: the first row."""
    task = TaskContext.get().partitionId()
    columns = ["kind", "task", "text", *_RESULT]
    last = None
    for frame in frames:
        out = []
        for key, text in zip(frame["doc_id"], frame["text"]):
            fp = fingerprint(text)
            if last is None:
                out.append((2, task, text, key, None, None, fp.tobytes(), None, None, None))
            else:
                out.append((0, task, None, *_row(*last, text, fp)))
            last = (key, text, fp)
        if out:
            yield _frame(out, columns)
    if last is not None:
        key, text, fp = last
        yield _frame([(1, task, text, key, None, None, fp.tobytes(), None, None, None)], columns)


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [_row(k, t, np.frombuffer(f, dtype=np.uint32), t2, np.frombuffer(f2, dtype=np.uint32))
                for k, t, f, t2, f2 in zip(frame["doc_id"], frame["text"], frame["fp"], frame["next_text"], frame["next_fp"])]
        yield _frame(rows, _RESULT)


def fingerprint_neighbours(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row."""
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = narrow(docs, doc_id=id_col, text=text_col)
    rows = base.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("_rk"), text_or_empty().alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", "_rk").sortWithinPartitions("doc_id", "_rk").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    passed = materialize(dealt.mapInPandas(_stream, "kind int, task int, text string, " + _TYPES))
    # one row per task: bounded by the partition count
    order = Window.orderBy("task")
    whole = Window.partitionBy()
    last = passed.where("kind = 1").select("task", "doc_id", "text", "fp")
    first = passed.where("kind = 2").select(F.col("task").alias("next"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    chain = (passed.where("kind = 2").select("task")
             .withColumn("next", F.coalesce(F.lead("task").over(order), F.min("task").over(whole))))
    ends = last.join(chain, "task").join(first, "next").select("doc_id", "text", "fp", "next_text", "next_fp")
    done = passed.where("kind = 0").select(*_RESULT).unionByName(ends.mapInPandas(_finish, _TYPES))
    text = lambda c: F.lower(F.hex(c))
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "n_chars", "edited_sha256", text("fp").alias("fingerprint"),
                       text("efp").alias("edited_fingerprint"), "near_edited", "near_next")
