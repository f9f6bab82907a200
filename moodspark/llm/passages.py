"""Removal of repeated byte strings with a Burrows-Wheeler transform.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere
is found exactly and removed.

1. Anchors: every window of LENGTH bytes picks the smallest hash among its
   substrings of ``GRAM`` bytes (the leftmost of equals), so equal windows pick
   equal anchors. Consecutive windows with one anchor are a run, and a run's
   bytes are its region. Runs are counted per anchor; anchors met once are done.
2. Regions that are equal as a whole (anchor hash and digest, 128 bits) are
   repeated throughout. Only anchors with different regions go on, each
   distinct region once.
3. Regions of one anchor meet in one task, several anchors at a time. Their
   rotations are sorted (prefix doubling), and threshold-bounded interval
   expansion derives the common prefixes: boundaries of value v are extended
   backward through the transform to those of value v + 1, breadth first, and
   the expansion stops at LENGTH. Boundaries never reached have a common prefix
   of at least LENGTH, and their windows are repeated.
4. An anchor with more distinct regions than a task sorts at once (2**21 bytes)
   has its windows counted one by one instead (128-bit hashes, combined before
   the shuffle), so no group is unbounded and none is cut.
5. Repeated windows become byte ranges per document; texts are read again and
   cut. Only documents in a fixed-size bitmap of affected keys are shuffled.

A passage of many words can be shorter than LENGTH bytes. ``shared_ranges`` finds
those that another text holds too, by the same steps over words: windows of WORDS
words, anchors of words, and rotations of word sequences. Nothing is removed for
them; they are reported beside. Copies of one text don't count as another text.

Cases: null text is empty; texts shorter than LENGTH lose nothing; matches
never cross documents; a string may repeat inside one text, overlapping
itself; repeated rows remove each other; rows are told apart by doc_id (null is
a value) and a hash of the text; the bytes that stay need not be UTF-8; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import narrow, text_or_empty
from moodspark.session import materialize

LENGTH = 400
WORDS = 51
SORTED = 1 << 21  # bytes sorted at once: three numbers of 21 bits fit a sort key
BITS = 1 << 24
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POS = np.uint64((1 << 30) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * _P)


class _Powers:
    """Powers of the rolling hash and their inverses, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _P, dtype=np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _Q, dtype=np.uint64)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _totals(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every prefix, and the inverse powers that shift a difference to place 0."""
    n = len(values)
    up, down = _POWERS.upto(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * up, out=total[1:])
    return total, down


def word_values(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word, ``[^\\x20\\x09-\\x0D]+``, of a text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    space = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    first, stop = edges[::2], edges[1::2]
    total, down = _totals(_byte_values()[data])
    return _mix((total[stop] - total[first]) * down[first]) if len(first) else np.empty(0, dtype=np.uint64)


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each run of a text of at least ``length`` bytes."""
    return _runs(_byte_values()[data], length, gram)


def _runs(values: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = len(values), length - gram + 1
    total, down = _totals(values)
    h = _mix((total[gram:] - total[:-gram]) * down[:n - gram + 1])
    low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[:len(low) - (width - step)], low[width - step:])
    at = (low & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], first, last


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _run_pass(length: int, gram: int, words: bool = False):
    schema = pa.schema([("ah", pa.int64()), ("rd", pa.int64()), ("did", pa.int64()), ("rk", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out):
            ah, rd, lo, hi = (np.concatenate([o[i] for o in out]) for i in range(4))
            counts = [len(o[0]) for o in out]
            did = pa.array([x for o, c in zip(out, counts) for x in [o[4]] * c], pa.int64())
            rk = pa.array(np.repeat(np.array([o[5] for o in out], dtype=np.int64), counts))
            return pa.RecordBatch.from_arrays([pa.array(ah), pa.array(rd), did, rk, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], schema=schema)

        for batch in batches:
            out, rows = [], 0
            for did, rk, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                values = word_values(raw) if words else np.frombuffer(raw, dtype=np.uint8)
                if len(values) < length:
                    continue
                ah, lo, hi = _runs(values, length, gram) if words else runs(values, length, gram)
                digest, size = xxhash.xxh3_64_intdigest, values.itemsize
                raw = values.tobytes() if words else raw
                rd = np.array([digest(raw[a * size:b * size]) for a, b in zip(lo.tolist(), (hi + length).tolist())], dtype=np.uint64)
                out.append((_signed(ah), _signed(rd), lo, hi, did, rk))
                rows += len(ah)
                if rows > 200_000:
                    yield flush(out)
                    out, rows = [], 0
            if out:
                yield flush(out)
    return run


def sorted_rotations(data: np.ndarray, least: int) -> np.ndarray:
    """Places of all rotations of ``data``, sorted by at least their first ``least`` symbols (prefix doubling)."""
    n = len(data)
    used = np.zeros(int(data.max()) + 1, dtype=np.int64)
    used[data] = 1
    code = (np.cumsum(used) - 1)[data]
    bits = max(1, int(code.max()).bit_length())
    place_bits = max(1, (n - 1).bit_length())
    places = np.arange(n, dtype=np.int64)
    known = max(1, (63 - place_bits) // bits)
    key = np.zeros(n, dtype=np.int64)
    for j in range(known):
        key = (key << bits) | np.roll(code, -j)
    small = 3 * place_bits <= 63
    while True:
        packed = np.sort((key << place_bits) | places) if small else None
        order = packed & ((1 << place_bits) - 1) if small else np.argsort(key, kind="stable")
        ranked = packed >> place_bits if small else key[order]
        new = np.concatenate([[False], ranked[1:] != ranked[:-1]])
        if known >= least or new[1:].all():
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        key = (rank << place_bits) | np.roll(rank, -known)
        known *= 2


def long_boundaries(data: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Mask over sorted places i > 0: the rotations at i - 1 and i share at least ``least`` symbols.

    Breadth-first backward extension: with boundaries of value v known, the
    next place of a symbol after such a boundary, its last place lying before
    it, is mapped by the transform to a boundary of value v + 1 (unless that
    one has a smaller value already).
    """
    n = len(data)
    transform = data[order - 1]  # the symbol before each rotation
    by_symbol = np.argsort(transform, kind="stable")
    to = np.empty(n, dtype=np.int64)
    to[by_symbol] = np.arange(n)
    sorted_symbols = transform[by_symbol]
    fresh = np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]])
    before = np.full(n, -1, dtype=np.int64)  # the last place with the same symbol
    before[by_symbol[1:][~fresh[1:]]] = by_symbol[:-1][~fresh[1:]]
    reached = np.zeros(n + 1, dtype=bool)
    now = np.flatnonzero(fresh)
    reached[now] = True
    # a place whose neighbour before has the same symbol extends its own boundary only
    heads = np.flatnonzero((before >= 0) & (before != np.arange(n) - 1))
    follows = np.zeros(n, dtype=bool)
    follows[1:] = transform[1:] == transform[:-1]
    marks = np.zeros(n + 1, dtype=np.int32)
    for _ in range(least - 1):
        if not len(now):
            break
        direct = to[now[follows[now]]]
        direct = direct[~reached[direct]]
        reached[direct] = True
        if len(heads):
            if len(now) * 8 > n:
                marks[:] = 0
                marks[now + 1] = 1
                total = np.cumsum(marks, dtype=np.int32)
                hit = total[heads + 1] > total[before[heads] + 1]
            else:
                now.sort()
                hit = np.searchsorted(now, heads, "right") > np.searchsorted(now, before[heads], "right")
            met = to[heads[hit]]
            met = met[~reached[met]]
            reached[met] = True
            heads = heads[~hit]
            now = np.concatenate([direct, met])
        else:
            now = direct
    return ~reached[:n]


def repeated_windows(regions: list[bytes], length: int) -> list[np.ndarray]:
    """Of each region, the offsets whose next ``length`` bytes also start elsewhere in the regions."""
    sizes = np.array([len(r) + 1 for r in regions])
    data = np.frombuffer(b"\0".join(regions) + b"\0", dtype=np.uint8).astype(np.int64) + 1
    heads = np.cumsum(sizes) - sizes
    data[heads + sizes - 1] = 0
    order = sorted_rotations(data, length)
    long_ = long_boundaries(data, order, length)
    long_[0] = False
    both = long_.copy()
    both[:-1] |= long_[1:]
    found = np.zeros(len(data), dtype=bool)
    found[order[both]] = True
    return [np.flatnonzero(found[a:a + max(0, s - length)]) for a, s in zip(heads, sizes)]


def shared_windows(regions: list[bytes], low: list[int], high: list[int], length: int) -> list[np.ndarray]:
    """Of each region of word hashes, the offsets whose next ``length`` words another text holds too.

    A region's owners are the texts holding it; ``low`` and ``high`` are their
    smallest and largest keys.
    """
    values = [np.frombuffer(r, dtype=np.uint64) for r in regions]
    sizes = np.array([len(v) + 1 for v in values])
    heads = np.cumsum(sizes) - sizes
    ends = heads + sizes - 1
    data = np.zeros(int(sizes.sum()), dtype=np.int64)
    inside = np.ones(len(data), dtype=bool)
    inside[ends] = False
    data[inside] = np.unique(np.concatenate(values), return_inverse=True)[1] + 1
    order = sorted_rotations(data, length)
    fresh = ~long_boundaries(data, order, length)
    fresh[0] = True
    starts = np.flatnonzero(fresh)  # sorted places between two of them share their first ``length`` words
    least = np.minimum.reduceat(np.repeat(np.array(low, dtype=np.int64), sizes)[order], starts)
    most = np.maximum.reduceat(np.repeat(np.array(high, dtype=np.int64), sizes)[order], starts)
    found = np.zeros(len(data), dtype=bool)
    found[order] = np.repeat(least != most, np.diff(np.append(starts, len(data))))
    return [np.flatnonzero(found[a:a + max(0, s - length)]) for a, s in zip(heads, sizes)]


_RANGES = pa.schema([("did", pa.int64()), ("rk", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _as_ranges(found: list[tuple], length: int) -> pa.RecordBatch:
    did, rk, start, stop = [], [], [], []
    for d, r, lo, at in found:
        cut = np.flatnonzero(np.diff(at) > 1)
        for a, b in zip(np.append(0, cut + 1), np.append(cut, len(at) - 1)):
            did.append(d)
            rk.append(r)
            start.append(lo + int(at[a]))
            stop.append(lo + int(at[b]) + length)
    return pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(rk, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], schema=_RANGES)


def _sort_pass(length: int):
    """Streams regions sorted by anchor; whole anchors are sorted together up to about half of SORTED bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            if len(rows) < 2:
                return None
            found = repeated_windows([r[3] for r in rows], length)
            return _as_ranges([(r[0], r[1], r[2], at) for r, at in zip(rows, found) if len(at)], length)

        held, held_bytes, group, group_bytes, now = [], 0, [], 0, None
        for batch in batches:
            for ah, did, rk, lo, region in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if ah != now:
                    if held and held_bytes + group_bytes > SORTED // 2:
                        out = flush(held)
                        if out is not None:
                            yield out
                        held, held_bytes = [], 0
                    held += group
                    held_bytes += group_bytes
                    now, group, group_bytes = ah, [], 0
                group.append((did, rk, lo, region))
                group_bytes += len(region) + 1
        if held and held_bytes + group_bytes > SORTED // 2:
            out = flush(held)
            if out is not None:
                yield out
            held = []
        out = flush(held + group)
        if out is not None:
            yield out
    return run


def _region_pass(length: int):
    schema = pa.schema([("ah", pa.int64()), ("did", pa.int64()), ("rk", pa.int64()), ("lo", pa.int32()), ("region", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for did, rk, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = text.encode()
                out += [(w["ah"], did, rk, w["lo"], raw[w["lo"]:w["hi"] + length]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)
    return run


def _window_pass(length: int):
    """Every window of the regions of an anchor that is too common to be sorted at once."""
    schema = pa.schema([("ah", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()), ("rk", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ah, did, rk, lo, region in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for k in range(len(region) - length + 1):
                    h = xxhash.xxh3_128_intdigest(region[k:k + length])
                    out.append((ah, (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), did, rk, lo + k))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)
    return run


_PART = "ah long, rd long, start int, stop int"


def _word_region_pass(length: int):
    """Regions, as word hashes, of each text; equal texts come once."""
    kinds = [("ah", pa.int64()), ("rd", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]
    schema = pa.schema([*kinds, ("region", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = word_values(text.encode())
                out += [(*(w[k] for k, _ in kinds), values[w["lo"]:w["hi"] + length].tobytes()) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)
    return run


def _word_sort_pass(length: int):
    """As _sort_pass, over words: offsets in a region, by anchor and digest."""
    schema = pa.schema([("ah", pa.int64()), ("rd", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            if len(rows) < 2:
                return
            found = shared_windows([r[4] for r in rows], [r[2] for r in rows], [r[3] for r in rows], length)
            ranges = _as_ranges([(r[0], r[1], 0, at) for r, at in zip(rows, found) if len(at)], length)
            yield pa.RecordBatch.from_arrays(ranges.columns, schema=schema)

        held, n_held, group, n_group, now = [], 0, [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    if held and n_held + n_group > SORTED // 2:
                        yield from flush(held)
                        held, n_held = [], 0
                    held, n_held = held + group, n_held + n_group
                    now, group, n_group = row[0], [], 0
                group.append(row)
                n_group += len(row[4]) // 8 + 1
        if held and n_held + n_group > SORTED // 2:
            yield from flush(held)
            held = []
        yield from flush(held + group)
    return run


def _word_window_pass(length: int):
    """As _window_pass, over words."""
    names = ("ah", "rd", "low", "high", "h1", "h2")
    schema = pa.schema([*((k, pa.int64()) for k in names), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *row, region in zip(*(c.to_pylist() for c in batch.columns)):
                for k in range(len(region) // 8 - length + 1):
                    h = xxhash.xxh3_128_intdigest(region[8 * k:8 * (k + length)])
                    out.append((*row, (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), k))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)
    return run


def _bitmap(keys: DataFrame) -> DataFrame:
    """word, bits: a bitmap of BITS bits over a hash of (did, rk), whatever the number of keys."""
    slot = f"pmod(xxhash64(did, rk), {BITS})"
    return keys.groupBy(F.expr(f"{slot} div 64").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} % 64 as int))")).alias("bits"))


def _split(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that may be among ``keys``, and those that surely aren't."""
    slot = f"pmod(xxhash64(did, rk), {BITS})"
    marked = (docs.withColumn("word", F.expr(f"{slot} div 64")).join(F.broadcast(_bitmap(keys)), "word", "left")
              .withColumn("maybe", F.expr(f"coalesce((bits & shiftleft(1L, cast({slot} % 64 as int))) <> 0, false)")))
    kept = marked.drop("word", "bits")
    return kept.where("maybe").drop("maybe"), kept.where("not maybe").drop("maybe")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = narrow(docs, doc_id=id_col, text=text_col)
    return base.select(F.col("doc_id").cast("long").alias("did"), F.xxhash64("text").alias("rk"), text_or_empty().alias("text"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """did, rk, start, stop: byte ranges (they may overlap) that make up all repeated strings.

    ``docs`` has did, rk, text.
    """
    gram = gram or length // 2
    most = SORTED // (2 * length - gram + 1)
    kinds = "ah long, rd long, did long, rk long, lo int, hi int"
    # written, so that the joins with their own counts deal both sides anew and AQE can split a hot anchor
    found = materialize(docs.mapInArrow(_run_pass(length, gram), kinds))
    status = materialize(found.groupBy("ah").agg(F.count("*").alias("c"), F.min("rd").alias("x"), F.max("rd").alias("y"))
                         .where("c > 1").select("ah", (F.col("x") != F.col("y")).alias("mixed")))
    again = materialize(found.join(status, "ah"))
    stop = (F.col("hi") + length).cast("int").alias("stop")
    ranges = again.where("not mixed").select("did", "rk", F.col("lo").alias("start"), stop)

    mixed = again.where("mixed")
    regions = materialize(mixed.groupBy("ah", "rd").agg(F.count("*").alias("c"), F.min(F.struct("did", "rk", "lo", "hi")).alias("r")))
    whole = mixed.join(regions.where("c > 1").select("ah", "rd"), ["ah", "rd"])
    ranges = ranges.unionByName(whole.select("did", "rk", F.col("lo").alias("start"), stop))

    common = regions.groupBy("ah").agg(F.count("*").alias("d")).where(F.col("d") > most).select("ah", F.lit(True).alias("common"))
    reps = (regions.groupBy(F.col("r.did").alias("did"), F.col("r.rk").alias("rk"))
            .agg(F.collect_list(F.struct("ah", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))).alias("wanted")))
    reps = materialize(reps)
    near, _ = _split(docs, reps.select("did", "rk"))
    texts = (near.join(reps.withColumnRenamed("did", "d2").withColumnRenamed("rk", "k2"),
                       F.col("did").eqNullSafe(F.col("d2")) & (F.col("rk") == F.col("k2")))
             .select("did", "rk", "text", "wanted"))
    cut = texts.mapInArrow(_region_pass(length), "ah long, did long, rk long, lo int, region binary")
    cut = materialize(cut.join(common, "ah", "left"))
    columns = ["ah", "did", "rk", "lo", "region"]
    sorted_ = (cut.where("common is null").select(*columns).repartition(F.col("ah")).sortWithinPartitions("ah")
               .mapInArrow(_sort_pass(length), "did long, rk long, start int, stop int"))
    windows = materialize(cut.where("common").select(*columns).mapInArrow(
        _window_pass(length), "ah long, h1 long, h2 long, did long, rk long, start int"))
    twice = materialize(windows.groupBy("ah", "h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("ah", "h1", "h2"))
    single = windows.join(twice, ["ah", "h1", "h2"]).select("did", "rk", "start", (F.col("start") + length).cast("int").alias("stop"))
    return ranges.unionByName(sorted_).unionByName(single)


def shared_ranges(docs: DataFrame, words: int = WORDS, gram: int | None = None) -> DataFrame:
    """did, rk, start, stop: word ranges (they may overlap) that make up all passages of ``words`` words in another text too.

    ``docs`` has did, rk, text; rk tells texts apart.
    """
    gram = gram or max(1, words // 4)
    most = SORTED // (2 * words - gram + 1)
    owners = [F.min("rk").alias("low"), F.max("rk").alias("high")]
    several = F.col("low") != F.col("high")
    found = materialize(docs.mapInArrow(_run_pass(words, gram, True), "ah long, rd long, did long, rk long, lo int, hi int"))
    met = materialize(found.groupBy("ah").agg(*owners).where(several).select("ah"))
    again = materialize(found.join(met, "ah"))
    regions = materialize(again.groupBy("ah", "rd").agg(*owners, F.min(F.struct("did", "rk", "lo", "hi")).alias("r")))
    whole = (again.join(regions.where(several).select("ah", "rd"), ["ah", "rd"])
             .select("did", "rk", F.col("lo").alias("start"), (F.col("hi") + words).cast("int").alias("stop")))

    mixed = regions.groupBy("ah").agg(F.count("*").alias("d")).where("d > 1").select("ah", (F.col("d") > most).alias("common"))
    mixed = materialize(mixed)
    wanted = F.struct("ah", "rd", "low", "high", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    reps = materialize(regions.join(mixed, "ah").groupBy(F.col("r.did").alias("d2"), F.col("r.rk").alias("k2"))
                       .agg(F.collect_list(wanted).alias("wanted")))
    near, _ = _split(docs, reps.select(F.col("d2").alias("did"), F.col("k2").alias("rk")))
    texts = (near.dropDuplicates(["did", "rk"]).join(reps, F.col("did").eqNullSafe(F.col("d2")) & (F.col("rk") == F.col("k2")))
             .select("text", "wanted"))
    columns = ["ah", "rd", "low", "high", "region"]
    cut = texts.mapInArrow(_word_region_pass(words), "ah long, rd long, low long, high long, region binary")
    cut = materialize(cut.join(mixed, "ah"))
    parts = (cut.where("not common").select(*columns).repartition(F.col("ah")).sortWithinPartitions("ah")
             .mapInArrow(_word_sort_pass(words), _PART))
    windows = materialize(cut.where("common").select(*columns).mapInArrow(
        _word_window_pass(words), "ah long, rd long, low long, high long, h1 long, h2 long, start int"))
    twice = (windows.groupBy("ah", "h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
             .where(several).select("ah", "h1", "h2"))
    single = windows.join(twice, ["ah", "h1", "h2"]).select("ah", "rd", "start", (F.col("start") + words).cast("int").alias("stop"))
    parts = parts.unionByName(single).select("ah", "rd", "start", "stop")
    inside = again.join(parts, ["ah", "rd"]).select("did", "rk", (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("stop")).alias("stop"))
    return whole.unionByName(inside)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_SHARED = ", n_passages long, n_passage_words long"


def _cut_pass(with_kept: bool | str, with_shared: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept", pa.string() if with_kept == "text" else pa.binary())] if with_kept else []
    schema = pa.schema(fields + ([("n_passages", pa.int64()), ("n_passage_words", pa.int64())] if with_shared else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            starts, shared = (batch.column(i).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows for i in (2, 3))
            for did, text, ranges, passages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), starts, shared):
                raw = text.encode()
                spans = merged([(r["start"], r["stop"]) for r in ranges or ()])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                row = [did, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
                row += [kept.decode("utf-8", "replace") if with_kept == "text" else kept] if with_kept else []
                held = merged([(r["start"], r["stop"]) for r in passages or ()])
                out.append(row + ([len(held), sum(b - a for a, b in held)] if with_shared else []))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, with_kept: bool | str = False, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    ``with_kept``: also the kept bytes, or with "text" the same as text (bytes of
    a character that a cut went through show as U+FFFD). ``words``: also n_passages
    and n_passage_words, the maximal runs made of passages of that many words that
    another text holds too, and the words in them, judged on the input.
    """
    rows = _keyed(docs, "doc_id", "text")
    ranges = repeated_ranges(rows, length, gram).withColumn("shared", F.lit(False))
    if words:
        ranges = ranges.unionByName(shared_ranges(rows, words).withColumn("shared", F.lit(True)))
    place = F.struct("start", "stop")
    spans = materialize(ranges.groupBy("did", "rk").agg(
        F.collect_list(F.when(~F.col("shared"), place)).alias("ranges"), F.collect_list(F.when(F.col("shared"), place)).alias("passages")))
    maybe, sure = _split(rows, spans.select("did", "rk"))
    joined = maybe.join(spans.withColumnRenamed("did", "d2").withColumnRenamed("rk", "k2"),
                        F.col("did").eqNullSafe(F.col("d2")) & (F.col("rk") == F.col("k2")), "left").select("did", "text", "ranges", "passages")
    kinds = _REPORT + (", kept string" if with_kept == "text" else ", kept binary" if with_kept else "") + (_SHARED if words else "")
    run = _cut_pass(with_kept, bool(words))
    return joined.mapInArrow(run, kinds).unionByName(sure.select("did", "text").mapInArrow(run, kinds))
