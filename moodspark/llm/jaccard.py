"""N-gram Jaccard join over a token-group matrix.

A document is the set of its distinct word shingles (64-bit hashes). Documents
with equal sets are one class, so copies cost one set. The exact join of the
classes runs as follows.

1. Tokens are ordered rarest first: heavy hitters, counted in every task over
   all rows, come last. The first ``n - ceil(t n) + 1`` tokens of a set (its
   prefix) must meet the prefix of any set with similarity t.
2. Partition: each shared prefix token votes for the smallest class that has it;
   a class joins the group of its most voted leader and of its own size (in
   steps of ``STEP``). The matrix holds, for each group, the union of its
   members' prefix tokens (only tokens of two or more classes matter).
3. Bound: a class that meets m tokens of a group's union overlaps any member
   in at most ``m + t max(n, s)`` tokens; where that is below what the sizes
   need, the group stays closed.
4. Open: the members of a group and the classes that qualified for it form a
   list. Lists are cut into hashed blocks of about ``BLOCK``; two neighbouring
   blocks are a unit. Units first compare parity bitmaps of their sets (a bit
   per token or less): differing bits are a lower bound of the symmetric
   difference, so a class whose bound rules out every partner leaves before its
   tokens are read. The rest is compared as a product of incidence matrices; a
   task returns a spanning forest of its links, never its pairs. A list of one
   block is done with that. In longer lists, what the links so far join into
   the list's largest component needs no more comparison among itself; all the
   others are compared with every block.

Components are those of the links; sets are compared exactly (as sets of
64-bit hashes). The only broadcast tables are the heavy hitters (``HOT`` at
most; they only steer the order) and a bitmap of fixed size.

Cases: null and empty texts have no shingles, link with nothing and are their
own component; texts with fewer words than a shingle are one shingle; rows
that share a doc_id or have none take part like others, a component's id being
its smallest non-null doc_id; repeated rows get repeated results; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import narrow, repeat_ranges, text_or_empty
from moodspark.llm.graph import connected_components
from moodspark.session import materialize, written

HOT = 50_000
STEP = 1.02
BLOCK = 64
BITS = 1 << 24
_CHUNK = 1_000_000  # characters worked on at once
_POOL = 700_000  # tokens counted at once for heavy hitters
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str], width: int, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [t.encode().lower() for t in texts]  # bytes.lower touches A-Z only
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    heads = np.cumsum([0, *[len(r) + 1 for r in raw]])[:-1]
    word = ~_IS_SPACE[data]
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    ends = np.flatnonzero(~word & before)
    lengths = ends - starts
    flat = repeat_ranges(starts, lengths)
    offset = flat - np.repeat(starts, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _A, dtype=np.uint64))
    values = np.add.reduceat((data[flat].astype(np.uint64) + np.uint64(1)) * power[offset], np.cumsum(lengths) - lengths)
    values = _mix(values + lengths.astype(np.uint64) + np.uint64(seed))
    bounds = np.searchsorted(starts, np.append(heads, len(data)))
    rolled = values[: max(0, len(values) - width + 1)].copy()
    for j in range(1, width):
        rolled = rolled * _A + values[j: len(values) - width + 1 + j]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            s = np.sort(rolled[a:b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            total = b - a
            for x in values[a:b]:
                total = (int(total) * 0x9E3779B97F4A7C15 + int(x)) & 0xFFFFFFFFFFFFFFFF
            out.append(_mix(np.array([total], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit hashes of a set; the second tells classes apart that share the first."""
    s = np.uint64(2 * seed + 1)
    with np.errstate(over="ignore"):
        first = np.add.reduce(_mix(tokens * _A + s), dtype=np.uint64)
        second = np.add.reduce(_mix(tokens * _C + s + np.uint64(1)), dtype=np.uint64)
    return int(np.int64(first.view(np.int64))), int(np.int64(second.view(np.int64)))


def parity(tokens: np.ndarray) -> bytes:
    """Bit b is the parity of the tokens whose hash ends in b; a power of two of bits, at least one per token."""
    size = 64
    while size < len(tokens):
        size *= 2
    counts = np.bincount((_mix(tokens) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    """Parity bitmaps of a smaller size: halves added up without carry."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def possible(sizes: np.ndarray, bits: list[bytes], side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets of a unit may link with another one (if any is marked by ``side``, with or as a marked one)."""
    alive = np.zeros(len(sizes), dtype=bool)
    width = np.array([len(b) // 8 for b in bits])
    groups = {w: np.flatnonzero(width == w) for w in np.unique(width)}
    matrix = {w: np.stack([np.frombuffer(bits[i], dtype=np.uint64) for i in at]) for w, at in groups.items()}
    for a in groups:
        for b in groups:
            if b < a:
                continue
            left, right = groups[a], groups[b]
            folded = _folded(matrix[b], a)
            step = max(1, (1 << 20) // (a * len(right)))
            for k in range(0, len(left), step):
                part = left[k:k + step]
                apart = np.bitwise_count(matrix[a][k:k + step][:, None, :] ^ folded[None, :, :]).sum(axis=2, dtype=np.int64)
                total = sizes[part][:, None] + sizes[right][None, :]
                both = np.minimum((total - apart) // 2, np.minimum(sizes[part][:, None], sizes[right][None, :]))
                ok = (den * both >= num * (total - both)) & (part[:, None] != right[None, :])
                if side.any():
                    ok &= (side[part][:, None] + side[right][None, :]) > 0
                alive[part] |= ok.any(axis=1)
                alive[right] |= ok.any(axis=0)
    return alive


def _chunks(columns: list, most: int = _CHUNK):
    """Consecutive pieces of parallel columns, the last of which are texts, of about ``most`` characters."""
    texts = columns[-1]
    begin, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield [c[begin:i] for c in columns]
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield [c[begin:] for c in columns]


def _first_pass(width: int, seed: int):
    """kind 0: a row's class; kind 1: a token that is frequent in its pool, with its count."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("rk", pa.int64()), ("c1", pa.int64()),
                        ("c2", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def frequent(pool: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(pool))
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        counts = np.diff(np.append(starts, len(every)))
        often = counts >= 4
        tokens, counts = every[starts[often]].view(np.int64), counts[often].astype(np.int64)
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int32)), none, none, pa.array(tokens), none,
                                           pa.array(counts), pa.nulls(len(tokens), pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, pooled = [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for ids, keys, texts in _chunks(columns):
                sets = shingle_sets(texts, width)
                made = [class_key(s, seed) for s in sets]
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(k, np.int32)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                     pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary())], schema=schema)
                pool += [s for s in sets if len(s)]
                pooled += sum(len(s) for s in sets)
                if pooled > _POOL:
                    yield frequent(pool)
                    pool, pooled = [], 0
        if pool:
            yield frequent(pool)
    return run


def prefix_length(n, num: int, den: int):
    return n - (num * n + den - 1) // den + 1


def _prefix_pass(width: int, seed: int, num: int, den: int, hot):
    """token, c1, n: the prefix tokens of the rows, one row per class and chunk."""
    schema = pa.schema([("token", pa.int64()), ("c1", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = hot.value
        for batch in batches:
            for (texts,) in _chunks([batch.column(0).to_pylist()]):
                seen, tokens, owners, sizes = set(), [], [], []
                for s in shingle_sets(texts, width):
                    if not len(s):
                        continue
                    key = class_key(s, seed)[0]
                    if key in seen:
                        continue
                    seen.add(key)
                    p = int(prefix_length(len(s), num, den))
                    if len(known):
                        at = np.searchsorted(known, s)
                        at[at == len(known)] = 0
                        weight = np.where(known[at] == s, rank[at], 0)
                        if weight.any():
                            s_ = s[np.argsort(weight, kind="stable")[:p]]  # hash order among equals
                        else:
                            s_ = s[:p]
                    else:
                        s_ = s[:p]
                    tokens.append(s_)
                    owners.append(np.full(len(s_), key, dtype=np.int64))
                    sizes.append(np.full(len(s_), len(s), dtype=np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)),
                                                      pa.array(np.concatenate(sizes))], schema=schema)
    return run


def _set_pass(width: int, seed: int):
    """c1, tokens of the texts that are asked for; hash neighbours of another class fall out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("c1", pa.int64()), ("tokens", pa.binary())])
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2)]
            for wanted, texts in _chunks(columns):
                sets = shingle_sets(texts, width)
                keep = [(c, s.tobytes()) for c, s in zip(wanted, sets) if len(s) and class_key(s, seed)[0] == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in keep], pa.int64()), pa.array([b for _, b in keep], pa.binary())], schema=schema)
    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of one unit: products of incidence matrices, cut by columns."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(tokens)))
    shared = np.repeat(counts > 1, counts)
    column = (np.cumsum(new[shared]) - 1) if shared.any() else np.zeros(0, np.int64)
    owner = owner[shared]
    out = np.zeros((m, m))
    step = max(1, (1 << 21) // m)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + step, step))
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            x = np.zeros((m, step), dtype=np.float32)
            x[owner[a:b], column[a:b] - column[a] // step * step] = 1
            out += x @ x.T
    return out.astype(np.int64)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric link matrix."""
    m = len(linked)
    root = np.arange(m)
    for i in range(m):
        near = np.flatnonzero(linked[i, :i])
        if len(near):
            roots = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, roots)] = roots[0]
    return [(i, int(r)) for i, r in enumerate(root) if i != r]


def compare(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links of one unit. ``side`` 1 marks the ones compared with all; if none is marked, all are."""
    if len(keys) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    if len(keys) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        ok = den * both >= num * (sizes.sum() - both)
        return [(int(keys[1]), int(keys[0]))] if ok else []
    both = overlaps(sets)
    union = sizes[:, None] + sizes[None, :] - both
    linked = (den * both >= num * union) & (keys[:, None] != keys[None, :])
    if side.any():
        linked &= (side[:, None] + side[None, :]) > 0
    return [(int(keys[i]), int(keys[j])) for i, j in forest(linked)]


def _units_of(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list[tuple], bool]]:
    """Units of a stream sorted by its first two columns: (grp, unit), the other columns' rows, batch at an end."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns))):
            if row[:2] != now:
                if rows:
                    yield now, rows, False
                now, rows = row[:2], []
            rows.append(row[2:])
        yield now, [], True
    if rows:
        yield now, rows, False
    yield now, [], True


def _sieve_pass(num: int, den: int):
    """grp, unit, side, c1 of the classes that may link within their unit; rows (grp, unit, side, c1, n, bits)."""
    schema = pa.schema([("grp", pa.int64()), ("unit", pa.int64()), ("side", pa.int32()), ("c1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (unit, rows, ended) in _units_of(batches, 6):
            if len(rows) > 1:
                sizes = np.array([r[2] for r in rows], dtype=np.int64)
                alive = possible(sizes, [r[3] for r in rows], np.array([r[0] for r in rows]), num, den)
                out += [(*unit, rows[i][0], rows[i][1]) for i in np.flatnonzero(alive)]
            if ended and out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)
                out = []
    return run


def _unit_pass(num: int, den: int):
    """Spanning links of each unit; rows (grp, unit, side, c1, tokens)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = []
        for (_, rows, ended) in _units_of(batches, 5):
            if len(rows) > 1:
                keys, first = np.unique(np.array([r[1] for r in rows], dtype=np.int64), return_index=True)
                mark = {}
                for side, key, _ in rows:
                    mark[key] = max(mark.get(key, 0), side)
                sets = [np.frombuffer(rows[i][2], dtype=np.uint64) for i in first]
                links += compare(keys, sets, np.array([mark[int(k)] for k in keys]), num, den)
            if ended and links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], schema=schema)
                links = []
    return run


def _sieved(units: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    rows = units.join(signs, "c1").select("grp", "unit", "side", "c1", "n", "bits")
    dealt = rows.repartition(F.col("grp"), F.col("unit")).sortWithinPartitions("grp", "unit")
    return materialize(dealt.mapInArrow(_sieve_pass(num, den), "grp long, unit long, side int, c1 long"))


def _run_units(units: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    rows = units.join(sets, "c1").select("grp", "unit", "side", "c1", "tokens")
    dealt = rows.repartition(F.col("grp"), F.col("unit")).sortWithinPartitions("grp", "unit")
    return materialize(dealt.mapInArrow(_unit_pass(num, den), "a long, b long"))


def classes(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray], int]:
    """Per row: doc_id, rk (hash of the text), c1, n; the heavy hitters; the seed of the class hashes."""
    base = narrow(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), text_or_empty().alias("text"))
    seed = 0
    while True:
        made = materialize(base.mapInArrow(_first_pass(width, seed), "kind int, doc_id long, rk long, c1 long, c2 long, n long, bits binary"))
        rows = made.where("kind = 0").select("doc_id", "rk", "c1", "c2", "n", "bits")
        clash = rows.groupBy("c1").agg(F.min("c2").alias("x"), F.max("c2").alias("y")).where("x <> y").limit(1).count()
        if not clash:
            break
        seed += 1  # two different sets share a 64-bit class hash: hash anew
    often = (made.where("kind = 1").groupBy(F.col("c1").alias("token")).agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "token").limit(HOT).toPandas())
    tokens = often["token"].to_numpy(dtype=np.int64).view(np.uint64)
    counts = often["n"].to_numpy(dtype=np.int64)
    order = np.argsort(tokens)
    return rows, (tokens[order], counts[order]), seed


def _maybe_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``keys``: a broadcast bitmap of BITS bits, whatever their number."""
    slot = f"pmod({key}, {BITS})"
    bitmap = keys.groupBy(F.expr(f"{slot} div 64").alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} % 64 as int))")).alias("_bits"))
    marked = df.withColumn("_word", F.expr(f"{slot} div 64")).join(F.broadcast(bitmap), "_word")
    return marked.where(F.expr(f"(_bits & shiftleft(1L, cast({slot} % 64 as int))) <> 0")).drop("_word", "_bits")


def _lists(rows: DataFrame, num: int, den: int) -> DataFrame:
    """grp, c1: members of each group and the classes whose bound opens it; groups of one fall out."""
    shared = materialize(rows.groupBy("token").agg(F.min("c1").alias("g"), F.max("c1").alias("x")).where("g <> x").select("token", "g"))
    # most tokens are in one class only; a bitmap of fixed size lets most of them stay out of the join's shuffle
    hits = materialize(_maybe_among(rows, "token", shared).join(shared, "token").select("token", "c1", "n", "g").distinct())
    votes = hits.groupBy("c1", "g").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    leader = votes.groupBy("c1").agg(F.first("n").alias("n"), F.max(F.struct("k", F.bitwise_not("g").alias("m"))).alias("top"))
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(STEP)))
    group = leader.select("c1", "n", F.xxhash64(F.col("top.m"), size).alias("grp"))
    matrix = (hits.join(group.select("c1", "grp"), "c1").groupBy("token", "grp")
              .agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    t = num / den
    n = F.col("n").cast("double")
    fits = (F.col("hi") >= n * t - 1e-9) & (F.col("lo") <= n / t + 1e-9)
    met = (hits.select("token", "c1", "n").join(matrix, "token").where(fits).groupBy("c1", "grp")
           .agg(F.first("n").alias("n"), F.count("*").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    low, high = F.greatest(F.col("lo").cast("double"), n * t), F.least(F.col("hi").cast("double"), n / t)
    need = lambda s: t * (n + s) / (1 + t) - t * F.greatest(n, s)
    opened = met.where(F.col("m") + 1e-6 >= F.least(need(low), need(high))).select("grp", "c1")
    lists = group.select("grp", "c1").unionByName(opened).distinct()
    sizes = lists.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1")
    return lists.join(sizes, "grp").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("c1", "grp"), F.col("blocks")).cast("int")).drop("size")


def _wanted_sets(docs: DataFrame, wanted: DataFrame, rows: DataFrame, width: int, seed: int) -> DataFrame:
    """c1, tokens of every class that is wanted, from one of its texts."""
    least = F.min(F.struct("rk", "doc_id")).alias("one")
    reps = materialize(rows.select("c1", "rk", "doc_id").join(wanted, "c1").groupBy("c1").agg(least)
                       .select("c1", "one.rk", F.col("one.doc_id").alias("rid")))
    texts = docs.select(F.col("doc_id").cast("long").alias("did"), F.xxhash64("text").alias("rk"), text_or_empty().alias("text"))
    near = _maybe_among(texts, "rk", reps)
    # a row repeated in id and text gives its set as often; units take each class once
    return (near.join(reps, "rk").where(F.col("did").eqNullSafe(F.col("rid"))).select("c1", "text")
            .mapInArrow(_set_pass(width, seed), "c1 long, tokens binary"))


def class_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(doc_id, c1, n of every row; node, root of every class that links with another)."""
    spark = docs.sparkSession
    rows, hot, seed = classes(docs, width, num, den)
    shared = spark.sparkContext.broadcast(hot)
    prefixes = (docs.select(text_or_empty().alias("text"))
                .mapInArrow(_prefix_pass(width, seed, num, den, shared), "token long, c1 long, n int"))
    lists = materialize(_lists(prefixes, num, den))
    signs = materialize(rows.select("c1", "n", "bits").join(lists.select("c1").distinct(), "c1")
                        .groupBy("c1").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))
    # neighbouring blocks, in a ring: every class is in at most two units
    ring = F.array_distinct(F.array(F.col("block").cast("long"), F.pmod(F.col("block") + F.col("blocks") - 1, F.col("blocks")).cast("long")))
    first = _sieved(lists.select("grp", F.explode(ring).alias("unit"), F.lit(0).alias("side"), "c1"), signs, num, den)
    long_ = lists.where("blocks > 2")
    sets = materialize(_wanted_sets(docs, first.select("c1").unionByName(long_.select("c1")).distinct(), rows, width, seed)
                       .repartition("c1"))
    links = _run_units(first, sets, num, den)
    # long lists: all that is not in a list's largest component against every block
    roots = connected_components(links)
    placed = long_.join(roots.withColumnRenamed("node", "c1"), "c1", "left").withColumn("root", F.coalesce("root", "c1"))
    main = (placed.groupBy("grp", "root").agg(F.count("*").alias("k")).groupBy("grp")
            .agg(F.max(F.struct("k", "root")).alias("top")).select("grp", F.col("top.root").alias("main")))
    rest = placed.join(main, "grp").where("root <> main").select("grp", "c1", "blocks")
    parts = rest.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rest = (materialize(rest.join(parts, "grp"))
            .withColumn("part", F.pmod(F.xxhash64("c1", "grp", F.lit(1)), F.col("parts")).cast("long")))
    unit = F.col("part") * F.col("blocks") + F.col("block")
    asked = (rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("grp", unit.alias("unit"), F.lit(1).alias("side"), "c1"))
    against = (lists.join(parts, "grp").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
               .select("grp", unit.alias("unit"), F.lit(0).alias("side"), "c1"))
    more = _run_units(_sieved(asked.unionByName(against), signs, num, den), sets, num, den)
    return rows.drop("bits"), connected_components(links.unionByName(more))


def components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; sets link at similarity num / den or more."""
    rows, roots = class_components(docs, width, num, den)
    alone = F.col("n") == 0
    placed = (rows.join(roots.withColumnRenamed("node", "c1"), "c1", "left")
              .select("doc_id", "n", F.when(~alone, F.coalesce("root", "c1")).alias("root")))
    named = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(named, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with exactly one row of each component, and all rows without shingles.

    The row with the smallest doc_id stays (null last); of several with that id
    the one whose text has the smallest hash, of equal rows in both the one with
    the smallest hash of all columns.
    """
    rows, roots = class_components(docs, width, num, den)
    placed = (rows.where("n > 0").join(roots.withColumnRenamed("node", "c1"), "c1", "left")
              .select("doc_id", "rk", F.coalesce("root", "c1").alias("root")))
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rk")
    least = placed.groupBy("root").agg(F.min(place).alias("one"))
    judged = placed.groupBy("doc_id", "rk", "root").agg(F.count("*").alias("_n")).join(least, "root")
    # keys of rows that go (_one false) and of equal rows of which one stays
    marks = materialize(judged.where((place != F.col("one")) | (F.col("_n") > 1)).groupBy(F.col("doc_id").alias("_d"), F.col("rk").alias("_k")).agg(
        F.min(place == F.col("one")).alias("_one")))
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_rk"))
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_rk") == F.col("_k"))
    if not marks.where("_one").limit(1).count():  # no equal rows among those that stay
        return packed.join(marks, same, "left_anti").select("_row.*")
    left = written(packed.join(marks, same, "left").where("_one is null or _one").select("_row", "_id", "_rk", "_one"), "components")
    single = left.where("_one").groupBy("_id", "_rk").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return left.where("_one is null").select("_row.*").unionAll(single.select("_row.*"))
