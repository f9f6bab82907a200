"""Hard-negative mining by coordinate pruning over length buckets (LEMP).

Vectors are grouped by length (an eighth of a power of two per bucket) and cut
into blocks of about ``BLOCK``. A block holds, besides its vectors, the list of
its members sorted by value for every coordinate of their unit vectors. An
anchor's least useful score, divided by its own length and the block's longest,
is a least cosine; a vector within that angle has each coordinate within a range
around the anchor's. For the anchor's ``FOCUS`` largest coordinates two binary
searches give that range of the sorted list, the ranges' members are
intersected, and what is left is verified by exact integer products: one by one
where few are left, else in one product for all such anchors of the block.

Two passes over the blocks. The first finds each anchor's positives (the
highest scores among its own label) under a threshold that rises with the k-th
best so far; the second, per anchor and positive, the highest scores of other
labels inside the positive's window, whose lower end is a threshold from the
start: blocks whose longest vector can't reach it are not even dealt. In both,
groups of anchors stay resident while slices of blocks stream past
(``operators.cells``), and what the cells leave, at most k rows per anchor (or
anchor and positive), is merged by score and id.

Cases: rows with a null id, label or vector, or a null or non-finite component,
take no part; a candidate with the anchor's own id never counts; rows repeated
in id, label and vector are one anchor but repeated candidates, and a repeated
positive has its negatives once per repetition; rows that share an id but not
the vector or label are anchors of their own; ties go to the smaller id;
vectors of different length never meet; anchors without positives, or whose
windows are empty, leave no row; scores beyond a long stop at its ends; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm.common import narrow
from moodspark.llm.topk import product
from moodspark.operators import cells
from moodspark.session import materialize

BLOCK = 4096
GROUP = 8192   # anchors in a group
FOCUS = 4      # coordinates whose ranges are intersected
FEW = 0.25     # share of a block up to which what is left of it is verified anchor by anchor
_CHUNK = 1024  # anchors in one product
_EXACT = 2.0 ** 53


def participants(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """vec_id, label, v (array of long), dim of the rows that take part; n: how often each occurs."""
    base = narrow(df, vec_id=id_col, x=vec_col, label=label_col).dropna()
    x = F.transform("x", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = base.where(fine).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
    return rows.groupBy("vec_id", "label", "v").agg(F.count("*").alias("n")).withColumn("dim", F.size("v"))


def _below(score: np.ndarray) -> np.ndarray:
    """The integers as doubles that are not above them."""
    out = score.astype(np.float64)
    return np.where(np.abs(out) < _EXACT, out, np.nextafter(out, -np.inf))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in vectors])


def _pack_block(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per block, longest first: ids, labels, vectors and, per coordinate, the members in order of their unit value."""
    frame = frame.sort_values(["norm", "vec_id"], ascending=[False, True], kind="stable")
    data = _matrix(frame["v"])
    norms = np.sqrt((data.astype(float) ** 2).sum(axis=1))
    order = np.argsort(data / np.where(norms > 0, norms, 1)[:, None], axis=0, kind="stable").T
    small = np.abs(data).max(initial=0) < 2 ** 31
    row = {k: frame[k].iloc[0] for k in ("dim", "bucket", "block")}
    row |= {"ids": frame["vec_id"].to_numpy(dtype=np.int64).tobytes(), "labels": frame["label"].to_numpy(dtype=np.int64).tobytes(),
            "data": data.astype(np.int32 if small else np.int64).tobytes(), "sorted": order.astype(np.uint16 if len(data) < 2 ** 16 else np.uint32).tobytes(),
            "longest": float(norms.max(initial=0.0))}
    return pd.DataFrame([row])


def _pack_anchors(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["label", "vec_id"], kind="stable")
    return pd.DataFrame([{"dim": frame["dim"].iloc[0], "grp": frame["grp"].iloc[0], "ids": frame["vec_id"].to_numpy(dtype=np.int64).tobytes(),
                          "labels": frame["label"].to_numpy(dtype=np.int64).tobytes(), "data": _matrix(frame["v"]).tobytes()}])


class Block:
    """A block as it streams past: vectors, unit vectors and sorted coordinate lists."""

    def __init__(self, ids: bytes, labels: bytes, data: bytes, lists: bytes, dim: int):
        self.ids, self.labels = np.frombuffer(ids, dtype=np.int64), np.frombuffer(labels, dtype=np.int64)
        n = len(self.ids)
        self.data = np.frombuffer(data, dtype=np.int32 if len(data) == 4 * n * dim else np.int64).reshape(n, dim).astype(np.int64)
        self.order = np.frombuffer(lists, dtype=np.uint16 if len(lists) == 2 * n * dim else np.uint32).reshape(dim, n)
        self.floats = self.data.astype(np.float64)
        self.norms = np.sqrt((self.floats ** 2).sum(axis=1))
        self.top = np.abs(self.floats).max(initial=0.0)
        self._values: dict[int, np.ndarray] = {}

    def values(self, f: int) -> np.ndarray:
        """The unit vectors' values of a coordinate, in order."""
        if f not in self._values:
            at = self.order[f]
            self._values[f] = self.floats[at, f] / np.where(self.norms[at] > 0, self.norms[at], 1)
        return self._values[f]

    def feasible(self, unit: np.ndarray, cosine: float) -> np.ndarray | None:
        """Members whose focus coordinates lie in the ranges that a cosine of at least ``cosine`` allows; None: all of them."""
        alive, within = None, np.arccos(min(1.0, cosine))
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            own = np.arccos(np.clip(unit[f], -1.0, 1.0))
            values = self.values(f)
            start = np.searchsorted(values, np.cos(min(np.pi, own + within)) - 1e-9, "left")
            stop = np.searchsorted(values, np.cos(max(0.0, own - within)) + 1e-9, "right")
            if stop - start == len(values):
                continue
            found = np.zeros(len(values), dtype=bool)
            found[self.order[f][start:stop]] = True
            alive = found if alive is None else alive & found
            if not alive.any():
                break
        return alive

    def hits(self, anchors: np.ndarray, norms: np.ndarray, least: np.ndarray, most: np.ndarray, columns: np.ndarray | None = None):
        """(anchor place, member, score) of all products between ``least`` and ``most`` of an anchor; members only out of ``columns``."""
        longest = self.norms.max(initial=0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where((least > 0) & (norms > 0), least * (1 - 1e-9) / (norms * max(longest, 1e-300)), -1.0)
        rows, members, scores, shared = [], [], [], []
        exact = np.abs(anchors).max(initial=0) * self.top * max(1, anchors.shape[1]) < _EXACT

        def multiply(q, index):
            if not exact:
                return product(q, self.data[index])
            part = self.floats if len(index) == len(self.ids) else self.floats[index]
            return (q.astype(np.float64) @ part.T).astype(np.int64)

        everyone = np.arange(len(self.ids)) if columns is None else columns
        for a in np.flatnonzero(cosine <= 1 + 1e-9):
            alive = self.feasible(anchors[a] / norms[a], cosine[a]) if cosine[a] > 0 else None
            if alive is None or alive.sum() > FEW * len(alive):
                shared.append(a)
                continue
            index = everyone[alive[everyone]]
            if len(index):
                s = multiply(anchors[a:a + 1], index)[0]
                ok = (s >= least[a]) & (s <= most[a])
                rows.append(np.full(int(ok.sum()), a))
                members.append(index[ok])
                scores.append(s[ok])
        for at in range(0, len(shared), _CHUNK):
            these = np.array(shared[at:at + _CHUNK])
            s = multiply(anchors[these], everyone)
            row, col = np.nonzero((s >= least[these][:, None]) & (s <= most[these][:, None]))
            rows.append(these[row])
            members.append(everyone[col])
            scores.append(s[row, col])
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x).astype(np.int64) if x else empty for x in (rows, members, scores))


class Best:
    """The ``k`` best (score, id) of each of ``n`` places; better is a higher score, then a smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.place, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = np.full(n, -np.inf)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(place):
            return
        place, score, ids = np.concatenate([self.place, place]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, place))
        place, score, ids = place[order], score[order], ids[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        keep = rank < self.k
        self.place, self.score, self.id, rank = place[keep], score[keep], ids[keep], rank[keep]
        full = rank == self.k - 1
        self.kth[self.place[full]] = _below(self.score[full])


_COLUMNS = ["dim", "grp", "slice", "kind", "ids", "labels", "data", "sorted"]


def _positives(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """First pass: the k best of each anchor among its own label, per cell."""
        now = None

        def finished():
            return pd.DataFrame({"dim": now[0], "grp": now[1], "place": best.place, "anchor_id": ids[best.place], "vec_id": best.id, "score": best.score})

        for frame in frames:
            for dim, grp, part, kind, its_ids, its_labels, data, lists in zip(*[frame[c] for c in _COLUMNS]):
                if kind == 0:
                    if now is not None:
                        yield finished()
                    now, ids, labels = (dim, grp, part), np.frombuffer(its_ids, dtype=np.int64), np.frombuffer(its_labels, dtype=np.int64)
                    anchors = np.frombuffer(data, dtype=np.int64).reshape(len(ids), dim)
                    norms, best = np.sqrt((anchors.astype(float) ** 2).sum(axis=1)), Best(len(ids), k)
                    continue
                block = Block(its_ids, its_labels, data, lists, dim)
                for label in np.intersect1d(labels, block.labels):
                    own = np.flatnonzero(labels == label)
                    row, member, score = block.hits(anchors[own], norms[own], best.kth[own], np.full(len(own), np.inf), np.flatnonzero(block.labels == label))
                    other = block.ids[member] != ids[own[row]]
                    best.add(own[row[other]], score[other], block.ids[member[other]])
        if now is not None:
            yield finished()
    return run


def window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest n with low * score <= 100 * n <= high * score."""
    whole, rest = score // 100, score % 100
    return low * whole - (-low * rest) // 100, high * whole + high * rest // 100


def _windows(low: int, high: int):
    def run(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The group's row with its anchors' positives, and the least length that a block must have to serve it."""
        if not len(group):
            return pd.DataFrame(columns=["dim", "grp", "ids", "labels", "data", "pairs", "need"])
        row = group.iloc[0]
        found = found.sort_values(["place", "rank"])
        pairs = found[["place", "vec_id", "score"]].to_numpy(dtype=np.int64)
        anchors = np.frombuffer(row["data"], dtype=np.int64).reshape(-1, max(1, row["dim"]))
        norms = np.sqrt((anchors.astype(float) ** 2).sum(axis=1))[pairs[:, 0]]
        least, most = window(pairs[:, 2], low, high)
        open_ = least <= most
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(norms > 0, least / norms, np.where(least <= 0, 0.0, np.inf))[open_].min(initial=np.inf)
        return pd.DataFrame([{"dim": row["dim"], "grp": row["grp"], "ids": row["ids"], "labels": row["labels"], "data": row["data"],
                              "pairs": pairs.tobytes(), "need": float(need)}])
    return run


def _negatives(k: int, low: int, high: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Second pass: per anchor and positive the k best of other labels inside the window, per cell."""
        now = None

        def finished():
            p = best.place
            return pd.DataFrame({"dim": now[0], "grp": now[1], "pair": p, "anchor_id": ids[pairs[p, 0]], "positive_id": pairs[p, 1],
                                 "negative_id": best.id, "positive_score": pairs[p, 2], "negative_score": best.score})

        for frame in frames:
            for (dim, grp, part, kind, its_ids, its_labels, data, lists), its_pairs in zip(zip(*[frame[c] for c in _COLUMNS]), frame["pairs"]):
                if kind == 0:
                    if now is not None:
                        yield finished()
                    now, ids, labels = (dim, grp, part), np.frombuffer(its_ids, dtype=np.int64), np.frombuffer(its_labels, dtype=np.int64)
                    anchors = np.frombuffer(data, dtype=np.int64).reshape(len(ids), dim)
                    norms = np.sqrt((anchors.astype(float) ** 2).sum(axis=1))
                    pairs = np.frombuffer(its_pairs, dtype=np.int64).reshape(-1, 3)
                    least, most = window(pairs[:, 2], low, high)
                    used = np.flatnonzero(least <= most)
                    first, best = np.searchsorted(pairs[:, 0], np.arange(len(ids) + 1)), Best(len(pairs), k)
                    continue
                block = Block(its_ids, its_labels, data, lists, dim)
                from_ = np.maximum(_below(least), best.kth)
                lowest, highest = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
                np.minimum.at(lowest, pairs[used, 0], from_[used])
                np.maximum.at(highest, pairs[used, 0], -_below(-most[used]))
                asking = np.flatnonzero(lowest <= highest)
                row, member, score = block.hits(anchors[asking], norms[asking], lowest[asking], highest[asking])
                row = asking[row]
                other = (block.labels[member] != labels[row]) & (block.ids[member] != ids[row])
                row, member, score = row[other], member[other], score[other]
                for i in range(int((first[1:] - first[:-1]).max(initial=0))):
                    pair = first[row] + i
                    ok = pair < first[row + 1]
                    pair = np.where(ok, pair, 0)
                    ok &= (score >= from_[pair]) & (score >= least[pair]) & (score <= most[pair])
                    best.add(pair[ok], score[ok], block.ids[member[ok]])
        if now is not None:
            yield finished()
    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer products of floor(scale * x). A negative's score is
    ``low`` to ``high`` percent of the positive's. ``is_anchor`` is a condition
    on ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = participants(vectors, id_col, vec_col, label_col, scale)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    each = rows.withColumn("norm", norm)
    each = each.withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 8)).otherwise(F.lit(-1 << 20)).cast("int"))
    # more copies of a row than are asked for can't show in a result
    each = each.withColumn("n", F.least(F.col("n"), F.lit(max(positives, negatives))))
    buckets = each.groupBy("dim", "bucket").agg(F.ceil(F.sum("n") / block).cast("int").alias("_blocks"))
    # a row per dimension and eighth of a power of two: bounded whatever the number of rows
    placed = each.join(F.broadcast(buckets), ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("int"))
    copies = placed.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    packed = materialize(copies.select("dim", "bucket", "block", "vec_id", "label", "v", "norm").groupBy("dim", "bucket", "block").applyInPandas(
        _pack_block, "dim int, bucket int, block int, ids binary, labels binary, data binary, longest double, sorted binary"))

    asked = each.where(is_anchor)
    total = asked.groupBy("dim").agg(F.ceil(F.count("*") / group).cast("int").alias("_parts"))
    grouped = asked.join(F.broadcast(total), "dim").withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("_parts")).cast("int"))
    groups = materialize(grouped.select("dim", "grp", "vec_id", "label", "v").groupBy("dim", "grp").applyInPandas(
        _pack_anchors, "dim int, grp int, ids binary, labels binary, data binary"))

    n_groups, n_blocks = max(1, groups.count()), max(1, packed.count())
    slices = cells.slices_for(spark, n_groups, n_blocks)
    blocks = (packed.withColumn("slice", F.pmod(F.xxhash64("bucket", "block"), F.lit(slices)).cast("int"))
              .withColumn("ord", -F.col("longest")).drop("bucket", "block"))
    first = cells.deal(groups.withColumn("ord", F.lit(0.0)), blocks, slices, n_groups, on=["dim"])
    found = first.mapInPandas(_positives(positives), "dim int, grp int, place int, anchor_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("dim", "grp", "place").orderBy(F.desc("score"), "vec_id")))
    pairs = ranked.where(F.col("rank") <= positives).select("dim", "grp", "place", "rank", "vec_id", "score")

    # a group's positives are at most GROUP x positives rows
    opened = materialize(groups.groupBy("dim", "grp").cogroup(pairs.groupBy("dim", "grp")).applyInPandas(
        _windows(low, high), "dim int, grp int, ids binary, labels binary, data binary, pairs binary, need double"))
    second = cells.deal(opened.withColumn("ord", F.lit(0.0)), blocks, slices, n_groups, on=["dim"],
                        serves=F.col("longest") * (1 + 1e-9) >= F.col("need"), group_info=["need"])
    mined = second.mapInPandas(_negatives(negatives, low, high), "dim int, grp int, pair int, anchor_id long, positive_id long, negative_id long, "
                                                                 "positive_score long, negative_score long")
    place = Window.partitionBy("dim", "grp", "pair").orderBy(F.desc("negative_score"), "negative_id")
    out = mined.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
