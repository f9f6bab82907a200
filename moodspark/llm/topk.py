"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (an eighth of a power of two per bucket) and
buckets are cut into blocks of about ``BLOCK`` vectors; queries are packed into
blocks as well. A first pass scores each query block against one block of the
longest vectors, which gives every query a threshold that its k-th score can't
fall below. The second pass deals pairs (query block, candidate block): buckets
whose longest vector can't reach any threshold are never opened. In an open
block, the threshold divided by both lengths is a cosine: where it is high, the
feasible interval of the query's largest coordinates prunes candidates
(coordinate pruning), else only shorter candidates are cut off (length
pruning). What is left is verified by its integer product. A query block and a
candidate block meet in one row of at most a few MB, and leave at most k rows
per query.

Components are floor(1024 * x); products are exact: in doubles while their sum
stays below 2**53, in Python integers beyond.

Cases: vectors that are null or hold null or non-finite components, and rows
without vec_id, take no part; a candidate with the query's own vec_id never
counts; rows repeated in vec_id and vector are repeated candidates but one
query; vectors of different dimension never meet; an empty table or query set
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm.common import narrow

BLOCK = 4096
QUERY_BLOCK = 512
COSINE = 0.75  # local thresholds from here on prune by coordinate
FOCUS = 4      # coordinates looked at


def quantized(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """vec_id, v (array of long), dim of every row that takes part."""
    base = narrow(df, vec_id=id_col, x=vec_col).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    x = F.transform("x", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return base.where(fine).select("vec_id", F.transform(x, lambda e: F.floor(e * scale)).alias("v"), F.size("x").alias("dim"))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))


def _pack(keys: list[str], extra: str):
    """One row per block: ids and the matrix as bytes (int64)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["norm", "vec_id"], ascending=[False, True], kind="stable")
        data = np.stack([np.asarray(v, dtype=np.int64) for v in frame["v"]]) if len(frame) else np.zeros((0, 0), np.int64)
        row = {k: frame[k].iloc[0] for k in keys}
        row |= {"ids": frame["vec_id"].to_numpy(dtype=np.int64).tobytes(), "data": data.tobytes(), "longest": float(frame["norm"].iloc[0])}
        return pd.DataFrame([row])
    schema = ", ".join(f"{k} {t}" for k, t in zip(keys, extra.split())) + ", ids binary, data binary, longest double"
    return run, schema


def product(queries: np.ndarray, cands: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all pairs of two blocks."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(cands).max(initial=0)) * max(1, queries.shape[1])
    if top < 2.0 ** 53:
        return (queries.astype(np.float64) @ cands.T.astype(np.float64)).astype(np.int64)
    big = queries.astype(object) @ cands.T.astype(object)
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(qids, queries, thresholds, cids, cands, k: int):
    """Per query its k best of the block that reach its threshold: rows (query place, vec_id, score)."""
    qn = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    cn = np.sqrt((cands.astype(float) ** 2).sum(axis=1))  # sorted, longest first
    places, ids, scores = [], [], []

    def take(at: int, index: np.ndarray, s: np.ndarray):
        ok = (cids[index] != qids[at]) & (s >= thresholds[at])
        index, s = index[ok], s[ok]
        if len(s) > k:
            kth = np.partition(s, len(s) - k)[len(s) - k]
            index, s = index[s >= kth], s[s >= kth]
        order = np.lexsort((cids[index], -s.astype(float) if np.abs(s).max(initial=0) < 2 ** 53 else -s))[:k]
        places.append(np.full(len(order), at))
        ids.append(cids[index][order])
        scores.append(s[order])

    slack = 1 - 1e-9
    floor_ = np.where(np.isfinite(thresholds), thresholds, -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(qn > 0, floor_ / (qn * max(cn[0], 1e-300)), -np.inf) if len(cn) else np.full(len(qn), np.inf)
    by_length = []
    unit = None
    for at in range(len(qids)):
        if local[at] > 1 + 1e-9:
            continue  # not even the longest vector of the block can reach it
        if local[at] < COSINE:
            by_length.append(at)
            continue
        if unit is None:
            unit = cands / np.where(cn > 0, cn, 1)[:, None]
        q = queries[at] / qn[at]
        t = min(1.0, local[at] * slack)
        alive = cn * qn[at] >= floor_[at] * slack
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            # a vector within the angle acos(t) of q has its coordinate within that angle of q's
            own, within = np.arccos(np.clip(q[f], -1.0, 1.0)), np.arccos(t)
            alive &= unit[:, f] >= np.cos(min(np.pi, own + within)) - 1e-9
            alive &= unit[:, f] <= np.cos(max(0.0, own - within)) + 1e-9
        index = np.flatnonzero(alive)
        if len(index):
            take(at, index, product(queries[at:at + 1], cands[index])[0])
    if by_length:
        need = np.array([floor_[a] / qn[a] if qn[a] > 0 else -np.inf for a in by_length])
        reach = int((cn >= need.min() * slack).sum()) if np.isfinite(need.min()) and need.min() > 0 else len(cn)
        s = product(queries[by_length], cands[:reach])
        index = np.arange(reach)
        for row, at in enumerate(by_length):
            take(at, index, s[row])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(ids), np.concatenate(scores)


def _unpack(row, ids: str, data: str):
    keys = np.frombuffer(row[ids], dtype=np.int64)
    return keys, np.frombuffer(row[data], dtype=np.int64).reshape(len(keys), -1)


def _seed(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k-th score of each query in the first block, as its threshold."""
        for frame in frames:
            found = []
            for _, row in frame.iterrows():
                qids, q = _unpack(row, "ids", "data")
                low = np.full(len(qids), -np.inf)
                if row["cids"] is not None:
                    cids, c = _unpack(row, "cids", "cdata")
                    at, _, s = best(qids, q, low, cids, c, k)
                    for i in range(len(qids)):
                        mine = s[at == i]
                        if len(mine) >= k:
                            low[i] = float(mine.min())
                norms = np.sqrt((q.astype(float) ** 2).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(norms > 0, low / norms, -np.inf)
                found.append((row["dim"], row["part"], row["ids"], row["data"], low.tobytes(), float(need.min()) if len(need) else 0.0))
            yield pd.DataFrame(found, columns=["dim", "part", "ids", "data", "low", "need"])
    return run


def _open(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                qids, q = _unpack(row, "ids", "data")
                cids, c = _unpack(row, "cids", "cdata")
                at, ids, s = best(qids, q, np.frombuffer(row["low"], dtype=float), cids, c, k)
                yield pd.DataFrame({"query_id": qids[at], "qkey": at + int(row["part"]) * (1 << 20), "vec_id": ids, "score": s})
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of each query, ties to the smaller vec_id.

    ``is_query`` is a condition on ``vec_id``.
    """

    rows = quantized(vectors, id_col, vec_col)
    # rows repeated in id and vector: more than k of them can't show in a top k
    each = rows.groupBy("vec_id", "v", "dim").agg(F.least(F.count("*"), F.lit(k)).alias("n")).withColumn("norm", _norm(F.col("v")))
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 8)).otherwise(F.lit(-1 << 20)).cast("int")
    each = each.withColumn("bucket", bucket)
    buckets = (each.groupBy("dim", "bucket").agg(F.sum("n").alias("_n"), F.max("norm").alias("_most"))
               .withColumn("blocks", F.ceil(F.col("_n") / BLOCK).cast("int")).select("dim", "bucket", "blocks", "_most"))
    # a row per dimension and eighth of a power of two: bounded whatever the number of rows
    salted = (each.join(F.broadcast(buckets.select("dim", "bucket", "blocks")), ["dim", "bucket"])
              .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
              .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))))
    pack, schema = _pack(["dim", "bucket", "block"], "int int int")
    cands = salted.select("dim", "bucket", "block", "vec_id", "v", "norm").groupBy("dim", "bucket", "block").applyInPandas(pack, schema)
    cands = cands.select("dim", "bucket", "block", F.col("ids").alias("cids"), F.col("data").alias("cdata"))

    asked = each.where(is_query)
    total = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    qpack, qschema = _pack(["dim", "part"], "int int")
    packed = (asked.join(F.broadcast(total), "dim").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")).cast("int"))
              .select("dim", "part", "vec_id", "v", "norm").groupBy("dim", "part").applyInPandas(qpack, qschema))
    longest = buckets.groupBy("dim").agg(F.max("bucket").alias("bucket"))
    first = cands.where("block = 0").join(F.broadcast(longest), ["dim", "bucket"]).select("dim", "cids", "cdata")
    seeded = (packed.join(first, "dim", "left")
              .mapInPandas(_seed(k), "dim int, part int, ids binary, data binary, low binary, need double"))
    reach = (seeded.join(F.broadcast(buckets), "dim").where(F.col("_most") * (1 + 1e-9) >= F.col("need"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("dim", "bucket", "block", "part", "ids", "data", "low"))
    pairs = reach.join(cands, ["dim", "bucket", "block"])
    found = pairs.mapInPandas(_open(k), "query_id long, qkey long, vec_id long, score long")
    place = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
