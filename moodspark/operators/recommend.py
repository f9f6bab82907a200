"""Cosine top-k recommendation (R1/X9/T4/J8) and per-user daily emotion.

Exact top-k of every profile against every song needs every similarity, but
never as rows. Queries are packed into groups, items into blocks of neighbours,
and the two meet in a grid of cells (``cells``): a group stays resident, the
blocks of an item slice stream past it, and a running top k per query is all
that is kept. A block carries its centroid and radius, which bound the cosine
of all its members: a query whose k-th best is above that bound is left out of
the block's product, and a block that no query needs is skipped. The cells'
partial results merge by score and id. Nothing is collected on the driver but
counts; only pivots (a fixed number) and a row per query group are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from moodspark.operators import cells
from moodspark.session import materialize, ship_package

BLOCK = 1024    # items in a block
GROUP = 8192    # queries in a group
PIVOTS = 256    # at most; blocks hold items of one pivot
_CHUNK = 1024   # queries in one product
_SLACK = 2e-9   # scores compare after rounding to 9 places


def _units(vecs: list) -> np.ndarray:
    """Unit vectors; rows of NaN where a vector is zero, not finite or holds NULL."""
    lengths = {len(v) for v in vecs}
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    mat = np.array([[np.nan if x is None else x for x in v] for v in vecs], dtype=np.float64).reshape(len(vecs), -1)
    norms = np.linalg.norm(mat, axis=1)
    ok = np.isfinite(norms) & (norms > 0)
    return np.where(ok[:, None], mat / np.where(ok, norms, 1.0)[:, None], np.nan)


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per block: ids and unit vectors as bytes, centroid and radius; undefined vectors fall out."""
    mat = _units(frame["vec"].tolist())
    ok = ~np.isnan(mat).any(axis=1)
    ids, unit = frame["id"].to_numpy(dtype=np.int64)[ok], mat[ok]
    centre = unit.sum(axis=0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 1e-9 else centre * 0
    near = (unit @ centre).min(initial=1.0) if size > 1e-9 else -1.0
    return pd.DataFrame([{"pivot": int(frame["pivot"].iloc[0]), "blk": int(frame["blk"].iloc[0]), "ids": ids.tobytes(), "mat": unit.tobytes(),
                          "dims": mat.shape[1], "centre": centre.tobytes(), "radius": float(np.arccos(np.clip(near, -1.0, 1.0)))}])


_PACKED = "pivot int, blk int, ids binary, mat binary, dims int, centre binary, radius double"


def _sound(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))


def _nearest(pivots: list):
    """Adds the number of the nearest pivot; vectors of another length get -1 (and fail where they are packed or compared)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = np.nan_to_num(_units(pivots))
        for frame in frames:
            if len(frame):
                same = np.array([len(v) == centres.shape[1] for v in frame["vec"]])
                at = np.full(len(frame), -1, dtype=np.int32)
                if same.any():
                    at[same] = (np.nan_to_num(_units(frame["vec"][same].tolist())) @ centres.T).argmax(axis=1)
                yield frame.assign(pivot=at)
    return run


def _item_blocks(items: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Blocks of about ``block`` items with one pivot in common, and roughly their number.

    A pivot with more items than that (a hot region, copies) has them dealt by hash.
    """
    n = items.count()
    wanted = min(PIVOTS, -(-n // block))
    pivots = [r["vec"] for r in items.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()] if wanted > 1 else []
    placed = items.mapInPandas(_nearest(pivots), StructType([*items.schema.fields, StructField("pivot", IntegerType())])) if pivots else items.withColumn("pivot", F.lit(0))
    if pivots:
        placed = materialize(placed)
        sizes = placed.groupBy("pivot").count().select("pivot", F.ceil(F.col("count") / block).cast("int").alias("_n"))
        placed = placed.join(F.broadcast(sizes), "pivot")  # one row per pivot
    else:
        placed = placed.withColumn("_n", F.lit(max(1, -(-n // block))))
    keyed = placed.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).drop("_n")
    return keyed.groupBy("pivot", "blk").applyInPandas(_pack, _PACKED), max(1, -(-n // block)) + len(pivots)


def _query_groups(queries: DataFrame, group: int) -> tuple[DataFrame, int]:
    n = max(1, -(-queries.count() // group))
    keyed = queries.withColumn("pivot", F.lit(0)).withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return keyed.groupBy("blk").applyInPandas(_pack, _PACKED), n


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best per row of ``scores`` (columns are ``ids``), ties to the smaller id.

    Scores compare after rounding to 9 places.
    """
    rounded = np.round(scores, 9)
    if scores.shape[1] > k:
        kth = -np.partition(-rounded, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero((rounded >= kth[:, None]) & np.isfinite(rounded))
    else:
        row, col = np.nonzero(np.isfinite(rounded))
    order = np.lexsort((ids[row, col] if ids.ndim == 2 else ids[col], -rounded[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < k
    row, col = row[keep], col[keep]
    return row, (ids[row, col] if ids.ndim == 2 else ids[col]), scores[row, col]


def _stream(k: int, exclude_self: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells in order; a cell's query group (kind 0) comes before its item blocks."""
        now = q_ids = q = top_id = top = None

        def finished():
            row, ids, score = best_of(top, top_id, k)
            return pd.DataFrame({"query_id": q_ids[row], "query_no": row + (int(now[0]) << 32), "item_id": ids, "score": score})

        def merge(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray):
            row, found, score = best_of(scores, ids, k)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            wide, wide_id = np.full((len(rows), k), -np.inf), np.full((len(rows), k), -1, dtype=np.int64)
            wide[row, place], wide_id[row, place] = score, found
            both, both_id = np.hstack([top[rows], wide]), np.hstack([top_id[rows], wide_id])
            row, found, score = best_of(both, both_id, k)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best, best_ids = np.full((len(rows), k), -np.inf), np.full((len(rows), k), -1, dtype=np.int64)
            best[row, place], best_ids[row, place] = score, found
            top[rows], top_id[rows] = best, best_ids

        for frame in frames:
            for grp, part, kind, ids, mat, dims, centre, radius in zip(*[frame[c] for c in ("grp", "slice", "kind", "ids", "mat", "dims", "centre", "radius")]):
                ids, mat = np.frombuffer(ids, dtype=np.int64), np.frombuffer(mat, dtype=np.float64).reshape(-1, dims)
                if kind == 0:
                    if now is not None:
                        yield finished()
                    now, q_ids, q = (grp, part), ids, mat
                    top, top_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, dtype=np.int64)
                    continue
                if (grp, part) != now or not len(ids) or not len(q_ids):
                    continue
                if mat.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors of different lengths: {sorted((mat.shape[1], q.shape[1]))}")
                angle = np.arccos(np.clip(q @ np.frombuffer(centre, dtype=np.float64), -1.0, 1.0))
                bound = np.cos(np.clip(angle - radius - 1e-7, 0.0, np.pi))
                needed = np.flatnonzero(bound >= top[:, -1] - _SLACK)
                for at in range(0, len(needed), _CHUNK):
                    rows = needed[at:at + _CHUNK]
                    scores = q[rows] @ mat.T
                    if exclude_self:
                        scores[q_ids[rows][:, None] == ids[None, :]] = -np.inf
                    merge(rows, scores, ids)
        if now is not None:
            yield finished()
    return run


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
                exclude_self: bool = False, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Top ``k`` items per query by cosine similarity; ties by item id: (query_id, rank, item_id, score).

    Vectors of different lengths fail the job. Queries or items with a zero or
    NULL-containing vector have undefined cosine and produce no pairs.
    """
    spark = queries.sparkSession
    ship_package(spark)  # the cells run in Python workers
    asked, n_groups = _query_groups(_sound(queries, id_col, vec_col), group)
    packed, n_blocks = _item_blocks(_sound(items, id_col, vec_col), block)
    slices = cells.slices_for(spark, n_groups, n_blocks)
    here = F.pmod(F.xxhash64("pivot", "blk"), F.lit(slices)).cast("int")
    blocks = packed.withColumn("slice", here).withColumn("ord", F.xxhash64("pivot", "blk")).drop("pivot", "blk")
    groups = asked.withColumnRenamed("blk", "grp").withColumn("ord", F.lit(0).cast("long")).drop("pivot")
    rows = cells.deal(groups, blocks, slices, n_groups, on=[])
    partial = rows.mapInPandas(_stream(k, exclude_self), "query_id long, query_no long, item_id long, score double")
    place = Window.partitionBy("query_id", "query_no").orderBy(F.desc(F.round("score", 9)), "item_id")
    return partial.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def daily_counts(events: DataFrame, user_col: str, ts_col: str, type_col: str, types: list[str]) -> DataFrame:
    """Per (user, day) counts of each type (explicit pivot values: no extra job)."""
    day = F.date_format(F.to_date(F.col(ts_col)), "yyyy-MM-dd").alias("day")
    aggs = [F.expr(f"CAST(count_if(`{type_col}` = '{t}') AS BIGINT) AS n_{t}") for t in types]
    return events.groupBy(F.col(user_col), day).agg(*aggs)


def dominant(types: list[str], prefix: str = "n_") -> F.Column:
    """Argmax over the per-type counts, first type (catalog order) on ties."""
    cols = [f"`{prefix}{t}`" for t in types]
    best = "greatest(" + ", ".join(cols) + ")"
    return F.expr("CASE " + " ".join(f"WHEN {c} = {best} THEN '{t}'" for t, c in zip(types, cols)) + " END")
