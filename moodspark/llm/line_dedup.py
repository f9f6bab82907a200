"""Line dedup: range-partitioned line hashes, a streaming pass, keep bitmaps.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys of at least ``min_chars`` code points that are in at least ``min_docs``
documents lose all their lines except in the largest doc_id that holds them.

Rows ``(128-bit key hash, doc_id, position)`` are range-partitioned by (hash,
doc_id) and sorted by (hash, doc_id descending, position), so a hash that holds
a third of all lines is spread over many tasks. Each task streams its sorted
rows and holds at most the lines of two documents at a time. Only the group
that a task starts with, and the one it ends with, can reach into other tasks:
their few sums (two rows per task) are added up and settle the rows left open.
The result is one compressed bitmap per document that loses lines, never text;
it meets its document unpacked, and SQL functions cut the text.

Cases: null text is one empty line; a null doc_id counts as one document that
is smaller than all others; rows that share a doc_id are one document to the
counting and each keeps its own positions (they are told apart by a hash of
their text); further columns are ignored; an empty table gives no bitmaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from moodspark.llm.common import SPACE_CHARS, ascii_lower, narrow, row_key, text_or_empty
from moodspark.session import materialize

_MIN_ID = -(1 << 63)
_PASS = "kind int, h1 long, h2 long, did long, rk long, pos int, n long, top long, task int"


def line_rows(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h1, h2 (hash of the key), did, rk (row key), pos of every line that is long enough."""
    base = narrow(docs, doc_id=id_col, text=text_col)
    lines = base.select(F.coalesce("doc_id", F.lit(_MIN_ID)).alias("did"), row_key(F.col("doc_id"), F.col("text")).alias("rk"),
                        F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.trim(F.col("line"), F.lit(SPACE_CHARS)))
    keyed = lines.select("did", "rk", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    digest = F.md5("key")
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return keyed.select(half(1).alias("h1"), half(17).alias("h2"), "did", "rk", "pos")


def _stream(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a dropped line; 1: an open line; 2: the sums of an open group."""
        task = TaskContext.get().partitionId()
        schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()),
                            ("rk", pa.int64()), ("pos", pa.int32()), ("n", pa.int64()), ("top", pa.int64()), ("task", pa.int32())])

        def out(kind, rows, n=0, top=0):
            h1, h2, did, rk, pos = rows
            k = len(h1)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, v, dtype=t)) if np.isscalar(v) else pa.array(v.astype(t)) for v, t in
                 ((kind, "i4"), (h1, "i8"), (h2, "i8"), (did, "i8"), (rk, "i8"), (pos, "i4"), (n, "i8"), (top, "i8"), (task, "i4"))], schema=schema)

        def sums(group):
            one = [np.array([x]) for x in (group["key"][0], group["key"][1], 0, 0, 0)]
            return out(2, one, group["n"], group["top"])

        group = None  # key, n (documents so far), top, last, held (rows of up to min_docs - 1 documents), first
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            h1, h2, did = cols[:3]
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            if group and group["key"] == (h1[0], h2[0]):
                new[0] = False
            starts = np.flatnonzero(new)
            edges = [0, *starts, len(h1)] if not new[0] else [*starts, len(h1)]
            # whole groups inside the batch, all at once; the first and last pieces one by one
            pieces = list(zip(edges[:-1], edges[1:]))
            inner = pieces[1:-1]
            if inner:
                a, b = inner[0][0], inner[-1][1]
            for k, (lo, hi) in enumerate(pieces[:1]):
                group, rows = _feed(group, [c[lo:hi] for c in cols], bool(new[0]), min_docs, out, sums)
                yield from rows
            if inner:
                yield from _close(group, out, sums)
                s = [c[a:b] for c in cols]
                fresh = new[a:b]
                gid = np.cumsum(fresh) - 1
                first_doc = s[2][np.flatnonzero(fresh)][gid]
                doc_new = fresh | np.concatenate([[True], s[2][1:] != s[2][:-1]])
                n = np.bincount(gid, weights=doc_new).astype(np.int64)[gid]
                drop = (n >= min_docs) & (s[2] != first_doc)
                if drop.any():
                    yield out(0, [c[drop] for c in s])
                group = {"key": None, "first": False, "held": []}
            if len(pieces) > 1:
                lo, hi = pieces[-1]
                group, rows = _feed(group, [c[lo:hi] for c in cols], True, min_docs, out, sums)
                yield from rows
        if group and group["key"] is not None:
            for rows in group["held"]:
                yield out(1, rows)
            yield sums(group)

    def _feed(group, rows, is_new, min_docs, out, sums):
        done = []
        if is_new:
            done += list(_close(group, out, sums))
            group = {"key": (rows[0][0], rows[1][0]), "n": 0, "top": int(rows[2][0]), "last": None, "held": [], "first": group is None}
        did = rows[2]
        doc_new = np.concatenate([[group["last"] is None or did[0] != group["last"]], did[1:] != did[:-1]])
        group["n"] += int(doc_new.sum())
        group["last"] = did[-1]
        if group["first"]:  # may go on from the task before: all its lines stay open
            done.append(out(1, rows))
        else:
            group["held"].append(rows)
            if group["n"] >= min_docs:
                for held in group["held"]:
                    drop = held[2] != group["top"]
                    if drop.any():
                        done.append(out(0, [c[drop] for c in held]))
                group["held"] = []
        return group, done

    def _close(group, out, sums):
        if group is None or group["key"] is None:
            return
        if group["first"]:
            yield sums(group)

    return run


def dropped_lines(rows: DataFrame, min_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """did, rk, pos of every line to drop."""
    spark = rows.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.repartitionByRange(parts, "h1", "h2", F.col("did").desc())
             .sortWithinPartitions("h1", "h2", F.col("did").desc(), "rk", "pos"))
    passed = materialize(dealt.mapInArrow(_stream(min_docs), _PASS))
    # at most two rows per task: bounded by the partition count, not by the data
    groups = (passed.where("kind = 2").groupBy("h1", "h2")
              .agg(F.sum("n").alias("_docs"), F.max("top").alias("_top")))
    opened = (passed.where("kind = 1").select("h1", "h2", "did", "rk", "pos")
              .join(F.broadcast(groups), ["h1", "h2"])
              .where((F.col("_docs") >= min_docs) & (F.col("did") != F.col("_top"))))
    return passed.where("kind = 0").select("did", "rk", "pos").unionByName(opened.select("did", "rk", "pos"))


@pandas_udf(BinaryType())
def pack_bitmap(positions: pd.Series, n_lines: pd.Series) -> pd.Series:
    """Compressed keep bitmap: bit i is 1 where line i stays."""
    def one(pos, n):
        keep = np.ones((int(n) + 7) // 8 * 8, dtype=np.uint8)  # lines beyond the last dropped one stay
        keep[np.asarray(pos, dtype=np.int64)] = 0
        return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)
    return pd.Series([one(p, n) for p, n in zip(positions, n_lines)])


def unpack_bitmap(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")[:n]


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """did, rk, keep (compressed bitmap) of each document that loses lines; text is not among them."""
    lost = (dropped_lines(line_rows(docs, min_chars), min_docs)
            .groupBy("did", "rk").agg(F.collect_set("pos").alias("pos")))
    return lost.select("did", "rk", pack_bitmap("pos", F.array_max("pos") + 1).alias("keep"), F.size("pos").alias("n_dropped"))


@pandas_udf(BinaryType())
def line_flags(keep: pd.Series) -> pd.Series:
    """One byte per line of a bitmap: 1 where the line stays."""
    return pd.Series([None if k is None else np.unpackbits(np.frombuffer(zlib.decompress(k), dtype=np.uint8), bitorder="little").tobytes() for k in keep])


def kept_lines(text: Column, flags: Column) -> Column:
    """The lines that stay, joined by a newline; lines beyond the flags stay. No text goes through Python."""
    stays = lambda _, i: (i >= F.octet_length(flags)) | (F.substring(flags, i + 1, 1) == F.lit(b"\1"))
    return F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``_row`` (all columns of a document), ``_text``, ``flags`` (null: all lines stay), ``n_dropped``."""
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(_MIN_ID)).alias("did"),
                       row_key(F.col("doc_id"), F.col("text")).alias("rk"), text_or_empty().alias("_text"))
    return rows.join(bitmaps.select("did", "rk", line_flags("keep").alias("flags"), "n_dropped"), ["did", "rk"], "left")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the repeated lines taken out of text (n_chars follows); null text stays null."""
    joined = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    kept = joined.withColumn("_new", F.when(F.col("flags").isNull(), F.col("_row.text")).otherwise(kept_lines(F.col("_text"), F.col("flags"))))
    cols = []
    for name in docs.columns:
        if name == "text":
            cols.append(F.col("_new").alias("text"))
        elif name == "n_chars":
            cols.append(F.when(F.col("flags").isNull(), F.col("_row.n_chars"))
                        .otherwise(F.char_length("_new").cast(docs.schema[name].dataType)).alias(name))
        else:
            cols.append(F.col("_row").getField(name).alias(name))
    return kept.select(*cols)


def line_report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of ``docs``."""
    base = narrow(docs, doc_id="doc_id", text="text")
    joined = with_bitmaps(base, keep_bitmaps(base, min_chars, min_docs))
    kept = F.when(F.col("flags").isNull(), F.col("_text")).otherwise(kept_lines(F.col("_text"), F.col("flags")))
    return joined.select(F.col("_row.doc_id").alias("doc_id"),
                         (F.char_length("_text") - F.char_length(F.translate("_text", "\n", "")) + 1).cast("long").alias("n_lines"),
                         F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))
