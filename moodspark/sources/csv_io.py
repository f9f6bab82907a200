"""CSV scans and sinks with explicit schemas.

Quote/escape are RFC 4180 style and whitespace is preserved on both sides,
so quoted commas and embedded newlines round-trip. A file is read by many
tasks although a quoted field may hold newlines: every byte range of the file
first counts its quotes (one number per range comes out of that); the running
parity over a file's ranges tells whether a range starts inside quotes, and with
that each task knows which of its line ends are ends of records. What is open at
the end of a range joins what the next one starts with, two pieces a range at
most. Records are parsed by the JVM.

As with the source's pandas ``to_csv``/``read_csv`` pair, an empty string
and NULL are both written as an empty field and read back as NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodspark.session import ship_package

# Java charset name of Korean cp949 (Unified Hangul Code), and Python's.
CP949 = "x-windows-949"
_PYTHON_NAMES = {CP949: "cp949"}
# In these a quote, comma or newline byte never is a part of another character.
_SPLITTABLE = ("UTF-8", "UTF8", "US-ASCII", "ISO-8859-1", CP949.upper())

_COMMON = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
           "ignoreTrailingWhiteSpace": "false"}
_CHARSETS = "spark.sql.legacy.javaCharsets"
_BUILT_IN = ("UTF-8", "UTF8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")


def _decoded(lines: pa.Array, encoding: str) -> pa.Array:
    if encoding == "UTF-8":
        try:
            return lines.cast(pa.string())
        except pa.ArrowInvalid:
            pass
    return pa.array([x.decode(encoding, "replace") for x in lines.to_pylist()], pa.string())


_PIECES = "fid long, start long, kind int, text string"
_FULL, _HEAD, _TAIL = 0, 1, 2


def _records(encoding: str):
    """Lines of byte ranges -> whole records, and the pieces at both ends of a range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, open_lines, open_kind, header = None, 0, [], _HEAD, False

        def out(kind: int, texts: pa.Array):
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, now[0])), pa.array(np.full(n, now[1])), pa.array(np.full(n, kind, np.int32)), texts],
                                              names=["fid", "start", "kind", "text"])

        def left_open():
            if open_lines and not header:
                yield out(open_kind, _decoded(pa.array([b"\n".join(open_lines)], pa.binary()), encoding))

        for batch in batches:
            fid, start, parity = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fid", "start", "inside"))
            edges = np.flatnonzero((fid[1:] != fid[:-1]) | (start[1:] != start[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(fid)]):
                if lo == hi:
                    continue
                if now != (fid[lo], start[lo]):
                    yield from left_open()
                    now, inside, open_lines, open_kind, header = (fid[lo], start[lo]), int(parity[lo]), [], _HEAD, start[lo] == 0
                lines = batch.column("value").slice(lo, hi - lo)
                after = (inside + np.cumsum(pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False))) % 2
                before = np.concatenate([[inside], after[:-1]])
                inside = int(after[-1])
                single = (before == 0) & (after == 0)
                if header and single[0] and not open_lines:
                    single[0] = header = False
                found, places = [lines.filter(pa.array(single))], [np.flatnonzero(single)]
                # records of several lines: from a line that opens quotes to the one that closes them
                at = 0
                while at < len(after):
                    if before[at] == 0:
                        opens = np.flatnonzero((before[at:] == 0) & (after[at:] == 1))
                        if not len(opens):
                            break
                        at, open_kind = at + int(opens[0]), _TAIL
                    closes = np.flatnonzero(after[at:] == 0)
                    end = at + int(closes[0]) + 1 if len(closes) else len(after)
                    open_lines += lines.slice(at, end - at).to_pylist()
                    if len(closes):
                        record = pa.array([b"\n".join(open_lines)], pa.binary())
                        if header:
                            header = False
                        elif open_kind == _TAIL:
                            found.append(record)
                            places.append([end - 1])
                        else:
                            yield out(_HEAD, _decoded(record, encoding))
                        open_lines = []
                    at = end
                order = np.argsort(np.concatenate(places), kind="stable")
                if len(order):
                    yield out(_FULL, _decoded(pa.concat_arrays(found).take(pa.array(order)), encoding))
        if now is not None:
            yield from left_open()
    return run


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``text``: the records of header CSV files, quoted newlines included, headers left out."""
    ship_package(spark)
    files = spark.read.option("lineSep", "\n").text(path)
    lines = files.select(F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("fid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("fid", "start").agg(F.sum(quotes).alias("n"))
    ranges = ranges.select("fid", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).cast("int").alias("inside"))
    # a row per byte range of a file
    known = lines.withColumn("value", F.col("value").cast("binary")).join(F.broadcast(ranges), ["fid", "start"])
    pieces = known.mapInArrow(_records(_PYTHON_NAMES.get(encoding, encoding)), _PIECES)
    whole = pieces.where(F.col("kind") == _FULL).select("text")
    parts = pieces.where(F.col("kind") != _FULL)
    group = F.count(F.when(F.col("kind") == _TAIL, 1)).over(Window.partitionBy("fid").orderBy("start", "kind"))
    joined = parts.withColumn("_g", group).groupBy("fid", "_g").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("_p"))
    opened = joined.where("_g > 0")  # what no range opened is the end of a header that a range cut
    records = whole.unionAll(opened.select(F.array_join("_p.text", "\n").alias("text")))
    ended = F.when(F.col("text").endswith("\r"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return records.select(ended.alias("text")).where("text <> ''")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV with an explicit schema (no inference pass); files of any size are split."""
    if encoding.upper() not in _SPLITTABLE:
        return (spark.read.options(**_COMMON).option("multiLine", "true").option("encoding", encoding)
                .option("mode", "FAILFAST").schema(schema).csv(path))
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {k: v for k, v in _COMMON.items() if k != "header"} | {"mode": "FAILFAST", "multiLine": "true"}
    return csv_records(spark, path, encoding).select(F.from_csv("text", ddl, options).alias("_r")).select("_r.*")


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", mode: str = "overwrite",
              max_records_per_file: int = 1_000_000) -> None:
    """One header per part file, no index column, overwrite is idempotent.

    Spark knows charsets beyond a fixed set under a legacy setting only; it is on during the write.
    """
    spark = df.sparkSession
    known = encoding.upper() in _BUILT_IN
    earlier = spark.conf.get(_CHARSETS, None)
    if not known:
        spark.conf.set(_CHARSETS, "true")
    try:
        (df.write.mode(mode).options(**_COMMON).option("encoding", encoding)
         .option("maxRecordsPerFile", str(max_records_per_file)).csv(path))
    finally:
        if not known:
            spark.conf.unset(_CHARSETS) if earlier is None else spark.conf.set(_CHARSETS, earlier)


def tag_rows(df: DataFrame, conditions: list[tuple[str, Column]], otherwise: str, tag_col: str = "split") -> DataFrame:
    """S3: one scan, each row tagged with the first source whose condition holds (NULL does not), else ``otherwise``."""
    tag = F.lit(otherwise)
    for name, condition in reversed(conditions):
        tag = F.when(condition, F.lit(name)).otherwise(tag)
    return df.withColumn(tag_col, tag)


def escape_unencodable(c: Column) -> Column:
    """Text with every run's character outside ASCII and the Hangul syllables as backslash-u and eight hex digits.

    The backslash itself is escaped too, so ``unescape`` gives the text back.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(?s)[\x00-\x5B\x5D-\x7F가-힣]+|."), 0)
    code = lambda x: F.concat(F.lit("\\u"), F.lpad(F.hex(F.encode(x, "UTF-32")), 8, "0"))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^[\x00-\x5B\x5D-\x7F가-힣]"), x).otherwise(code(x))), "")


def unescape(c: Column) -> Column:
    """The text that ``escape_unencodable`` was given."""
    parts = F.split(c, r"\\u", -1)
    text = F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(
        F.concat(F.decode(F.unhex(F.substring(x, 1, 8)), "UTF-32"), F.substr(x, F.lit(9)))))
    return F.array_join(text, "")
