"""M1/M2: the source's two unbounded loops as Structured Streaming queries.

* ``score_stream``: utterances arrive as files; a conversation is scored until
  its closing row (the source's loop ends at the sentinel ``"0"``), whichever
  micro-batch that row comes in. Rows before it go through the same DataFrame
  scorer as the batch path, each micro-batch into a folder of its own.
* ``dedupe_stream``: incremental page ingest with first-wins dedupe across
  batches. Rows of a key are combined within their task first, then meet the
  key's state.

State lives in RocksDB: one small row per key (per conversation and block group
its rows came in), of which a micro-batch reads and writes only the keys it holds, with a changelog in
the checkpoint. Checkpoints and sinks lie under the shared checkpoint folder, so
a restarted driver or lost executor resumes from the committed offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import NumericType, StructType

_STATE = "spark.sql.streaming.stateStore."
_ROCKSDB = {_STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            _STATE + "rocksdb.changelogCheckpointing.enabled": "true",
            # else a query with expiring state has one more empty batch to run for ever
            "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
_HANDED_ON = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch")


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that keeps streaming state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    for key in _HANDED_ON:
        own.conf.set(key, spark.conf.get(key))
    for key, value in _ROCKSDB.items():
        own.conf.set(key, value)
    return own


def file_stream(spark: SparkSession, directory: str, schema: StructType | str, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files below ``directory`` as they arrive, in sub-folders too."""
    reader = state_session(spark).readStream.schema(schema).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(directory)


def _run(writer) -> StreamingQuery:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _fields(df: DataFrame, names: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


# ---- M1: a conversation is open until its closing row ------------------------

def open_rows(rows: DataFrame, closed: DataFrame, key_cols: list[str], order_col: str) -> DataFrame:
    """Those of ``rows`` (with ``_salt``) that come before the place ``closed`` has for their key; rows without a place stay."""
    ends = closed.where(F.col("_closed").isNotNull()).select(*[F.col(c).alias(f"_e_{c}") for c in [*key_cols, "_salt"]], "_closed")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in key_cols], F.col("_salt") == F.col("_e__salt"))
    place = F.col(order_col)
    none = place.isNull() | (F.isnan(place) if _fractional(rows, order_col) else F.lit(False))
    before = F.col("_closed").isNull() | none | (place < F.col("_closed"))
    return rows.join(ends, same, "left").where(before)


def _fractional(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("float", "double")


def marked_rows(stream: DataFrame, key_cols: list[str], order_col: str, closes: Column, salts: int = 8) -> DataFrame:
    """The rows of ``stream`` that don't close (``_row``), and of each salted key that a micro-batch holds its closing place so far (``_closed``).

    A key's closing place (the least ``order_col`` of its closing rows so far) is
    kept as the state of a grouped minimum, which combines rows per task first;
    so it also ends rows of later micro-batches. Closing rows themselves are left
    out. A key's rows are dealt out over ``salts`` groups by blocks of 128 places,
    so that a short conversation is one group and a hot one several; closing rows
    reach all groups.
    """
    place = F.col(order_col)
    valid = place.isNotNull() & ~F.isnan(place) if _fractional(stream, order_col) else place.isNotNull()
    shut = F.coalesce(closes, F.lit(False))
    block = F.floor(place / 128) if isinstance(stream.schema[order_col].dataType, NumericType) else F.xxhash64(place)
    own = F.pmod(F.coalesce(block.cast("long"), F.lit(0)), F.lit(salts)).cast("int")
    nothing = F.lit(None).cast(stream.schema[order_col].dataType)
    row = F.struct(*stream.columns)
    rows = stream.where(~shut).select(*key_cols, own.alias("_salt"), row.alias("_row"), nothing.alias("_closed"))
    every = F.when(shut, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(own))
    probes = stream.select(*key_cols, F.explode(every).alias("_salt"), F.when(shut & valid, place).alias("_closed"))
    closed = probes.groupBy(*key_cols, "_salt").agg(F.min("_closed").alias("_closed"))
    return rows.unionByName(closed.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key_cols: list[str],
                 order_col: str, closes: Column | None = None) -> StreamingQuery:
    """M1: score arriving rows into ``sink``, each key until its closing row; runs all available input then stops.

    Each micro-batch goes through the batch scorer into its own ``batch_id=``
    folder with overwrite, so a retried batch replaces its output.
    """
    def write_open(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.DISK_ONLY)  # the state is looked up once
        try:
            rows = kept.where(F.col("_row").isNotNull()).select("_salt", "_row.*")
            write_batch(open_rows(rows, kept.where(F.col("_row").isNull()).drop("_row"), key_cols, order_col).select(*stream.columns), batch_id)
        finally:
            kept.unpersist()

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    if closes is None:
        return _run(stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint))
    marked = marked_rows(stream, key_cols, order_col, closes)
    return _run(marked.writeStream.outputMode("update").foreachBatch(write_open).option("checkpointLocation", checkpoint))


# ---- M2: first row of a key wins -----------------------------------------------

def _first_per_key(key_cols: list[str], order_col: str, most: int = 100_000):
    def combine(frames: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(frames, ignore_index=True)
        return rows.sort_values(order_col, kind="stable", na_position="last").drop_duplicates(key_cols)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's rows, one per key with its least order value; what is held back stays below ``most`` rows."""
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) > most:
                held = [combine(held)]
                if len(held[0]) > most // 2:
                    yield held.pop()
        if held:
            yield combine(held)
    return run


def dedupe_stream(stream: DataFrame, key_cols: list[str], order_col: str, keep_cols: list[str], sink: str, checkpoint: str,
                  prepare: Callable[[DataFrame], DataFrame] | None = None, expire_ms: int | None = None) -> StreamingQuery:
    """M2: first-wins dedupe across micro-batches into ``sink``; runs all available input then stops.

    Of a key's rows in a micro-batch the one with the least ``order_col`` wins,
    unless an earlier micro-batch had the key. Each task hands on one row per key,
    so a hot key reaches its group as a row per task. A key is remembered for
    ever, or for ``expire_ms`` after it was last written. Append output to a file
    sink with a checkpoint is exactly-once.
    """
    rows = prepare(stream) if prepare else stream
    cols = [*key_cols, order_col, *keep_cols]
    schema = _fields(rows, cols)
    combined = rows.select(*cols).mapInPandas(_first_per_key(key_cols, order_col), schema)
    timeout = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    fresh = combined.groupBy(*key_cols).applyInPandasWithState(_first_wins(order_col, cols, expire_ms), schema, "seen boolean", "append", timeout)
    return _run(fresh.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append"))


def _first_wins(order_col: str, out_cols: list[str], expire_ms: int | None):
    def run(key, chunks, state):
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            for _ in chunks:  # already emitted in an earlier batch
                pass
            return
        best = None
        for pdf in chunks:
            rows = pdf.sort_values(order_col, kind="stable", na_position="last").head(1)
            if best is None or (len(rows) and rows[order_col].iloc[0] < best[order_col].iloc[0]):
                best = rows if len(rows) else best
        if best is not None and len(best):
            state.update((True,))
            if expire_ms is not None:
                state.setTimeoutDuration(expire_ms)
            yield best[out_cols]
    return run
