"""The batch operators on streams.

Each function returns a streaming DataFrame or starts a query. Sinks write
tables: `write_table` appends, and `write_latest` writes one folder per
micro-batch, of which `read_latest` takes the newest row per key. Both go
through deterministic paths or Spark's own file sink, so a replayed batch does
not show twice.
"""

from __future__ import annotations

import contextlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoalsong import constants as C
from shoalsong import schemas
from shoalsong.constants import SegmentSpec
from shoalsong.operators import similarity, status
from shoalsong.plans import analysis
from shoalsong.sources import workspace
from shoalsong.sources.tables import read_if_present


def ingest(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New .wav files below `folder`, as they appear."""
    return (
        spark.readStream.format("binaryFile").schema(schemas.RECORDING_FILE)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav")
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session for the time of a stream; those that were not set are unset again."""
    before = {n: spark.conf.get(n, None) for n in values}
    for n, v in values.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def listed_together(spark: SparkSession):
    """While a stream of many files runs: the files of a batch are looked up by a task per core. Spark else
    starts a task for each file, and every task sends some 3 KB to the driver."""
    tasks = max(1, spark.sparkContext.defaultParallelism)
    return settings(spark, **{"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(tasks)})


def segments(files: DataFrame, spec: SegmentSpec, max_bytes: int = C.MAX_FILE_BYTES, root: str | None = None) -> DataFrame:
    """Segments of the arriving files: the batch code unchanged."""
    return analysis.segments_of(files, spec, max_bytes, root)


def timed(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone; a plain one is read as session time."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


# Drain what is there, then stop. Pass e.g. {"processingTime": "1 minute"} to keep running.
DRAIN = {"availableNow": True}


def classify_batches(pooled: DataFrame, refs: DataFrame, key: str, path: str, checkpoint: str,
                     trigger: dict = DRAIN, block_bytes: int = 32 << 20, **sizes) -> StreamingQuery:
    """Classify arriving pooled vectors against a fixed reference table.

    The nearest sites need a ranking, which a stream cannot do across batches
    but each micro-batch can for its own recordings. What depends on the
    references alone is made once, before the stream starts: no batch sends them
    through the driver again, its tasks read the stored cells that they need.
    """
    spark = pooled.sparkSession
    folder = workspace.new_folder(spark, "categories")
    similarity.category_vectors(refs).write.parquet(folder)
    vectors = spark.read.parquet(folder)
    index = similarity.reference_cells(refs, block_bytes, sizes.get("matrix_bytes"))

    def score(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            labels = similarity.classify(batch, refs, vectors=vectors).select(key, "label", "confidence")
            sites = similarity.similar_sites_or_placeholder(batch, refs, key, index=index, **sizes)
            best = sites.where(F.col("rank") == 1).select(key, "site_id", "similarity")
            labels.join(best, key, "left").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (pooled.writeStream.foreachBatch(score)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def status_updates(log: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Running status per analysis. Flags only ever turn on, so state is small and late rows are harmless."""
    return status.with_status(status.status_flags(log, key))


FLAGS = ("has_result boolean, has_preprocessed boolean, has_error boolean, error_at bigint, error_event bigint, "
         "last_error string")


def _tracker(name: str, keep_ms: int):
    """A stateful processor: the flags of one analysis, dropped `keep_ms` after its last item once it is final."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Tracker(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.flags = handle.getValueState("flags", FLAGS)

        def handleInputRows(self, key, rows, timerValues):
            old = self.flags.get()
            result, cut, failed, *last = (False, False, False, None, None, None) if old is None else old
            for row in rows:
                result, cut, failed = result or row.sk == "RESULT", cut or row.sk == "PREPROCESSED", failed or row.sk == "ERROR"
                if row.sk == "ERROR" and (last[0] is None or (row.at, row.event_id) >= tuple(last[:2])):
                    last = [row.at, row.event_id, row.error]
            new = (result, cut, failed, *last)
            # Only a final analysis has a timer, one at most; each question to the store is a round trip.
            if old is not None and (old[0] or old[2]):
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if result or failed:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + keep_ms)
            if old is None or new != tuple(old):
                self.flags.update(new)
                yield Row(**{name: key[0]}, **dict(zip(
                    ("has_result", "has_preprocessed", "has_error", "error_at", "error_event", "last_error"), new)))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.flags.clear()
            return iter([])

        def close(self) -> None:
            pass

    return Tracker()


def tracked_status(log: DataFrame, key: str = "analysis_id", keep: int = 7 * 86400) -> DataFrame:
    """Changes of the flags per analysis, with state that ends: `keep` seconds after the last item of an
    analysis that has a result or an error, its state is dropped.

    An item that comes later starts a new state, and the table of `write_latest`
    reopens the analysis: flags of all its rows count (`read_tracked`), so nothing
    that was known is lost. Only unfinished analyses and those of the last `keep`
    seconds are in the store, however long the stream runs. No item is too late.
    Needs the RocksDB state store. To drain what is there and stop, switch
    `spark.sql.streaming.noDataMicroBatches.enabled` off: with timers Spark else
    goes on without end.
    """
    kind = dict(log.dtypes)[key]
    items = log.where(F.col("sk").isin("RESULT", "PREPROCESSED", "ERROR") & F.col(key).isNotNull()).select(
        key, "sk", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "error")
    return items.groupBy(key).transformWithState(
        _tracker(key, keep * 1000), f"{key} {kind}, {FLAGS}", "Update", "ProcessingTime")


def read_tracked(spark: SparkSession, path: str, key: str = "analysis_id", kind: str = "bigint") -> DataFrame:
    """Status per analysis from all rows that `tracked_status` has written with `write_latest`."""
    rows = read_if_present(spark, path, f"{key} {kind}, {FLAGS}, batch bigint", basePath=path)
    flags = rows.groupBy(key).agg(
        *[F.bool_or(c).alias(c) for c in ("has_result", "has_preprocessed", "has_error")],
        F.max(F.when(F.col("has_error"), F.struct("error_at", "error_event", "last_error")))["last_error"].alias("last_error"))
    return status.with_status(flags)


def _first_copies(keys: list[str]):
    """Arrow step: the first row of each key within a batch."""
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("_row", pa.array(range(batch.num_rows), pa.int64()))
            first = table.group_by(keys).aggregate([("_row", "min")]).column("_row_min")
            yield batch.take(pc.take(first, pc.sort_indices(first)).combine_chunks())

    return run


def deduplicated(log: DataFrame, keys: list[str], delay: str | None = None) -> DataFrame:
    """First delivery of each key, however late it comes; no row is lost.

    The state holds every key seen (use the RocksDB store; `write_new` needs no
    state at all). With `delay` the state is cleared of keys older than that,
    but then Spark also drops first deliveries that come later than `delay`
    behind the newest row.

    Copies that arrive in the same Arrow batch are dropped before the shuffle:
    of a key redelivered without end, each batch sends one row to its task.
    """
    log = timed(log.mapInArrow(_first_copies(keys), log.schema))
    if delay is None:
        return log.dropDuplicates(keys)
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def write_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str], trigger: dict = DRAIN) -> StreamingQuery:
    """Rows whose key no earlier batch has written, one folder per batch, replaced on replay.

    The table itself is the memory: each batch is joined with the keys of the
    earlier folders, so nothing is held as state and nothing is ever too late.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        schema = f"{', '.join(f'`{n}` {t}' for n, t in batch.dtypes)}, batch bigint"
        known = read_if_present(batch.sparkSession, path, schema, basePath=path).where(F.col("batch") < batch_id)
        fresh = batch.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def hourly_errors(logs: DataFrame) -> DataFrame:
    """Errors per hour and function, for update mode. Late rows are counted like
    any other: the state is one number per hour and function, so it needs no watermark."""
    return (
        timed(logs).where(F.col("level") == "ERROR")
        .groupBy(F.window("ts", "1 hour").alias("w"), "function").agg(F.count(F.lit(1)).alias("errors"))
        .select(F.col("w.start").alias("hour"), "function", "errors")
    )


def write_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict = DRAIN) -> StreamingQuery:
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def write_latest(updates: DataFrame, path: str, checkpoint: str, trigger: dict = DRAIN) -> StreamingQuery:
    """Changed rows of each micro-batch, one folder per batch, replaced on replay."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (updates.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def read_latest(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Newest row per key of a `write_latest` table; empty before its first batch."""
    rows = read_if_present(spark, path, schema, basePath=path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
