"""Recordings to results, job items and dead letters as one stream.

Each micro-batch of windows (`schemas.SEGMENT`, as `recordings.stream_segments`
or a table of segments gives them) is described and embedded once. From what
that writes, the batch derives

* `sums`: mergeable sums of vectors per recording, so a recording whose windows
  come in several batches is pooled when its last one is there;
* `results`: label and confidence of the recordings that became complete;
* `dead`: an error per rejected file;
* `items`: the job items of all of these (`schemas.JOB_ITEM`),

each a folder per batch, and then its marker in `commits`. Readers take batches
with a marker only, so the tables always tell the same story; a batch that is
replayed after a fault writes its folders and its marker again. The marker also
names the oldest batch with a recording that is still open, and no later batch
reads further back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoalsong import constants as C
from shoalsong import schemas
from shoalsong.constants import SegmentSpec
from shoalsong.operators import embedding, features, items, similarity
from shoalsong.sources.items import complete
from shoalsong.sources.tables import read_if_present
from shoalsong.streaming.jobs import DRAIN

CARRIED = ["recording_id", "segment_idx", "total_duration", "num_segments"]
VECTORS = ("recording_id string, segment_idx int, total_duration double, num_segments int, feature_embedding array<double>, "
           "embedding array<double>, error string, error_code string")
SUMS = ("recording_id string, is_feature boolean, _block int, _n bigint, _lo int, _hi int, " +
        ", ".join(f"_{i} double" for i in range(embedding.POOL_BLOCK)))
SEEN = "recording_id string, total_duration double, expected int, windows bigint"
RESULTS = "recording_id string, num_segments bigint, synthetic boolean, label string, confidence double"
DEAD = "recording_id string, error_code string, error string"
COMMIT = "oldest_open bigint"


def window_vectors(segments: DataFrame, spec: SegmentSpec, factory: embedding.ModelFactory | None = None,
                   width: int = C.EMBEDDING_WIDTH, noise: bool = True) -> DataFrame:
    """A row per window with its vectors, and the error rows as they came, in one Arrow step. A model may
    fail on a window: `error` says so and error_code stays null."""
    carried = CARRIED if factory is None else [*CARRIED, "samples"]
    measure = features.feature_batches(carried, spec.rate)
    describe = features.vector_batches(carried, width // 4, noise)
    infer = embedding.embed_batches([*CARRIED, "feature_embedding"], factory, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rejected = []

        def good():
            for batch in batches:
                bad = pc.is_valid(batch.column("error_code"))
                if pc.any(bad).as_py():
                    rejected.append(batch.filter(bad).select([*CARRIED, "error", "error_code"]))
                    batch = batch.filter(pc.invert(bad))
                if batch.num_rows:
                    yield batch.select([*CARRIED, "samples"])

        def widened(batch, names):
            kinds = {"feature_embedding": pa.list_(pa.float64()), "embedding": pa.list_(pa.float64()), "error_code": pa.string()}
            columns = [batch.column(n) if n in batch.schema.names else pa.nulls(batch.num_rows, kinds[n]) for n in names]
            return pa.RecordBatch.from_arrays(columns, names)

        names = [*CARRIED, "feature_embedding", "embedding", "error", "error_code"]
        for batch in infer(describe(measure(good()))):
            yield widened(batch, names)
        for batch in rejected:
            yield widened(batch, names)

    return segments.select(*CARRIED, "samples", "error_code", "error").mapInArrow(run, VECTORS)


def committed(spark: SparkSession, path: str, table: str, schema: str, since: int = 0, before: int | None = None) -> DataFrame:
    """Rows of the batches whose marker is there, with their `batch`."""
    rows = read_if_present(spark, f"{path}/{table}", f"{schema}, batch bigint", basePath=f"{path}/{table}")
    marks = read_if_present(spark, f"{path}/commits", f"{COMMIT}, batch bigint", basePath=f"{path}/commits").select("batch")
    rows, marks = (d.where(F.col("batch") >= since) for d in (rows, marks))
    if before is not None:
        rows, marks = (d.where(F.col("batch") < before) for d in (rows, marks))
    return rows.join(F.broadcast(marks.distinct()), "batch", "left_semi")  # a row per batch


def _oldest_open(spark: SparkSession, path: str, batch: int) -> int:
    marks = read_if_present(spark, f"{path}/commits", f"{COMMIT}, batch bigint", basePath=f"{path}/commits")
    last = marks.where(F.col("batch") < batch).agg(F.max_by("oldest_open", "batch")).first()[0]
    return 0 if last is None else last


def job_items(seen: DataFrame, results: DataFrame, dead: DataFrame, spec: SegmentSpec, batch: int) -> DataFrame:
    """Items of one batch: windows are there, results, errors, and what becomes of the uploads."""
    done = items.identified(results.withColumn("document", F.lit(None).cast("string")))
    cut = items.identified(seen.select("recording_id", F.col("total_duration").alias("duration_seconds"),
                                       F.col("expected").alias("num_segments")))
    failed = items.identified(dead)
    kinds = [items.upload_updates(cut, "processing"), items.preprocessed_items(cut), items.result_items(done),
             items.upload_updates(done, "complete"), items.error_items(failed, spec)]
    stamped = [items.stamped(complete(k).drop("ts", "event_id"), F.localtimestamp(), F.lit(batch * len(kinds) + i).cast("bigint"))
               for i, k in enumerate(kinds)]
    out = complete(stamped[0])
    for part in stamped[1:]:
        out = out.unionByName(complete(part))
    return out


def run(segments: DataFrame, refs: DataFrame, path: str, checkpoint: str, spec: SegmentSpec,
        factory: embedding.ModelFactory | None = None, width: int = C.EMBEDDING_WIDTH, noise: bool = True,
        trigger: dict = DRAIN) -> StreamingQuery:
    """Start the stream; `refs` are the reference entries to classify against."""
    spark = segments.sparkSession
    similarity.category_vectors(refs).write.mode("overwrite").parquet(f"{path}/categories")
    categories = spark.read.parquet(f"{path}/categories")

    def write(batch: DataFrame, batch_id: int) -> None:
        def put(df: DataFrame, table: str, schema: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{path}/{table}/batch={batch_id}")
            return spark.read.schema(schema).parquet(f"{path}/{table}/batch={batch_id}")

        vectors = put(window_vectors(batch, spec, factory, width, noise), "vectors", VECTORS)
        good = vectors.where(F.col("error_code").isNull())
        dead = put(vectors.where(F.col("error_code").isNotNull()).select("recording_id", "error_code", "error"), "dead", DEAD)
        sums = put(embedding.kind_sums(good), "sums", SUMS)
        seen = put(good.groupBy("recording_id").agg(
            F.max("total_duration").alias("total_duration"), F.max("num_segments").alias("expected"),
            F.count(F.lit(1)).alias("windows")), "seen", SEEN)

        since = _oldest_open(spark, path, batch_id)
        known = committed(spark, path, "seen", SEEN, since, batch_id).unionByName(seen.withColumn("batch", F.lit(batch_id).cast("bigint")))
        state = known.groupBy("recording_id").agg(
            F.sum("windows").alias("windows"), F.max("expected").alias("expected"), F.min("batch").alias("first"),
            F.max("batch").alias("last"))
        whole = state.where((F.col("windows") >= F.col("expected")) & (F.col("last") == batch_id)).select("recording_id")
        parts = committed(spark, path, "sums", SUMS, since, batch_id).drop("batch").unionByName(sums)
        pooled = embedding.pooled_sums(embedding.merged_sums(parts.join(whole, "recording_id", "left_semi")))
        labels = similarity.classify(pooled, refs, vectors=categories)
        results = put(labels.select("recording_id", "num_segments", "synthetic", "label", "confidence"), "results", RESULTS)
        new = seen.join(known.where(F.col("batch") < batch_id).select("recording_id"), "recording_id", "left_anti")
        put(job_items(new, results, dead, spec, batch_id), "items", schemas.JOB_ITEM)

        still = state.where(F.col("windows") < F.col("expected")).agg(F.min("first")).first()[0]
        mark = spark.createDataFrame([(batch_id + 1 if still is None else still,)], COMMIT)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")

    return (segments.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file that is done: its result or its error."""
    results = committed(spark, path, "results", RESULTS).drop("batch")
    return results.unionByName(committed(spark, path, "dead", DEAD).drop("batch"), allowMissingColumns=True)
