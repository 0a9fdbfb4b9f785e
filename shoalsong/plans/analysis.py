"""From recording files to one result row per recording."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalsong import constants as C
from shoalsong.constants import SegmentSpec
from shoalsong.functions import fields
from shoalsong.functions import vectors as V
from shoalsong.operators import embedding, features, similarity, validation
from shoalsong.sources import corpus, tables, wav, workspace


def check_files(files: DataFrame, spec: SegmentSpec, max_bytes: int = C.MAX_FILE_BYTES,
                root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(checked files, oversized files): headers parsed, durations judged. The
    recording_id is the path below `root`, so equal names in two folders stay two recordings."""
    admitted, oversized = validation.admit_by_size(files, max_bytes)
    checked = wav.with_duration_check(wav.with_header(admitted), spec)
    return checked.withColumn("recording_id", corpus.below(F.col("path"), root)), oversized


def segments_of(files: DataFrame, spec: SegmentSpec, max_bytes: int = C.MAX_FILE_BYTES,
                root: str | None = None) -> DataFrame:
    """One pass over the files: a row per segment, and a row with an error for
    every file that yields none. Written once, the two kinds are read apart by
    `good_segments` and `dead_letters`."""
    checked, oversized = check_files(files, spec, max_bytes, root)
    too_large = oversized.select(corpus.below(F.col("path"), root).alias("recording_id"), "error_code", "error")
    return wav.cut_segments(checked, spec).unionByName(too_large, allowMissingColumns=True)


def good_segments(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("error_code").isNull()).drop("error_code", "error")


def dead_letters(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("error_code").isNotNull()).select("recording_id", "error_code", "error")


def segment_vectors(
    checked: DataFrame,
    spec: SegmentSpec,
    factory: embedding.ModelFactory | None = None,
    width: int = C.EMBEDDING_WIDTH,
    noise: bool = True,
) -> DataFrame:
    """(recording_id, segment_idx, num_segments, feature_embedding, embedding, error) of the valid files.

    Cutting, features and inference run as one Arrow step, so windows of audio
    never return to the JVM: a file goes in, a few vectors per segment come out.
    """
    names = ["recording_id", "segment_idx", "num_segments"]
    carried = names if factory is None else names + ["samples"]
    cut = wav.cut_batches(spec)
    measure = features.feature_batches(carried, spec.rate)
    describe = features.vector_batches(carried, width // 4, noise)
    infer = embedding.embed_batches(names + ["feature_embedding"], factory, width)

    def run(batches):
        return infer(describe(measure(cut(batches))))

    return wav.signal_rows(checked.where(F.col("error_code").isNull())).mapInArrow(
        run, "recording_id string, segment_idx int, num_segments int, feature_embedding array<double>, "
             "embedding array<double>, error string")


def embed_files(
    checked: DataFrame,
    spec: SegmentSpec,
    factory: embedding.ModelFactory | None = None,
    width: int = C.EMBEDDING_WIDTH,
    noise: bool = True,
) -> DataFrame:
    """Pooled embedding per valid file of `check_files`. Feature vectors stand in
    for a recording whose inference failed, or for all of them without a model."""
    return embedding.pool_with_fallback(segment_vectors(checked, spec, factory, width, noise), "recording_id")


def file_outcomes(files: DataFrame, pooled: DataFrame, spec: SegmentSpec, max_bytes: int = C.MAX_FILE_BYTES,
                  root: str | None = None) -> DataFrame:
    """Exactly one row per file: its pooled embedding, or an error_code and error.

    `pooled` is the stored result of `embed_files` on the same files. A file that
    was admitted and still has no vector failed while it was cut or described.
    """
    checked, oversized = check_files(files, spec, max_bytes, root)
    judged = checked.select("recording_id", "error_code", "error").unionByName(
        oversized.select(corpus.below(F.col("path"), root).alias("recording_id"), "error_code", "error"))
    failed = F.col("error_code").isNull() & F.col("embedding").isNull()
    return judged.join(pooled, "recording_id", "left").withColumn(
        "error_code", F.when(failed, F.lit(C.PROCESSING_FAILED)).otherwise(F.col("error_code"))).withColumn(
        "error", F.when(failed, F.lit("no vector could be made of the samples")).otherwise(F.col("error")))


def _stored(value: Column) -> Column:
    return F.round(value, C.STORED_DECIMALS)


def result_documents(pooled: DataFrame, refs: DataFrame, key: str = "analysis_id") -> DataFrame:
    """One nested result per recording (`schemas.RESULT`), rounded for storage.

    The pooled vectors are written once and read by the classification and by
    the search, so that files behind them are decoded and embedded once.
    """
    spark, folder = pooled.sparkSession, workspace.new_folder(pooled.sparkSession, "pooled")
    pooled.write.parquet(folder)
    pooled = spark.read.schema(pooled.schema).parquet(folder)
    scored = similarity.project_2d(similarity.classify(pooled, refs))
    sites = (
        similarity.similar_sites_or_placeholder(pooled, refs, key)
        .groupBy(key)
        .agg(F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "site_id", "similarity", "country", "status"))),
            lambda s: F.struct(s["site_id"].alias("site_id"), _stored(s["similarity"]).alias("similarity"),
                               s["country"].alias("country"), s["status"].alias("status"))).alias("similar_sites"))
    )
    synthetic = F.col("synthetic") if "synthetic" in pooled.columns else F.lit(False)
    # At most ten points, so they fit in one value.
    points = similarity.reference_points(refs).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("ref_id", "site_id", "x", "y", "status"))),
        lambda p: F.struct(p["site_id"].alias("site_id"), _stored(p["x"]).alias("x"), _stored(p["y"]).alias("y"),
                           p["status"].alias("status"))).alias("points")).scalar()
    probabilities = F.map_from_entries(F.transform(
        "probabilities", lambda c: F.struct(c["status"].alias("key"), _stored(c["p"]).alias("value"))))
    return scored.join(sites, key, "left").select(
        F.col(key),
        F.lit("complete").alias("status"),
        F.struct(F.col("label"), _stored(F.col("confidence")).alias("confidence"),
                 probabilities.alias("probabilities")).alias("classification"),
        F.coalesce("similar_sites", F.array().cast(
            "array<struct<site_id:string,similarity:double,country:string,status:string>>")).alias("similar_sites"),
        F.struct(F.lit("projection_2d").alias("type"),
                 F.struct(_stored(F.col("x")).alias("x"), _stored(F.col("y")).alias("y")).alias("coordinates"),
                 points.alias("reference_sites")).alias("visualization"),
        F.struct(V.width(F.col("embedding")).alias("dimension"), F.col("num_segments"),
                 F.lit("mean").alias("aggregation"), synthetic.alias("synthetic")).alias("embedding_summary"),
        F.current_timestamp().alias("completed_at"),
        fields.caveat(synthetic).alias("caveats"),
    )


def reference_index(segments: DataFrame, key: str = "filename") -> DataFrame:
    """Reference entries from segment vectors (filename, embedding): pooled per
    file, with site and country taken from the file name."""
    pooled = embedding.mean_pool(segments, key)
    parsed = pooled.withColumn("_p", fields.filename_parts(F.col(key)))
    return parsed.select(
        F.xxhash64(key).alias("ref_id"), F.col(key).alias("filename"), "_p.site_id", "_p.country", "_p.site_type",
        "num_segments", "embedding")


def build_reference_tables(files: DataFrame, spec: SegmentSpec, factory: embedding.ModelFactory, path: str,
                           width: int = C.EMBEDDING_WIDTH, root: str | None = None,
                           upload_limits: bool = False) -> DataFrame:
    """Embed a reference corpus into two tables below `path`: the vectors of each
    file's segments, and the index of pooled entries. Runs the job.

    Returns one row per file seen (country, site_type, num_segments), 0 for files
    that were rejected or of which a segment failed: those are not in the index.
    A reference needs one segment; the size and duration limits of uploads hold
    for references only with `upload_limits`.

    A file may come in several rows with a column `part` (`schemas.FILE_PART`), as one value has a
    limit of its own: its windows are cut part by part, and it is in the index if all have a vector.
    """
    spark = files.sparkSession
    if upload_limits:
        checked, _ = check_files(files, spec, root=root)
    else:
        free = dataclasses.replace(spec, min_seconds=0.0, max_seconds=float("inf"))
        checked, _ = check_files(files, free, (1 << 63) - 1, root)
    segment_vectors(checked, spec, factory, width).drop("feature_embedding").write.mode("overwrite").parquet(
        f"{path}/segments")
    vectors = spark.read.schema(
        "recording_id string, segment_idx int, num_segments int, embedding array<double>, error string").parquet(
        f"{path}/segments")
    broken = vectors.groupBy("recording_id").agg(
        F.count("embedding").alias("_found"), F.greatest(F.count(F.lit(1)), F.max("num_segments")).alias("_all")).where(
        F.col("_found") < F.col("_all")).select("recording_id")
    whole = vectors.join(broken, "recording_id", "left_anti")
    tables.write_references(reference_index(whole.withColumnRenamed("recording_id", "filename")), f"{path}/index")
    index = tables.load_references(spark, f"{path}/index")
    once = files.where(F.coalesce("part.first", F.lit(0)) == 0) if "part" in files.columns else files
    seen = once.select(corpus.below(F.col("path"), root).alias("filename"))
    named = seen.join(index.select("filename", "num_segments"), "filename", "left").withColumn(
        "_p", fields.filename_parts(F.col("filename")))
    return named.select("filename", "_p.country", "_p.site_type",
                        F.coalesce("num_segments", F.lit(0)).cast("bigint").alias("num_segments"))
