"""Admission rules. Every rejected item stays visible as an error row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalsong import constants as C
from shoalsong.constants import SegmentSpec


def size_error(length: Column, limit: int = C.MAX_FILE_BYTES) -> Column:
    return F.when(length > limit, F.lit(C.FILE_TOO_LARGE))


def admit_by_size(files: DataFrame, limit: int = C.MAX_FILE_BYTES, column: str = "length"):
    """(admitted, errors). On a binary-file scan both filters reach the source,
    so the content of an oversized file is never read."""
    admitted = files.where(F.col(column) <= limit)
    rejected = files.where(F.col(column) > limit)
    errors = rejected.drop("content").select(
        "*",
        F.lit(C.FILE_TOO_LARGE).alias("error_code"),
        F.lit(f"File exceeds {limit} byte limit").alias("error"),
        F.col(column).alias("size_bytes"),
    )
    return admitted, errors


def duration_error(seconds: Column, spec: SegmentSpec) -> Column:
    """Both bounds are exclusive of the bound itself: exactly min or max passes."""
    return F.when(seconds < spec.min_seconds, F.lit(C.AUDIO_TOO_SHORT)).when(
        seconds > spec.max_seconds, F.lit(C.AUDIO_TOO_LONG))


def resampled_length(n_samples: Column, rate: Column, target: int) -> Column:
    return F.when(rate == target, n_samples.cast("bigint")).otherwise(
        F.floor(n_samples / rate * F.lit(target)).cast("bigint"))


def recording_verdicts(samples: DataFrame, spec: SegmentSpec, key: str = "recording_id") -> DataFrame:
    """One row per recording of a sample table: size, duration, segments, error.

    A plain count per recording, combined before the shuffle.
    """
    n_out = resampled_length(F.col("n_samples"), F.col("sample_rate"), spec.rate)
    return (
        samples.groupBy(key)
        .agg(F.max("sample_rate").alias("sample_rate"), F.count(F.lit(1)).alias("n_samples"))
        .withColumn("duration", F.col("n_samples") / F.col("sample_rate"))
        .withColumn("n_resampled", n_out)
        .withColumn("num_segments", F.floor(F.col("n_resampled") / spec.samples).cast("bigint"))
        .withColumn("error_code", F.coalesce(
            duration_error(F.col("duration"), spec),
            F.when(F.col("num_segments") == 0, F.lit(C.AUDIO_TOO_SHORT))))
        .withColumn("min_duration_required", F.when(
            F.col("error_code") == C.AUDIO_TOO_SHORT, F.lit(float(spec.min_seconds))))
        .withColumn("max_duration_allowed", F.when(
            F.col("error_code") == C.AUDIO_TOO_LONG, F.lit(float(spec.max_seconds))))
    )


def admitted_samples(samples: DataFrame, spec: SegmentSpec, key: str = "recording_id") -> DataFrame:
    """Samples of the valid recordings, with `n_samples`, placed by recording.

    Every later step works inside one recording, and a valid recording has at
    most max_seconds * rate samples, so no later group is unbounded: a
    recording holding a third of all rows is too long and is turned away here,
    before its rows are brought together. The explicit shuffle ends the join's
    stage, which lets AQE split a hot recording in the join itself; all windows
    and groupings that follow reuse this placement.
    """
    valid = recording_verdicts(samples, spec, key).where(F.col("error_code").isNull()).select(key, "n_samples")
    return samples.join(valid, key).repartition(key)


def errors_by_code(verdicts: DataFrame) -> DataFrame:
    return (verdicts.where(F.col("error_code").isNotNull())
            .groupBy("error_code").agg(F.count(F.lit(1)).alias("errors")))
