"""Acoustic features per segment.

Level features of sample rows are plain aggregates. The spectrum needs the
whole window at once: segments are arrays there and numpy transforms a batch of
windows inside the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalsong import constants as C

SEGMENT_KEY = ("recording_id", "segment_idx")


def level_features(windowed: DataFrame) -> DataFrame:
    """rms, peak, zero crossings and their rate per segment of sample rows.

    A step onto zero and a step off zero each count as a crossing; the rate is
    per sample, not per interval.
    """
    timeline = Window.partitionBy(*SEGMENT_KEY).orderBy("sample_idx")
    step = F.signum("v") != F.lag(F.signum("v")).over(timeline)
    return (
        windowed.withColumn("_step", step)
        .groupBy(*SEGMENT_KEY)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"),
            F.max(F.abs("v")).alias("peak"),
            F.count_if("_step").alias("zero_crossings"),
        )
        .withColumn("zcr", F.col("zero_crossings") / F.col("n"))
    )


def _windows(batch, most_values: int = 1 << 17):
    """(part of the batch, float64 matrix of its `samples`), windows of equal length together.

    Parts are small enough for a core's cache: a long window comes alone, short
    ones many at a time. Empty windows are left out.
    """
    lengths = np.diff(batch.column("samples").offsets.to_numpy())
    for size in np.unique(lengths[lengths > 0]):
        alike = batch if (lengths == size).all() else batch.filter(pa.array(lengths == size))
        step = max(1, most_values // int(size))
        for start in range(0, alike.num_rows, step):
            part = alike.slice(start, step)
            flat = part.column("samples").flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(part.num_rows, size).astype(np.float64)


def _magnitudes(matrix):
    return np.abs(np.fft.rfft(matrix, axis=1))


def _passed_through(segments: DataFrame) -> tuple[list[str], str]:
    keep = [f for f in segments.schema.fields if f.name != "samples"]
    return [f.name for f in keep], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)


def bin_frequency(bin: Column, n: Column, sample_rate: int) -> Column:
    """Frequency in Hz of a bin of a window of n samples."""
    return bin * float(sample_rate) / n


def magnitude_spectrum(segments: DataFrame) -> DataFrame:
    """Replace `samples` by their number `n` and arrays `magnitude` and `share` (one-sided).

    The frequency of a bin follows from n (`bin_frequency`). An empty window gives no row.
    """
    names, kept = _passed_through(segments)
    vectors = pa.list_(pa.float64())

    def run(batches):
        for batch in batches:
            for part, matrix in _windows(batch):
                magnitude = _magnitudes(matrix)
                share = magnitude / (magnitude.sum(axis=1, keepdims=True) + C.SPECTRUM_EPSILON)
                ends = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * magnitude.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [pa.array(np.full(len(matrix), matrix.shape[1], dtype=np.int64))]
                    + [pa.ListArray.from_arrays(ends, pa.array(v.ravel()), vectors) for v in (magnitude, share)],
                    names + ["n", "magnitude", "share"])

    return segments.mapInArrow(run, kept + ", n bigint, magnitude array<double>, share array<double>")


def magnitude_spectrum_columns(segments: DataFrame) -> DataFrame:
    """As `magnitude_spectrum`, with built-in functions only.

    Each bin is a sum over the samples, so the work grows with the square of the
    window: for short windows, where starting Python costs more than the sums.
    """
    keep = [c for c in segments.columns if c != "samples"]
    n = F.size("samples")
    magnitude = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), _bin_magnitude)
    spectra = segments.where(n > 0).select(*keep, n.cast("bigint").alias("n"), magnitude.alias("magnitude"))
    total = F.aggregate("magnitude", F.lit(0.0), lambda a, x: a + x) + C.SPECTRUM_EPSILON
    # The total is an array of one value, so that it is summed up once per window.
    share = F.flatten(F.transform(F.array(total), lambda t: F.transform("magnitude", lambda x: x / t)))
    return spectra.select(*keep, "n", "magnitude", share.alias("share"))


def _bin_magnitude(k: Column) -> Column:
    n = F.size("samples")

    def part(wave) -> Column:
        # The angle is taken from a whole number below n, which keeps it exact for late samples.
        waves = F.transform("samples", lambda v, i: v * wave(
            F.pmod(k.cast("bigint") * i, n.cast("bigint")) * F.lit(2.0 * np.pi) / n))
        return F.aggregate(waves, F.lit(0.0), lambda a, x: a + x)

    return F.hypot(part(F.cos), part(F.sin))


def feature_batches(names: list[str], sample_rate: int):
    """Arrow step: the columns `names` plus the features of `samples`."""
    def run(batches):
        for batch in batches:
            for part, matrix in _windows(batch):
                n = matrix.shape[1]
                magnitude = _magnitudes(matrix)
                weighted = (magnitude * np.fft.rfftfreq(n, 1.0 / sample_rate)).sum(axis=1)
                signs = (matrix > 0).view(np.int8) - (matrix < 0).view(np.int8)
                crossings = np.count_nonzero(signs[:, 1:] != signs[:, :-1], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names]
                    + [pa.array(np.full(len(matrix), n, dtype=np.int64)),
                       pa.array(np.sqrt(np.einsum("ij,ij->i", matrix, matrix) / n)),
                       pa.array(np.maximum(matrix.max(axis=1), -matrix.min(axis=1))),
                       pa.array(crossings.astype(np.int64)),
                       pa.array(crossings / n),
                       pa.array(weighted / (magnitude.sum(axis=1) + C.SPECTRUM_EPSILON))],
                    names + ["n", "rms", "peak", "zero_crossings", "zcr", "centroid"])

    return run


def segment_features(segments: DataFrame, sample_rate: int) -> DataFrame:
    """Replace `samples` by n, rms, peak, zero_crossings, zcr and centroid (Hz).

    An empty window has no features and gives no row.
    """
    names, kept = _passed_through(segments)
    schema = kept + ", n bigint, rms double, peak double, zero_crossings bigint, zcr double, centroid double"
    return segments.mapInArrow(feature_batches(names, sample_rate), schema)


def feature_vector(block: int = C.FEATURE_BLOCK, centroid_scale: float = C.CENTROID_SCALE_HZ) -> Column:
    """Four constant blocks from the feature columns, without noise."""
    blocks = [F.col("rms"), F.col("peak"), F.col("zcr"), F.col("centroid") / centroid_scale]
    return F.concat(*[F.array_repeat(b, block) for b in blocks])


# Vectors that a task makes before it passes them on: a wide vector is thousands of times its features.
VECTOR_BYTES = 4 << 20


def vector_batches(names: list[str], block: int, noise: bool, centroid_scale: float = C.CENTROID_SCALE_HZ):
    """Arrow step: the columns `names` plus `feature_embedding`.

    A window with features that are not finite has no vector. The noise is seeded by the segment's own rms, so the result does not depend
    on how the rows are partitioned.
    """
    def vector(rms, peak, zcr, centroid):
        if not np.isfinite([rms, peak, zcr, centroid]).all():
            return None
        base = np.repeat([rms, peak, zcr, centroid / centroid_scale], block)
        if not noise:
            return base
        return base + C.FEATURE_NOISE * np.random.RandomState(int(abs(rms * 1e6) % 2**31)).randn(len(base))

    rows = max(1, VECTOR_BYTES // (8 * 4 * max(1, block)))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                levels = [part.column(c).to_numpy() for c in ("rms", "peak", "zcr", "centroid")]
                vectors = [vector(*row) for row in zip(*levels)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(vectors, pa.list_(pa.float64()))],
                    names + ["feature_embedding"])

    return run


def noisy_vectors(features: DataFrame, block: int = C.FEATURE_BLOCK,
                  centroid_scale: float = C.CENTROID_SCALE_HZ) -> DataFrame:
    """(recording_id, segment_idx, feature_embedding) with the published noise."""
    names = list(SEGMENT_KEY)
    kept = ", ".join(f"{n} {features.schema[n].dataType.simpleString()}" for n in names)
    return features.select(*names, "rms", "peak", "zcr", "centroid").mapInArrow(
        vector_batches(names, block, True, centroid_scale), kept + ", feature_embedding array<double>")
