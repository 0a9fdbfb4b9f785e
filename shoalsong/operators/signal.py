"""Signal operators on sample rows.

Input rows are (recording_id, sample_idx, v, sample_rate, n_samples) of valid
recordings (`validation.admitted_samples`). Everything is keyed by recording,
so one placement by recording serves the whole chain: no operator here adds a
shuffle, and none joins. Output positions are generated from the source sample
they lie on instead of joining an output grid back to the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalsong.constants import SegmentSpec

KEY = "recording_id"

# Full scale of the sample formats.
FULL_SCALE = ((8, 128.0), (16, 32768.0), (32, 2147483648.0))


def _timeline() -> Window:
    return Window.partitionBy(KEY).orderBy("sample_idx")


def duration(samples: DataFrame) -> DataFrame:
    return samples.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_samples"),
        (F.count(F.lit(1)) / F.max("sample_rate")).alias("duration"))


def downmix(samples: DataFrame, channels: int) -> DataFrame:
    """Mean over the interleaved channels; a partial last frame is not a frame."""
    whole = samples.where(F.col("sample_idx") < F.col("n_samples") - F.col("n_samples") % channels)
    return (
        whole.groupBy(KEY, F.floor(F.col("sample_idx") / channels).cast("bigint").alias("frame"))
        .agg(F.avg("v").alias("v"), F.max("sample_rate").alias("sample_rate"),
             F.floor(F.max("n_samples") / channels).cast("bigint").alias("n_samples"))
        .withColumnRenamed("frame", "sample_idx")
    )


def normalize_fullscale(value: Column, bits: Column) -> Column:
    """Integer sample to [-1, 1); other widths are taken as already scaled."""
    scale = F.lit(1.0)
    for width, full in FULL_SCALE:
        scale = F.when(bits == width, F.lit(full)).otherwise(scale)
    return value / scale


def normalize_peak(samples: DataFrame, only_above_one: bool = False) -> DataFrame:
    """Divide by the recording's peak; silence stays silent."""
    peak = F.max(F.abs("v")).over(Window.partitionBy(KEY))
    divisor = F.when(F.col("_peak") > 1.0, F.col("_peak")).otherwise(F.lit(1.0)) if only_above_one else F.col("_peak")
    return (samples.withColumn("_peak", peak)
            .withColumn("v", F.when(F.col("_peak") > 0, F.col("v") / divisor).otherwise(F.lit(0.0)))
            .drop("_peak"))


def _emit(samples: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per output index in [first, last]; none if the range is empty."""
    outputs = F.when(first <= last, F.sequence(first, last))
    return samples.withColumn("out_idx", F.explode(outputs))


def resample_linear(samples: DataFrame, target: int, boundary: str = "compat") -> DataFrame:
    """Linear interpolation at half-open positions j * rate / target.

    The fraction is taken before the position is moved off the last sample, so
    a position on the last sample interpolates from the one before it by the
    leftover fraction (`boundary="compat"`); `"clamp"` holds the last sample.
    Recordings already at the target rate pass through.
    """
    rate, n, i = F.col("sample_rate"), F.col("n_samples"), F.col("sample_idx")
    n_out = F.floor(n / rate * F.lit(target)).cast("bigint")
    timed = (
        samples.withColumn("_next", F.lead("v").over(_timeline()))
        .withColumn("_prev", F.lag("v").over(_timeline()))
        .withColumn("n_out", F.when(rate == target, n).otherwise(n_out))
    )
    # j lies on sample i when i <= j * rate / target < i + 1.
    first = F.when(rate == target, i).otherwise(F.ceil(i * target / rate)).cast("bigint")
    last = F.when(rate == target, i).otherwise(F.ceil((i + 1) * target / rate) - 1).cast("bigint")
    out = _emit(timed, first, F.least(last, F.col("n_out") - 1))
    fraction = F.col("out_idx") * rate / F.lit(target) - i
    at_end = i == n - 1
    if boundary == "compat":
        low = F.when(at_end, F.coalesce("_prev", "v")).otherwise(F.col("v"))
        high = F.when(at_end, F.col("v")).otherwise(F.col("_next"))
    elif boundary == "clamp":
        low, high = F.col("v"), F.coalesce("_next", "v")
    else:
        raise ValueError(f"unknown boundary {boundary!r}")
    value = F.when(rate == target, F.col("v")).otherwise(low * (1 - fraction) + high * fraction)
    return _resampled(out, value, target)


def resample_endpoint(samples: DataFrame, target: int) -> DataFrame:
    """Linear interpolation on a grid whose ends meet the first and last sample."""
    rate, n, i = F.col("sample_rate"), F.col("n_samples"), F.col("sample_idx")
    n_out = F.floor(n / rate * F.lit(target)).cast("bigint")
    timed = (
        samples.withColumn("_next", F.lead("v").over(_timeline()))
        .withColumn("n_out", F.when(rate == target, n).otherwise(n_out))
    )
    m = F.col("n_out")
    # j lies on sample i when i <= j * (n - 1) / (m - 1) < i + 1.
    steps, span = m - 1, n - 1
    same = (rate == target) | (steps <= 0) | (span <= 0)
    first = F.when(same, i).otherwise(F.ceil(i * steps / F.greatest(span, F.lit(1))))
    last = F.when(same, i).otherwise(F.ceil((i + 1) * steps / F.greatest(span, F.lit(1))) - 1)
    out = _emit(timed, first.cast("bigint"), F.least(last.cast("bigint"), m - 1))
    position = F.col("out_idx") * span / F.greatest(steps, F.lit(1))
    value = F.when(same | F.col("_next").isNull(), F.col("v")).otherwise(
        F.col("v") + (F.col("_next") - F.col("v")) * (position - i))
    return _resampled(out, value, target)


def _resampled(out: DataFrame, value: Column, target: int) -> DataFrame:
    return out.select(KEY, F.col("out_idx").alias("sample_idx"), value.alias("v"),
                      F.lit(target).alias("sample_rate"), F.col("n_out").alias("n_samples"))


def segment_fixed(samples: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Non-overlapping windows; samples after the last whole window are dropped."""
    size = spec.samples
    whole = F.floor(F.col("n_samples") / size) * size
    return _windowed(samples.where(F.col("sample_idx") < whole), size)


def segment_padded(samples: DataFrame, spec: SegmentSpec) -> DataFrame:
    """As `segment_fixed`, but a tail of more than half a window is kept and
    filled with zeros, which the last sample of the recording emits."""
    size = spec.samples
    tail = F.col("n_samples") % size
    keep_tail = tail > size // 2
    whole = F.col("n_samples") - tail
    is_last = F.col("sample_idx") == F.col("n_samples") - 1
    kept = samples.where((F.col("sample_idx") < whole) | keep_tail)
    end = F.when(is_last & keep_tail, whole + size - 1).otherwise(F.col("sample_idx"))
    return _windowed(
        kept.withColumn("_pos", F.explode(F.sequence("sample_idx", end)))
        .withColumn("v", F.when(F.col("_pos") == F.col("sample_idx"), F.col("v")).otherwise(F.lit(0.0)))
        .withColumn("sample_idx", F.col("_pos")).drop("_pos"),
        size,
    )


def _windowed(samples: DataFrame, size: int) -> DataFrame:
    return samples.withColumn("segment_idx", F.floor(F.col("sample_idx") / size).cast("bigint")).withColumn(
        "offset", F.col("sample_idx") % size)


def first_window(samples: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Window 0 of the padded segmentation; recordings too short for one give no row."""
    return segment_padded(samples, spec).where(F.col("segment_idx") == 0)


def without_window(samples: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Recordings `first_window` has nothing for."""
    size = spec.samples
    return (samples.groupBy(KEY).agg(F.max("n_samples").alias("n_samples"))
            .where((F.col("n_samples") < size) & (F.col("n_samples") <= size // 2)))


def quantize_pcm16(value: Column) -> Column:
    """16-bit sample, truncated toward zero."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)) * 32767).cast("smallint")


def recording_summary(verdicts: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Header of each valid recording after processing."""
    return verdicts.where(F.col("error_code").isNull()).select(
        KEY,
        F.lit(spec.rate).alias("sample_rate"),
        F.lit(float(spec.seconds)).alias("segment_duration"),
        F.lit(spec.samples).alias("segment_samples"),
        (F.col("n_resampled") / spec.rate).alias("total_duration"),
        F.col("sample_rate").alias("original_sample_rate"),
        "num_segments",
    )


def segment_arrays(windowed: DataFrame) -> DataFrame:
    """Sample rows of segments as one array per segment; a segment has a fixed size."""
    return (
        windowed.groupBy(KEY, "segment_idx")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "v"))).alias("_s"))
        .select(KEY, "segment_idx", F.transform("_s", lambda s: s["v"]).alias("samples"))
    )
