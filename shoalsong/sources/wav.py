"""WAV recordings as rows: header parse, cutting into segments, encoding.

Spark reads the files, splits them over tasks, validates headers and routes
errors. Python only touches bytes: it finds the chunks of one file, and turns
the data bytes of one admitted file into windows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalsong import constants as C
from shoalsong import schemas
from shoalsong.constants import SegmentSpec
from shoalsong.operators import validation

# Fixed values of the WAV format.
PCM, IEEE_FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
HEADER_BYTES = 44
PCM_BITS = (8, 16, 32)


# Hexadecimal shape of the common 44-byte header: RIFF, size, WAVE, "fmt " of 16
# bytes, "data".
PLAIN_HEADER = "^52494646.{8}57415645666D742010000000.{32}64617461.{8}$"


def find_chunks(content, length: int) -> dict:
    """Walk the chunks up to the data chunk of a file of `length` bytes. `content` gives bytes by
    slices: at least everything before the samples."""
    if bytes(content[:4]) != b"RIFF":
        return {"error": "missing RIFF header"}
    if bytes(content[8:12]) != b"WAVE":
        return {"error": "missing WAVE marker"}
    found, at = {}, 12
    while at + 8 <= length:
        name = bytes(content[at:at + 4])
        size = int.from_bytes(content[at + 4:at + 8], "little")
        body = at + 8
        if name == b"fmt " and size >= 16 and body + 16 <= length:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", content[body:body + 16])
            if kind == EXTENSIBLE and size >= 26 and body + 26 <= length:
                kind = int.from_bytes(content[body + 24:body + 26], "little")
            found = {"audio_format": kind, "channels": channels, "sample_rate": rate, "bits": bits}
        elif name == b"data":
            if not found:
                return {"error": "missing format chunk"}
            return {**found, "data_offset": body, "data_bytes": min(size, length - body)}
        at = body + size + size % 2
    return {**found, "error": "missing data chunk" if found else "missing format chunk"}


def judge(header: dict) -> dict:
    """Add error, error_code and frames."""
    kind, bits = header.get("audio_format"), header.get("bits")
    if "error" in header:
        reason = header["error"]
    elif header["channels"] < 1 or header["sample_rate"] < 1:
        reason = "no channels or no sample rate"
    elif kind != PCM and not (kind == IEEE_FLOAT and bits == 32):
        reason = f"unsupported audio format {kind}"
    elif bits not in PCM_BITS:
        reason = f"unsupported bit depth: {bits}-bit"
    else:
        frames, rest = divmod(header["data_bytes"], header["channels"] * bits // 8)
        if rest:
            return {**header, "error": "data ends inside a frame", "error_code": C.PROCESSING_FAILED}
        return {**header, "frames": frames}
    return {**header, "error": reason, "error_code": C.INVALID_AUDIO_FORMAT}


def with_header(files: DataFrame, column: str = "content") -> DataFrame:
    """Add the `schemas.WAV_HEADER` columns; unreadable files get an error_code,
    and an unexpected fault stays with its own row.

    Of files with the plain header only its 44 bytes go to Python; the chunks
    of the others can lie anywhere, so those are sent whole.
    """
    arrow_type = pa.struct([
        (f.name, pa.string() if f.name.startswith("error") else pa.int64()) for f in schemas.WAV_HEADER.fields])

    @F.arrow_udf(schemas.WAV_HEADER)
    def header(contents: pa.Array, lengths: pa.Array) -> pa.Array:
        rows = []
        for content, length in zip(contents, lengths.to_pylist()):
            try:
                view = memoryview(content.as_buffer() if content.is_valid else b"")
                rows.append(judge(find_chunks(view, length or 0)))
            except Exception as problem:
                rows.append({"error": str(problem), "error_code": C.PROCESSING_FAILED})
        return pa.array(rows, arrow_type)

    start = F.substring(column, 1, HEADER_BYTES)
    needed = F.when(F.hex(start).rlike(PLAIN_HEADER), start).otherwise(F.col(column))
    return files.withColumn("_h", header(needed, F.length(column))).select(*files.columns, "_h.*")


def format_error(content: Column) -> Column:
    """Cheap check of the two markers that needs no Python."""
    def marker(start):
        return F.substring(content, start, 4)

    return F.when(
        F.coalesce(marker(1) != F.lit(b"RIFF"), F.lit(True)), F.lit("missing RIFF header")
    ).when(F.coalesce(marker(9) != F.lit(b"WAVE"), F.lit(True)), F.lit("missing WAVE marker"))


def with_duration_check(headed: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Add duration, n_resampled, num_segments; set error_code for bad durations.

    A `part` of a file (`schemas.FILE_PART`) is judged and described by the frames of the whole.
    """
    frames, rate = F.col("frames"), F.col("sample_rate")
    if "part" in headed.columns:
        frames = F.coalesce("part.frames", "frames")
    timed = headed.select(
        *[c for c in headed.columns if c not in ("error", "error_code")],
        F.col("error").alias("_error"), F.col("error_code").alias("_code"),
        (frames / rate).alias("duration"),
        validation.resampled_length(frames, rate, spec.rate).alias("n_resampled"))
    seconds, segments = F.col("duration"), F.floor(F.col("n_resampled") / spec.samples).cast("int")
    too_short = F.format_string("%.2f s, at least %.2f s required", seconds, F.lit(float(spec.min_seconds)))
    too_long = F.format_string("%.2f s, at most %.2f s allowed", seconds, F.lit(float(spec.max_seconds)))
    return timed.select(
        *[c for c in timed.columns if c not in ("_error", "_code")],
        segments.alias("num_segments"),
        F.coalesce("_code", validation.duration_error(seconds, spec),
                   F.when(segments == 0, F.lit(C.AUDIO_TOO_SHORT))).alias("error_code"),
        F.coalesce("_error", F.when(seconds > spec.max_seconds, too_long)
                   .when((seconds < spec.min_seconds) | (segments == 0), too_short)).alias("error"))


def data_bytes(column: str = "content") -> Column:
    """The data chunk, cut out on the JVM."""
    return F.substring(F.col(column), (F.col("data_offset") + 1).cast("int"), F.col("data_bytes").cast("int"))


def integers(data, bits: int, audio_format: int, compat: bool):
    """Sample values as stored, and what full scale is."""
    if bits == 8:
        return np.frombuffer(data, np.uint8).astype(np.int16) - 128, 32768.0 if compat else 128.0
    if bits == 16:
        return np.frombuffer(data, "<i2"), 32768.0
    if audio_format == IEEE_FLOAT and not compat:
        return np.frombuffer(data, "<f4"), 1.0
    return np.frombuffer(data, "<i4"), 2147483648.0


def scaled(data, bits: int, audio_format: int, compat: bool):
    """Float32 samples of one channel by full scale."""
    ints, scale = integers(data, bits, audio_format, compat)
    return (ints.astype(np.float32) / scale).astype(np.float32)


def mono(data, bits: int, audio_format: int, channels: int, compat: bool):
    """Float32 mono signal of one recording in [-1, 1]."""
    if channels == 1:
        return scaled(data, bits, audio_format, compat)
    mixed = integers(data, bits, audio_format, compat)[0].reshape(-1, channels).mean(axis=1, dtype=np.float64)
    # A mixed signal is scaled by its own peak; silence stays silent.
    peak = np.abs(mixed).max(initial=0.0)
    return (mixed / peak if peak > 0 else mixed).astype(np.float32)


def grid_of(rate: int, target: int, start: int, stop: int):
    """Source index and fraction of the output positions [start, stop)."""
    position = np.arange(start, stop, dtype=np.int64) * rate / target
    at = position.astype(np.int64)
    return at, position - at


def interpolate(signal, at, share):
    """Half-open linear interpolation; the fraction was taken before the index
    is moved off the last sample."""
    if len(at) and at[-1] > len(signal) - 2:
        at = np.minimum(at, max(len(signal) - 2, 0))
    low = signal[at]
    high = signal[np.minimum(at + 1, len(signal) - 1)] if len(signal) < 2 else signal[at + 1]
    return (low * (1 - share) + high * share).astype(np.float32)


# Windows that a task holds before it passes them on: short ones cost more as rows than as samples.
HELD_WINDOWS = 4096


def cut_batches(spec: SegmentSpec, compat: bool = False):
    """Arrow step: one row per window of each file, or of each part of one (`schemas.SEGMENT`)."""
    size, target = spec.samples, spec.rate
    arrow_schema = pa.schema([
        ("recording_id", pa.string()), ("segment_idx", pa.int32()), ("samples", pa.list_(pa.float32())),
        ("sample_rate", pa.int32()), ("original_sample_rate", pa.int64()), ("total_duration", pa.float64()),
        ("num_segments", pa.int32()), ("error_code", pa.string()), ("error", pa.string())])
    per_batch = max(1, min(HELD_WINDOWS, (4 << 20) // size))

    # Only the grid of the latest rate is kept.
    first_grids = {}

    def grid(rate, i):
        """Where a window spans a whole number of source samples, all windows
        of a rate share the grid of the first, moved along."""
        if size * rate % target:
            return grid_of(rate, target, i * size, (i + 1) * size)
        if rate not in first_grids:
            first_grids.clear()
            first_grids[rate] = grid_of(rate, target, 0, size)
        at, share = first_grids[rate]
        return at + i * (size * rate // target), share

    def windows(row):
        signal = mono(row["data"].as_buffer(), row["bits"].as_py(), row["audio_format"].as_py(),
                       row["channels"].as_py(), compat)
        if signal.dtype.kind == "f" and not np.isfinite(signal).all():
            raise ValueError("samples are not finite numbers")
        rate, part = row["sample_rate"].as_py(), row["part"].as_py() if "part" in row else None
        first, end = (part["first"], part["end"]) if part else (0, row["num_segments"].as_py())
        if part and (end - first) * size * rate > len(signal) * target:
            raise ValueError("part ends before its last window")
        for i in range(end - first):
            yield first + i, signal[i * size:(i + 1) * size] if rate == target else interpolate(signal, *grid(rate, i))

    def emit(records):
        arrays = [pa.array(values, field.type) for values, field in zip(zip(*records), arrow_schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    def run(batches):
        held = []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                name, rate, count = (row[c].as_py() for c in ("recording_id", "sample_rate", "num_segments"))
                code, message = row["error_code"].as_py(), row["error"].as_py()
                if code is not None:
                    held.append((name, None, None, target, rate, None, None, code, message))
                    continue
                seconds = row["n_resampled"].as_py() / target
                try:
                    for i, window in windows(row):
                        held.append((name, i, window, target, rate, seconds, count, None, None))
                        if len(held) >= per_batch:
                            yield emit(held)
                            held = []
                except Exception as problem:
                    held.append((name, None, None, target, rate, seconds, count, C.PROCESSING_FAILED, str(problem)))
        if held:
            yield emit(held)

    return run


def signal_rows(checked: DataFrame, key: str = "recording_id") -> DataFrame:
    """What `cut_batches` needs of checked files; no bytes of rejected ones."""
    part = ["part"] if "part" in checked.columns else []
    return checked.select(
        F.col(key).cast("string").alias("recording_id"),
        F.when(F.col("error_code").isNull(), data_bytes()).alias("data"),
        "sample_rate", "channels", "bits", "audio_format", "n_resampled", "num_segments", "error_code", "error", *part)


def cut_segments(checked: DataFrame, spec: SegmentSpec, key: str = "recording_id", compat: bool = False) -> DataFrame:
    """One row per segment of files that went through `with_duration_check`.

    Each file is cut inside its own task, so segments never need a shuffle; a
    window is resampled only when it is emitted. Nothing is lost: a rejected
    file, or one that fails while being cut, is a row with an error instead of
    samples. `compat=True` reads 8-bit and 32-bit float files at the historical
    (wrong) scale.
    """
    return signal_rows(checked, key).mapInArrow(cut_batches(spec, compat), schemas.SEGMENT)


def decode_samples(checked: DataFrame, key: str = "recording_id", chunk: int = 1 << 20, compat: bool = False) -> DataFrame:
    """Normalised mono samples at the original rate, in array rows of at most
    `chunk` samples: (recording_id, start_idx, samples, sample_rate, error_code, error).

    `posexplode(samples)` turns them into the sample rows of `operators.signal`.
    """
    def parts_of(row):
        if row["error_code"].is_valid:
            return [(None, None, row["error_code"].as_py(), row["error"].as_py())]
        try:
            signal = mono(row["data"].as_buffer(), row["bits"].as_py(), row["audio_format"].as_py(),
                           row["channels"].as_py(), compat)
            return [(i, signal[i:i + chunk], None, None) for i in range(0, len(signal), chunk)]
        except Exception as problem:
            return [(None, None, C.PROCESSING_FAILED, str(problem))]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                for start, samples, code, message in parts_of(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["recording_id"].as_py()], pa.string()), pa.array([start], pa.int64()),
                         pa.array([samples], pa.list_(pa.float32())), pa.array([row["sample_rate"].as_py()], pa.int64()),
                         pa.array([code], pa.string()), pa.array([message], pa.string())],
                        ["recording_id", "start_idx", "samples", "sample_rate", "error_code", "error"])

    return signal_rows(checked, key).mapInArrow(
        run, "recording_id string, start_idx bigint, samples array<float>, sample_rate bigint, "
             "error_code string, error string")


def encode(signals: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, pcm array<smallint>, sample_rate) to (key, content): mono 16-bit WAV files."""
    def run(batches):
        for batch in batches:
            contents = []
            for pcm, rate in zip(batch.column("pcm"), batch.column("sample_rate").to_pylist()):
                data = pcm.values.to_numpy(zero_copy_only=False).astype("<i2").tobytes()
                contents.append(struct.pack(
                    "<4sI4s4sIHHIIHH4sI", b"RIFF", HEADER_BYTES - 8 + len(data), b"WAVE", b"fmt ", 16,
                    PCM, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(contents, pa.binary())], [key, "content"])

    dtype = signals.schema[key].dataType.simpleString()
    return signals.select(key, "pcm", "sample_rate").mapInArrow(run, f"{key} {dtype}, content binary")
