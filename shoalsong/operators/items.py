"""Job items (`schemas.JOB_ITEM`) from files, windows, results and errors.

Each function gives put or update rows without a time; `stamped` adds it. Ids
are strings. `identified` derives both from a file's path, so that a repeated
run writes the same items again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalsong import constants as C
from shoalsong.constants import SegmentSpec
from shoalsong.functions import fields


def path_id(kind: str, path: Column) -> Column:
    """An id in the form of a UUID that depends on the path alone."""
    digits = F.md5(F.concat(F.lit(f"{kind}:"), path))
    return F.concat_ws("-", *[F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def identified(rows: DataFrame, path: str = "recording_id") -> DataFrame:
    """With upload_id and analysis_id of the row's file."""
    return rows.withColumn("upload_id", path_id("upload", F.col(path))).withColumn(
        "analysis_id", path_id("analysis", F.col(path)))


def stamped(items: DataFrame, ts: Column, event_id: Column) -> DataFrame:
    """With the time of the items; event_id decides between rows of one item at one time."""
    return items.withColumn("ts", ts).withColumn("event_id", event_id)


def _item(rows: DataFrame, pk: Column, sk: str, op: str, state: str, **attributes: Column) -> DataFrame:
    return rows.select(pk.alias("pk"), F.lit(sk).alias("sk"), F.lit(op).alias("op"), "upload_id", "analysis_id",
                       F.lit(state).alias("status"), *[c.alias(n) for n, c in attributes.items()])


def upload_items(files: DataFrame, name: str = "recording_id", content_type: Column | None = None) -> DataFrame:
    """METADATA of new files (upload_id, analysis_id, length, name): put, uploaded."""
    file = F.element_at(F.split(name, "/"), -1)
    rows = files.withColumn("_analysis", F.lit(None).cast("string")).drop("analysis_id").withColumnRenamed("_analysis", "analysis_id")
    return _item(rows, fields.upload_key(F.col("upload_id")), "METADATA", "put", "uploaded", filename=file,
                 file_key=F.concat(F.lit("uploads/"), "upload_id", F.lit("/"), file), size_bytes=F.col("length"),
                 content_type=F.coalesce(content_type, F.lit(C.DEFAULT_CONTENT_TYPE)) if content_type is not None
                 else F.lit(C.DEFAULT_CONTENT_TYPE))


def upload_updates(rows: DataFrame, state: str) -> DataFrame:
    """What happens to an upload later (upload_id, analysis_id): its analysis and status, the rest stays."""
    return _item(rows, fields.upload_key(F.col("upload_id")), "METADATA", "update", state)


def preprocessed_items(recordings: DataFrame) -> DataFrame:
    """PREPROCESSED of cut recordings (upload_id, analysis_id, duration_seconds, num_segments)."""
    return _item(recordings, fields.analysis_key(F.col("analysis_id")), "PREPROCESSED", "put", "preprocessed",
                 duration_seconds=F.col("duration_seconds"), num_segments=F.col("num_segments"),
                 segments_key=F.concat(F.lit("processed/"), "analysis_id", F.lit("/segments")))


def result_items(results: DataFrame) -> DataFrame:
    """RESULT of classified recordings (upload_id, analysis_id, label, confidence, num_segments, document)."""
    return _item(results, fields.analysis_key(F.col("analysis_id")), "RESULT", "put", "complete", label=F.col("label"),
                 confidence=F.round("confidence", C.STORED_DECIMALS),
                 num_segments=F.col("num_segments"), document=F.col("document"))


def error_items(rejected: DataFrame, spec: SegmentSpec) -> DataFrame:
    """ERROR of rejected files (upload_id, analysis_id, error_code, error), with the bound that they miss."""
    code = F.col("error_code")
    return _item(rejected, fields.analysis_key(F.col("analysis_id")), "ERROR", "put", "failed", error_code=code, error=F.col("error"),
                 min_duration_required=F.when(code == C.AUDIO_TOO_SHORT, F.lit(float(spec.min_seconds))),
                 max_duration_allowed=F.when(code == C.AUDIO_TOO_LONG, F.lit(float(spec.max_seconds))))
