"""Declared schemas; nothing in the library is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

RECORDING_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

# What a header parse adds to a file; error_code is null for a readable one.
WAV_HEADER = T.StructType([
    T.StructField("audio_format", T.LongType()),
    T.StructField("channels", T.LongType()),
    T.StructField("sample_rate", T.LongType()),
    T.StructField("bits", T.LongType()),
    T.StructField("data_offset", T.LongType()),
    T.StructField("data_bytes", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("frames", T.LongType()),
])

# Column `part` of files that come in several rows: the windows [first, end) of the recording whose
# samples are in this row's content, and the frames of the whole recording. The content begins with
# the first sample of its first window and holds one sample more than its windows, if there is one.
FILE_PART = T.StructType([
    T.StructField("first", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("frames", T.LongType()),
])

SEGMENT = T.StructType([
    T.StructField("recording_id", T.StringType()),
    T.StructField("segment_idx", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("original_sample_rate", T.LongType()),
    T.StructField("total_duration", T.DoubleType()),
    T.StructField("num_segments", T.IntegerType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("error", T.StringType()),
])

REFERENCE_ENTRY = T.StructType([
    T.StructField("ref_id", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("site_id", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("site_type", T.StringType()),
    T.StructField("num_segments", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])

SITE = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("status", T.StringType()),
])

JOB_LOG = T.StructType([
    T.StructField("pk", T.StringType()),
    T.StructField("sk", T.StringType()),
    T.StructField("analysis_id", T.StringType()),
    T.StructField("upload_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])

# A put (the whole item) or an update (the attributes that are not null) of an item. METADATA items have
# the file, PREPROCESSED its duration and windows, RESULT the label and the document, ERROR code and bounds.
JOB_ITEM = T.StructType([
    T.StructField("pk", T.StringType()),
    T.StructField("sk", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("upload_id", T.StringType()),
    T.StructField("analysis_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("file_key", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("num_segments", T.LongType()),
    T.StructField("segments_key", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("document", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("min_duration_required", T.DoubleType()),
    T.StructField("max_duration_allowed", T.DoubleType()),
])

RESULT = T.StructType([
    T.StructField("analysis_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("classification", T.StructType([
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
    ])),
    T.StructField("similar_sites", T.ArrayType(T.StructType([
        T.StructField("site_id", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("status", T.StringType()),
    ]))),
    T.StructField("visualization", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StructType([
            T.StructField("x", T.DoubleType()),
            T.StructField("y", T.DoubleType()),
        ])),
        T.StructField("reference_sites", T.ArrayType(T.StructType([
            T.StructField("site_id", T.StringType()),
            T.StructField("x", T.DoubleType()),
            T.StructField("y", T.DoubleType()),
            T.StructField("status", T.StringType()),
        ]))),
    ])),
    T.StructField("embedding_summary", T.StructType([
        T.StructField("dimension", T.IntegerType()),
        T.StructField("num_segments", T.LongType()),
        T.StructField("aggregation", T.StringType()),
        T.StructField("synthetic", T.BooleanType()),
    ])),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("caveats", T.StringType()),
])
