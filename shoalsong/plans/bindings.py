"""The library's inputs derived from the given tables, each from the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalsong.constants import MAX_FILE_BYTES, SegmentSpec
from shoalsong.functions import fields
from shoalsong.operators import embedding, signal, validation
from shoalsong.sources import wav

# Seconds and rates scaled to the event table: 4 samples a second, windows of 16.
SPEC = SegmentSpec(rate=4, seconds=4.0, min_seconds=7.5, max_seconds=36.0)
SIZE_LIMIT = 5000
# Samples of a recording that are gathered at a time.
PIECE = 1 << 20
# Windows in a part of a recording: at most 8,192 samples at the highest rate.
PART_WINDOWS = 256


# Declared, so that no job has to read file footers for a schema.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(selector: Column, *values: str) -> Column:
    """values[selector], null beyond the last."""
    return F.get(F.array(*[F.lit(v) for v in values]), selector.cast("int"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a labelled reference entry."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), "n_name")
    code = pick(F.col("label") % 5, "H", "D", "R", "M", "U")
    return table(spark, sf_dir, "embeddings").join(nations, "label", "left").select(
        F.col("vec_id").alias("ref_id"),
        F.concat("n_name", F.lit("_"), code, "label", F.lit("_"), "vec_id", F.lit(".wav")).alias("filename"),
        F.concat("n_name", F.lit("_"), code, "label").alias("site_id"),
        F.col("n_name").alias("country"),
        code.alias("site_type"),
        F.lit(1).cast("bigint").alias("num_segments"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def segment_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a segment vector, four to a recording."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label",
        F.floor(F.col("vec_id") / 4).cast("bigint").alias("analysis_id"),
        (F.col("vec_id") % 4).alias("segment_idx"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.mean_pool(segment_vectors(spark, sf_dir), "analysis_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an audio sample of its user's recording."""
    level = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 500))
    rate = F.when(F.col("user_id") % 3 == 0, 4).when(F.col("user_id") % 3 == 1, 2).otherwise(8)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"), "event_id", "ts", level.alias("v"), rate.alias("sample_rate"))


def _numbered(placed: DataFrame) -> DataFrame:
    """Sample rows numbered in time order, of recordings that are bounded and placed."""
    order = Window.partitionBy("recording_id").orderBy("ts", "event_id")
    return placed.select(
        "recording_id", (F.row_number().over(order) - 1).cast("bigint").alias("sample_idx"), "v",
        "sample_rate", "n_samples")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample rows of the valid recordings."""
    return _numbered(validation.admitted_samples(samples(spark, sf_dir), SPEC))


def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, n_samples, length) of every recording: the bytes that a file of it has."""
    sizes = samples(spark, sf_dir).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return sizes.withColumn("length", 2 * F.col("n_samples") + wav.HEADER_BYTES)


def file_signals(spark: SparkSession, sf_dir: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Sample rows of every recording that fits into a file of the published size limit."""
    fitting = file_sizes(spark, sf_dir).where(F.col("length") <= max_bytes).drop("length")
    return _numbered(samples(spark, sf_dir).join(fitting, "recording_id").repartition("recording_id"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled sample rows with segment_idx and offset."""
    return signal.segment_fixed(signal.resample_linear(signals(spark, sf_dir), SPEC.rate), SPEC)


def pcm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `segments`, from 16-bit samples: what the audio files hold."""
    quantised = signals(spark, sf_dir).withColumn(
        "v", signal.normalize_fullscale(signal.quantize_pcm16(F.col("v")).cast("double"), F.lit(16)))
    return signal.segment_fixed(signal.resample_linear(quantised, SPEC.rate), SPEC)


def wav_files(spark: SparkSession, sf_dir: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(recording_id, path, length, content): every recording as a WAV file, valid or not.

    A recording whose file would exceed `max_bytes` has its counted length and no
    content, so the size rule turns it into an error row. Samples of the others
    are gathered `PIECE` at a time as rows; whole files are only put together of
    packed 16-bit arrays, at most `max_bytes`.
    """
    pieces = (
        file_signals(spark, sf_dir, max_bytes)
        .groupBy("recording_id", F.floor(F.col("sample_idx") / PIECE).alias("piece"))
        .agg(F.sort_array(F.collect_list(F.struct("sample_idx", signal.quantize_pcm16(F.col("v")).alias("q")))).alias("s"),
             F.max("sample_rate").alias("sample_rate"))
        .select("recording_id", "piece", F.transform("s", lambda x: x["q"]).alias("pcm"), "sample_rate")
    )
    pcm = pieces.groupBy("recording_id").agg(
        F.sort_array(F.collect_list(F.struct("piece", "pcm"))).alias("p"), F.max("sample_rate").alias("sample_rate")).select(
        "recording_id", F.flatten(F.transform("p", lambda x: x["pcm"])).alias("pcm"), "sample_rate")
    written = wav.encode(pcm).select("recording_id", F.length("content").cast("bigint").alias("length"), "content")
    too_large = file_sizes(spark, sf_dir).where(F.col("length") > max_bytes).select(
        "recording_id", "length", F.lit(None).cast("binary").alias("content"))
    return written.unionByName(too_large).select(
        "recording_id", recording_name(F.col("recording_id")).alias("path"), "length", "content")


def file_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, path, length, content, part): every recording as WAV files, of whatever size.

    A row has up to `PART_WINDOWS` windows (`schemas.FILE_PART`), most recordings one row. `length` is
    that of the whole recording as one file. One task sorts a recording, on disk where it is long; no
    value holds a whole one, and its parts are encoded and used by many tasks.
    """
    rate, n = F.col("sample_rate"), F.col("n_samples")
    size = (rate * SPEC.samples / SPEC.rate).cast("bigint")
    windows = F.floor(validation.resampled_length(n, rate, SPEC.rate) / SPEC.samples)
    last = F.floor((F.greatest(windows, F.lit(1)) - 1) / PART_WINDOWS)
    part = F.least(F.floor(F.col("sample_idx") / (size * PART_WINDOWS)), last)
    # The first sample of a part ends the one before, whose last window is interpolated with it.
    begins = (part > 0) & (F.col("sample_idx") == part * size * PART_WINDOWS)
    sizes = file_sizes(spark, sf_dir).drop("length")
    placed = _numbered(samples(spark, sf_dir).join(sizes, "recording_id").repartition("recording_id")).select(
        "recording_id", "sample_idx", signal.quantize_pcm16(F.col("v")).alias("q"), "sample_rate", "n_samples",
        windows.alias("windows"), F.explode(F.when(begins, F.array(part - 1, part)).otherwise(F.array(part))).alias("i"))
    first = F.col("i") * PART_WINDOWS
    pcm = placed.groupBy("recording_id", "i").agg(
        F.sort_array(F.collect_list(F.struct("sample_idx", "q"))).alias("s"), F.max("sample_rate").alias("sample_rate"),
        F.max("n_samples").alias("frames"), F.max("windows").alias("windows")).select(
        F.struct("recording_id", F.struct(
            first.cast("int").alias("first"), F.least(first + PART_WINDOWS, F.col("windows")).cast("int").alias("end"),
            "frames").alias("part")).alias("key"),
        F.transform("s", lambda x: x["q"]).alias("pcm"), "sample_rate")
    return wav.encode(pcm.repartition("key"), "key").select(
        "key.recording_id", recording_name(F.col("key.recording_id")).alias("path"),
        (2 * F.col("key.part.frames") + wav.HEADER_BYTES).alias("length"), "content", "key.part")


def recording_name(recording_id: Column) -> Column:
    code = pick(recording_id % 5, "H", "D", "R", "M", "X")
    return F.concat(F.lit("c"), recording_id % 7, F.lit("_"), code, recording_id, F.lit("_20240101_120000.wav"))


def job_log(events: DataFrame) -> DataFrame:
    """Events as job items; clicks leave no item, so some analyses are unknown."""
    kind = F.col("event_type")
    sk = (F.when(kind == "signup", "METADATA").when(kind == "view", "PREPROCESSED")
          .when(kind == "purchase", "RESULT").when(kind == "error", "ERROR"))
    state = (F.when(kind == "signup", "uploaded").when(kind == "view", "preprocessed")
             .when(kind == "purchase", "complete").when(kind == "error", "failed"))
    analysis = analysis_id()
    return events.where(sk.isNotNull()).select(
        F.when(kind == "signup", fields.upload_key(analysis)).otherwise(fields.analysis_key(analysis)).alias("pk"),
        sk.alias("sk"), analysis.alias("analysis_id"), analysis.alias("upload_id"), "ts", "event_id",
        state.alias("status"), F.when(kind == "error", F.get_json_object("props", "$.k")).alias("error"))


def item_log(events: DataFrame) -> DataFrame:
    """Every event as a put or update of an item: a click updates the upload that a signup puts, and every
    fourth view, purchase and error updates what is there."""
    kind, of_four = F.col("event_type"), F.pmod("event_id", F.lit(4))
    analysis, is_upload = analysis_id(), F.col("event_type").isin("signup", "click")
    sk = (F.when(is_upload, "METADATA").when(kind == "view", "PREPROCESSED").when(kind == "purchase", "RESULT").otherwise("ERROR"))
    state = (F.when(kind == "signup", "uploaded").when(kind == "click", "processing").when(kind == "view", "preprocessed")
             .when(kind == "purchase", "complete").otherwise("failed"))
    return events.select(
        F.when(is_upload, fields.upload_key(analysis)).otherwise(fields.analysis_key(analysis)).alias("pk"), sk.alias("sk"),
        F.when((kind == "click") | (~is_upload & (of_four == 0)), "update").otherwise("put").alias("op"), "ts", "event_id",
        analysis.cast("string").alias("upload_id"), analysis.cast("string").alias("analysis_id"),
        F.when(of_four != 0, state).alias("status"), F.when(of_four != 1, F.col("event_id") * 10).cast("bigint").alias("size_bytes"),
        F.when(of_four != 2, F.pmod("event_id", F.lit(9))).cast("bigint").alias("num_segments"),
        F.when(kind == "error", F.get_json_object("props", "$.k")).alias("error"))


def analysis_id() -> Column:
    return (F.col("user_id") * 100 + F.dayofmonth("ts")).cast("bigint")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(analysis_id().alias("analysis_id")).distinct()
    return ids.withColumn("upload_id", F.col("analysis_id"))


def function_log(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("function"), "ts",
                         F.when(F.col("value") > 30, "ERROR").otherwise("INFO").alias("level"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    status = pick(F.col("s_suppkey") % 4, "healthy", "degraded", "restored_early", "restored_mid")
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("site_id"), F.col("n_name").alias("country"), status.alias("status"))


def filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    code = pick(key % 5, "H", "D", "R", "M", "X")
    named = F.concat(F.lit("n"), "s_nationkey", F.lit("_"), code, key, F.lit("_20230207_120400.wav"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(key % 11 == 0, "noise.wav").otherwise(named).alias("filename"),
        (key % 7).cast("bigint").alias("num_segments"))


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory = F.when(F.col("l_returnflag") == "A", 256).when(F.col("l_returnflag") == "N", 1024).otherwise(512)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("service"), F.col("l_shipdate").alias("ts"), memory.alias("memory_mb"),
        F.col("l_quantity").alias("seconds"), F.col("l_extendedprice").alias("amount"))
