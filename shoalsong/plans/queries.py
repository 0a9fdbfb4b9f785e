"""Registered queries: each operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalsong import constants as C
from shoalsong import schemas
from shoalsong.functions import fields, windows
from shoalsong.functions import vectors as V
from shoalsong.operators import embedding, features
from shoalsong.operators import items as job_items
from shoalsong.operators import reports, signal, similarity, status, validation
from shoalsong.plans import analysis
from shoalsong.plans import bindings as B
from shoalsong.sources import corpus, items, recordings, tables, wav, workspace
from shoalsong.streaming import chain, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = "analysis_id"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def r6(column: str | Column, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return V.rounded(value).alias(name or column)


def long(column: str | Column, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return value.cast("bigint").alias(name or column)


def entries(df: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """A vector column as rows (pos, value)."""
    unfolded = df.select(*keys, F.posexplode_outer(vector).alias("pos", "value"))
    return unfolded.where(F.col("pos").isNotNull()).select(*keys, long("pos"), r6("value"))


# --- Sources and sinks -------------------------------------------------------


def _export(spark: SparkSession, files: DataFrame) -> str:
    """Write (path, content) rows as files below the shared folder; a recording beyond the size limit
    has no content and is refused before it is stored."""
    folder = workspace.new_folder(spark, "corpus")
    stored = files.where(F.col("content").isNotNull())
    written = corpus.export_recordings(stored.select(F.col("path").alias("name"), "content"), folder)
    written.write.parquet(workspace.new_folder(spark, "manifest"))
    return folder


@query
def scan_recordings(spark, sf_dir):
    folder = _export(spark, B.wav_files(spark, sf_dir))
    return corpus.scan_recordings(spark, folder).select(
        corpus.file_name(F.col("path")).alias("filename"), "length")


@query
def admit_by_size(spark, sf_dir):
    documents = B.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("length"))
    admitted, errors = validation.admit_by_size(documents, B.SIZE_LIMIT)
    return admitted.select("doc_id", F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("error_code")).unionByName(
        errors.select("doc_id", "size_bytes", "error_code"))


@query
def decode_recordings(spark, sf_dir):
    checked, _ = analysis.check_files(B.wav_files(spark, sf_dir).drop("recording_id"), B.SPEC)
    decoded = wav.decode_samples(checked)
    return decoded.select(
        F.col("recording_id").alias("filename"), long("sample_rate"), "start_idx",
        F.posexplode("samples").alias("at", "v")
    ).select("filename", "sample_rate", (F.col("start_idx") + F.col("at")).alias("sample_idx"),
             long(F.col("v") * 32768, "pcm"))


@query
def encode_recordings(spark, sf_dir):
    return B.wav_files(spark, sf_dir).select(
        "recording_id", "length", F.lower(F.hex(F.substring("content", 1, wav.HEADER_BYTES))).alias("header"))


@query
def segment_table(spark, sf_dir):
    folder = workspace.new_folder(spark, "segments")
    files = B.wav_files(spark, sf_dir).drop("recording_id")
    tables.write_segments(analysis.segments_of(files, B.SPEC), folder)
    stored = tables.read_segments(spark, folder)
    return stored.select(
        F.col("recording_id").alias("filename"), long("segment_idx"), long(F.size("samples"), "n"),
        long("original_sample_rate"), r6("total_duration"), long("num_segments"),
        r6(F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x), "total"), "error_code")


@query
def load_refs(spark, sf_dir):
    folder = workspace.new_folder(spark, "references")
    missing = tables.load_references(spark, folder)
    tables.write_references(B.refs(spark, sf_dir), folder)
    return tables.load_references(spark, folder).unionByName(missing).select(
        "ref_id", "filename", "site_id", "country", "site_type", "num_segments",
        long(V.width(F.col("embedding")), "dim"), r6(V.norm(F.col("embedding")), "norm"))


def _site_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment vectors under the name of the file they were recorded in."""
    code = B.pick(F.col("label") % 5, "H", "D", "R", "M", "X")
    day = F.lpad(F.floor(F.col("vec_id") / 50).cast("string"), 6, "0")
    return B.segment_vectors(spark, sf_dir).select(
        F.concat(F.lit("n"), "label", F.lit("_"), code, "label", F.lit("_20230207_"), day, F.lit(".wav")).alias("filename"),
        "embedding")


@query
def build_ref_index(spark, sf_dir):
    folder = workspace.new_folder(spark, "references")
    tables.write_references(analysis.reference_index(_site_segments(spark, sf_dir)), folder)
    index = tables.load_references(spark, folder)
    return entries(index, "filename", "site_id", "country", "site_type", "num_segments")


@query
def build_ref_tables(spark, sf_dir):
    """The index from recording files of any size, by way of the stored segment vectors."""
    folder = workspace.new_folder(spark, "reference_tables")
    files = B.file_parts(spark, sf_dir).drop("recording_id")
    seen = analysis.build_reference_tables(files, B.SPEC, _block_means, folder, width=4)
    index = entries(tables.load_references(spark, f"{folder}/index"), "filename", "site_id")
    return seen.join(index, "filename")


@query
def pool_refs_by_site(spark, sf_dir):
    return entries(similarity.pool_by_site(B.refs(spark, sf_dir)), "ref_id", "site_id", "country", "site_type", "num_segments")


@query
def job_log_append(spark, sf_dir):
    folder = workspace.new_folder(spark, "job_log")
    log = B.job_log(B.table(spark, sf_dir, "events"))
    tables.append_log(log.where(F.col("sk") == "METADATA"), folder)
    tables.append_log(log.where(F.col("sk") != "METADATA"), folder)
    return tables.read_log(spark, folder).select("pk", "sk", long(KEY), long("upload_id"), "event_id", "status", "error")


@query
def lookup_items(spark, sf_dir):
    log = B.job_log(B.table(spark, sf_dir, "events"))
    keys = B.requests(spark, sf_dir).select(fields.analysis_key(F.col(KEY)).alias("pk"), F.lit("RESULT").alias("sk"))
    return tables.lookup_items(log, keys).select("pk", "sk", "event_id", "status")


def _item_table(spark: SparkSession, sf_dir: str) -> str:
    """Events as puts and updates, appended in three parts in any order, compacted before the last."""
    folder, rows = workspace.new_folder(spark, "items"), B.item_log(B.table(spark, sf_dir, "events"))
    for part in range(3):
        if part == 2:
            items.compact(spark, folder, buckets=8)
        items.append_items(rows.where(F.pmod("event_id", F.lit(3)) == part), folder)
    return folder


@query
def stored_items(spark, sf_dir):
    """Current items of a table of puts and updates, part of them compacted."""
    return items.read_items(spark, _item_table(spark, sf_dir)).select(
        "pk", "sk", "event_id", "status", "size_bytes", "num_segments", "error")


@query
def stored_item_lookup(spark, sf_dir):
    """The results of all requests by key from the same table."""
    keys = B.requests(spark, sf_dir).select(fields.analysis_key(F.col(KEY)).alias("pk"), F.lit("RESULT").alias("sk"))
    return items.lookup(spark, _item_table(spark, sf_dir), keys).select("pk", "sk", "event_id", "status", "num_segments")


@query
def result_documents(spark, sf_dir):
    documents = analysis.result_documents(B.pooled(spark, sf_dir), B.refs(spark, sf_dir))
    stored = documents.select(F.to_json(F.struct("*")).alias("body"))
    d = stored.select(F.from_json("body", schemas.RESULT).alias("d")).select("d.*")
    summary, seen = F.col("embedding_summary"), F.col("classification")
    return d.select(
        long(KEY), "status", seen["label"].alias("label"), r6(seen["confidence"], "confidence"),
        *[r6(seen["probabilities"][s], f"p_{s}") for s in reports.STATUSES],
        *[F.col("similar_sites")[i]["site_id"].alias(f"site_{i + 1}") for i in range(3)],
        *[r6(F.col("similar_sites")[i]["similarity"], f"similarity_{i + 1}") for i in range(3)],
        F.col("visualization.type").alias("type"),
        F.col("visualization.reference_sites")[9]["site_id"].alias("tenth_point"),
        r6(F.col("visualization.reference_sites")[9]["x"], "tenth_x"),
        r6(F.col("visualization.coordinates.x"), "x"), r6(F.col("visualization.coordinates.y"), "y"),
        long(summary["dimension"], "dimension"), long(summary["num_segments"], "num_segments"),
        summary["aggregation"].alias("aggregation"), summary["synthetic"].alias("synthetic"), "caveats")


@query
def storage_rollup(spark, sf_dir):
    documents = B.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s3a://"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
        F.col("n_chars").alias("length"))
    return corpus.storage_rollup(corpus.with_prefix(documents), "bucket", "prefix")


@query
def item_count(spark, sf_dir):
    return reports.item_count(B.job_log(B.table(spark, sf_dir, "events")))


# --- Projections, filters, scalar functions ----------------------------------


@query
def parse_filenames(spark, sf_dir):
    parsed = B.filenames(spark, sf_dir).withColumn("p", fields.filename_parts(F.col("filename")))
    return parsed.select("filename", "p.country", "p.site", "p.site_type", "p.site_id",
                         F.date_format("p.recorded_at", "yyyy-MM-dd HH:mm:ss").alias("recorded_at"))


@query
def site_status(spark, sf_dir):
    return B.refs(spark, sf_dir).select("ref_id", "site_type", fields.status_of(F.col("site_type")).alias("status"))


@query
def default_fields(spark, sf_dir):
    key = F.col("s_suppkey")
    gaps = B.filenames(spark, sf_dir).select(
        "s_suppkey",
        F.when(key % 3 != 0, F.col("filename")).alias("filename"),
        F.when(key % 2 == 0, F.lit("audio/x-wav")).alias("content_type"),
        F.when(key % 5 != 0, F.concat(F.lit("s"), key)).alias("site_id"),
        F.when(key % 4 != 0, F.lit("Fiji")).alias("country"),
        F.when(key % 7 != 0, F.lit("H")).alias("site_type"))
    return gaps.select("s_suppkey", *fields.upload_defaults(key), *fields.site_defaults())


@query
def display_labels(spark, sf_dir):
    sites = B.sites(spark, sf_dir)
    gap = F.when(F.substring("site_id", -1, 1) != "7", F.col("status"))
    return sites.select("site_id", fields.display_label(gap).alias("label"))


@query
def filter_sites(spark, sf_dir):
    sites = B.sites(spark, sf_dir)
    views = [reports.filter_sites(sites, c, s).withColumn("view", F.lit(f"{c}/{s}"))
             for c, s in (("All", "All"), ("NATION_3", "All"), ("All", "degraded"), ("NATION_3", "healthy"))]
    return views[0].unionByName(views[1]).unionByName(views[2]).unionByName(views[3])


@query
def round_results(spark, sf_dir):
    vectors = B.segment_vectors(spark, sf_dir).select(
        "vec_id", F.struct(F.col("embedding").alias("vector"), V.norm(F.col("embedding")).alias("length")).alias("d"))
    rounded = vectors.withColumn("d", fields.round_leaves(F.col("d"), vectors.schema["d"].dataType))
    stored = rounded.select("vec_id", "d.length", F.posexplode("d.vector").alias("pos", "value"))
    return stored.select("vec_id", long("pos"), r6("length"),
                         (fields.decimal_leaf(F.col("value")).cast("double") + F.lit(0.0)).alias("value"))


@query
def parse_keys(spark, sf_dir):
    log = B.job_log(B.table(spark, sf_dir, "events"))
    return log.select("event_id", fields.key_kind(F.col("pk")).alias("kind"), fields.key_id(F.col("pk")).alias("id"),
                      fields.path_id(F.concat(F.lit("/prod/visualize/"), fields.key_id(F.col("pk")))).alias("path_id"))


@query
def json_required_field(spark, sf_dir):
    kind = F.col("event_type")
    bodies = B.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "click", "{}").when(kind == "view", '{"k": ""}').when(kind == "error", "not json")
        .otherwise(F.col("props")).alias("body"))
    return status.required_field(bodies, "body", "k").select("event_id", "k", "error_code")


# --- Signal ------------------------------------------------------------------


@query
def recording_duration(spark, sf_dir):
    return signal.duration(B.samples(spark, sf_dir)).select("recording_id", "n_samples", r6("duration"))


@query
def downmix_mono(spark, sf_dir):
    mixed = signal.downmix(B.signals(spark, sf_dir), 2)
    return mixed.select("recording_id", "sample_idx", r6("v"), "n_samples")


@query
def normalize_fullscale(spark, sf_dir):
    level = F.col("v")
    bits = F.when(F.col("recording_id") % 3 == 0, 16).when(F.col("recording_id") % 3 == 1, 32).otherwise(8)
    top = F.when(bits == 16, 32767).when(bits == 32, 2147483647).otherwise(127)
    pcm = B.samples(spark, sf_dir).select("event_id", (level * top).cast("bigint").alias("pcm"), bits.alias("bits"))
    return pcm.select("event_id", "pcm", r6(signal.normalize_fullscale(F.col("pcm"), F.col("bits")), "v"))


@query
def normalize_peak(spark, sf_dir):
    loud = B.signals(spark, sf_dir).withColumn("v", F.col("v") * 1.5)
    by_peak = signal.normalize_peak(loud).withColumnRenamed("v", "by_peak")
    above = signal.normalize_peak(by_peak.withColumn("v", F.col("by_peak") * (F.col("recording_id") % 3)), only_above_one=True)
    return above.select("recording_id", "sample_idx", r6("by_peak"), r6("v", "above_one"))


@query
def resample_linear(spark, sf_dir):
    return signal.resample_linear(B.signals(spark, sf_dir), B.SPEC.rate).select(
        "recording_id", "sample_idx", r6("v"), "n_samples")


@query
def resample_linear_clamped(spark, sf_dir):
    return signal.resample_linear(B.signals(spark, sf_dir), B.SPEC.rate, boundary="clamp").select(
        "recording_id", "sample_idx", r6("v"), "n_samples")


@query
def resample_endpoint(spark, sf_dir):
    return signal.resample_endpoint(B.signals(spark, sf_dir), B.SPEC.rate).select(
        "recording_id", "sample_idx", r6("v"), "n_samples")


@query
def segment_fixed(spark, sf_dir):
    return B.segments(spark, sf_dir).select("recording_id", "segment_idx", "offset", r6("v"))


@query
def segment_padded(spark, sf_dir):
    resampled = signal.resample_endpoint(B.signals(spark, sf_dir), B.SPEC.rate)
    return signal.segment_padded(resampled, B.SPEC).select("recording_id", "segment_idx", "offset", r6("v"))


def _cut_by_sql(samples: DataFrame, padded: bool) -> DataFrame:
    windows.register_windows(samples.sparkSession)
    return samples.sparkSession.sql(
        f"SELECT * FROM cut_windows(TABLE({{samples}}) PARTITION BY recording_id ORDER BY (sample_idx), "
        f"{B.SPEC.samples}, {str(padded).lower()})", samples=samples.select("recording_id", "sample_idx", "v"),
    ).select("recording_id", "segment_idx", "offset", r6("v"))


@query
def segment_fixed_sql(spark, sf_dir):
    return _cut_by_sql(signal.resample_linear(B.signals(spark, sf_dir), B.SPEC.rate), False)


@query
def segment_padded_sql(spark, sf_dir):
    return _cut_by_sql(signal.resample_endpoint(B.signals(spark, sf_dir), B.SPEC.rate), True)


@query
def first_window(spark, sf_dir):
    # Windows of 64 make some recordings whole, some padded and some too short.
    spec = C.SegmentSpec(rate=4, seconds=32.0)
    mixed = signal.downmix(B.signals(spark, sf_dir), 2)
    found = signal.first_window(mixed, spec).groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("v"), "total"))
    skipped = signal.without_window(mixed, spec).select(
        "recording_id", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("total"))
    return found.unionByName(skipped)


@query
def quantize_pcm16(spark, sf_dir):
    return B.samples(spark, sf_dir).select("event_id", long(signal.quantize_pcm16(F.col("v")), "pcm"))


@query
def recording_summary(spark, sf_dir):
    summary = signal.recording_summary(validation.recording_verdicts(B.samples(spark, sf_dir), B.SPEC), B.SPEC)
    return summary.select("recording_id", long("sample_rate"), r6("segment_duration"), long("segment_samples"),
                          r6("total_duration"), long("original_sample_rate"), "num_segments")


# --- Validation --------------------------------------------------------------


@query
def validate_duration(spark, sf_dir):
    verdicts = validation.recording_verdicts(B.samples(spark, sf_dir), B.SPEC)
    return verdicts.select("recording_id", r6("duration"), "num_segments", "error_code",
                           "min_duration_required", "max_duration_allowed")


def _damaged(files: DataFrame, *damage: Column) -> DataFrame:
    """File i % n gets damage i % n."""
    broken = F.lit(None).cast("binary")
    for i, content in enumerate(damage):
        broken = F.when(F.col("recording_id") % len(damage) == i, content).otherwise(broken)
    return files.withColumn("content", broken).withColumn(
        "length", F.coalesce(F.length("content").cast("bigint"), F.col("length")))


def _replaced(start: int, text: bytes) -> Column:
    """Content with the bytes from 0-based `start` replaced."""
    return F.concat(F.substring("content", 1, start), F.lit(text),
                    F.substring(F.col("content"), F.lit(start + len(text) + 1), F.length("content")))


@query
def validate_format(spark, sf_dir):
    damaged = _damaged(B.wav_files(spark, sf_dir), F.col("content"), _replaced(0, b"RIFX"), _replaced(8, b"WAVX"),
                       _replaced(12, b"fmx "), _replaced(34, b"\x18\x00"))
    return wav.with_header(damaged).select(
        "recording_id", "error_code", "error", wav.format_error(F.col("content")).alias("marker_error"), "frames")


@query
def dead_letter(spark, sf_dir):
    damaged = _damaged(B.wav_files(spark, sf_dir), F.col("content"), _replaced(0, b"RIFX"),
                       F.expr("substring(content, 1, length(content) - 1)"),
                       F.substring("content", 1, 36), F.col("content"))
    strict = C.SegmentSpec(rate=4, seconds=4.0, min_seconds=12.0, max_seconds=24.0)
    segments = analysis.segments_of(damaged.drop("recording_id"), strict, max_bytes=190)
    return analysis.dead_letters(segments).select(F.col("recording_id").alias("filename"), "error_code")


def _damaged_folder(spark: SparkSession, sf_dir: str) -> str:
    """Recordings as files of which some are broken and some are empty."""
    damaged = _damaged(B.wav_files(spark, sf_dir), F.col("content"), _replaced(0, b"RIFX"),
                       F.expr("substring(content, 1, length(content) - 1)"),
                       F.substring("content", 1, 36), F.lit(b""))
    return _export(spark, damaged)


def _file_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy(F.col("recording_id").alias("filename")).agg(
        F.max("error_code").alias("error_code"), F.count("segment_idx").alias("windows"))


@query
def recording_source(spark, sf_dir):
    """Every file of a folder by the data source: its length and windows, or its error."""
    folder = _damaged_folder(spark, sf_dir)
    files = recordings.read_files(spark, folder).select(F.col("recording_id").alias("filename"), "length")
    segments = recordings.read_segments(spark, folder, B.SPEC, splitBytes=65536)
    return files.join(_file_summary(segments), "filename")


@query
def stream_recordings(spark, sf_dir):
    """The same folder as a stream."""
    folder = _damaged_folder(spark, sf_dir)
    segments = recordings.stream_segments(spark, folder, workspace.new_folder(spark, "seen"), B.SPEC)
    path, progress = _folders(spark)
    jobs.write_table(segments, path, progress).awaitTermination()
    return _file_summary(spark.read.schema(segments.schema).parquet(path))


@query
def errors_by_code(spark, sf_dir):
    return validation.errors_by_code(validation.recording_verdicts(B.samples(spark, sf_dir), B.SPEC))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.job_log(B.table(spark, sf_dir, "events"))
    return status.latest_state(log.where(F.col("sk") == "METADATA"))


@query
def orphan_requests(spark, sf_dir):
    return status.orphan_requests(B.requests(spark, sf_dir), _uploads(spark, sf_dir))


@query
def matched_requests(spark, sf_dir):
    return status.matched_requests(B.requests(spark, sf_dir), _uploads(spark, sf_dir))


# --- Features ----------------------------------------------------------------


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.level_features(B.segments(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.segment_features(signal.segment_arrays(B.segments(spark, sf_dir)), B.SPEC.rate)


@query
def feature_rms(spark, sf_dir):
    return _levels(spark, sf_dir).select("recording_id", "segment_idx", r6("rms"))


@query
def feature_zcr(spark, sf_dir):
    return _levels(spark, sf_dir).select("recording_id", "segment_idx", "zero_crossings", r6("zcr"))


@query
def feature_peak(spark, sf_dir):
    return _levels(spark, sf_dir).select("recording_id", "segment_idx", r6("peak"))


@query
def magnitude_spectrum(spark, sf_dir):
    return _bins(features.magnitude_spectrum(signal.segment_arrays(B.segments(spark, sf_dir))))


@query
def magnitude_spectrum_columns(spark, sf_dir):
    return _bins(features.magnitude_spectrum_columns(signal.segment_arrays(B.segments(spark, sf_dir))))


def _bins(spectra: DataFrame) -> DataFrame:
    bins = F.posexplode(F.arrays_zip("magnitude", "share")).alias("bin", "z")
    return spectra.select("recording_id", "segment_idx", "n", bins).select(
        "recording_id", "segment_idx", long("bin"), r6(features.bin_frequency(F.col("bin"), F.col("n"), B.SPEC.rate), "frequency"),
        r6("z.magnitude", "magnitude"), r6("z.share", "share"))


@query
def spectral_centroid(spark, sf_dir):
    return _features(spark, sf_dir).select("recording_id", "segment_idx", r6("centroid"))


@query
def feature_embedding(spark, sf_dir):
    vector = features.feature_vector(block=2, centroid_scale=B.SPEC.rate / 2)
    return entries(_features(spark, sf_dir).withColumn("embedding", vector), "recording_id", "segment_idx")


@query
def feature_embedding_noisy(spark, sf_dir):
    """Per block of a vector what can be told without the noise itself: its length, that its mean
    is the feature to within five standard errors, and that it varies."""
    size, key = C.FEATURE_BLOCK, ["recording_id", "segment_idx"]
    measured = _features(spark, sf_dir)
    noisy = features.noisy_vectors(measured, centroid_scale=B.SPEC.rate / 2)
    plain = measured.select(*key, features.feature_vector(block=1, centroid_scale=B.SPEC.rate / 2).alias("plain"))
    blocks = noisy.join(plain, key).select(*key, "feature_embedding", F.posexplode("plain").alias("block", "value"))
    part = blocks.withColumn("part", F.slice("feature_embedding", F.col("block") * size + 1, F.lit(size)))
    near = F.abs(V.mean(F.col("part")) - F.col("value")) <= 5.5 * C.FEATURE_NOISE / size**0.5
    return part.select(*key, long("block"), long(F.size("part"), "n"), r6("value"), near.alias("near"),
                       (F.array_max("part") > F.array_min("part")).alias("varied"))


# --- Embedding ---------------------------------------------------------------


def _block_means() -> embedding.Model:
    """A stand-in model: four numbers, the means of the quarters of a window."""
    return lambda windows: windows.reshape(len(windows), 4, -1).mean(axis=2, dtype=np.float64)


@query
def embed_segments(spark, sf_dir):
    segments = signal.segment_arrays(B.pcm_segments(spark, sf_dir))
    return entries(embedding.embed_segments(segments, _block_means, width=4), "recording_id", "segment_idx")


@query
def embed_length_guard(spark, sf_dir):
    resampled = signal.resample_linear(B.signals(spark, sf_dir), B.SPEC.rate)
    cut = resampled.withColumn("segment_idx", F.floor(F.col("sample_idx") / B.SPEC.samples).cast("bigint")).withColumn(
        "offset", F.col("sample_idx") % B.SPEC.samples)
    checked = embedding.with_length_check(signal.segment_arrays(cut), B.SPEC.samples)
    return checked.select("recording_id", "segment_idx", "length_ok", "error")


@query
def truncate_dim(spark, sf_dir):
    nested = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return entries(B.segment_vectors(spark, sf_dir).withColumn("embedding", embedding.flatten_and_truncate(nested, 40)), "vec_id")


@query
def mean_pool(spark, sf_dir):
    return entries(B.pooled(spark, sf_dir), KEY, "num_segments")


@query
def mean_pool_matrices(spark, sf_dir):
    return entries(embedding.mean_pool_matrices(B.segment_vectors(spark, sf_dir), KEY), KEY, "num_segments")


def _with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = B.segment_vectors(spark, sf_dir)
    return vectors.withColumn("feature_embedding", F.transform("embedding", lambda x, i: x * x + i)).withColumn(
        "embedding", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")))


@query
def embed_with_fallback(spark, sf_dir):
    return entries(embedding.pool_with_fallback(_with_faults(spark, sf_dir), KEY), KEY, "synthetic", "num_segments")


@query
def embedding_summary(spark, sf_dir):
    pooled = embedding.pool_with_fallback(_with_faults(spark, sf_dir), KEY)
    return embedding.embedding_summary(pooled, KEY).select(
        KEY, long("dimension"), "num_segments", "aggregation", "synthetic")


# --- Similarity --------------------------------------------------------------


@query
def pair_with_refs(spark, sf_dir):
    return similarity.comparable_references(B.pooled(spark, sf_dir), B.refs(spark, sf_dir), KEY).select(
        KEY, long("dim"), "comparable", "categorised")


@query
def cosine_similarity(spark, sf_dir):
    segments = B.segment_vectors(spark, sf_dir)
    pooled = B.pooled(spark, sf_dir).select(KEY, F.col("embedding").alias("mean"))
    return segments.join(pooled, KEY).select("vec_id", KEY, r6(V.cosine(F.col("embedding"), F.col("mean")), "similarity"))


@query
def enrich_sites(spark, sf_dir):
    # Country codes are nation keys here; some files carry no known code.
    nations = B.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))
    parsed = B.filenames(spark, sf_dir).withColumn("p", fields.filename_parts(F.col("filename"))).select(
        "s_suppkey", "p.country", "p.site_id", "p.site_type")
    return reports.enrich_sites(parsed, nations).select(
        "s_suppkey", "site_id", "country", "country_name", fields.status_of(F.col("site_type")).alias("status"))


@query
def category_similarity(spark, sf_dir):
    return similarity.category_similarity(B.pooled(spark, sf_dir), B.refs(spark, sf_dir), KEY).select(
        KEY, "site_type", "status", r6("similarity"))


@query
def complete_categories(spark, sf_dir):
    refs = B.refs(spark, sf_dir).withColumn("site_type", F.when(F.col("site_type") != "M", F.col("site_type")))
    return similarity.complete_categories(B.pooled(spark, sf_dir), refs, KEY).select(
        KEY, long("ordinal"), "status", r6("similarity"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.classify(B.pooled(spark, sf_dir), B.refs(spark, sf_dir))


@query
def class_probabilities(spark, sf_dir):
    return _classified(spark, sf_dir).select(KEY, F.explode_outer("probabilities").alias("c")).select(
        KEY, F.col("c.status").alias("status"), r6("c.p", "probability"))


@query
def classify(spark, sf_dir):
    return _classified(spark, sf_dir).select(KEY, "num_segments", "label", r6("confidence"), "valid")


@query
def probabilities_long(spark, sf_dir):
    return similarity.probabilities_long(_classified(spark, sf_dir), KEY).select(KEY, "status", r6("probability"))


@query
def classify_no_refs(spark, sf_dir):
    none = spark.createDataFrame([], schemas.REFERENCE_ENTRY)
    pooled = B.pooled(spark, sf_dir)
    scored = similarity.classify(pooled, none).select(KEY, "label", r6("confidence"), "valid")
    sites = similarity.similar_sites_or_placeholder(pooled, none, KEY)
    return scored.join(sites, KEY).select(
        KEY, "label", "confidence", "valid", long("rank"), "site_id", "country", "status", r6("similarity"))


@query
def top_k_sites(spark, sf_dir):
    return similarity.similar_sites(B.pooled(spark, sf_dir), B.refs(spark, sf_dir), KEY).select(
        KEY, long("rank"), "ref_id", "site_id", "country", "status", r6("similarity"))


@query
def top_k_sites_blocked(spark, sf_dir):
    """The join for reference tables too large to broadcast."""
    return similarity.similar_sites(
        B.pooled(spark, sf_dir), B.refs(spark, sf_dir), KEY, broadcast_bytes=0, block_bytes=1 << 18).select(
        KEY, long("rank"), "ref_id", "site_id", "country", "status", r6("similarity"))


@query
def ref_points(spark, sf_dir):
    return similarity.reference_points(B.refs(spark, sf_dir)).select("ref_id", "site_id", "status", r6("x"), r6("y"))


@query
def project_2d(spark, sf_dir):
    return similarity.project_2d(B.pooled(spark, sf_dir)).select(KEY, r6("x"), r6("y"))


@query
def acoustic_space(spark, sf_dir):
    return similarity.acoustic_space(_classified(spark, sf_dir), B.refs(spark, sf_dir), KEY).select(
        "point_id", "site", "status", "type", r6("x"), r6("y"))


# --- Job status --------------------------------------------------------------


@query
def latest_state(spark, sf_dir):
    return status.latest_state(B.job_log(B.table(spark, sf_dir, "events"))).select(
        "pk", "sk", "event_id", "status", "error")


@query
def resolve_status(spark, sf_dir):
    log = B.job_log(B.table(spark, sf_dir, "events"))
    return status.resolve_status(B.requests(spark, sf_dir), log).select(KEY, "status", "error")


@query
def resolve_status_errors_first(spark, sf_dir):
    log = B.job_log(B.table(spark, sf_dir, "events"))
    return status.resolve_status(B.requests(spark, sf_dir), log, errors_first=True).select(KEY, "status", "error")


@query
def upload_lifecycle(spark, sf_dir):
    log = B.job_log(B.table(spark, sf_dir, "events"))
    return status.lifecycle_of_log(log)


@query
def status_answers(spark, sf_dir):
    """Requests for every pooled recording and every logged analysis."""
    log = B.job_log(B.table(spark, sf_dir, "events"))
    pooled = B.pooled(spark, sf_dir)
    results = similarity.classify(pooled, B.refs(spark, sf_dir)).select(KEY, "label", r6("confidence"))
    requests = B.requests(spark, sf_dir).select(KEY).union(pooled.select(KEY)).distinct()
    return status.answers(requests, log, results)


# --- Reports -----------------------------------------------------------------


@query
def status_counts(spark, sf_dir):
    return reports.status_counts(B.sites(spark, sf_dir))


@query
def site_metrics(spark, sf_dir):
    return reports.site_metrics(B.sites(spark, sf_dir))


@query
def country_status_pivot(spark, sf_dir):
    # Sites whose name ends in 7 report nothing, in 8 a status that is not published.
    end = F.right("site_id", F.lit(1))
    status = F.when(end == "8", "closed").when(end != "7", F.col("status"))
    return reports.country_status_pivot(B.sites(spark, sf_dir).withColumn("status", status))


@query
def value_counts(spark, sf_dir):
    return reports.value_counts(B.sites(spark, sf_dir), "status", "country")


@query
def distinct_countries(spark, sf_dir):
    return reports.distinct_values(B.sites(spark, sf_dir), "country")


@query
def recent_errors(spark, sf_dir):
    logs = B.function_log(B.table(spark, sf_dir, "events"))
    return reports.recent_errors(logs, logs.select("function").distinct(), hours=1)


@query
def monthly_cost_by_service(spark, sf_dir):
    return reports.monthly_cost(B.invocations(spark, sf_dir)).select("month", "service", F.round("cost", 2).alias("cost"))


@query
def compute_metering(spark, sf_dir):
    metered = reports.compute_metering(B.invocations(spark, sf_dir), free_gb_seconds=5000.0, free_requests=200)
    return metered.select("month", r6("gb_seconds"), "requests", r6("cost"))


@query
def index_build_stats(spark, sf_dir):
    files = B.filenames(spark, sf_dir).withColumn("p", fields.filename_parts(F.col("filename")))
    return reports.index_build_stats(files.select("p.country", "p.site_type", "num_segments"))


# --- Whole analysis of recording files ---------------------------------------


@query
def analyse_recordings(spark, sf_dir):
    """Files to labels: decode, cut, describe, pool, index the same files as references, classify.
    One row per file, with its label or its error."""
    files = B.wav_files(spark, sf_dir).drop("recording_id")
    pooled, refs = _own_references(spark, files)
    labels = similarity.classify(pooled, refs).select("recording_id", "label", r6("confidence"))
    outcomes = analysis.file_outcomes(files, pooled, B.SPEC).join(labels, "recording_id", "left")
    return outcomes.select(
        F.col("recording_id").alias("filename"), "num_segments", "synthetic", "label", "confidence", "error_code")


def _own_references(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pooled vectors of the files, and the same as reference entries."""
    checked, _ = analysis.check_files(files, B.SPEC)
    folder = workspace.new_folder(spark, "pooled")
    analysis.embed_files(checked, B.SPEC, _block_means, width=4, noise=False).write.parquet(folder)
    pooled = spark.read.parquet(folder)
    parts = fields.filename_parts(F.col("recording_id"))
    refs = pooled.select(
        F.xxhash64("recording_id").alias("ref_id"), F.col("recording_id").alias("filename"),
        parts["site_id"].alias("site_id"), parts["country"].alias("country"), parts["site_type"].alias("site_type"),
        "num_segments", "embedding")
    return pooled, refs


# --- Streaming ---------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str, order: str) -> DataFrame:
    """The table as a stream of four files by `order`, one per batch, in any sequence."""
    table = B.table(spark, sf_dir, name)
    folder = workspace.new_folder(spark, "arrivals")
    table.repartitionByRange(4, F.col(order).desc()).write.parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _folders(spark: SparkSession) -> tuple[str, str]:
    return workspace.new_folder(spark, "stream"), workspace.new_folder(spark, "progress")


@query
def stream_ingest(spark, sf_dir):
    folder = _export(spark, B.wav_files(spark, sf_dir))
    files = jobs.ingest(spark, folder).select(corpus.file_name(F.col("path")).alias("filename"), "length")
    path, progress = _folders(spark)
    with jobs.listed_together(spark):
        jobs.write_table(files, path, progress).awaitTermination()
    return spark.read.schema(files.schema).parquet(path)


@query
def stream_features(spark, sf_dir):
    folder = _export(spark, B.wav_files(spark, sf_dir))
    segments = analysis.good_segments(jobs.segments(jobs.ingest(spark, folder), B.SPEC, root=folder)).select(
        F.col("recording_id").alias("filename"), "segment_idx", "samples")
    described = features.segment_features(segments, B.SPEC.rate)
    path, progress = _folders(spark)
    with jobs.listed_together(spark):
        jobs.write_table(described, path, progress).awaitTermination()
    return spark.read.schema(described.schema).parquet(path).select(
        "filename", long("segment_idx"), r6("rms"), r6("peak"), "zero_crossings", r6("centroid"))


@query
def stream_chain(spark, sf_dir):
    """Files to results, dead letters and job items as one stream; the windows of a recording come in
    several batches. The status is what the items say."""
    files = B.wav_files(spark, sf_dir)
    _, refs = _own_references(spark, files.drop("recording_id"))
    cut = recordings.read_segments(spark, _export(spark, files), B.SPEC)
    arrived, schema = workspace.new_folder(spark, "segments"), schemas.SEGMENT
    cut.repartition(4, F.coalesce("segment_idx", F.lit(0))).write.parquet(arrived)
    segments = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    path, progress = _folders(spark)
    chain.run(segments, refs, path, progress, B.SPEC, _block_means, width=4, noise=False).awaitTermination()
    log = chain.committed(spark, path, "items", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.JOB_ITEM.fields))
    states = status.with_status(status.status_flags(status.current_items(log.drop("batch")))).select(KEY, "status")
    done = job_items.identified(chain.outcomes(spark, path)).join(states, KEY)
    return done.select(F.col("recording_id").alias("filename"), "num_segments", "synthetic", "label", r6("confidence"),
                       "error_code", "status")


@query
def stream_classify(spark, sf_dir):
    arrived = workspace.new_folder(spark, "pooled")
    B.pooled(spark, sf_dir).write.parquet(arrived)
    pooled = spark.readStream.schema(spark.read.parquet(arrived).schema).option("maxFilesPerTrigger", 8).parquet(arrived)
    path, progress = _folders(spark)
    jobs.classify_batches(pooled, B.refs(spark, sf_dir), KEY, path, progress).awaitTermination()
    scored = f"{KEY} bigint, label string, confidence double, site_id string, similarity double, batch bigint"
    return jobs.read_latest(spark, path, scored, [KEY]).select(
        KEY, "label", r6("confidence"), "site_id", r6("similarity"))


@query
def stream_status(spark, sf_dir):
    updates = jobs.status_updates(B.job_log(_stream(spark, sf_dir, "events", "ts")))
    path, progress = _folders(spark)
    jobs.write_latest(updates, path, progress).awaitTermination()
    return jobs.read_latest(spark, path, f"{KEY} bigint, status string, error string, batch bigint", [KEY])


@query
def stream_status_expiring(spark, sf_dir):
    """The status by state that ends some time after a result or error."""
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    path, progress = _folders(spark)
    with jobs.settings(spark, **{"spark.sql.streaming.stateStore.providerClass": store,
                                 "spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        updates = jobs.tracked_status(B.job_log(_stream(spark, sf_dir, "events", "ts")), keep=1)
        jobs.write_latest(updates, path, progress).awaitTermination()
    return jobs.read_tracked(spark, path)


@query
def stream_dedup(spark, sf_dir):
    log = B.job_log(_stream(spark, sf_dir, "events", "ts"))
    delivered_twice = log.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    unique = jobs.deduplicated(delivered_twice, ["pk", "sk", "event_id"]).select(
        "pk", "sk", "event_id", "status")
    path, progress = _folders(spark)
    jobs.write_table(unique, path, progress).awaitTermination()
    return spark.read.schema(unique.schema).parquet(path)


@query
def stream_error_window(spark, sf_dir):
    counts = jobs.hourly_errors(B.function_log(_stream(spark, sf_dir, "events", "ts")))
    path, progress = _folders(spark)
    jobs.write_latest(counts, path, progress).awaitTermination()
    schema = "hour timestamp, function string, errors bigint, batch bigint"
    return jobs.read_latest(spark, path, schema, ["hour", "function"]).select(
        F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "function", "errors")
