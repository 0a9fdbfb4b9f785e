"""Recording files: decoding, rejection, cutting, embedding."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavs import chunk, fmt, int16, riff, sine, wav

from shoalsong import constants as C
from shoalsong.constants import CURRENT_SPEC, SegmentSpec
from shoalsong.operators import features
from shoalsong.plans import analysis
from shoalsong.sources import corpus, tables, wav as W

R = 32000


def interpolated(signal, rate, target):
    """Half-open linear interpolation, one position at a time."""
    n_out, out = int(len(signal) / rate * target), []
    for j in range(n_out):
        position = j * rate / target
        share = position - int(position)
        i = min(int(position), len(signal) - 2)
        out.append(signal[i] * (1 - share) + signal[i + 1] * share)
    return np.array(out)


def corpus_files():
    quiet = np.zeros(8000 * 6 * 2, "<i2")
    stereo = np.stack([int16(sine(6, 8000, 300)), int16(sine(6, 8000, 300, 0.25))], axis=1)
    return {
        "plain.wav": wav(int16(sine(6, R)), R),
        "drifting.wav": wav(int16(0.5 * np.sin(2 * np.pi * 500 * np.linspace(0, 6, 6 * R))), R),
        "resampled.wav": wav(int16(sine(12.5, 16000)), 16000),
        "odd_rate.wav": wav(int16(sine(8, 44100)), 44100),
        "tail.wav": wav(int16(sine(7, R)), R),
        "stereo.wav": wav(stereo, 8000, channels=2),
        "silent_stereo.wav": wav(quiet, 8000, channels=2),
        "eight_bit.wav": wav((sine(6, 8000) * 127 + 128).astype("u1"), 8000, bits=8),
        "int32.wav": wav((sine(6, 8000) * 2147483647).astype("<i4"), 8000, bits=32),
        "float32.wav": wav(sine(6, 8000).astype("<f4"), 8000, bits=32, kind=3),
        "exact_minimum.wav": wav(int16(sine(5, R)), R),
        "just_short.wav": wav(int16(sine(4.99, R)), R),
        "exact_maximum.wav": wav(np.full(600 * 8000, 128, "u1"), 8000, bits=8),
        "just_long.wav": wav(np.full(int(600.1 * 8000), 128, "u1"), 8000, bits=8),
        "bits24.wav": wav(np.zeros(R * 6 * 3, "u1"), R, bits=24),
        "compressed.wav": wav(int16(sine(6, R)), R, kind=85),
        "no_riff.wav": b"JUNK" + wav(int16(sine(6, R)), R)[4:],
        "no_wave.wav": wav(int16(sine(6, R)), R).replace(b"WAVE", b"AVI ", 1),
        "no_fmt.wav": riff(chunk(b"data", int16(sine(6, R)).tobytes())),
        "no_data.wav": riff(fmt(R)),
        "odd_list.wav": wav(int16(sine(6, R)), R, before=chunk(b"LIST", b"abc")),
        "extensible.wav": riff(fmt(R, kind=0xFFFE, extra=b"\x16\0\x10\0\0\0\0\0\x01\0" + b"\0" * 14),
                               chunk(b"data", int16(sine(6, R)).tobytes())),
        "cut_even.wav": wav(int16(sine(7, R)), R)[:44 + 2 * 6 * R],
        "cut_odd.wav": wav(int16(sine(7, R)), R)[:44 + 2 * 6 * R + 1],
        "zero_rate.wav": wav(int16(sine(6, R)), 0),
        "huge_rate.wav": wav(int16(sine(6, R)), 2**32 - 1),
        "zero_channels.wav": riff(fmt(R, channels=0), chunk(b"data", b"\0\0")),
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, content in corpus_files().items():
        (root / "deep").mkdir(exist_ok=True)
        (root / "deep" / name).write_bytes(content)
    (root / "notes.txt").write_text("not audio")
    return str(root)


@pytest.fixture(scope="module")
def segments(spark, folder):
    path = folder + "-segments"
    tables.write_segments(analysis.segments_of(corpus.scan_recordings(spark, folder), CURRENT_SPEC, root=folder + "/deep"), path)
    return tables.read_segments(spark, path)


def signal_of(segments, name):
    rows = segments.where(F.col("recording_id") == name).orderBy("segment_idx").collect()
    return np.concatenate([np.array(r["samples"]) for r in rows])


def test_scan_finds_wav_files_only(spark, folder):
    found = corpus.scan_recordings(spark, folder).select(corpus.file_name(F.col("path"))).collect()
    assert sorted(r[0] for r in found) == sorted(corpus_files())


def test_every_file_is_segments_or_one_error(segments):
    errors = {r["recording_id"]: r["error_code"] for r in analysis.dead_letters(segments).collect()}
    assert errors == {
        "just_short.wav": "AUDIO_TOO_SHORT", "just_long.wav": "AUDIO_TOO_LONG",
        "bits24.wav": "INVALID_AUDIO_FORMAT", "compressed.wav": "INVALID_AUDIO_FORMAT",
        "no_riff.wav": "INVALID_AUDIO_FORMAT", "no_wave.wav": "INVALID_AUDIO_FORMAT",
        "no_fmt.wav": "INVALID_AUDIO_FORMAT", "no_data.wav": "INVALID_AUDIO_FORMAT",
        "cut_odd.wav": "PROCESSING_FAILED",
        "zero_rate.wav": "INVALID_AUDIO_FORMAT", "zero_channels.wav": "INVALID_AUDIO_FORMAT",
        "huge_rate.wav": "AUDIO_TOO_SHORT",
    }
    counts = {r[0]: r[1] for r in analysis.good_segments(segments).groupBy("recording_id").count().collect()}
    assert set(counts) | set(errors) == set(corpus_files())
    assert counts["resampled.wav"] == 2 and counts["tail.wav"] == 1 and counts["exact_minimum.wav"] == 1
    assert counts["exact_maximum.wav"] == 120


def test_size_limit(spark, folder):
    small = analysis.segments_of(corpus.scan_recordings(spark, folder), CURRENT_SPEC, max_bytes=100, root=folder + "/deep")
    errors = {r["recording_id"]: r["error_code"] for r in analysis.dead_letters(small).collect()}
    assert errors["plain.wav"] == "FILE_TOO_LARGE" and errors["no_data.wav"] == "INVALID_AUDIO_FORMAT"


def test_windows_hold_160000_samples(segments):
    sizes = {r[0] for r in analysis.good_segments(segments).select(F.size("samples")).distinct().collect()}
    assert sizes == {160000}


@pytest.mark.parametrize("name,signal,rate", [
    ("plain.wav", int16(sine(6, R)) / 32768, R),
    ("odd_list.wav", int16(sine(6, R)) / 32768, R),
    ("extensible.wav", int16(sine(6, R)) / 32768, R),
    ("cut_even.wav", int16(sine(7, R)) / 32768, R),
    ("resampled.wav", int16(sine(12.5, 16000)) / 32768, 16000),
    ("odd_rate.wav", int16(sine(8, 44100)) / 32768, 44100),
    ("float32.wav", sine(6, 8000), 8000),
    ("int32.wav", sine(6, 8000), 8000),
    ("eight_bit.wav", ((sine(6, 8000) * 127 + 128).astype("u1").astype(float) - 128) / 128, 8000),
    ("silent_stereo.wav", np.zeros(48000), 8000),
])
def test_samples(segments, name, signal, rate):
    got = signal_of(segments, name)
    want = signal if rate == R else interpolated(signal.astype(np.float32), rate, R)
    assert np.allclose(got, want[:len(got)], atol=2e-7)


def test_stereo_is_scaled_by_its_peak(segments):
    mixed = np.stack([int16(sine(6, 8000, 300)), int16(sine(6, 8000, 300, 0.25))], axis=1).mean(axis=1)
    got = signal_of(segments, "stereo.wav")
    assert np.allclose(got, interpolated(mixed / np.abs(mixed).max(), 8000, R)[:len(got)], atol=2e-7)


def test_compat_scales(spark, folder):
    files = corpus.scan_recordings(spark, folder).where(F.col("path").endswith("eight_bit.wav"))
    checked, _ = analysis.check_files(files, CURRENT_SPEC, root=folder + "/deep")
    old = signal_of(W.cut_segments(checked, CURRENT_SPEC, compat=True), "eight_bit.wav")
    new = signal_of(W.cut_segments(checked, CURRENT_SPEC), "eight_bit.wav")
    assert np.allclose(old * 256, new, atol=1e-6)


def test_decoded_chunks_join_to_the_signal(spark, folder):
    files = corpus.scan_recordings(spark, folder).where(F.col("path").endswith("resampled.wav"))
    checked, _ = analysis.check_files(files, CURRENT_SPEC, root=folder + "/deep")
    rows = W.decode_samples(checked, chunk=30000).orderBy("start_idx").collect()
    assert [r["start_idx"] for r in rows] == list(range(0, 200000, 30000))
    assert np.allclose(np.concatenate([r["samples"] for r in rows]), int16(sine(12.5, 16000)) / 32768)


def test_empty_content_is_an_error(spark):
    # A file scan passes over empty files; a table of contents may hold them.
    rows = spark.createDataFrame([("a", bytearray()), ("b", None)], "path string, content binary")
    assert [r["error_code"] for r in W.with_header(rows).collect()] == ["INVALID_AUDIO_FORMAT"] * 2


def test_sine_features(segments):
    row = features.segment_features(
        segments.where(F.col("recording_id") == "drifting.wav").select("recording_id", "segment_idx", "samples"), R).first()
    assert row["rms"] == pytest.approx(0.35353, abs=1e-5)
    assert row["centroid"] == pytest.approx(832.35, abs=0.01)
    assert row["n"] == 160000


def test_encode_then_decode(spark):
    pcm = [[-32768, 0, 32767], list(range(-50, 50))]
    df = spark.createDataFrame([(i, p, 8) for i, p in enumerate(pcm)], "recording_id bigint, pcm array<smallint>, sample_rate int")
    files = W.encode(df)
    read = W.with_header(files)
    assert [r["frames"] for r in read.orderBy("recording_id").collect()] == [3, 100]
    spec = SegmentSpec(rate=8, seconds=0.25, min_seconds=0, max_seconds=600)
    decoded = W.decode_samples(W.with_duration_check(read, spec)).orderBy("recording_id").collect()
    assert [[round(v * 32768) for v in r["samples"]] for r in decoded] == pcm


def test_oversized_content_is_not_read(spark, folder):
    admitted, errors = __import__("shoalsong.operators.validation", fromlist=["x"]).admit_by_size(
        corpus.scan_recordings(spark, folder), 1000)
    plan = admitted._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan
    assert "content" not in errors.columns


def test_embedding_falls_back_per_recording(spark, folder):
    def picky():
        def model(windows):
            if np.abs(windows).max(axis=1).min() == 0:
                raise ValueError("silence")
            return windows.reshape(len(windows), 8, -1).mean(axis=2)
        return model

    names = ("plain.wav", "silent_stereo.wav", "resampled.wav")
    files = corpus.scan_recordings(spark, folder).where(corpus.file_name(F.col("path")).isin(*names))
    checked, _ = analysis.check_files(files, CURRENT_SPEC, root=folder + "/deep")
    rows = {r["recording_id"]: r for r in analysis.embed_files(checked, CURRENT_SPEC, picky, width=8, noise=False).collect()}
    assert {n: rows[n]["synthetic"] for n in names} == {"plain.wav": False, "silent_stereo.wav": True, "resampled.wav": False}
    signal = (int16(sine(6, R)) / 32768)[:160000]
    assert np.allclose(rows["plain.wav"]["embedding"], signal.reshape(8, -1).mean(axis=1), atol=1e-7)
    assert rows["resampled.wav"]["num_segments"] == 2


def test_no_model_gives_1280_features(spark, folder):
    files = corpus.scan_recordings(spark, folder).where(F.col("path").endswith("plain.wav"))
    checked, _ = analysis.check_files(files, CURRENT_SPEC, root=folder + "/deep")
    row = analysis.embed_files(checked, CURRENT_SPEC).first()
    assert row["synthetic"] and row["dim"] == C.EMBEDDING_WIDTH
    window = (int16(sine(6, R)) / 32768)[:160000].astype(np.float32).astype(float)
    rms = np.sqrt((window ** 2).mean())
    np.random.seed(int(abs(rms * 1e6) % 2**31))
    assert np.allclose(row["embedding"][:320], rms + np.random.randn(320) * 0.1)


def test_export_then_scan(spark, tmp_path):
    files = spark.createDataFrame([("a/x.wav", bytearray(b"1")), ("b/y.wav", bytearray(b"22"))], "name string, content binary")
    for _ in range(2):  # a repeated task replaces its files
        corpus.export_recordings(files, str(tmp_path)).collect()
    found = corpus.scan_recordings(spark, str(tmp_path)).select("length", "content").orderBy("length").collect()
    assert [(r["length"], bytes(r["content"])) for r in found] == [(1, b"1"), (2, b"22")]


def test_equal_names_in_two_folders_are_two_recordings(spark, tmp_path):
    for name, tone in (("u1", 440), ("u2", 880)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "rec.wav").write_bytes(wav(int16(sine(11, R, tone)), R))
    files = corpus.scan_recordings(spark, str(tmp_path))
    checked, _ = analysis.check_files(files, CURRENT_SPEC, root=f"file://{tmp_path}")
    rows = {r["recording_id"]: r for r in analysis.embed_files(checked, CURRENT_SPEC, noise=False).collect()}
    assert {k: r["num_segments"] for k, r in rows.items()} == {"u1/rec.wav": 2, "u2/rec.wav": 2}
    assert rows["u1/rec.wav"]["embedding"] != rows["u2/rec.wav"]["embedding"]


def test_samples_that_are_no_numbers_fail_one_file_only(spark, tmp_path):
    samples = np.array(sine(11, R), np.float32)
    bad = samples.copy()
    bad[-5] = np.nan
    (tmp_path / "good.wav").write_bytes(wav(samples, R, bits=32, kind=3))
    (tmp_path / "nan.wav").write_bytes(wav(bad, R, bits=32, kind=3))
    (tmp_path / "short.wav").write_bytes(wav(int16(sine(1, R)), R))
    root, path = str(tmp_path), str(tmp_path / "pooled")
    files = corpus.scan_recordings(spark, root)
    checked, _ = analysis.check_files(files, CURRENT_SPEC, root=root)
    analysis.embed_files(checked, CURRENT_SPEC).write.parquet(path)
    outcome = analysis.file_outcomes(files, spark.read.parquet(path), CURRENT_SPEC, root=root).collect()
    assert {r["recording_id"]: (r["error_code"], r["num_segments"]) for r in outcome} == {
        "good.wav": (None, 2), "nan.wav": ("PROCESSING_FAILED", None), "short.wav": ("AUDIO_TOO_SHORT", None)}
    letters = analysis.dead_letters(analysis.segments_of(files, CURRENT_SPEC, root=root)).collect()
    assert sorted((r["recording_id"], r["error_code"]) for r in letters) == [
        ("nan.wav", "PROCESSING_FAILED"), ("short.wav", "AUDIO_TOO_SHORT")]
