"""Sample-row operators against numpy, and against the audio-file form."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_audio import interpolated
from wavs import wav

from shoalsong.constants import SegmentSpec
from shoalsong.operators import features, signal, validation
from shoalsong.plans import analysis

SPEC = SegmentSpec(rate=100, seconds=0.4, min_seconds=0.5, max_seconds=60)
# (rate, samples) of each recording.
SHAPES = [(100, 50), (100, 97), (44, 61), (250, 333), (30, 40), (100, 60), (160, 321), (99, 99)]


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(5)
    return {i: (rate, rng.integers(-32768, 32767, n).astype("<i2")) for i, (rate, n) in enumerate(SHAPES)}


@pytest.fixture(scope="module")
def samples(spark, recordings):
    rows = [(i, j, float(v) / 32768, rate, len(x)) for i, (rate, x) in recordings.items() for j, v in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id bigint, sample_idx bigint, v double, sample_rate int, n_samples bigint").repartition("recording_id")


def collected(df):
    out = {}
    for r in df.orderBy("recording_id", "sample_idx").collect():
        out.setdefault(r["recording_id"], []).append(r["v"])
    return {k: np.array(v) for k, v in out.items()}


def test_resample_linear(samples, recordings):
    got = collected(signal.resample_linear(samples, 100))
    for i, (rate, x) in recordings.items():
        want = x / 32768 if rate == 100 else interpolated(x / 32768, rate, 100)
        assert np.allclose(got[i], want, atol=1e-12), i


def test_last_position_interpolates_from_the_sample_before(spark):
    rows = [(0, j, v, 1, 5) for j, v in enumerate([0.0, 1.0, 2.0, 3.0, 10.0])]
    df = spark.createDataFrame(rows, "recording_id int, sample_idx bigint, v double, sample_rate int, n_samples bigint")
    assert collected(signal.resample_linear(df, 2))[0].tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 6.5, 3, 6.5]
    assert collected(signal.resample_linear(df, 2, "clamp"))[0].tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 6.5, 10, 10]
    with pytest.raises(ValueError):
        signal.resample_linear(df, 2, "other")


def test_resample_endpoint(samples, recordings):
    got = collected(signal.resample_endpoint(samples, 100))
    for i, (rate, x) in recordings.items():
        x = x / 32768
        n_out = int(len(x) / rate * 100)
        want = x if rate == 100 else np.interp(np.linspace(0, len(x) - 1, n_out), np.arange(len(x)), x)
        assert np.allclose(got[i], want, atol=1e-9), i


def test_segments_are_a_prefix_of_the_signal(samples):
    resampled = signal.resample_linear(samples, 100)
    whole, cut = collected(resampled), collected(signal.segment_fixed(resampled, SPEC))
    for i, x in whole.items():
        assert np.array_equal(cut[i], x[:len(x) // 40 * 40])


def test_padding_keeps_tails_of_more_than_half_a_window(samples):
    resampled = signal.resample_linear(samples, 100)
    whole, padded = collected(resampled), collected(signal.segment_padded(resampled, SPEC))
    for i, x in whole.items():
        tail = len(x) % 40
        want = np.concatenate([x, np.zeros(40 - tail)]) if tail > 20 else x[:len(x) - tail]
        assert np.array_equal(padded[i], want), i


def test_both_forms_agree(spark, samples, recordings):
    """Sample rows and audio files give the same segments and features."""
    files = spark.createDataFrame(
        [(str(i), len(w), bytearray(w)) for i, (rate, x) in recordings.items() for w in [wav(x, rate)]],
        "path string, length bigint, content binary")
    from_files = features.segment_features(
        analysis.good_segments(analysis.segments_of(files, SPEC)).select("recording_id", "segment_idx", "samples"), 100)
    rows = signal.segment_arrays(signal.segment_fixed(signal.resample_linear(samples, 100), SPEC))
    from_rows = features.segment_features(rows, 100)

    def table(df):
        return sorted((int(r["recording_id"]), r["segment_idx"], r["n"], round(r["rms"], 5), round(r["centroid"], 2))
                      for r in df.collect())

    assert table(from_files) == table(from_rows) and len(table(from_rows)) > 8


def test_level_features_equal_array_features(samples):
    windowed = signal.segment_fixed(signal.resample_linear(samples, 100), SPEC)
    levels = {(r["recording_id"], r["segment_idx"]): r for r in features.level_features(windowed).collect()}
    arrays = features.segment_features(signal.segment_arrays(windowed), 100).collect()
    assert len(levels) == len(arrays)
    for r in arrays:
        other = levels[r["recording_id"], r["segment_idx"]]
        assert (r["n"], r["zero_crossings"]) == (other["n"], other["zero_crossings"])
        assert r["rms"] == pytest.approx(other["rms"]) and r["peak"] == other["peak"] and r["zcr"] == other["zcr"]


def test_steps_onto_and_off_zero_each_count(spark):
    rows = [(0, 0, j, v) for j, v in enumerate([1.0, 0.0, -1.0, -1.0, 0.0, 0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "recording_id int, segment_idx int, sample_idx int, v double")
    row = features.level_features(df).first()
    assert row["zero_crossings"] == 4 and row["zcr"] == 0.5


def test_peak_normalisation_of_silence(spark):
    df = spark.createDataFrame([(0, j, 0.0) for j in range(3)], "recording_id int, sample_idx int, v double")
    assert [r["v"] for r in signal.normalize_peak(df).collect()] == [0.0] * 3


def test_noise_is_a_function_of_the_row(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, rng.normal(size=64).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "recording_id int, segment_idx int, samples array<double>")

    def vectors(partitions):
        described = features.segment_features(df.repartition(partitions), 32000)
        return {r["recording_id"]: r["feature_embedding"] for r in features.noisy_vectors(described).collect()}

    one = vectors(1)
    assert one == vectors(7)
    window = np.array(rows[4][2])
    rms = float(np.sqrt(np.mean(window ** 2)))
    noise = np.random.RandomState(int(abs(rms * 1e6) % 2**31)).randn(1280) * 0.1
    share = np.abs(np.fft.rfft(window))
    centroid = np.sum(np.fft.rfftfreq(64, 1 / 32000) * share / (share.sum() + 1e-10))
    base = np.repeat([rms, np.abs(window).max(), np.sum(np.diff(np.sign(window)) != 0) / 64, centroid / 16000], 320)
    assert np.allclose(one[4], base + noise, atol=1e-12)


@pytest.mark.parametrize("n,rate,code", [
    (500, 100, None), (499, 100, "AUDIO_TOO_SHORT"), (6000, 100, None), (6001, 100, "AUDIO_TOO_LONG")])
def test_bounds_themselves_are_admitted(spark, n, rate, code):
    spec = SegmentSpec(rate=100, seconds=5.0, max_seconds=60.0)
    df = spark.range(n).select(F.lit(1).alias("recording_id"), F.lit(rate).alias("sample_rate"))
    assert validation.recording_verdicts(df, spec).first()["error_code"] == code
