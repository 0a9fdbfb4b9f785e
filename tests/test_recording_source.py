"""The data source for recordings: the same rows as whole-file decoding, by ranges, and as a stream."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_audio import corpus_files
from wavs import int16, sine, wav

from shoalsong import constants as C
from shoalsong.constants import CURRENT_SPEC, SegmentSpec
from shoalsong.plans import analysis
from shoalsong.sources import corpus, recordings
from shoalsong.streaming import jobs

BLOCK = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("recordings")
    (root / "a" / "b").mkdir(parents=True)
    for i, (name, content) in enumerate(corpus_files().items()):
        (root / ("a/b" if i % 3 else ".") / name).write_bytes(content)
    (root / "a" / "plain.wav").write_bytes(wav(int16(sine(11, 22050, 440)), 22050))
    (root / "bad_floats.wav").write_bytes(wav(np.array([0.5, np.nan] * 40000, "<f4"), 8000, bits=32, kind=3))
    (root / "notes.txt").write_text("not a recording")
    return str(root)


def rows(segments):
    return sorted((r["recording_id"], -1 if r["segment_idx"] is None else r["segment_idx"], tuple(r["samples"] or ()),
                   r["original_sample_rate"], r["total_duration"], r["num_segments"], r["error_code"])
                  for r in segments.collect())


@pytest.fixture(scope="module")
def decoded(spark, folder):
    files = corpus.scan_recordings(spark, folder)
    found = rows(analysis.segments_of(files, CURRENT_SPEC, max_bytes=2_000_000, root=folder))
    # A file that fails while it is cut has its numbers; errors carry none here.
    return [r if r[6] is None else (r[0], r[1], r[2], None, None, None, r[6]) for r in found]


@pytest.mark.parametrize("split", [64 << 20, 100_000, 4097])
def test_equals_whole_file_decoding(spark, folder, decoded, split):
    segments = recordings.read_segments(spark, folder, CURRENT_SPEC, maxBytes=2_000_000, splitBytes=split)
    found = [r if r[6] is None else (r[0], r[1], r[2], None, None, None, r[6]) for r in rows(segments)]
    assert found == decoded
    assert {"AUDIO_TOO_SHORT", "FILE_TOO_LARGE", "INVALID_AUDIO_FORMAT", "PROCESSING_FAILED", None} <= {r[6] for r in found}


def test_messages_equal(spark, folder):
    def messages(segments):
        return {(r["recording_id"], r["error"]) for r in segments.collect() if r["error"]}

    files = corpus.scan_recordings(spark, folder)
    assert messages(recordings.read_segments(spark, folder, CURRENT_SPEC)) == messages(
        analysis.segments_of(files, CURRENT_SPEC, root=folder))


def test_empty_files_and_folders(spark, tmp_path):
    assert recordings.read_segments(spark, str(tmp_path / "none")).count() == 0
    assert recordings.read_files(spark, str(tmp_path)).count() == 0
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    found = {r["recording_id"]: (r["length"], r["error_code"]) for r in recordings.read_files(spark, str(tmp_path)).collect()}
    assert found == {"empty.wav": (0, C.INVALID_AUDIO_FORMAT), "short.wav": (4, C.INVALID_AUDIO_FORMAT)}
    dead = analysis.dead_letters(recordings.read_segments(spark, str(tmp_path)))
    assert sorted(r["recording_id"] for r in dead.collect()) == ["empty.wav", "short.wav"]


def test_a_long_recording_is_cut_by_several_tasks(spark, tmp_path):
    """Sparse on disk: 2 GB that begin like a recording."""
    frames = 10**9
    head = wav(np.zeros(0, "<i2"), 32000)[:40] + (2 * frames).to_bytes(4, "little")
    with open(tmp_path / "long.wav", "wb") as file:
        file.write(head)
        file.seek(44 + 2 * 500_000_000)
        file.write(int16(sine(5, 32000)).tobytes())
        file.truncate(44 + 2 * frames)
    spec = SegmentSpec(max_seconds=10**6)
    segments = recordings.read_segments(spark, str(tmp_path), spec, maxBytes=4 << 30, splitBytes=256 << 20)
    found = segments.groupBy(F.spark_partition_id().alias("task")).agg(
        F.count(F.lit(1)).alias("windows"), F.max(F.array_max("samples")).alias("peak")).collect()
    assert len(found) == 8 and sum(r["windows"] for r in found) == frames // spec.samples
    assert sum(r["peak"] > 0.4 for r in found) == 1


class Counting(io.BytesIO):
    """A file that counts the bytes read."""

    read_bytes = 0

    def read_at(self, count, offset):
        self.seek(offset)
        found = self.read(count)
        self.read_bytes += len(found)
        return found


@pytest.mark.parametrize("name", ["no_riff.wav", "compressed.wav", "bits24.wav", "just_long.wav", "odd_list.wav"])
def test_only_headers_are_read(name):
    content = corpus_files()[name]
    file = Counting(content)
    recordings.verdict(recordings.head_of(file, len(content)), CURRENT_SPEC)
    assert file.read_bytes < 200


def test_pieces():
    plan = recordings.plan([("a", 0), ("b", 10_000), ("c", 100)], 6000)
    assert [[(p.name, p.begin, p.end) for p in x.pieces] for x in plan] == [
        [("a", 0, 0), ("b", 0, 6000)], [("b", 6000, 10_000), ("c", 0, 100)]]
    assert [len(x.pieces) for x in recordings.plan([("a", 10**12)], 4096, whole=True)] == [1]
    assert [x.pieces for x in recordings.plan([], 6000)] == [[]]


def test_every_window_has_one_piece():
    for begin_at in (44, 1000):
        head = {"channels": 1, "bits": 16, "audio_format": 1, "sample_rate": 44100, "data_offset": begin_at,
                "num_segments": 57, "frames": 57 * 5 * 44100}
        size = begin_at + 2 * head["frames"]
        for step in (1000, 441_000, 441_001, size):
            seen = [i for at in range(0, size, step) for i in recordings.windows_of(
                recordings.Piece("x", size, at, min(size, at + step)), head, CURRENT_SPEC)]
            assert seen == list(range(57))


def test_stream_takes_every_file_once(spark, tmp_path):
    root, log, out, progress = (str(tmp_path / n) for n in ("in", "log", "out", "progress"))
    (tmp_path / "in").mkdir()

    def drain():
        stream = recordings.stream_segments(spark, root, log, CURRENT_SPEC)
        jobs.write_table(stream, out, progress).awaitTermination()
        return stream.schema

    (tmp_path / "in" / "b.wav").write_bytes(wav(int16(sine(6, 32000)), 32000))
    (tmp_path / "in" / "empty.wav").write_bytes(b"")
    drain()
    # Older by name and by time than what has been seen.
    (tmp_path / "in" / "a.wav").write_bytes(wav(int16(sine(12, 16000, 900)), 16000))
    import os

    os.utime(tmp_path / "in" / "a.wav", (1, 1))
    drain()
    schema = drain()
    got = rows(spark.read.schema(schema).parquet(out))
    assert got == rows(recordings.read_segments(spark, root, CURRENT_SPEC)) and len(got) == 4


def test_a_batch_that_is_repeated_takes_the_same_files(tmp_path):
    (tmp_path / "in").mkdir()
    settings = recordings._Settings({"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "maxFilesPerTrigger": "2"})
    for name in "cab":
        (tmp_path / "in" / f"{name}.wav").write_bytes(b"x")
    stream = recordings.RecordingStream(settings)
    assert stream.initialOffset() == {"batch": 0}
    assert stream.latestOffset() == {"batch": 1} and stream.latestOffset() == {"batch": 2} and stream.latestOffset() == {"batch": 2}
    (tmp_path / "in" / "0.wav").write_bytes(b"x")
    again = recordings.RecordingStream(settings)
    names = [[p.name for x in again.partitions({"batch": a}, {"batch": b}) for p in x.pieces] for a, b in ((0, 1), (1, 2), (0, 2))]
    assert names == [["a.wav", "b.wav"], ["c.wav"], ["a.wav", "b.wav", "c.wav"]]
    assert again.latestOffset() == {"batch": 3}


def test_a_stream_needs_its_log():
    with pytest.raises(ValueError, match="log"):
        recordings.RecordingStream(recordings._Settings({"path": "/tmp"}))
