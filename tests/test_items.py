"""The item table: puts and updates in any order, compaction, versions, look-ups; and the stream that feeds one."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_audio import corpus_files
from wavs import int16, sine, wav

from shoalsong import schemas
from shoalsong.constants import CURRENT_SPEC
from shoalsong.operators import items as job_items
from shoalsong.operators import status
from shoalsong.plans import analysis
from shoalsong.sources import corpus, items, recordings
from shoalsong.streaming import chain

COLUMNS = "pk string, sk string, op string, ts timestamp_ntz, event_id bigint, status string, size_bytes bigint, error string"


def random_log(seed, n=600, keys=40):
    import datetime

    rng, start = np.random.RandomState(seed), datetime.datetime(2024, 1, 1)
    return [(f"UPLOAD#{rng.randint(keys)}", rng.choice(["METADATA", "RESULT"]), rng.choice(["put", "update", "update"]),
             start + datetime.timedelta(seconds=int(rng.randint(300))), i, *[
                 None if rng.rand() < 0.5 else v for v in (f"s{i}", i, f"e{i}")]) for i in range(n)]


def folded(log):
    """One row at a time, in the order of time."""
    state = {}
    for pk, sk, op, ts, event_id, *values in sorted(log, key=lambda r: (r[3], r[4])):
        old = state.get((pk, sk))
        if op == "put" or old is None:
            values = values if op == "put" or old is None else old
        else:
            values = [o if v is None else v for o, v in zip(old[2:], values)]
        state[pk, sk] = (ts, event_id, *values)
    return sorted((*k, *v) for k, v in state.items())


def rows(df):
    return sorted(map(tuple, df.select("pk", "sk", "ts", "event_id", "status", "size_bytes", "error").collect()))


def test_fold_equals_one_row_at_a_time(spark):
    log = random_log(1)
    assert rows(status.current_items(spark.createDataFrame(log, COLUMNS))) == folded(log)


@pytest.mark.parametrize("compactions", [(), (2,), (1, 3, 5)])
def test_appends_in_any_order(spark, tmp_path, compactions):
    log, path = random_log(2), str(tmp_path / "items")
    # Part by part as they come, which is not the order of time.
    for i in range(6):
        items.append_items(spark.createDataFrame(log[i::6], COLUMNS), path)
        if i in compactions:
            items.compact(spark, path, buckets=4)
        assert rows(items.read_items(spark, path)) == folded([r for k in range(i + 1) for r in log[k::6]])


def test_history_is_bounded_and_untouched_buckets_stay(spark, tmp_path):
    log, path = random_log(3), str(tmp_path / "items")
    items.append_items(spark.createDataFrame(log, COLUMNS), path)
    items.compact(spark, path, buckets=16)
    version, deltas, base = items._manifest(spark, path)
    assert deltas == [] and len(base) == 16
    stored = items._changes(spark, path, [], [f for f in base.values() if f]).count()
    assert stored == len(folded(log)) < len(log)
    one = [(*log[0][:4], 10_000, "new", 1, None)]
    items.append_items(spark.createDataFrame(one, COLUMNS), path)
    items.compact(spark, path)
    _, _, again = items._manifest(spark, path)
    assert sum(again[b] != base[b] for b in range(16)) == 1
    items.compact(spark, path)  # nothing to do
    assert items._manifest(spark, path)[0] == version + 2
    items.vacuum(spark, path, keep=1)
    assert rows(items.read_items(spark, path)) == folded(log + one)
    assert os.listdir(f"{path}/deltas") == [] and sum(len(f) for _, f, _ in os.walk(f"{path}/base")) <= 2 + 16


def test_a_reader_during_compaction_sees_one_version(spark, tmp_path):
    log, path = random_log(4), str(tmp_path / "items")
    items.append_items(spark.createDataFrame(log[:300], COLUMNS), path)
    before = items.read_items(spark, path)
    number = items._manifest(spark, path)[0]
    items.append_items(spark.createDataFrame(log[300:], COLUMNS), path)
    items.compact(spark, path, buckets=4)
    assert rows(before) == folded(log[:300]) == rows(items.read_items(spark, path, number))
    # Folders that no manifest names, as a writer leaves them that stopped half-way, are not seen.
    items.complete(spark.createDataFrame(log, COLUMNS)).write.parquet(f"{path}/deltas/000000000099-left")
    assert rows(items.read_items(spark, path)) == folded(log)


def test_lookup_opens_only_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    log, path = random_log(5, 4000, 2000), str(tmp_path / "items")
    items.append_items(spark.createDataFrame(log, COLUMNS), path)
    items.compact(spark, path, buckets=32)
    want = folded(log)
    keys = spark.createDataFrame([want[0][:2], want[700][:2], ("UPLOAD#none", "METADATA"), (None, "RESULT")], "pk string, sk string")
    found = items.lookup(spark, path, keys)
    assert rows(found) == [want[0], want[700]]
    opened = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
    wanted = {str(r["bucket"]) for r in keys.select(items.bucket_of(32)).collect()}
    assert opened <= wanted and len(opened) <= 4
    plan = found._jdf.queryExecution().toString()
    assert "In(pk" in plan or "EqualTo(pk" in plan or "Or(" in plan
    many = spark.createDataFrame([r[:2] for r in want], "pk string, sk string")
    monkeypatch.setattr(items, "PUSHED_KEYS", 10)
    assert rows(items.lookup(spark, path, many)) == want


def test_no_table_yet(spark, tmp_path):
    path = str(tmp_path / "none")
    assert items.read_items(spark, path).columns == items.ITEM_COLUMNS and items.read_items(spark, path).count() == 0
    assert items.lookup(spark, path, spark.createDataFrame([("a", "b")], "pk string, sk string")).count() == 0
    items.compact(spark, path)
    items.append_items(spark.createDataFrame([], COLUMNS), path)
    items.compact(spark, path)
    assert items.read_items(spark, path).count() == 0


def test_items_of_an_upload_until_its_result(spark, tmp_path):
    """The flow of one user: upload, ask, see it processing, get the result; another file fails."""
    path = str(tmp_path / "items")
    files = job_items.identified(spark.createDataFrame([("a/x.wav", 100), ("y.wav", 7)], "recording_id string, length bigint"))
    asked = files.where("recording_id = 'a/x.wav'")
    bad = files.where("recording_id = 'y.wav'").selectExpr("*", "'AUDIO_TOO_SHORT' AS error_code", "'1 s' AS error")
    cut = asked.selectExpr("*", "12.5D AS duration_seconds", "2L AS num_segments")
    done = cut.selectExpr("*", "'healthy' AS label", "0.1234567D AS confidence", "'{}' AS document")

    def add(rows, minute):
        ts = F.lit(f"2024-01-01 00:{minute:02d}:00").cast("timestamp_ntz")
        items.append_items(job_items.stamped(rows, ts, F.lit(minute).cast("bigint")), path)

    def state():
        found = items.read_items(spark, path)
        return {r["filename"]: r["status"] for r in found.where("sk = 'METADATA'").collect()}, {
            r["status"] for r in status.resolve_status(files, found).collect()}

    add(job_items.upload_items(files), 0)
    assert state() == ({"x.wav": "uploaded", "y.wav": "uploaded"}, {"not_found"})
    add(job_items.upload_updates(asked, "processing"), 1)
    add(job_items.preprocessed_items(cut), 2)
    add(job_items.error_items(bad, CURRENT_SPEC), 2)
    items.compact(spark, path, 4)
    assert state() == ({"x.wav": "processing", "y.wav": "uploaded"}, {"processing", "failed"})
    add(job_items.result_items(done), 3)
    add(job_items.upload_updates(done, "complete"), 3)
    assert state() == ({"x.wav": "complete", "y.wav": "uploaded"}, {"complete", "failed"})
    found = {(r["sk"], r["filename"]): r for r in items.read_items(spark, path).collect()}
    upload = found["METADATA", "x.wav"]
    assert (upload["size_bytes"], upload["content_type"]) == (100, "audio/wav") and upload["analysis_id"] == asked.first()["analysis_id"]
    assert upload["file_key"] == f"uploads/{upload['upload_id']}/x.wav" and len(upload["upload_id"]) == 36
    assert found["METADATA", "y.wav"]["analysis_id"] is None
    assert found["RESULT", None]["confidence"] == 0.123457
    assert found["ERROR", None]["min_duration_required"] == 5.0 and found["ERROR", None]["max_duration_allowed"] is None


# --- The chain as a stream -------------------------------------------------------


# A lambda, as workers cannot import this module.
_means = lambda: lambda windows: windows.reshape(len(windows), 4, -1).mean(axis=2, dtype=np.float64)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("chain")
    names = ("plain.wav", "resampled.wav", "stereo.wav", "just_short.wav", "no_riff.wav", "cut_odd.wav", "float32.wav")
    for name, content in corpus_files().items():
        if name in names:
            (root / name).write_bytes(content)
    (root / "long.wav").write_bytes(wav(int16(sine(41, 8000, 333)), 8000))
    (root / "empty.wav").write_bytes(b"")
    return str(root)


@pytest.fixture(scope="module")
def refs(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame(
        [(i, "f", f"s{i}", "c", "HDRM"[i % 4], 1, rng.normal(size=4).tolist()) for i in range(12)], schemas.REFERENCE_ENTRY)


def outcome(df):
    return sorted((r["recording_id"], r["num_segments"], r["synthetic"], r["label"],
                   None if r["confidence"] is None else round(r["confidence"], 9), r["error_code"]) for r in df.collect())


@pytest.fixture(scope="module")
def wanted(spark, folder, refs):
    from shoalsong.operators import similarity

    files = corpus.scan_recordings(spark, folder)
    checked, _ = analysis.check_files(files, CURRENT_SPEC, root=folder)
    pooled = analysis.embed_files(checked, CURRENT_SPEC, _means, width=4, noise=False)
    labels = similarity.classify(pooled, refs).select("recording_id", "label", "confidence")
    batch = analysis.file_outcomes(files, pooled, CURRENT_SPEC, root=folder).join(labels, "recording_id", "left")
    return sorted(outcome(batch) + [("empty.wav", None, None, None, None, "INVALID_AUDIO_FORMAT")])


def drain(spark, segments, refs, path, progress):
    query = chain.run(segments, refs, path, progress, CURRENT_SPEC, _means, width=4, noise=False)
    query.awaitTermination()
    return query


def test_chain_of_arriving_files(spark, folder, refs, wanted, tmp_path):
    path, progress, log, root = (str(tmp_path / n) for n in ("out", "progress", "log", "in"))
    os.mkdir(root)
    names = sorted(os.listdir(folder))
    for part in (names[:4], names[4:]):
        for name in part:
            os.link(f"{folder}/{name}", f"{root}/{name}")
        drain(spark, recordings.stream_segments(spark, root, log, CURRENT_SPEC), refs, path, progress)
    assert outcome(chain.outcomes(spark, path)) == wanted
    found = chain.committed(spark, path, "items", chain_items()).drop("batch")
    states = status.with_status(status.status_flags(status.current_items(found)))
    assert sorted(r["status"] for r in states.collect()) == sorted(
        "complete" if w[5] is None else "failed" for w in wanted)


def chain_items():
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.JOB_ITEM.fields)


def test_windows_of_a_recording_in_several_batches_and_a_repeated_batch(spark, folder, refs, wanted, tmp_path):
    path, arrived = str(tmp_path / "out"), str(tmp_path / "segments")
    cut = recordings.read_segments(spark, folder, CURRENT_SPEC).withColumn("n", F.coalesce("segment_idx", F.lit(0)))
    for part in range(3):
        cut.where(F.col("n") % 3 == part).drop("n").coalesce(1).write.mode("append").parquet(arrived)
    stream = spark.readStream.schema(schemas.SEGMENT).option("maxFilesPerTrigger", 1).parquet(arrived)
    drain(spark, stream, refs, path, str(tmp_path / "progress"))
    assert outcome(chain.outcomes(spark, path)) == wanted
    batches = sorted(r["batch"] for r in chain.committed(spark, path, "results", chain.RESULTS).select("batch").distinct().collect())
    assert len(batches) > 1
    # A fault before the last marker: the batch shows nowhere, and again once it is repeated.
    last = max(int(d.split("=")[1]) for d in os.listdir(f"{path}/commits"))
    kept = outcome(chain.outcomes(spark, path))
    os.rename(f"{path}/commits/batch={last}", str(tmp_path / "mark"))
    assert len(outcome(chain.outcomes(spark, path))) < len(kept)
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "progress" / "commits" / name).unlink(missing_ok=True)
    drain(spark, stream, refs, path, str(tmp_path / "progress"))
    assert outcome(chain.outcomes(spark, path)) == kept
