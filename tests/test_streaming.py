"""Streams over several batches end where the batch job ends."""

import datetime
import time

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import Row, Window
from pyspark.sql import functions as F
from wavs import int16, sine, wav

from shoalsong import schemas
from shoalsong.constants import CURRENT_SPEC
from shoalsong.operators import features, similarity, status
from shoalsong.plans import analysis
from shoalsong.plans import bindings as B
from shoalsong.sources import corpus
from shoalsong.streaming import jobs


@pytest.fixture
def split_events(spark, tmp_path):
    """The events as five files, and a stream that reads one file per batch."""
    folder = str(tmp_path / "events")
    events = B.table(spark, SMALL, "events")
    # Newest first: every later file lies behind what has been seen.
    places = events.withColumn("_part", F.ntile(5).over(Window.orderBy(F.desc("ts"), "event_id")))
    for part in range(1, 6):
        places.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return events, stream


def run(start, *args):
    query = start(*args)
    query.awaitTermination()
    return query


def test_status_machine(spark, split_events, tmp_path):
    events, stream = split_events
    path, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    run(jobs.write_latest, jobs.status_updates(B.job_log(stream)), path, progress)
    # A restart with nothing new changes nothing.
    run(jobs.write_latest, jobs.status_updates(B.job_log(stream)), path, progress)
    got = jobs.read_latest(spark, path, "analysis_id bigint, status string, error string, batch bigint", ["analysis_id"])
    log = B.job_log(events)
    want = status.resolve_status(log.select("analysis_id").distinct(), log)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.fixture
def timers(spark):
    names = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass":
             "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_status_with_state_that_ends(spark, timers, tmp_path):
    """State of finished analyses is dropped; a late item reopens them from the table."""
    folder, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "analysis_id bigint, sk string, ts timestamp_ntz, event_id bigint, error string"

    def drain(rows, keep):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = run(jobs.write_latest, jobs.tracked_status(stream, keep=keep), path, progress)
        return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])

    def found():
        return {r["analysis_id"]: (r["status"], r["error"]) for r in jobs.read_tracked(spark, path).collect()}

    at = datetime.datetime(2024, 1, 1)
    drain([(i, "PREPROCESSED", at, i, None) for i in range(20)] + [(i, "RESULT", at, 100 + i, None) for i in range(18)]
          + [(50, "ERROR", at, 200, "late"), (50, "ERROR", at - datetime.timedelta(1), 201, "early"), (60, "METADATA", at, 1, None)], 1)
    assert found() == {**{i: ("complete", None) for i in range(18)}, 18: ("processing", None), 19: ("processing", None),
                       50: ("failed", "late")}
    time.sleep(2)
    # The timers of the first batch fire with this one: two unfinished analyses and the new one are left.
    drain([(70, "PREPROCESSED", at, 300, None)], 1)
    rows = drain([(3, "ERROR", at, 301, "after the result"), (50, "RESULT", at, 302, None)], 3600)
    assert rows <= 2 * (3 + 2)  # flags and a timer each, where 21 analyses were seen
    assert found() == {**{i: ("complete", None) for i in range(18)}, 18: ("processing", None), 19: ("processing", None),
                       50: ("complete", None), 70: ("processing", None)}


def test_tracked_status_equals_the_batch(spark, timers, split_events, tmp_path):
    events, stream = split_events
    path, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    run(jobs.write_latest, jobs.tracked_status(B.job_log(stream)), path, progress)
    log = B.job_log(events).where("sk <> 'METADATA'")
    want = status.resolve_status(log.select("analysis_id").distinct(), log)
    assert sorted(map(str, map(tuple, jobs.read_tracked(spark, path).collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_redelivered_items(spark, split_events, tmp_path):
    events, stream = split_events
    path, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    twice = B.job_log(stream).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("copy")
    run(jobs.write_table, jobs.deduplicated(twice, ["pk", "sk", "event_id"]).select("event_id"), path, progress)
    got = sorted(r[0] for r in spark.read.parquet(path).collect())
    assert got == sorted(r["event_id"] for r in B.job_log(events).collect())


def test_error_windows(spark, split_events, tmp_path):
    events, stream = split_events
    path, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    run(jobs.write_latest, jobs.hourly_errors(B.function_log(stream)), path, progress)
    got = jobs.read_latest(spark, path, "hour timestamp, function string, errors bigint, batch bigint", ["hour", "function"])
    want = B.function_log(events).where("level = 'ERROR'").groupBy(
        F.date_trunc("hour", "ts").cast("timestamp").alias("hour"), "function").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_files_that_arrive_later(spark, tmp_path):
    folder, path, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    folder.mkdir()

    def drain():
        segments = analysis.good_segments(jobs.segments(jobs.ingest(spark, str(folder), 1), CURRENT_SPEC))
        described = features.segment_features(segments.select("recording_id", "segment_idx", "samples"), 32000)
        run(jobs.write_table, described, path, progress)
        return described.schema

    (folder / "a.wav").write_bytes(wav(int16(sine(6, 32000)), 32000))
    (folder / "bad.wav").write_bytes(b"RIFFxxxxNOPE")
    drain()
    (folder / "b.wav").write_bytes(wav(int16(sine(12, 16000, 900)), 16000))
    schema = drain()
    batch = analysis.good_segments(analysis.segments_of(corpus.scan_recordings(spark, str(folder)), CURRENT_SPEC))
    want = features.segment_features(batch.select("recording_id", "segment_idx", "samples"), 32000)
    got = spark.read.schema(schema).parquet(path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 3


def test_classification(spark, tmp_path):
    rng = np.random.default_rng(2)
    refs = spark.createDataFrame(
        [(i, "f", f"s{i}", "c", "HDRM"[i % 4], 1, rng.normal(size=8).tolist()) for i in range(20)], schemas.REFERENCE_ENTRY)
    pooled = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)],
                                   "recording_id bigint, embedding array<double>")
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    pooled.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(pooled.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run(jobs.classify_batches, stream, refs, "recording_id", path, str(tmp_path / "progress"))
    got = {r["recording_id"]: r["label"] for r in spark.read.parquet(path).collect()}
    want = {r["recording_id"]: r["label"] for r in similarity.classify(pooled, refs).collect()}
    assert got == want


def test_new_rows_by_the_table_itself(spark, split_events, tmp_path):
    events, stream = split_events
    path, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    keys = ["user_id", "event_type"]
    run(jobs.write_new, stream.select(*keys, "event_id"), path, progress, keys)
    got = sorted(map(tuple, spark.read.parquet(path).select(*keys).collect()))
    assert got == sorted(map(tuple, events.select(*keys).distinct().collect()))


def test_no_batch_yet(spark, tmp_path):
    assert jobs.read_latest(spark, str(tmp_path / "none"), "a bigint, b string, batch bigint", ["a"]).count() == 0


def test_files_of_a_batch_are_listed_by_few_tasks(spark, tmp_path):
    """Not by a task per file, of which each sends its own result to the driver."""
    name, folder = "spark.sql.sources.parallelPartitionDiscovery.parallelism", tmp_path / "in"
    folder.mkdir()
    for i in range(60):
        (folder / f"c_{i}.wav").write_bytes(wav(int16(sine(0.01, 800)), 800))
    before = spark.conf.get(name)
    with jobs.listed_together(spark):
        files = jobs.ingest(spark, str(folder)).select("path", "length")
        query = run(jobs.write_table, files, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert spark.conf.get(name) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    assert tasks and max(tasks) <= spark.sparkContext.defaultParallelism < 60


def test_references_are_prepared_once_for_all_batches(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    refs = spark.createDataFrame(
        [(i, "f", f"s{i}", "c", "HDRM"[i % 4], 1, rng.normal(size=8).tolist()) for i in range(50)], schemas.REFERENCE_ENTRY)
    pooled = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)],
                                   "recording_id bigint, embedding array<double>")
    made, folder, path = [], str(tmp_path / "in"), str(tmp_path / "out")
    pack, write = similarity._pack, similarity.cells.write_cells
    monkeypatch.setattr(similarity, "_pack", lambda *a: made.append("matrices") or pack(*a))
    monkeypatch.setattr(similarity.cells, "write_cells", lambda *a: made.append("cells") or write(*a))
    pooled.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(pooled.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = run(jobs.classify_batches, stream, refs, "recording_id", path, str(tmp_path / "progress"))
    assert len(query.recentProgress) >= 4 and made == ["cells"]
    monkeypatch.undo()
    got = {r["recording_id"]: (r["site_id"], round(r["similarity"], 9)) for r in spark.read.parquet(path).collect()}
    want = similarity.similar_sites(pooled, refs).where("rank = 1").collect()
    assert got == {r["recording_id"]: (r["site_id"], round(r["similarity"], 9)) for r in want}


class _Store:
    """One state value and its timers, counting what is asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        self.asked += 1
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000 + len(self.timers) + self.asked


def test_timers_are_looked_up_of_finished_analyses_only():
    store = _Store()
    tracker = jobs._tracker("analysis_id", 500)
    tracker.init(store)
    asked = []
    for event, sk in enumerate(["PREPROCESSED", "PREPROCESSED", "RESULT", "ERROR", "RESULT"]):
        row = Row(sk=sk, at=event, event_id=event, error=None)
        list(tracker.handleInputRows((7,), iter([row]), store))
        asked.append((store.asked, len(store.timers)))
    assert asked == [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1)]
    assert tuple(store.value) == (True, True, True, 3, 3, None)
