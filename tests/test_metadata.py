"""Names, keys, documents, job status and reports on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shoalsong.functions import fields
from shoalsong.operators import reports, status
from shoalsong.plans import analysis
from shoalsong.constants import SegmentSpec
from shoalsong.sources import tables, workspace
from wavs import int16, sine, wav


@pytest.mark.parametrize("name,country,site,site_type,stamp", [
    ("aus_D1_20230207_120400.wav", "aus", "D1", "D", dt.datetime(2023, 2, 7, 12, 4)),
    ("data/deep/idn_H2_20230207_120400.wav", "idn", "H2", "H", dt.datetime(2023, 2, 7, 12, 4)),
    ("noise.wav", "unknown", "unknown", "U", None),
    ("aus_.wav", "aus", "", "U", None),
    ("aus_M1", "aus", "M1", "M", None),
    ("aus_R1_baddate_xx.v2.wav", "aus", "R1", "R", None),
])
def test_file_names(spark, name, country, site, site_type, stamp):
    df = spark.createDataFrame([(name,)], "f string").select(fields.filename_parts(F.col("f")).alias("p")).select("p.*")
    row = df.first()
    assert tuple(row) == (country, site, site_type, f"{country}_{site}", stamp)


def test_labels(spark):
    df = spark.createDataFrame([("restored_early",), (None,)], "s string")
    assert [r[0] for r in df.select(fields.display_label(F.col("s"))).collect()] == ["Restored Early", "Unknown"]


def test_rounding_keeps_the_shape(spark):
    schema = "d struct<a: double, b: array<double>, m: map<string, double>, t: string, n: struct<x: float>>"
    df = spark.createDataFrame([((1.23456789, [0.00000049, 2.0], {"k": 9.87654321}, "text", (0.5,)),)], schema)
    out = df.select(fields.round_leaves(F.col("d"), df.schema["d"].dataType).alias("d"))
    assert out.schema["d"].dataType.simpleString() == df.schema["d"].dataType.simpleString()
    d = out.first()["d"]
    assert d["a"] == 1.234568 and d["b"] == [0.0, 2.0] and d["m"] == {"k": 9.876543} and d["t"] == "text"


LOG = "analysis_id bigint, sk string, ts timestamp_ntz, event_id bigint, error string"


@pytest.fixture
def log(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "RESULT", 5, None), (1, "ERROR", 6, "late"), (2, "PREPROCESSED", 1, None), (2, "ERROR", 2, "hidden"),
            (3, "ERROR", 1, "first"), (3, "ERROR", 3, "second"), (4, "METADATA", 1, None)]
    return spark.createDataFrame([(a, sk, t + dt.timedelta(hours=h), h, e) for a, sk, h, e in rows], LOG)


def test_status_precedence(spark, log):
    requests = spark.createDataFrame([(i,) for i in range(1, 6)], "analysis_id bigint")
    got = {r[0]: (r["status"], r["error"]) for r in status.resolve_status(requests, log).collect()}
    assert got == {1: ("complete", None), 2: ("processing", None), 3: ("failed", "second"),
                   4: ("not_found", "ANALYSIS_NOT_FOUND"), 5: ("not_found", "ANALYSIS_NOT_FOUND")}
    visible = {r[0]: r["status"] for r in status.resolve_status(requests, log, errors_first=True).collect()}
    assert visible[2] == "failed" and visible[1] == "complete"


def test_answers_carry_results_only_when_complete(spark, log):
    requests = spark.createDataFrame([(1,), (2,)], "analysis_id bigint")
    results = spark.createDataFrame([(1, "complete", "healthy"), (2, "complete", "degraded")], "analysis_id bigint, status string, label string")
    got = {r[0]: (r["status"], r["label"]) for r in status.answers(requests, log, results).collect()}
    assert got == {1: ("complete", "healthy"), 2: ("processing", None)}


def test_published_sites(spark):
    sites = tables.reference_sites(spark)
    assert tuple(reports.site_metrics(sites).first()) == (8, 3, 2, 3)
    pivot = {r["country"]: (r["healthy"], r["degraded"], r["restored_early"], r["restored_mid"])
             for r in reports.country_status_pivot(sites).collect()}
    assert pivot["Australia"] == (2, 1, 1, 0) and pivot["Indonesia"] == (1, 0, 0, 1)
    named = reports.enrich_sites(spark.createDataFrame([("phl",), ("xyz",)], "country string"), tables.country_names(spark))
    assert {r["country"]: r["country_name"] for r in named.collect()} == {"phl": "Philippines", "xyz": "Unknown"}


def test_functions_without_errors_stay(spark):
    now = dt.datetime(2024, 1, 1, 12)
    logs = spark.createDataFrame(
        [("router", now, "INFO"), ("router", now - dt.timedelta(minutes=59), "ERROR"),
         ("classifier", now - dt.timedelta(hours=1), "ERROR")], "function string, ts timestamp_ntz, level string")
    functions = spark.createDataFrame([("router",), ("classifier",), ("preprocessor",)], "function string")
    got = {r[0]: r[1] for r in reports.recent_errors(logs, functions).collect()}
    assert got == {"router": 1, "classifier": 0, "preprocessor": 0}


def test_free_tier(spark):
    month = dt.datetime(2024, 1, 5)
    small = spark.createDataFrame([(month, 1024, 400000.0)], "ts timestamp_ntz, memory_mb int, seconds double")
    assert reports.compute_metering(small).first()["cost"] == 0
    large = spark.createDataFrame([(month, 1024, 1400000.0)], "ts timestamp_ntz, memory_mb int, seconds double")
    assert reports.compute_metering(large).first()["cost"] == pytest.approx(16.6667)


def test_reference_tables_leave_out_files_with_a_failing_segment(spark, tmp_path):
    def factory():
        def model(windows):
            if windows.min() < -0.9:
                raise ValueError("too loud")
            return windows[:, :4]
        return model

    loud = int16(sine(2, 100, 5, 0.5))
    loud[150] = -32768
    files = spark.createDataFrame(
        [(name, len(c), bytearray(c)) for name, c in {
            "in/aus_H1_20230101_000000.wav": wav(int16(sine(2, 100, 5)), 100),
            "in/aus_D1_20230101_000000.wav": wav(loud, 100),
            "in/idn_M1_20230101_000000.wav": b"RIFF",
        }.items()], "path string, length bigint, content binary")
    seen = analysis.build_reference_tables(files, SegmentSpec(rate=100, seconds=1.0, min_seconds=1.0), factory, str(tmp_path), width=4)
    assert {(r["country"], r["site_type"]): r["num_segments"] for r in seen.collect()} == {
        ("aus", "H"): 2, ("aus", "D"): 0, ("idn", "M"): 0}
    index = tables.load_references(spark, str(tmp_path / "index")).collect()
    assert [(r["site_id"], r["site_type"], len(r["embedding"])) for r in index] == [("aus_H1", "H", 4)]
    stats = {(r["country"], r["site_type"]): (r["files"], r["files_ok"], r["segments"]) for r in reports.index_build_stats(seen).collect()}
    assert stats[("aus", "D")] == (1, 0, 0) and stats[("aus", "H")] == (1, 1, 2)


class Session:
    """Just the two settings the workspace looks at."""

    def __init__(self, folder, master):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_comes_from_the_session(spark):
    assert workspace.new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert workspace.shared_folder(Session("hdfs://name/shared/", "yarn")) == "hdfs://name/shared"
    assert workspace.shared_folder(Session(None, "local[2]"))
    with pytest.raises(RuntimeError):
        workspace.shared_folder(Session(None, "yarn"))


def test_updates_keep_other_attributes(spark):
    from shoalsong.operators import reports, status

    rows = [("U#1", "M", "put", 1, 1, "a1", "uploaded", None), ("U#1", "M", "update", 2, 2, None, "linked", None),
            ("U#1", "M", "update", 3, 3, None, None, "late"), ("U#2", "M", "put", 1, 4, "x", "uploaded", "old"),
            ("U#2", "M", "put", 5, 5, "y", "uploaded", None), ("U#2", "M", "update", 4, 6, None, "lost", None),
            ("U#3", "M", "update", 1, 7, None, "only", None)]
    log = spark.createDataFrame(rows, "pk string, sk string, op string, ts bigint, event_id bigint, analysis_id string, status string, error string")
    got = {r["pk"]: (r["analysis_id"], r["status"], r["error"]) for r in status.current_items(log).collect()}
    assert got == {"U#1": ("a1", "linked", "late"), "U#2": ("y", "uploaded", None), "U#3": (None, "only", None)}
    sites = spark.createDataFrame([("a", "healthy"), ("a", None), ("a", "closed")], "country string, status string")
    assert reports.country_status_pivot(sites).first().asDict() == {
        "country": "a", "healthy": 1, "degraded": 0, "restored_early": 0, "restored_mid": 0, "unknown": 2}
