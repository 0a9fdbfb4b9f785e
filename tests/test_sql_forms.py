"""Table function, spectra by columns, life of uploads by one aggregate, prefixes of paths."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_scale import plan_of

from shoalsong.functions import windows
from shoalsong.operators import features, status
from shoalsong.plans import bindings as B
from shoalsong.plans.queries import QUERIES
from shoalsong.sources import corpus


@pytest.mark.parametrize("padded", [False, True])
@pytest.mark.parametrize("records", [7, 10000])
def test_windows_by_sql(spark, padded, records):
    lengths = {"a": 40, "b": 5, "c": 3, "d": 23, "e": 8, "f": 1}
    rows = [(k, i, None if i == 2 else float(i), "x") for k, n in lengths.items() for i in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        windows.register_windows(spark, "cut_text_keys", "string")
        samples = spark.createDataFrame(rows, "recording_id string, sample_idx int, v double, extra string")
        found = spark.sql(f"SELECT * FROM cut_text_keys(TABLE({{t}}) PARTITION BY recording_id ORDER BY (sample_idx), 8, {padded})",
                          t=samples.repartition(3)).collect()
        assert spark.sql("SELECT * FROM cut_text_keys(TABLE({t}) PARTITION BY recording_id ORDER BY (sample_idx), 8, true)",
                         t=samples.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = []
    for k, n in lengths.items():
        end = n // 8 * 8 + (8 if padded and n % 8 > 4 else 0)
        wanted += [(k, i // 8, i % 8, None if i == 2 else float(i) if i < n else 0.0) for i in range(end)]
    assert sorted(map(tuple, found), key=lambda r: r[:3]) == sorted(wanted, key=lambda r: r[:3])


def test_spectra_by_columns_equal_numpy(spark):
    rng = np.random.RandomState(5)
    rows = [(i, [float(x) for x in rng.randn(n)]) for i, n in enumerate([1, 2, 3, 16, 31, 64, 200])] + [(90, []), (91, [0.0] * 8)]
    segments = spark.createDataFrame(rows, "recording_id bigint, samples array<double>")
    found, wanted = ({r.recording_id: r for r in f(segments).collect()}
                     for f in (features.magnitude_spectrum_columns, features.magnitude_spectrum))
    assert set(found) == set(wanted) == {*range(7), 91}
    for i, r in wanted.items():
        assert found[i].n == r.n == len(rows[i][1] if i < 90 else rows[-1][1])
        assert np.allclose(found[i].magnitude, r.magnitude, atol=1e-9) and np.allclose(found[i].share, r.share, atol=1e-9)
    assert np.allclose(wanted[4].magnitude, np.abs(np.fft.rfft(rows[4][1])))


def test_spectra_by_columns_stay_in_the_jvm(spark):
    plan = plan_of(QUERIES["magnitude_spectrum_columns"](spark, SMALL))
    assert "Python" not in plan and "MapInArrow" not in plan


def test_life_of_uploads_by_one_aggregate(spark):
    log = B.job_log(B.table(spark, SMALL, "events"))
    by_kind = [log.where(F.col("sk") == k).select("upload_id", "analysis_id").distinct() for k in ("METADATA", "PREPROCESSED", "RESULT")]
    joined = status.upload_lifecycle(by_kind[0].select("upload_id"), by_kind[1], by_kind[2])
    found = status.lifecycle_of_log(log)
    plan = plan_of(found)
    assert sorted(map(str, found.collect())) == sorted(map(str, joined.select(*found.columns).collect()))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_items_without_upload(spark):
    rows = [("METADATA", "u1", None), ("RESULT", "u1", "a1"), ("METADATA", "u2", None), ("PREPROCESSED", "u2", "a2"),
            ("PREPROCESSED", "u3", "a3"), ("METADATA", None, "a4"), (None, "u5", "a5"), ("METADATA", "u2", None), ("RESULT", "u2", "a2")]
    log = spark.createDataFrame(rows, "sk string, upload_id string, analysis_id string")
    assert sorted(map(tuple, status.lifecycle_of_log(log).collect())) == [("u1", None, "uploaded"), ("u2", "a2", "complete")]
    assert status.lifecycle_of_log(log.limit(0)).count() == 0


@pytest.mark.parametrize("path, bucket, prefix", [
    ("s3a://store/uploads/a/b.wav", "store", "uploads"), ("s3://store/b.wav", "store", ""), ("file:///data/x/b.wav", None, "data"),
    ("file:/data/b.wav", None, "data"), ("/data/b.wav", None, "data"), ("data/b.wav", None, "data"), ("b.wav", None, ""),
    ("abfss://box@acct.example/in/x", "box@acct.example", "in"), ("", None, ""), (None, None, None)])
def test_prefix_of_a_path(spark, path, bucket, prefix):
    row = corpus.with_prefix(spark.createDataFrame([(path,)], "path string")).first()
    assert (row.bucket, row.prefix) == (bucket, prefix)
