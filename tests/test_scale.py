"""Skewed inputs, lost copies, and the shape of plans."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shoalsong import constants as C
from shoalsong.operators import embedding, similarity, status, validation
from shoalsong.plans import bindings as B
from shoalsong.sources import corpus, tables

QUERIES = entry.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_query_forms_a_product(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["segment_fixed", "feature_rms", "spectral_centroid", "segment_padded", "downmix_mono"])
def test_signal_chain_shuffles_samples_once(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    # One exchange of counts for the verdicts, one of the samples by recording.
    assert plan.count("Exchange hashpartitioning") == 2


def test_summaries_do_not_read_samples(spark, tmp_path):
    tables.write_segments(spark.createDataFrame(
        [("a", 0, [1.0], 4, 4, 1.0, 1, None, None)], tables.schemas.SEGMENT), str(tmp_path / "s"))
    plan = plan_of(tables.read_segments(spark, str(tmp_path / "s")).groupBy("recording_id").count())
    assert "ReadSchema: struct<recording_id:string>" in plan


def test_lookup_reaches_the_scan(spark, tmp_path):
    log = B.job_log(B.table(spark, SMALL, "events"))
    tables.append_log(log, str(tmp_path / "log"))
    plan = plan_of(tables.lookup_item(tables.read_log(spark, str(tmp_path / "log")), "ANALYSIS#101", "RESULT"))
    assert "EqualTo(pk,ANALYSIS#101)" in plan


def test_listing_does_not_read_content(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"x" * 100)
    plan = plan_of(corpus.storage_rollup(corpus.scan_recordings(spark, str(tmp_path)), "path"))
    assert "content" not in plan.split("ReadSchema")[1]


def test_missing_tables_are_empty(spark, tmp_path):
    assert tables.load_references(spark, str(tmp_path / "none")).count() == 0
    assert tables.load_references(spark, str(tmp_path / "none"), "json").count() == 0
    assert tables.read_log(spark, str(tmp_path / "none")).columns == tables.schemas.JOB_LOG.names


def test_json_index_keeps_its_order(spark, tmp_path):
    (tmp_path / "metadata.json").write_text(
        '[{"filename": "b.wav", "site_id": "aus_H1", "country": "aus", "site_type": "H", "num_segments": 2,'
        ' "embedding_file": "b.npy", "mean_embedding": [1.0, 0.0]},\n {"filename": "a.wav", "mean_embedding": [0.0, 1.0]}]')
    rows = tables.load_references(spark, str(tmp_path), "json").orderBy("ref_id").collect()
    assert [r["filename"] for r in rows] == ["b.wav", "a.wav"] and rows[1]["site_id"] is None


def test_recording_with_a_third_of_all_samples(spark):
    """It is turned away as too long; the others are untouched."""
    normal = spark.range(40000).select((F.col("id") % 400).alias("recording_id"), "id")
    hot = spark.range(20000).select(F.lit(-1).cast("bigint").alias("recording_id"), "id")
    samples = normal.union(hot).select("*", F.lit(0.5).alias("v"), F.lit(4).alias("sample_rate"))
    kept = validation.admitted_samples(samples, C.SegmentSpec(rate=4, seconds=4.0, min_seconds=7.5, max_seconds=36.0))
    assert kept.groupBy("recording_id").count().where("count = 100").count() == 400
    assert kept.where("recording_id = -1").count() == 0


def test_key_with_a_third_of_all_segments(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("recording_id"),
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    pooled = {r["recording_id"]: r for r in embedding.mean_pool(df, "recording_id").collect()}
    assert pooled[-1]["num_segments"] == n // 3
    assert pooled[-1]["embedding"] == [np.arange(0, n, 3).mean(), 1.0]
    # What a task sends of the hot key does not grow with its rows.
    plan = plan_of(embedding.mean_pool(df, "recording_id"))
    assert plan.index("partial_count") > plan.index("Exchange")


def test_log_key_with_a_third_of_all_items(spark):
    log = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("pk"),
        F.lit("RESULT").alias("sk"), F.current_timestamp().alias("ts"), F.col("id").alias("event_id"))
    latest = {r["pk"]: r["event_id"] for r in status.latest_state(log).collect()}
    assert latest["hot"] == 29997 and len(latest) == 601


def test_blocked_and_broadcast_search_agree_on_copies(spark):
    """A third of the index is one vector; ties still go to the lower ref_id."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(600, 16))
    vectors[::3] = vectors[0]
    refs = spark.createDataFrame([(i, v.tolist(), "H", "s", "c", 1, "f") for i, v in enumerate(vectors)],
                                 "ref_id bigint, embedding array<double>, site_type string, site_id string, country string, num_segments bigint, filename string")
    pooled = spark.createDataFrame([(i, (vectors[0] + 0.1 * rng.normal(size=16)).tolist()) for i in range(50)],
                                   "recording_id bigint, embedding array<double>")
    expected = {i: [0, 3, 6, 9, 12] for i in range(50)}
    for sizes in ({}, {"broadcast_bytes": 0, "block_bytes": 4096}):
        got = {}
        for r in similarity.nearest_references(pooled, refs, k=5, **sizes).orderBy("rank").collect():
            got.setdefault(r["recording_id"], []).append(r["ref_id"])
        assert got == expected


def test_nearest_without_references_or_recordings(spark):
    refs = spark.createDataFrame([], tables.schemas.REFERENCE_ENTRY)
    pooled = spark.createDataFrame([(1, [1.0])], "recording_id bigint, embedding array<double>")
    assert similarity.nearest_references(pooled, refs).count() == 0
    assert similarity.nearest_references(pooled.limit(0), refs).count() == 0
