"""Similarity against numpy brute force on small awkward inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalsong import constants as C
from shoalsong import schemas
from shoalsong.operators import embedding, similarity
from shoalsong.plans import analysis

NAMES = dict(C.CATEGORIES)
REF = "ref_id bigint, filename string, site_id string, country string, site_type string, num_segments bigint, embedding array<double>"


def cosine(a, b):
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / scale) if scale else 0.0


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    refs, samples = [], []
    for i in range(300):
        width = 6 if i % 7 else 9
        vector = rng.normal(size=width)
        if i % 50 == 3:
            vector = np.zeros(width)
        if 100 <= i < 200 and width == 6:  # a third of the index are copies
            vector = np.arange(1.0, 7.0)
        refs.append((i, None, None if i % 11 == 0 else f"s{i % 40}", f"c{i % 5}", "HDRMUX"[i % 6], 2, vector))
    for i in range(120):
        vector = rng.normal(size=(6, 9, 4)[i % 3 if i % 10 else 0])
        if i == 60:
            vector = np.zeros(6)
        if i % 4 == 0 and len(vector) == 6 and i != 60:
            vector = np.arange(1.0, 7.0) + rng.normal(size=6) * 0.01
        samples.append((i, vector))
    return refs, samples


@pytest.fixture(scope="module")
def frames(spark, data):
    refs = spark.createDataFrame([(*r[:-1], r[-1].tolist()) for r in data[0]], REF).repartition(5)
    pooled = spark.createDataFrame([(i, v.tolist(), 1) for i, v in data[1]],
                                   "recording_id bigint, embedding array<double>, num_segments bigint").repartition(4)
    return pooled, refs


def expected_probabilities(vector, refs):
    scores = []
    for code, _ in C.CATEGORIES:
        found = [cosine(vector, r[-1]) for r in refs if r[4] == code and len(r[-1]) == len(vector)]
        scores.append(np.mean(found) if found else 0.1)
    total = sum(scores)
    return [s / total for s in scores] if total > 0 else scores


def test_classify(frames, data):
    pooled, refs = frames
    got = {r["recording_id"]: r for r in similarity.classify(pooled, refs).collect()}
    assert len(got) == 120
    for i, vector in data[1]:
        want = expected_probabilities(vector, data[0])
        assert np.allclose([c["p"] for c in got[i]["probabilities"]], want, atol=1e-9)
        assert got[i]["label"] == C.CATEGORIES[int(np.argmax(np.round(want, 12)))][1]
    # No reference of width 4: four equal shares, and the first category wins.
    four = next(i for i, v in data[1] if len(v) == 4)
    assert got[four]["label"] == "healthy" and got[four]["confidence"] == 0.25 and not got[four]["valid"]


def expected_nearest(vector, refs, k):
    found = [(-round(cosine(vector, r[-1]), 12), r[0]) for r in refs if len(r[-1]) == len(vector)]
    return [ref for _, ref in sorted(found)[:k]]


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_bytes": 2000}, {"broadcast_bytes": 0, "block_bytes": 1 << 20}])
@pytest.mark.parametrize("k", [1, 3, 25])
def test_nearest(frames, data, sizes, k):
    pooled, refs = frames
    got = {}
    for r in similarity.nearest_references(pooled, refs, k=k, **sizes).collect():
        got.setdefault(r["recording_id"], []).append((r["rank"], r["ref_id"]))
    for i, vector in data[1]:
        assert [ref for _, ref in sorted(got.get(i, []))] == expected_nearest(vector, data[0], k), i


def test_nearest_with_file_names_as_keys(frames, data):
    pooled, refs = frames
    named = pooled.withColumn("recording_id", F.concat(F.lit("r"), "recording_id"))
    for sizes in ({}, {"broadcast_bytes": 0, "block_bytes": 2000}):
        got = {}
        for r in similarity.nearest_references(named, refs, **sizes).orderBy("rank").collect():
            got.setdefault(r["recording_id"], []).append(r["ref_id"])
        for i, vector in data[1]:
            assert got.get(f"r{i}", []) == expected_nearest(vector, data[0], 3)


def test_similar_sites_defaults(frames):
    pooled, refs = frames
    rows = similarity.similar_sites(pooled, refs, k=25).collect()
    assert {r["site_id"] for r in rows if r["ref_id"] % 11 == 0} == {"unknown"}
    assert all(r["status"] == NAMES.get("HDRMUX"[r["ref_id"] % 6], "unknown") for r in rows)


def test_no_references(spark, frames):
    none = spark.createDataFrame([], schemas.REFERENCE_ENTRY)
    row = similarity.classify(frames[0], none).first()
    assert row["label"] == "healthy" and row["confidence"] == 0.65 and not row["valid"]
    sites = similarity.similar_sites_or_placeholder(frames[0], none).where("recording_id = 5").orderBy("rank").collect()
    assert [r["site_id"] for r in sites] == ["aus_H1", "idn_H1", "aus_H2"]


def test_comparable_references(frames, data):
    got = {r["recording_id"]: r["comparable"] for r in similarity.comparable_references(*frames).collect()}
    for i, vector in data[1]:
        assert got[i] == sum(len(r[-1]) == len(vector) for r in data[0])


def test_pool_by_site_keeps_one_row_per_site(frames, data):
    refs = frames[1].where(F.size("embedding") == 6)
    rows = similarity.pool_by_site(refs).collect()
    sites = {}
    for r in data[0]:
        if len(r[-1]) == 6:
            sites.setdefault((r[2] or "unknown", r[3], r[4]), []).append(r[-1])
    assert len(rows) == len(sites)
    for row in rows:
        assert np.allclose(row["embedding"], np.mean(sites[row["site_id"], row["country"], row["site_type"]], axis=0))


@pytest.mark.parametrize("width", [1, 31, 32, 33, 70])
def test_mean_pool_widths(spark, width):
    rng = np.random.default_rng(width)
    vectors = rng.normal(size=(50, width))
    rows = [(i % 4, v.tolist()) for i, v in enumerate(vectors)] + [(9, None), (0, None)]
    df = spark.createDataFrame(rows, "recording_id bigint, embedding array<double>").repartition(3)
    got = {r["recording_id"]: r for r in embedding.mean_pool(df, "recording_id").collect()}
    for key in range(4):
        assert np.allclose(got[key]["embedding"], vectors[key::4].mean(axis=0))
        assert got[key]["num_segments"] == len(vectors[key::4]) and got[key]["dim"] == width
    assert got[9]["embedding"] is None and got[9]["num_segments"] == 0


def test_mixed_widths_have_no_mean(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "recording_id bigint, embedding array<double>")
    assert embedding.mean_pool(df, "recording_id").first().asDict() == {
        "recording_id": 1, "embedding": None, "dim": None, "num_segments": 2}


def test_projection_of_odd_width(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 8.0],)], "embedding array<double>")
    row = similarity.project_2d(df).first()
    assert (row["x"], row["y"]) == (1.5, 5.0)


def test_result_document_of_1280_entries(spark):
    rng = np.random.default_rng(1)
    refs = [(i, f"f{i}.wav", f"s{i}", "aus", "HDRM"[i % 4], 1, rng.normal(size=1280).tolist()) for i in range(12)]
    pooled = spark.createDataFrame([(7, rng.normal(size=1280).tolist(), 3)], "analysis_id bigint, embedding array<double>, num_segments bigint")
    row = analysis.result_documents(pooled, spark.createDataFrame(refs, REF)).first()
    assert row["embedding_summary"]["dimension"] == 1280 and len(row["similar_sites"]) == 3
    assert sum(row["classification"]["probabilities"].values()) == pytest.approx(1, abs=1e-5)
    assert row["caveats"].endswith("visual surveys.")


def test_vectors_with_nan(spark):
    nan = float("nan")
    refs = spark.createDataFrame(
        [(0, "f", "a", "c", "H", 1, [1.0, 0.0]), (1, "f", "b", "c", "D", 1, [nan, 1.0]), (2, "f", "d", "c", "D", 1, [0.0, 1.0])], REF)
    pooled = spark.createDataFrame([(0, [0.1, 1.0]), (1, [nan, 1.0])], "recording_id bigint, embedding array<double>")
    rows = {r["recording_id"]: r for r in similarity.classify(pooled, refs).collect()}
    assert rows[0]["label"] == "degraded" and rows[0]["valid"]
    assert rows[1]["label"] is None and not rows[1]["valid"]
    nearest = similarity.nearest_references(pooled, refs).orderBy("rank").collect()
    assert [(r["recording_id"], r["ref_id"]) for r in nearest] == [(0, 2), (0, 0)]


def test_wide_and_mixed_vectors_do_not_fail_others(spark):
    from shoalsong import schemas
    from shoalsong.operators import embedding, similarity

    wide = [float(i % 7) for i in range(4096)]
    refs = spark.createDataFrame([(1, "f", "s1", "c", "H", 1, wide), (2, "g", "s2", "c", "D", 1, [1.0, 0.0])], schemas.REFERENCE_ENTRY)
    pooled = spark.createDataFrame([("a", wide), ("b", [2.0, 0.0])], "recording_id string, embedding array<double>")
    got = {r["recording_id"]: (r["label"], r["dim"]) for r in similarity.classify(pooled, refs).collect()}
    assert got["a"][1] == 4096 and got["a"][0] == "healthy" and got["b"][0] == "degraded"
    segments = spark.createDataFrame([("m", [1.0, 2.0]), ("m", [1.0]), ("ok", [1.0, 3.0]), ("ok", [3.0, 5.0])],
                                     "recording_id string, embedding array<double>")
    means = {r["recording_id"]: (r["embedding"], r["dim"]) for r in embedding.mean_pool(segments, "recording_id").collect()}
    assert means == {"m": (None, None), "ok": ([2.0, 4.0], 2)}
