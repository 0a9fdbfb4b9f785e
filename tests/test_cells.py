"""Nearest references by cells: exact, without a shuffle of recordings, and with most products passed over."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalsong.operators import cells, similarity

REF = "ref_id bigint, site_id string, country string, site_type string, embedding array<double>"


def clustered(seed, n, width=16, clusters=12, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(clusters, width))
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, width)) * spread


def unit(matrix):
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def brute(queries, references, k):
    scores = np.round(unit(queries) @ unit(references).T, 12)
    return [sorted(range(len(references)), key=lambda j: (-row[j], j))[:k] for row in scores]


@pytest.mark.parametrize("k", [1, 3, 40])
@pytest.mark.parametrize("kind", ["clustered", "random", "copies", "zeros"])
def test_search_equals_brute_force(k, kind):
    queries, references = clustered(1, 150), clustered(2, 400)
    if kind == "random":
        references = np.random.default_rng(5).normal(size=(400, 16))
    if kind == "copies":
        references[:200] = references[0]
    if kind == "zeros":
        queries[:5], references[100:130] = 0, 0
    units = unit(references)
    pivots = cells.farthest_first(units[:60], 12)
    angle = np.arccos(np.clip(units @ pivots.T, -1, 1))
    owner = np.where(units.any(axis=1), angle.argmin(axis=1), -1)
    parts = {(16, int(p), q): np.flatnonzero((owner == p) & (np.arange(400) % 3 == q)) for p in np.unique(owner) for q in range(3)}
    parts = {c: ids for c, ids in parts.items() if len(ids)}
    ranges = [(*c, *((angle[ids, c[1]].min(), angle[ids, c[1]].max()) if c[1] >= 0 else (0.0, 0.0))) for c, ids in parts.items()]
    rows, found, _, compared = cells.search(
        unit(queries), k, pivots, ranges, lambda *c: (parts[c], units[parts[c]]))
    got = [found[rows == i].tolist() for i in range(150)]
    assert got == brute(queries, references, k)
    if kind == "clustered" and k < 40:
        assert compared < 0.25 * 150 * 400


@pytest.fixture(scope="module")
def frames(spark):
    references, recordings = clustered(3, 600), clustered(4, 200)
    references[:200] = references[0]  # a third are copies, more than a cell takes
    refs = spark.createDataFrame([(i, f"s{i}", "c", "H", v.tolist()) for i, v in enumerate(references)], REF).repartition(4)
    pooled = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(recordings)],
                                   "recording_id bigint, embedding array<double>").repartition(4)
    return pooled, refs, brute(recordings, references, 3)


def test_no_recording_is_shuffled(frames):
    pooled, refs, want = frames
    found = similarity.nearest_references(pooled, refs, broadcast_bytes=0, block_bytes=4096)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r["recording_id"], []).append(r["ref_id"])
    assert [got[i] for i in range(200)] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The only exchange is the repartition of the input above.
    assert plan.count("Exchange") == 1 and "RoundRobin" in plan and "Join" not in plan


def test_a_hot_cell_is_split(spark, frames, tmp_path):
    entries = frames[1].select("ref_id", F.size("embedding").alias("dim"), "embedding")
    pivots = cells.choose_pivots(entries, 8)
    written = cells.write_cells(entries, pivots, str(tmp_path / "cells"), 4096)
    sizes = [len(cells.read_cell(str(tmp_path / "cells"), *c[:3])[0]) for c in written]
    assert sum(sizes) == 600 and max(sizes) < 100  # 32 vectors of 128 bytes each, were the hash even


def test_a_cell_is_decoded_into_place(tmp_path):
    """Reading a cell takes little more than its matrix, and a task keeps two of the usual size."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows, dim = 40_000, 64
    units = np.random.default_rng(2).normal(size=(rows, dim))
    folder = tmp_path / "dim=64" / "pivot=3" / "part=0"
    folder.mkdir(parents=True)
    for half in (0, 1):
        own = units[half::2]
        table = pa.table({"ref_id": np.arange(half, rows, 2), "angle": np.zeros(len(own)),
                          "unit": pa.array([u.tobytes() for u in own], pa.binary())})
        pq.write_table(table, folder / f"part-{half}.snappy.parquet")
    pool, usual = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        ref_ids, matrix = cells.read_cell(str(tmp_path), dim, 3, 0)
    finally:
        pa.set_memory_pool(usual)
    order = np.argsort(ref_ids)
    assert ref_ids[order].tolist() == list(range(rows)) and (matrix[order] == units).all()
    assert pool.max_memory() < units.nbytes
    assert cells.HELD_BYTES <= 2 * (32 << 20)
