"""A group of vectors that are all linked is compared without holding its pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import GroupedData

from shoalsong.llm import embeddings


def joined(spark, monkeypatch):
    """What block_links does with one group."""
    caught = []
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, run, schema: caught.append(run))
    classes = spark.createDataFrame([(0, 2, b"", 1)], "id bigint, width int, vector binary, n bigint")
    embeddings.block_links(classes, spark.createDataFrame([(0, 2, 0, 0, True)], embeddings.MEMBER), 0.9, "<f8")
    return caught[0]


def group(vectors):
    """All vectors on both sides."""
    data, n = [v.tobytes() for v in vectors], len(vectors)
    return pa.table({"left": [True] * n + [False] * n, "id": np.tile(np.arange(n), 2), "vector": data * 2,
                     "n": np.tile(np.arange(n) % 3 + 1, 2)})


def test_pairs_of_a_dense_group_are_not_held(spark, monkeypatch):
    run, n = joined(spark, monkeypatch), 4096
    table = group(1 + np.random.RandomState(0).rand(n, 8) / 10)
    tracemalloc.start()
    found = run(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    weight = np.arange(n) % 3 + 1
    rows = [r for r in found.to_pylist() if r["id"] is not None]
    assert {r["id"]: r["weight"] for r in rows} == {i: weight.sum() - weight[i] for i in range(n)}
    assert {(r["a"], r["b"]) for r in found.to_pylist() if r["a"] is not None} == {(i, 0) for i in range(1, n)}
    # The two index arrays of all pairs alone are 16 * n * n = 268 MB.
    assert peak < 200 << 20


def test_links_equal_brute_force(spark, monkeypatch):
    """Chains and clusters that span the slices."""
    run, rng = joined(spark, monkeypatch), np.random.RandomState(1)
    monkeypatch.setattr(embeddings, "SLICE", 7, raising=False)
    turn = np.r_[np.arange(150) * 0.02, rng.permutation(np.arange(100) * 0.03 + np.pi)]
    vectors = rng.permutation(np.stack([np.cos(turn), np.sin(turn)], axis=1))
    found = run(group(vectors)).to_pylist()
    near = (vectors @ vectors.T >= 0.9) & ~np.eye(len(vectors), dtype=bool)
    weight = np.arange(len(vectors)) % 3 + 1
    assert {r["id"]: r["weight"] for r in found if r["id"] is not None} == {
        i: int(weight[near[i]].sum()) for i in np.flatnonzero(near.any(axis=1))}
    low = np.arange(len(vectors))
    for _ in vectors:
        low = np.minimum(low, np.where(near, low[None], len(low)).min(axis=1))
    assert {r["a"]: r["b"] for r in found if r["a"] is not None} == {i: b for i, b in enumerate(low.tolist()) if i != b}
