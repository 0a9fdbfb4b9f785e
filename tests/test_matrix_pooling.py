"""Pooling on matrices against pooling by blocks of entries."""

import numpy as np
import pytest

from shoalsong.operators import embedding


def frame(spark, width=33):
    rng = np.random.default_rng(width)
    rows = [(i % 7 if i % 3 else 0, "ab"[i % 2], rng.normal(size=width).tolist()) for i in range(900)]
    rows += [(20, None, [1.0]), (20, None, [3.0]), (21, "x", [1.0]), (21, "x", [1.0, 2.0]), (22, "x", None), (22, "x", [2.0, None]),
             (23, "x", []), (24, "y", None), (None, "a", [5.0]), (25, "z", [float("nan"), 1.0]), (25, "z", [1.0, 1.0])]
    return spark.createDataFrame(rows, "site bigint, n string, embedding array<double>").repartition(3)


def found(df):
    rows = {(r["site"], r["n"]): r for r in df.collect()}
    return {k: (None if r["embedding"] is None else [x if x is None else round(x, 9) for x in r["embedding"]], r["dim"], r["num_segments"]) for k, r in rows.items()}


@pytest.mark.parametrize("held", [embedding.POOL_BYTES, 1000])
def test_equals_pooling_by_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(embedding, "POOL_BYTES", held)
    df = frame(spark)
    got, want = found(embedding.mean_pool_matrices(df, "site", "n")), found(embedding.mean_pool(df, "site", "n"))
    # Vectors without entries have no mean in either form; an entry that is null in all vectors is 0 here.
    odd = [(23, "x"), (22, "x")]
    assert got[23, "x"][0] in (None, []) and want[23, "x"][0] in (None, [])
    assert got[22, "x"][0] == [2.0, 0.0] and want[22, "x"][0] == [2.0, None]
    assert {k: str(v) for k, v in got.items() if k not in odd} == {k: str(v) for k, v in want.items() if k not in odd}
    assert got[20, None] == ([2.0], 1, 2) and got[21, "x"] == (None, None, 2) and got[24, "y"] == (None, None, 0)


def test_empty(spark):
    assert embedding.mean_pool_matrices(frame(spark).limit(0), "site").count() == 0


def test_a_row_per_key_and_task_is_shuffled(spark):
    rows = spark.range(6400).selectExpr("id % 3 AS site", "transform(sequence(1, 1280), x -> double(x + id)) AS embedding").repartition(4)
    pooled = embedding.mean_pool_matrices(rows, "site")
    assert pooled.count() == 3
    types = [rows.schema["site"].dataType]
    fold = embedding._fold_sums(["site"], [embedding.to_arrow_type(t) for t in types], False)
    ready = rows.selectExpr("site", "1L AS _n", "embedding AS _vector")
    assert ready.mapInArrow(fold, ready.schema).count() == 12
    assert pooled._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
