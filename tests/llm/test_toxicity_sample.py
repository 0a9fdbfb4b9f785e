"""Long labelled texts cost the training sample no other rows."""

import hashlib
import zlib

import numpy as np

from shoalsong.llm import toxicity


def ids_by_order(n):
    return sorted((i for i in range(n) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).digest())


def frames(spark, texts):
    rows = list(texts.items())
    labels = [(i, int(i % 3 == 0)) for i in texts]
    return (spark.createDataFrame(rows, "doc_id bigint, text string"),
            spark.createDataFrame(labels, "doc_id bigint, toxic int"))


def test_a_text_above_the_bound_costs_no_other_row(spark):
    ids = ids_by_order(300)
    texts = {i: f"plain words number {i} {'grobwort' if i % 3 == 0 else 'freundlich'}" for i in ids}
    texts[ids[0]] = "long " * (toxicity.MAX_BYTES // 5 + 1)
    found, labels, rate = toxicity.training_rows(*frames(spark, texts), toxicity.MAX_ROWS, toxicity.MAX_BYTES)
    assert len(found) == len(ids) - 1 and set(found.to_pylist()) == set(texts.values()) - {texts[ids[0]]}
    assert labels.sum() == sum(i % 3 == 0 for i in ids[1:])
    assert np.isclose(rate, np.mean([i % 3 == 0 for i in ids]))


def test_long_texts_come_after_the_others(spark):
    ids = ids_by_order(300)
    texts = {i: f"short {i}" for i in ids} | {i: f"{i} " + "x" * 6000 for i in ids[:8]}
    found, _, _ = toxicity.training_rows(*frames(spark, texts), 400, 20_000)
    assert {t for i, t in texts.items() if i in ids[8:]} <= set(found.to_pylist())
    assert sum(map(len, found.to_pylist())) <= 20_000 and any(len(t) > 6000 for t in found.to_pylist())


def test_only_rows_that_do_not_fit_are_passed_over():
    assert toxicity.fitting(np.array([0, 0, 0, 1, 1]), np.array([60, 30, 10, 10, 5]), 100).tolist() == [0, 2, 3, 4]
    assert toxicity.fitting(np.array([0, 0, 1, 1]), np.array([40, 20, 45, 200]), 100).tolist() == [0, 2]
