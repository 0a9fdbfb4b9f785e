"""Tables whose further columns have the names that operators use inside."""

import pytest

from shoalsong.llm import linefreq, minhash, mixing

NAMES = ["_copies", "_n", "_id", "_key", "_size", "_own_key", "_own_size", "_copy", "_text_key", "_w", "_host", "_text",
         "_TEXT_", "depleted", "_none", "digest", "key", "size", "taken", "block", "begin", "lines"]
WORDS = " ".join(f"w{i}" for i in range(80))
ROWS = [(1, WORDS, "a"), (2, WORDS, "a"), (3, WORDS + " end", None), (4, None, "b"), (5, "", "b"), (6, "one two", "a"), (1, WORDS, "a")]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame(
        [(*row, *NAMES) for row in ROWS],
        "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))


def of(df, *columns):
    return sorted(map(str, df.select("doc_id", "text", "source", *columns).collect()))


@pytest.mark.parametrize("operator, results", [
    (minhash.without_duplicates, []),
    (mixing.mixed_documents, []),
    (linefreq.quality_rules, ["n_words", "n_repeat_words", "n_lost_words", "base_failed", "kept"]),
])
def test_other_columns_may_have_any_name(plain, clashing, operator, results):
    out = operator(clashing)
    assert out.columns == clashing.columns + [c for c in out.columns if c not in clashing.columns]
    assert all(row[name] == name for row in out.collect() for name in NAMES)
    assert of(out, *results) == of(operator(plain), *results)


def test_a_schedule_of_many_stretches(spark, monkeypatch):
    sources = spark.createDataFrame([("a", "=a", 0, 90.0), ("b", "=b", 1, 41.0), ("c", "=c", 2, 0.0)],
                                    "source string, key string, rank bigint, target double")
    whole = sorted(mixing.schedule(sources, 1).collect())
    monkeypatch.setattr(mixing, "STRETCH", 7)
    assert sorted(mixing.schedule(sources, 1).collect()) == whole
    assert [row.slot for row in whole] == list(range(131))
