"""Rare words have their own probability, not that of all words they share a number with."""

import numpy as np
import pytest

from shoalsong.llm import pll


@pytest.fixture(scope="module")
def corpus(spark):
    """2,000 words that occur 30 times each, and 40 documents of words that occur once."""
    rng = np.random.RandomState(5)
    known = rng.permutation(np.repeat(np.arange(2000), 30)).reshape(-1, 50)
    rows = [(i, " ".join(f"known{w}" for w in line)) for i, line in enumerate(known)]
    rows += [(10_000 + i, " ".join(f"once{i}x{k}" for k in range(50))) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def means(scored):
    return {r.doc_id: r.mean_log_prob for r in scored.collect()}


def test_words_that_occur_once_are_unlikely(corpus):
    found = means(pll.pseudo_likelihood(corpus))
    known = [v for k, v in found.items() if k < 10_000]
    once = [v for k, v in found.items() if k >= 10_000]
    assert len(once) == 40 and max(once) < min(known) - 1


def test_counts_joined_by_shuffle_score_alike(corpus, monkeypatch):
    whole = means(pll.pseudo_likelihood(corpus))
    for most in (0, 2010):
        monkeypatch.setattr(pll, "TABLE", most)
        parts = means(pll.pseudo_likelihood(corpus))
        assert parts.keys() == whole.keys() and all(abs(parts[k] - whole[k]) < 1e-3 for k in whole)


def test_numbers_grow_with_the_words():
    assert pll.classes_for(404_216) == 32 and pll.classes_for(5_000_000) == 48 and pll.classes_for(10**8) == 100
    numbers, sizes = pll.word_numbers(np.arange(5000), np.arange(5000)[::-1] + 1, 48)
    assert (numbers[: 48 * 48 - pll.RARE] == np.arange(48 * 48 - pll.RARE)).all() and sizes.sum() == 5000 * 5001 / 2
