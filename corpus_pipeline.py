"""From raw documents to token ids: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoalsong.llm import bpe, linefreq, minhash, mixing, toxicity
from shoalsong.llm.queries import vocabulary
from shoalsong.llm.tables import load, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model gives a score below 0.5."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, model).where("predicted = 0").select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by the removal of frequent lines."""
    return linefreq.quality_rules(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles."""
    return minhash.without_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


#: Frequent words that the last stage broadcasts, and their bytes: a driver that has run the other stages
#: holds less than one that only encodes. All other words are joined by a shuffle.
HOT_WORDS, HOT_BYTES = 250_000, 8 << 20


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row per document in the mix."""
    encoded = bpe.encode(docs.select("doc_id", "text"), vocabulary(), HOT_WORDS, HOT_BYTES, decoded=True)
    return bpe.digests(encoded)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("near duplicates", drop_near_copies),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]

# Signatures, models and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
