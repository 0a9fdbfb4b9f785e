"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalsong.llm import (
    bpe, chat, embeddings, extract, fim, lexical, linefreq, minhash, mixing, pll, token_files, toxicity, warc)
from shoalsong.llm.oracle import ORACLE  # noqa: F401
from shoalsong.llm.tables import load
from shoalsong.sources.workspace import new_folder


def _page(record_id):
    return F.regexp_extract(record_id, r"(-?[0-9]+)$", 1).try_cast("bigint")


def op1_warc(spark, sf_dir):
    index = warc.write_archives(load(spark, sf_dir, "pages"), min_bytes=0)
    found = warc.read_records(index, payloads=False)
    return found.select(_page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        _page(F.col("refers_to")).alias("refers_to"), "url")


def op2_perspectives(spark, sf_dir):
    return chat.perspectives(load(spark, sf_dir, "conversations"))


def op3_line_frequency(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linefreq.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lost_words")


def op4_suffix_array(spark, sf_dir):
    found = extract.main_texts(load(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op5_metric_join(spark, sf_dir):
    return embeddings.near_duplicate_vectors(load(spark, sf_dir, "embeddings"), min_cosine=0.9)


def op6_minhash(spark, sf_dir):
    found = minhash.near_duplicates(load(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def op7_bpe(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, vocabulary(), decoded=True))


def op8_mixing(spark, sf_dir):
    placed, mix = mixing.mixture(load(spark, sf_dir, "documents"))
    return mixing.taken_words(placed, mix).select("doc_id", "size", "source_size", "target", "taken")


def op9_pseudo_likelihood(spark, sf_dir):
    return pll.pseudo_likelihood(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_orc_tokens(spark, sf_dir):
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    token_files.write_token_files(
        load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.digests(token_files.read_token_files(spark, folder))


def op12_fill_in_middle(spark, sf_dir):
    return fim.digests(fim.fill_in_middle(load(spark, sf_dir, "documents")))


def op13_lexical_search(spark, sf_dir):
    return lexical.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_perspectives": op2_perspectives,
    "op3_line_frequency": op3_line_frequency,
    "op4_suffix_array": op4_suffix_array,
    "op5_metric_join": op5_metric_join,
    "op6_minhash": op6_minhash,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_pseudo_likelihood": op9_pseudo_likelihood,
    "op10_toxicity": op10_toxicity,
    "op11_orc_tokens": op11_orc_tokens,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lexical_search": op13_lexical_search,
}
