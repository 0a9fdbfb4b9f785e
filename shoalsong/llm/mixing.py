"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source is a stream: its documents in shuffled order, repeated up to the
limit of repeats. The stream is cut into blocks of equal numbers of words and
the source owns as many slots of the schedule as it has blocks up to its
target. Slots are the points of the golden-ratio lattice: slot i has the point
(i * g mod M) / M, g the whole number nearest to M / golden ratio that is
coprime with M. Its source is the one in whose stretch of the cumulative
weights the point lies. So every source gets its exact number of slots, spread
evenly over the schedule; the k-th slot of a source, in order of time, takes
its k-th block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalsong.llm.tables import broadcast_if_small, not_null_key, partitions, running_total, staged, unused

WHITE = "\t\n\x0b\x0c\r"
BLOCK_WORDS = 4096
# Points of the lattice that one row unfolds into.
STRETCH = 1 << 16
MAX_REPEATS = 3
CYCLE = (1, 2, 3)


def word_count(text):
    """Runs of characters other than space and \\t to \\r; null counts 0."""
    plain = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("bigint")


def source_targets(sizes: DataFrame, cycle=CYCLE, repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source (source, key, source_size, weight, target) from rows (source, key, size).

    Weights repeat `cycle` over the sources by code point, null last. A target
    is weight * level, or repeats * source_size where that is less; the level
    is the one at which targets add up to all sizes. Only sums reach the driver.
    """
    sources = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = sources.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1))
    ranked = running_total(sources, [], ["_null", "source"], "_one", "rank")
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int"))
    ranked = staged(ranked.select("source", "key", "rank", "source_size", weight.alias("weight")), "sources")
    most = F.col("source_size") * repeats
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return ranked.withColumn("target", F.lit(0.0))
    level = total / weights
    while True:
        below = most < F.lit(level) * F.col("weight")
        full, weights = ranked.agg(
            F.coalesce(F.sum(F.when(below, most)), F.lit(0)), F.sum(F.when(~below, F.col("weight")))).first()
        if not weights or (total - full) / weights <= level:
            break
        level = (total - full) / weights
    # No source is above its limit at this level, so the smaller value is the target.
    return ranked.withColumn("target", F.least(most.cast("double"), F.lit(level) * F.col("weight")))


def _step(slots: int) -> tuple[int, int]:
    """The lattice step g for this many slots, and its inverse."""
    g = max(1, round(slots / ((1 + math.sqrt(5)) / 2)))
    while math.gcd(g, slots) != 1:
        g += 1
    return g % max(slots, 1), pow(g, -1, slots) if slots > 1 else 0


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (slot, key, block): which block of which source each slot of the schedule takes.

    A source has one row for every `STRETCH` of its points, and these rows are dealt to
    all tasks, so neither a task nor an array holds the slots of a whole source.
    """
    quotas = sources.withColumn("words", F.floor(F.col("target") + 0.5).cast("bigint"))
    quotas = quotas.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("bigint"))
    quotas = running_total(quotas, [], ["rank"], "blocks", "begin")
    quotas = staged(quotas.where("blocks > 0"), "quotas")
    slots = quotas.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    _, inverse = _step(slots) if slots else (0, 0)
    end = F.col("begin") + F.col("blocks") - 1
    stretches = quotas.select("key", end.alias("end"), F.explode(F.sequence("begin", end, F.lit(STRETCH).cast("bigint"))).alias("low"))
    stretches = stretches.repartition(partitions(sources.sparkSession))
    high = F.least("end", F.col("low") + (STRETCH - 1))
    points = stretches.select("key", F.explode(F.sequence("low", high)).alias("point"))
    product = F.col("point").cast("decimal(19,0)") * F.lit(inverse).cast("decimal(19,0)")
    times = points.select("key", F.pmod(product, F.lit(max(slots, 1)).cast("decimal(19,0)")).cast("bigint").alias("slot"))
    return running_total(times.withColumn("_one", F.lit(1)), ["key"], ["slot"], "_one", "block").select("slot", "key", "block")


def mixture(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, cycle=CYCLE, repeats: int = MAX_REPEATS):
    """The documents with their places, and the mix: (placed, mix).

    placed: (doc_id, source, key, size, begin, source_size, target), a row per
    document; `begin` is its place in the shuffled stream of its source.
    mix: (slot, block, key, begin, from_word, n_words): the pieces of documents
    that each slot of the schedule takes, words from_word to from_word + n_words.

    The order within a source is that of md5(seed, doc_id), so reruns agree. A
    source's taken words are its target rounded to a whole word. Null sources
    are a source of their own; documents without words (null, empty) have size
    0 and are never taken; rows with equal doc_id are documents of their own. An
    empty table gives empty results. Other columns are ignored.
    """
    sizes = staged(docs.select("doc_id", "source", not_null_key(F.col("source")).alias("key"),
                               word_count(F.col("text")).alias("size")), "sizes")
    sources = staged(source_targets(sizes, cycle, repeats), "targets")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    placed = running_total(sizes.withColumn("order", order), ["key"], ["order", "doc_id", "size"], "size", "begin")
    placed = placed.join(sources.select("key", "source_size", "target"), "key")
    placed = staged(placed.select("doc_id", "source", "key", "size", "begin", "source_size", "target"), "placed")

    words = F.floor(F.col("target") + 0.5).cast("bigint")
    taken = placed.where("size > 0").select(
        "key", "begin", "size", words.alias("words"), F.col("source_size"),
        F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("round"))
    taken = taken.withColumn("first", F.col("round") * F.col("source_size") + F.col("begin"))
    taken = taken.withColumn("last", F.least(F.col("first") + F.col("size"), F.col("words"))).where("first < last")
    block = F.explode(F.sequence(F.expr(f"first div {block_words}"), F.expr(f"(last - 1) div {block_words}")))
    pieces = taken.withColumn("block", block)
    low, high = F.greatest("first", F.col("block") * block_words), F.least("last", (F.col("block") + 1) * block_words)
    pieces = pieces.select("key", "block", "begin", (low - F.col("first")).alias("from_word"), (high - low).alias("n_words"))
    mix = pieces.join(schedule(sources, block_words), ["key", "block"])
    return placed, mix.select("slot", "block", "key", "begin", "from_word", "n_words")


def taken_words(placed: DataFrame, mix: DataFrame) -> DataFrame:
    """`placed` with `taken`: the words that the mix takes of each document, repeats counted."""
    sums = mix.groupBy("key", "begin").agg(F.sum("n_words").alias("_taken"))
    has = placed.where("size > 0").join(sums, ["key", "begin"], "left")
    rest = placed.where("size = 0").withColumn("_taken", F.lit(0).cast("bigint"))
    return has.unionByName(rest).withColumn("taken", F.coalesce("_taken", F.lit(0))).drop("_taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` (doc_id, source, text, ...) as often as the mix takes them, all their columns.

    A row comes taken / size times, rounded: as only the document at the end of
    a source's target is taken in part, that keeps to the targets. Rows with
    equal doc_id, source and size share what is taken of them evenly. Other
    columns may have any name. An empty table gives an empty result.
    """
    of_id, of_key, of_size, copies, key, size, copy = unused(
        docs, "_id", "_key", "_size", "_copies", "_own_key", "_own_size", "_copy")
    taken = taken_words(*mixture(docs, **options)).where("size > 0")
    taken = taken.groupBy(F.col("doc_id").alias(of_id), F.col("key").alias(of_key), F.col("size").alias(of_size)).agg(
        F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias(copies)).where(F.col(copies) > 0)
    taken = staged(taken, "taken")
    keyed = docs.withColumn(key, not_null_key(F.col("source"))).withColumn(size, word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)) & (F.col(size) == F.col(of_size))
    joined = keyed.join(broadcast_if_small(taken), same)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
