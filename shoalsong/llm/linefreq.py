"""Quality rules: base rules per text, and cross-document line frequency per host.

Only DataFrame functions. Lines are normalised and hashed; a line is removed if
more than `min_docs` and more than `share` of the distinct texts of its host
hold it. A document that loses more than half of its words so is depleted and
rejected. Exact copies count once per host: a text that was merely copied does
not make its own lines frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalsong.llm.mixing import WHITE
from shoalsong.llm.tables import not_null_key, staged, unused

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCS, SHARE, MAX_LOST_PERCENT = 20, 0.05, 50


def _let(value: Column, use) -> Column:
    """use(value), with value computed once per row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array, first occurrences included.

    Windows are hashed first, and sorted with their places, so equal hashes are neighbours. Only those
    are spelled out and sorted again: words decide, so the count is exact.
    """
    def twice(windows: Column) -> Column:
        # Places of windows that equal a neighbour. Three views of them: one before, the same, one after.
        none = F.array(F.struct(F.lit(None).alias("w"), F.lit(-1).alias("i")))
        before, after = F.concat(none, windows), F.concat(F.slice(windows, 2, F.size(windows)), none)
        # zip_with fills the shorter side with null, which equals nothing.
        pairs = F.zip_with(windows, F.zip_with(before, after, lambda b, a: F.struct(b.w.alias("b"), a.w.alias("a"))),
                           lambda x, n: F.when((x.w == n.b) | (x.w == n.a), x.i))
        return F.array_compact(pairs)

    def hashed(parts: Column) -> Column:
        pairs = F.zip_with(parts, F.slice(parts, 2, F.size(parts)), lambda a, b: F.xxhash64(a, b))
        threes = F.zip_with(pairs, F.slice(parts, 3, F.size(parts)), lambda a, b: F.xxhash64(a, b))
        return F.slice(threes, 1, F.size(parts) - 2)

    def spelled(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("i"))

    def covered(places: Column) -> Column:
        exact = _let(F.sort_array(F.transform(places, spelled)), twice)
        return F.size(F.array_distinct(F.flatten(F.transform(exact, lambda i: F.array(i, i + 1, i + 2)))))

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, _let(_let(placed, twice), covered)).otherwise(F.lit(0))

    each = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(_let(each, hashed), counted)).cast("bigint")


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null text counts as empty."""
    (words,) = unused(docs, "_w")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " " + WHITE, "") != "")
    measured = docs.select(
        *docs.columns,
        F.length(F.translate(text, " " + WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _let(words_of(text), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias(words),
    ).select(*docs.columns, f"{words}.n_words", "word_chars", "n_symbols", "n_dup_lines", f"{words}.n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def hashed_lines(text: Column) -> Column:
    """Normalised lines with a word as (md5, words): lower case, digits as 0, white space as one space, trimmed."""
    plain = F.translate(F.lower(text), "123456789\t\x0b\x0c\r", "000000000    ")
    plain = F.when(plain.contains("  "), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)
    lines = F.filter(F.transform(F.split(plain, "\n"), F.trim), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(
        F.unhex(F.md5(x.cast("binary"))).alias("line"), F.size(F.split(x, " ")).alias("words")))


def depleted_texts(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE,
                   lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """(host_key, text_key, n_lost_words, n_all_words) of the distinct texts per host that hold frequent
    lines, with `depleted`: whether more than lost_percent of the words were in them."""
    rows = docs.where("text is not null").select(
        not_null_key(F.col(host)).alias("host_key"), text_key(F.col("text")).alias("text_key"),
        hashed_lines(F.col("text")).alias("lines"))
    texts = staged(rows.groupBy("host_key", "text_key").agg(F.first("lines").alias("lines")), "lines")
    hosts = texts.groupBy("host_key").agg(F.count(F.lit(1)).alias("n_texts"))
    distinct = F.array_distinct(F.transform("lines", lambda x: x.line))
    counts = texts.select("host_key", F.explode(distinct).alias("line")).groupBy("host_key", "line").agg(
        F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    frequent = counts.join(hosts, "host_key").where(F.col("n_docs") > share * F.col("n_texts"))
    frequent = staged(frequent.select("host_key", "line"), "frequent")
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x.words)
    held = texts.select("host_key", "text_key", total.alias("n_all_words"), F.explode("lines").alias("l"))
    held = held.select("host_key", "text_key", "n_all_words", F.col("l.line").alias("line"), F.col("l.words").alias("words"))
    lost = held.join(frequent, ["host_key", "line"], "left_semi").groupBy("host_key", "text_key").agg(
        F.sum("words").alias("n_lost_words"), F.max("n_all_words").alias("n_all_words"))
    return lost.withColumn("depleted", 100 * F.col("n_lost_words") > lost_percent * F.col("n_all_words"))


def quality_rules(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """`docs` (text, host, ...) with the base measures, n_lost_words, base_failed and kept.

    Words are runs of characters other than space and \\t to \\r. A null text is
    empty and fails the base rules; a null host is a host of its own; repeated
    rows count as one text for line frequency and are judged alike. Columns of
    `docs` that have the name of a result are replaced, all others stay. Texts
    are read whole. An empty table gives an empty result.
    """
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept")
    docs = docs.drop(*results)
    host_key, key, depleted = unused(docs, "_host", "_text", "depleted")
    lost = staged(depleted_texts(docs, host, **limits).select(
        F.col("host_key").alias(host_key), F.col("text_key").alias(key), "n_lost_words", F.col("depleted").alias(depleted)), "lost")
    keyed = base_rules(docs).withColumn(host_key, not_null_key(F.col(host))).withColumn(key, text_key(F.col("text")))
    judged = keyed.join(lost, [host_key, key], "left")
    kept = ~F.col("base_failed") & ~F.coalesce(depleted, F.lit(False))
    lost_words = F.coalesce("n_lost_words", F.lit(0)).cast("bigint")
    return judged.withColumn("n_lost_words", lost_words).withColumn("kept", kept).drop(host_key, key, depleted)
