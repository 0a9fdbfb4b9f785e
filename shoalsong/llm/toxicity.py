"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams, a document the mean
of its distinct words (distinct in each piece of 256 KB, so that repeated junk
weighs little), and a linear softmax gives it a margin of class 1 over class 0.
Vectors and softmax are trained jointly in numpy by minibatch Adam. A misspelling
nobody saw shares most n-grams with the word it stands for, and so its vector.

Training sees a bounded sample of the labelled rows (MAX_ROWS, MAX_BYTES), as
many of one class as of the other if there are; the bias then gives the classes
back their shares.
Scoring covers every whole text: as all means are linear, the trained model is
one number per n-gram bucket, which each task averages over its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalsong.llm import words

SIZES = (3, 4, 5, 6)
BITS = 20
DIM = 8
#: The training sample: at most so many labelled rows, half of each class, and bytes of text.
MAX_ROWS, MAX_BYTES = 4000, 8 << 20
#: Texts longer than this many times MAX_BYTES / MAX_ROWS (33 KB) are taken only after all shorter ones.
LONG = 16
EPOCHS, BATCH, RATE, SHRINK = 20, 64, 0.02, 1e-3
#: Only buckets are learned whose shares of the texts of either class differ by so many standard
#: errors, so no text is learned by heart.
MIN_ERRORS = 4.0
#: Fixed factor of the averages: a mean over thousands of n-grams moves little when some of them do.
GAIN = 2000.0
#: Labels are learned only from documents whose crc32(doc_id) leaves a remainder other than 0.
FOLDS = 5

_random = np.random.RandomState(11)
PLACES = _random.randint(0, 2**32, (max(SIZES), 256), dtype=np.uint64).astype(np.uint32)
SALTS = _random.randint(0, 2**32, 8, dtype=np.uint64).astype(np.uint32)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text is divisible by FOLDS; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def gram_buckets(data: np.ndarray):
    """Yields (n, bucket of the n-gram that begins at each byte)."""
    total = PLACES[0][data]
    for i in range(1, max(SIZES)):
        total = total[:-1] + PLACES[i][data[i:]] if len(total) > 1 else total[:0]
        if i + 1 in SIZES:
            mixed = (total ^ SALTS[i]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            yield i + 1, (mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)


def word_grams(rows, starts, ends, data):
    """Yields (buckets of all n-grams of one length, first and last + 1 of each word among them)."""
    for n, buckets in gram_buckets(data):
        low = np.minimum(starts - 1, len(buckets))
        yield buckets, low, np.maximum(ends + 2 - n, low)


def distinct_words(column: pa.Array, hasher: words.Hasher):
    """Yields (rows, starts, ends, data) as words.pieces does, each word once per row of a piece."""
    for rows, starts, ends, data in words.pieces(column):
        if len(rows):
            keys = words.mixed(hasher(starts, ends, data) + rows.astype(np.uint64) * words.BASE)
            first = np.sort(np.unique(keys, return_index=True)[1])
            yield rows[first], starts[first], ends[first], data


def margins(column: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Margin per row; a row without words has the bias."""
    totals, count = np.zeros(len(column)), np.zeros(len(column))
    for rows, starts, ends, data in distinct_words(column, words.Hasher()):
        sums, sizes = np.zeros(len(rows)), np.zeros(len(rows))
        for buckets, low, high in word_grams(rows, starts, ends, data):
            upto = np.zeros(len(buckets) + 1)
            np.cumsum(table[buckets], out=upto[1:])
            sums += upto[high] - upto[low]
            sizes += high - low
        first = rows[0]
        part = np.bincount(rows - first, weights=sums / sizes)
        totals[first : first + len(part)] += part
        count[first : first + len(part)] += np.bincount(rows - first)
    return GAIN * totals / np.maximum(count, 1) + bias


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as sparse rows (begin of each row, buckets, weights): an n-gram weighs
    its share of its word, a word its share of its text."""
    begin, buckets, weights = [0], [], []
    hasher = words.Hasher()
    for i in range(len(texts)):
        ids, shares, n = [np.empty(0, np.uint32)], [np.empty(0)], 0
        for rows, starts, ends, data in distinct_words(texts.slice(i, 1), hasher):
            found = list(word_grams(rows, starts, ends, data))
            sizes = np.maximum(sum(high - low for _, low, high in found), 1)
            for part, low, high in found:
                count = high - low
                ids.append(part[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())])
                shares.append(np.repeat(1 / sizes, count))
            n += len(rows)
        there, at = np.unique(np.concatenate(ids), return_inverse=True)
        buckets.append(there.astype(np.int32))
        weights.append((np.bincount(at, weights=np.concatenate(shares), minlength=len(there)) / max(n, 1)).astype(np.float32))
        begin.append(begin[-1] + len(there))
    return (np.array(begin), np.concatenate([np.empty(0, np.int32), *buckets]),
            np.concatenate([np.empty(0, np.float32), *weights]))


def differing(begin: np.ndarray, buckets: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """By how many standard errors the share of texts with a bucket differs between the classes."""
    ones, rows = labels.sum(), max(len(labels), 1)
    zeros = rows - ones
    both = np.bincount(buckets, minlength=1 << BITS)
    one = np.bincount(buckets[np.repeat(labels > 0, np.diff(begin))], minlength=1 << BITS)
    share = both / rows
    error = np.sqrt(np.maximum(share * (1 - share), 0.25 / rows) * (1 / max(ones, 1) + 1 / max(zeros, 1)))
    return np.abs(one / max(ones, 1) - (both - one) / max(zeros, 1)) / error


def train(texts: pa.Array, labels: np.ndarray, rate: float | None = None, seed: int = 1) -> tuple[np.ndarray, float]:
    """(margin of each bucket, bias) of the jointly trained vectors and softmax.

    `rate` is the share of class 1 among all labelled rows, by default among
    these. Without rows of both classes nothing is learned but the rate.
    """
    rng = np.random.RandomState(seed)
    begin, buckets, weights = bags(texts)
    common = np.flatnonzero(differing(begin, buckets, labels) >= MIN_ERRORS)
    number = np.full(1 << BITS, -1, np.int32)
    number[common] = np.arange(len(common))
    known = number[buckets] >= 0
    begin = np.r_[0, np.cumsum(known)][begin]
    buckets, weights = number[buckets[known]], GAIN * weights[known]
    present = np.flatnonzero(np.diff(begin))
    here = float(np.clip(labels.mean(), 0.001, 0.999)) if len(labels) else 0.001
    rate = here if rate is None else float(np.clip(rate, 0.001, 0.999))
    params = [(rng.randn(len(common), DIM) * 0.01).astype(np.float32), (rng.randn(DIM, 2) * 0.5).astype(np.float32),
              np.array([0.0, np.log(here / (1 - here))], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS if 0 < labels.sum() < len(labels) else 0):
        for docs in np.array_split(rng.permutation(present), max(1, len(present) // BATCH)):
            step += 1
            grads = _gradients(docs, begin, buckets, weights, labels, *params)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    vectors, softmax, bias = params
    table = np.zeros(1 << BITS, np.float32)
    table[common] = vectors @ (softmax[:, 1] - softmax[:, 0])
    shift = np.log(rate / (1 - rate)) - np.log(here / (1 - here))
    return table, float(bias[1] - bias[0] + shift)


def _gradients(docs, begin, buckets, weights, labels, vectors, softmax, bias):
    sizes = begin[docs + 1] - begin[docs]
    starts = np.cumsum(sizes) - sizes
    places = np.repeat(begin[docs] - starts, sizes) + np.arange(sizes.sum())
    grams, weight = buckets[places], weights[places]
    mean = np.add.reduceat(vectors[grams] * weight[:, None], starts, axis=0)
    direction = softmax[:, 1] - softmax[:, 0]
    margin = mean @ direction + (bias[1] - bias[0])
    error = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[docs]) / len(docs)).astype(np.float32)
    per_gram = np.bincount(grams, weights=weight * np.repeat(error, sizes), minlength=len(vectors))
    to_softmax, total = mean.T @ error, float(error.sum())
    return (per_gram.astype(np.float32)[:, None] * direction + SHRINK * vectors,
            np.stack([-to_softmax, to_softmax], axis=1), np.array([-total, total], np.float32))


def fitting(toxic: np.ndarray, sizes: np.ndarray, max_bytes: int) -> np.ndarray:
    """Places of the rows, taken in order, that fit into the bytes: half of them are for each class,
    and what one class leaves is for the other. A row that doesn't fit is passed over alone."""
    out: list[int] = []
    left = max_bytes
    for turn, c in enumerate(sorted((0, 1), key=lambda c: sizes[toxic == c].sum())):
        room = left if turn else max_bytes // 2
        for i in np.flatnonzero(toxic == c):
            if sizes[i] <= room:
                room, left = room - int(sizes[i]), left - int(sizes[i])
                out.append(int(i))
    return np.array(sorted(out), np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int):
    """(texts, labels, rate) of the sample: of each class the labelled rows with the smallest
    md5 of doc_id, held-out ones left out, as many as the bounds allow.

    Texts of more than LONG times their share of the bytes come after all others, by their
    length in doublings, so a few long ones cannot fill the sample. Equal rows count once.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.md5(F.col("doc_id").cast("string").cast("binary")).alias("order")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    share = LONG * max_bytes / max(max_rows, 1)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / share))).alias("level")
    rows = docs.select("doc_id", size.alias("n"), F.xxhash64("text").alias("hash")).where(F.col("n") <= max_bytes)
    rows = rows.join(known, "doc_id").select("toxic", F.coalesce(level, F.lit(0)).alias("level"), order, "hash", "n").distinct()
    chosen = [rows.where(F.col("toxic") == c).orderBy("level", "order", "hash").limit(max_rows // 2).collect() for c in (0, 1)]
    chosen = [r for part in chosen for r in part]
    taken = fitting(np.array([r["toxic"] for r in chosen], np.int64), np.array([r["n"] for r in chosen], np.int64), max_bytes)
    taken = docs.sparkSession.createDataFrame(
        [(chosen[i]["order"], chosen[i]["hash"], chosen[i]["toxic"]) for i in taken], "order string, hash bigint, toxic int")
    found = docs.select(order, F.xxhash64("text").alias("hash"), "text").join(F.broadcast(taken), ["order", "hash"])
    found = found.dropDuplicates(["order", "hash"]).select("order", "toxic", "text").orderBy("order", "text")
    table = found.toArrow().combine_chunks()
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    return texts, table.column("toxic").to_numpy().astype(np.float64), rate


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES):
    return train(*training_rows(docs, labels, max_rows, max_bytes))


def toxicity_scores(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """`docs` with `score`, the probability of being toxic, and `predicted`, 1 from 0.5 on.

    Only the text is an input. A null, empty or blank text has the score of the
    bias alone; very long texts are scored whole, in pieces. Rows are scored one
    by one, so repeated rows and null ids are no special cases; columns named
    score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            margin = margins(batch.column("text"), *shared.value)
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    scored = docs.mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
