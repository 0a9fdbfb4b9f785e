"""Masked pseudo-likelihood of documents by a bidirectional window network.

The network predicts every word from the REACH words on either side of it, the
word itself masked: embeddings by offset are added, pass through tanh, and a
two-level softmax gives the class of the word and the word within its class. A
document's score is the sum of the log-probabilities of all its words.

All distinct words of the corpus are counted. The network knows numbers: words
are hashed into buckets, the buckets counted most often have a number of their
own, the rest share some, and there are more numbers the more distinct words the
corpus has. A word has its share of the probability of its number, its count
over that of all words with the number, so the probabilities of all counted
words add up to one and a rare word is as unlikely as it is rare. Training is data-parallel:
each task passes once over all its documents from the same start, and the
networks are averaged, weighted by words. So the model, the counts and what is
gathered for them follow the whole corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalsong.llm import words
from shoalsong.llm.tables import staged

REACH, DIM = 2, 16
#: Least classes, and numbers then; see `classes_for`.
CLASSES = 32
SIZE = CLASSES * CLASSES
RARE = 64
BUCKETS = 1 << 16
BATCH, RATE = 4096, 0.1
#: Words scored at once; pieces in which weights are averaged.
STEP, PARTS = 16384, 16
#: Words counted at once in a task; most counts sent to all tasks, those of other words are joined by shuffle.
COUNTED, TABLE = 1 << 21, 1 << 20


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the 64-bit hash of each distinct word and how often it is there."""
    def sums(held: list[np.ndarray]) -> pa.RecordBatch:
        there, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(there.view(np.int64)), pa.array(n)], ["word", "n"])

    def run(batches):
        hasher, held, size = words.Hasher(), [], 0
        for batch in batches:
            for _, starts, ends, data in words.pieces(batch.column("text")):
                held.append(hasher(starts, ends, data))
                size += len(held[-1])
                if size >= COUNTED:
                    yield sums(held)
                    held, size = [], 0
        if size:
            yield sums(held)

    sent = docs.select("text").mapInArrow(run, "word bigint, n bigint")
    return sent.groupBy("word").agg(F.sum("n").alias("n"))


def by_bucket(counts: DataFrame) -> DataFrame:
    """(bucket, n, words): words and distinct words per bucket."""
    bucket = F.shiftrightunsigned("word", 48).alias("bucket")
    return counts.groupBy(bucket).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): words per bucket over all documents."""
    return by_bucket(word_counts(docs)).select("bucket", "n")


def classes_for(distinct: int) -> int:
    """Classes, and words of a class: their product grows as the root of the distinct words."""
    return max(CLASSES, int(np.ceil(distinct**0.25)))


def word_numbers(bucket: np.ndarray, n: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Number of each bucket, the most frequent by rank, the others share the last RARE; and words per number."""
    own = classes * classes - RARE
    top = bucket[np.lexsort((bucket, -n))][:own]
    numbers = own + np.arange(BUCKETS) % RARE
    numbers[top] = np.arange(len(top))
    return numbers.astype(np.int32), np.bincount(numbers[bucket], weights=n, minlength=own + RARE)


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """(hashes in order, logarithms of their counts) of the at most `most` words counted most often,
    and the counts of the others, if there are any."""
    level = F.floor(F.log("n") * 8)
    sizes = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    fits = np.cumsum([n for _, n in sizes]) <= most
    lowest = [at for at, _ in sizes][int(fits.sum()) - 1] if fits.any() else 1 << 30
    table = counts.where(level >= lowest).select("word", "n").toArrow()
    hashes = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    logs = np.log(table.column("n").to_numpy()[order].astype(np.float64))
    return hashes[order], logs, None if fits.all() else counts.where(level < lowest)


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    return {"context": (2 * REACH, classes * classes + 1, DIM), "bias": (DIM,), "to_class": (DIM, classes),
            "class_bias": (classes,), "to_word": (classes, DIM, classes), "word_bias": (classes, classes)}


def initial(seed: int = 3, classes: int = CLASSES) -> dict[str, np.ndarray]:
    rng = np.random.RandomState(seed)
    scale = {"context": 0.1, "to_class": 0.1, "to_word": 0.1}
    return {k: (rng.randn(*s) * scale.get(k, 0)).astype(np.float32) for k, s in shapes(classes).items()}


def classes_of(net: dict[str, np.ndarray]) -> int:
    return len(net["class_bias"])


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in shapes(classes_of(net))])


def shaped(weights: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(classes).items():
        out[k] = weights[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def _softmax(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of the targets, all probabilities)."""
    x -= x.max(axis=1, keepdims=True)
    at_target = x[np.arange(len(x)), target]
    np.exp(x, out=x)
    total = x.sum(axis=1, keepdims=True)
    x /= total
    return at_target - np.log(total[:, 0]), x


def forward(net, around: np.ndarray, target: np.ndarray):
    """Log-probability of each target word, and what the gradients need."""
    classes = classes_of(net)
    total = net["bias"] + sum(net["context"][o][around[:, o]] for o in range(2 * REACH))
    hidden = np.tanh(total)
    group, place = target // classes, target % classes
    log_prob, by_class = _softmax(hidden @ net["to_class"] + net["class_bias"], group)
    by_word = np.empty((len(target), classes), hidden.dtype)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(classes + 1))
    for c in range(classes):
        at = order[bounds[c] : bounds[c + 1]]
        if len(at):
            inside, by_word[at] = _softmax(hidden[at] @ net["to_word"][c] + net["word_bias"][c], place[at])
            log_prob[at] += inside
    return log_prob, (hidden, group, place, by_class, by_word, order, bounds)


def gradients(net, around: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log-probability."""
    _, (hidden, group, place, by_class, by_word, order, bounds) = forward(net, around, target)
    rows, n = np.arange(len(target)), np.float32(len(target))
    at_class, at_word = -by_class, -by_word
    at_class[rows, group] += 1
    at_word[rows, place] += 1
    at_class /= n
    at_word /= n
    back = at_class @ net["to_class"].T
    to_word, word_bias = np.zeros_like(net["to_word"]), np.zeros_like(net["word_bias"])
    for c in range(classes_of(net)):
        at = order[bounds[c] : bounds[c + 1]]
        if len(at):
            to_word[c], word_bias[c] = hidden[at].T @ at_word[at], at_word[at].sum(axis=0)
            back[at] += at_word[at] @ net["to_word"][c].T
    back *= 1 - hidden * hidden
    context = np.empty_like(net["context"])
    for o in range(2 * REACH):
        for k in range(DIM):
            context[o, :, k] = np.bincount(around[:, o], weights=back[:, k], minlength=context.shape[1])
    return {"context": context, "bias": back.sum(axis=0), "to_class": hidden.T @ at_class,
            "class_bias": at_class.sum(axis=0), "to_word": to_word, "word_bias": word_bias}


def windows(numbers: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of documents in a row with REACH empty places (number `size`) between them, and the places of the words."""
    gap = np.full(REACH, size, np.int32)
    out = np.concatenate([gap, *(x for doc in numbers for x in (doc, gap))])
    return out, np.flatnonzero(out < size)


OFFSETS = np.array([*range(-REACH, 0), *range(1, REACH + 1)])


def groups(column: pa.Array, hasher, size: int):
    """Yields (rows, hashes): documents of about `size` words in all, each whole."""
    rows, docs, held = [], [], 0
    for row, hashes in words.row_hashes(column, hasher):
        rows.append(row)
        docs.append(hashes)
        held += len(hashes)
        if held >= size:
            yield rows, docs
            rows, docs, held = [], [], 0
    if rows:
        yield rows, docs


def numbered(docs: list[np.ndarray], numbers: np.ndarray) -> list[np.ndarray]:
    return [numbers[(hashes >> np.uint64(48)).astype(np.int64)] for hashes in docs]


def learn(net, places: np.ndarray, line: np.ndarray, squares, rng) -> None:
    """One pass over the words at `places`, in random order, by Adagrad."""
    places = rng.permutation(places)
    for i in range(0, len(places), BATCH):
        at = places[i : i + BATCH]
        grads = gradients(net, line[at[:, None] + OFFSETS], line[at])
        for k, g in grads.items():
            squares[k] += g * g
            net[k] += RATE * g / (np.sqrt(squares[k]) + 1e-8)


def train(docs: DataFrame, numbers: np.ndarray, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The average of the networks that the tasks train on all their documents."""
    start = initial() if start is None else start
    shared = docs.sparkSession.sparkContext.broadcast((numbers, start))

    def run(batches):
        numbers, net = shared.value[0], {k: v.copy() for k, v in shared.value[1].items()}
        squares = {k: np.full(v.shape, 1e-6, np.float32) for k, v in net.items()}
        rng, hasher, seen = np.random.RandomState(0), words.Hasher(), 0
        for batch in batches:
            for _, found in groups(batch.column("text"), hasher, 1 << 18):
                line, places = windows(numbered(found, numbers), classes_of(net) ** 2)
                learn(net, places, line, squares, rng)
                seen += len(places)
        if seen:
            parts = np.array_split(flat(net), PARTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(PARTS)), pa.array(np.full(PARTS, seen)), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["part", "n", "weights"])

    def average(batches):
        # Sums of what this task holds; one row per part leaves it.
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            for part, n, weights in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(weights, np.float32).astype(np.float64) * n
                sums[part] = sums.get(part, 0) + values
                counts[part] = counts.get(part, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array(list(counts.values()), pa.int64()),
             pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "n", "total"])

    sent = docs.select("text").mapInArrow(run, "part bigint, n bigint, weights binary")
    found = sent.repartition(PARTS, "part").mapInArrow(average, "part bigint, n bigint, total binary").collect()
    found = sorted(found, key=lambda r: r["part"])
    if not found:
        return start
    return shaped(np.concatenate([np.frombuffer(r["total"], np.float64) / r["n"] for r in found]), classes_of(start))


def score(docs: DataFrame, counts: DataFrame, numbers: np.ndarray, sizes: np.ndarray, net: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) per row of `docs` (doc_id, text).

    `counts` are the words of the corpus, `sizes` the words per number. A document
    without words has 0 tokens, log_prob 0 and a null mean. Texts are
    scored whole; windows don't reach beyond the text. Repeated rows and null
    ids are rows like any other; other columns are ignored.
    """
    hashes, logs, others = frequent_words(counts, TABLE)
    shared = docs.sparkSession.sparkContext.broadcast((numbers, net, hashes, logs, np.log(np.maximum(sizes, 1))))

    def run(batches):
        (numbers, net, known, logs, of_number), hasher = shared.value, words.Hasher()
        for batch in batches:
            count, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            rare: list = [None] * batch.num_rows
            for rows, docs in groups(batch.column("text"), hasher, STEP):
                found = numbered(docs, numbers)
                line, places = windows(found, classes_of(net) ** 2)
                lengths = np.array([len(x) for x in found])
                log_prob = np.concatenate([
                    forward(net, line[at[:, None] + OFFSETS], line[at])[0]
                    for at in np.array_split(places, max(1, len(places) // STEP))]).astype(np.float64)
                log_prob -= of_number[line[places]]
                every = np.concatenate(docs)
                there = np.zeros(len(every), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, every), len(known) - 1)
                    there = known[at] == every
                    log_prob[there] += logs[at[there]]
                begin = np.cumsum(lengths) - lengths
                count[rows], total[rows] = lengths, np.add.reduceat(log_prob, begin)
                for row, first, last in zip(rows, begin, begin + lengths):
                    missing = every[first:last][~there[first:last]]
                    rare[row] = missing.tobytes() if len(missing) else None
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(total), pa.array(rare, pa.binary())],
                                             ["doc_id", "n_tokens", "log_prob", "rare"])

    def unpack(batches):
        for batch in batches:
            data = batch.column("rare").to_pylist()
            row = batch.column("row").to_numpy().repeat([len(x) // 8 for x in data])
            word = np.frombuffer(b"".join(data), np.int64)
            for i in range(0, len(word), COUNTED):
                yield pa.RecordBatch.from_arrays([pa.array(row[i : i + COUNTED]), pa.array(word[i : i + COUNTED])], ["row", "word"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, log_prob double, rare binary")
    if others is not None:
        scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        apart = scored.where("rare is not null").select("row", "rare").mapInArrow(unpack, "row bigint, word bigint")
        added = apart.join(others, "word").groupBy("row").agg(F.sum(F.log("n")).alias("added"))
        scored = scored.join(added, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("added", F.lit(0.0)))
    return scored.select("doc_id", "n_tokens", "log_prob").withColumn("mean_log_prob", F.try_divide("log_prob", "n_tokens"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Trains on all documents and scores them all; see `score`."""
    counts = staged(word_counts(docs), "words")
    rows = by_bucket(counts).collect()
    bucket, n, distinct = (np.array([r[c] for r in rows], np.int64) for c in ("bucket", "n", "words"))
    classes = classes_for(int(distinct.sum()))
    numbers, sizes = word_numbers(bucket, n, classes)
    return score(docs, counts, numbers, sizes, train(docs, numbers, initial(classes=classes)))
