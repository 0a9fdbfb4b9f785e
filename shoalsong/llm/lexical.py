"""Ranked lexical search: the best documents for each query text by the terms they share.

The documents' terms are counted once and kept as a small table of those that
occur in a query. Then every task takes blocks of documents. In a block, a term
has a bitmap of the documents that hold it. For a query, the bitmaps of its
terms give every document the mask of the terms it matches; documents of one
mask are a group, with the sum of its terms' highest parts as its highest
score. Groups are evaluated from the highest bound downwards until the next
bound lies below the lowest score that the task still keeps. Terms that cannot
reach that score even together need not be looked at in documents that hold no
other. So each task sends on as many rows per query as are asked for, whatever
it read, and the best of them are the best of all.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoalsong.llm.tables import running_total, staged

# Terms and weights.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FLAT = 50

#: Bytes of a term stay, A-Z as a-z; all others end it.
PLAIN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

TOP = 50
#: Terms of queries, repeats over queries counted, that one pass over the documents serves; documents of a block.
PASS_TERMS, BLOCK_DOCS = 100_000, 8192
#: Documents that are evaluated at once at least.
STEP = 256
#: Groups per query into which the rows of all tasks are dealt before the last ranking.
BUCKETS = 64

COUNTED = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"


def query_terms(items: DataFrame) -> DataFrame:
    """(key, item_id, terms) of the rows of `items` (item_id, text) that have terms; `key` is the row's own."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    found = items.select("item_id", terms.alias("terms")).where(F.size("terms") > 0)
    return found.select(F.monotonically_increasing_id().alias("key"), "item_id", "terms")


def counted_terms(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that have terms: how many, and those with a number, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        number = shared.value.get
        for batch in batches:
            ids, sizes, ends, terms, counts, held = [], [], [0], [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_py() or "").encode().translate(PLAIN).split()
                if not words:
                    continue
                found = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                term, count = np.unique(found[found >= 0], return_counts=True)
                held += len(term)
                ids.append(doc_id)
                sizes.append(len(words))
                ends.append(held)
                terms.append(term)
                counts.append(count.astype(np.int32))
            if ids:
                flat = [pa.array(np.concatenate(x)) for x in (terms, counts)]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in flat]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists],
                                                 ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, COUNTED)


def length_parts(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms."""
    if len(n) and FLAT * int(n.max()) * n_docs >= 2**63:
        scaled = np.array([FLAT * x * n_docs // n_terms for x in n.tolist()], np.int64)
    else:
        scaled = FLAT * n * n_docs // n_terms
    return 100 - FLAT + scaled


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Documents with what each of their terms adds to a score."""

    def __init__(self, n, at, terms, tfs, weights, n_docs, n_terms) -> None:
        self.count = len(n)
        m = length_parts(n, n_docs, n_terms)
        rows = np.repeat(np.arange(self.count, dtype=np.int32), np.diff(at))
        tf = tfs.astype(np.int64)
        parts = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[rows]))
        self.at, self.terms, self.parts = at, terms, parts
        order = np.argsort(terms, kind="stable")
        self.rows = rows[order]
        self.known, begins = np.unique(terms[order], return_index=True)
        self.begins = np.append(begins, len(order))
        self.most = np.maximum.reduceat(parts[order], begins) if len(order) else np.empty(0, np.int64)
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, place: int) -> np.ndarray:
        """The documents that hold the term at this place of `known`, a bit each."""
        if place not in self.bitmaps:
            bits = np.zeros(self.count, np.uint8)
            bits[self.rows[self.begins[place] : self.begins[place + 1]]] = 1
            self.bitmaps[place] = np.packbits(bits)
        return self.bitmaps[place]

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of these documents for the terms marked in `wanted`."""
        sizes = self.at[docs + 1] - self.at[docs]
        ends = np.cumsum(sizes)
        place = np.repeat(self.at[docs] - ends + sizes, sizes) + np.arange(ends[-1])
        total = np.concatenate([[0], np.cumsum(np.where(wanted[self.terms[place]], self.parts[place], 0))])
        return total[ends] - total[ends - sizes]

    def masks(self, places: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct masks of these documents over the terms at `places`, as rows of bits, and the mask of each."""
        bits = np.stack([np.unpackbits(self.bitmap(p), count=self.count)[docs] for p in places.tolist()])
        packed = np.ascontiguousarray(np.packbits(bits, axis=0).T)
        if packed.shape[1] <= 8:
            whole = np.zeros((len(docs), 8), np.uint8)
            whole[:, : packed.shape[1]] = packed
            keys = whole.view(np.uint64).ravel()
        else:
            keys = packed.view(np.dtype((np.void, packed.shape[1]))).ravel()
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        return bits[:, first].T, group.ravel()

    def best(self, terms: np.ndarray, wanted: np.ndarray, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores among which the `top` best of this block are, if they reach `floor`."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.searchsorted(self.known, terms)
        place = place[(place < len(self.known)) & (self.known[np.minimum(place, len(self.known) - 1)] == terms)] if len(
            self.known) else place[:0]
        if not len(place):
            return none
        place = place[np.argsort(self.most[place], kind="stable")]
        reach = np.cumsum(self.most[place])
        needed = place[reach >= max(floor, 1)]
        if not len(needed):
            return none
        union = reduce(np.bitwise_or, [self.bitmap(p) for p in needed.tolist()])
        docs = np.flatnonzero(np.unpackbits(union, count=self.count))
        masks, group = self.masks(place, docs)
        bounds = masks.astype(np.int64) @ self.most[place]
        rank = np.empty(len(bounds), np.int64)
        order = np.argsort(-bounds, kind="stable")
        rank[order] = np.arange(len(order))
        by_bound = np.argsort(rank[group], kind="stable")
        docs, bound = docs[by_bound], bounds[group[by_bound]]
        found, scored, at = [], [], 0
        while at < len(docs) and bound[at] >= max(floor, 1):
            # Up to the end of a group, so that equal bounds are evaluated together.
            last = int(np.searchsorted(-bound, -bound[min(at + STEP, len(docs)) - 1], "right"))
            found.append(docs[at:last])
            scored.append(self.scores(docs[at:last], wanted))
            at = last
            every = np.concatenate(scored)
            if len(every) >= top:
                floor = max(floor, int(np.partition(every, len(every) - top)[len(every) - top]))
        return (np.concatenate(found), np.concatenate(scored)) if found else none


def _merged(kept, ids, missing, scores, top):
    """The `top` of what is kept (ids, missing, scores) and of new rows: by score, then id, null ids last."""
    ids, missing, scores = (np.concatenate([a, b]) for a, b in zip(kept, (ids, missing, scores)))
    order = np.lexsort((ids, missing, -scores))[:top]
    return ids[order], missing[order], scores[order]


def best_of_tasks(counted: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int,
                  top: int = TOP, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(query, doc_id, score): the `top` documents of each query of each task."""
    shared = counted.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = shared.value
        empty = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
        kept = [empty] * len(queries)
        wanted = np.zeros(len(weights), bool)
        for whole in batches:
            for i in range(0, whole.num_rows, block_docs):
                batch = whole.slice(i, block_docs)
                terms, tfs = batch.column("terms"), batch.column("tfs")
                at = terms.offsets.to_numpy().astype(np.int64)
                at, values = at - at[0], slice(at[0], at[-1])
                missing = np.asarray(batch.column("doc_id").is_null())
                ids = batch.column("doc_id").fill_null(0).to_numpy()
                block = Block(batch.column("n").to_numpy(), at, terms.values.to_numpy()[values], tfs.values.to_numpy()[values],
                              weights, n_docs, n_terms)
                for q, own in enumerate(queries):
                    wanted[own] = True
                    full = len(kept[q][2]) >= top
                    docs, scores = block.best(own, wanted, int(kept[q][2][-1]) if full else 0, top)
                    wanted[own] = False
                    good = scores > 0
                    if good.any():
                        kept[q] = _merged(kept[q], ids[docs[good]], missing[docs[good]], scores[good], top)
        for q, (ids, missing, scores) in enumerate(kept):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=missing), pa.array(scores)],
                    ["query", "doc_id", "score"])

    return counted.mapInArrow(run, "query int, doc_id bigint, score bigint")


def ranked(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The `top` rows of each key with `rank`. Rows of a key are first ranked in up to BUCKETS
    groups, by the task they come from, so no task takes those of all tasks."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = rows.withColumn("bucket", F.spark_partition_id() % BUCKETS)
    first = dealt.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "bucket").orderBy(*order)))
    first = first.where(F.col("rank") <= top).drop("bucket", "rank")
    last = first.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return last.where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pass_terms: int = PASS_TERMS,
           block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of `docs` (doc_id, text, ...) with a score above
    0 for each row of `items` (item_id, text, ...), best first, equal scores by ascending doc_id, null ids last.

    Ids of documents are whole numbers. Every row of either table counts as its
    own, repeats too. Null texts have no terms: such documents count nowhere,
    such items have no rows. Very long texts are taken whole. Other columns are
    ignored, whatever their names. If either table has no terms, the result is
    empty. Items are served in passes of at most `pass_terms` terms (one item at
    least), so what is broadcast is bounded however many items there are.
    """
    spark = docs.sparkSession
    named = staged(query_terms(items), "queries")
    sized = running_total(named.select("key", F.size("terms").cast("bigint").alias("size")), [], ["key"], "size", "before")
    passes = staged(sized.select("key", F.expr(f"before div {pass_terms}").alias("pass")), "passes")
    kind = dict(items.dtypes)["item_id"]
    results = []
    for number in range((passes.agg(F.max("pass")).first()[0] or 0) + 1):
        own = named.join(passes.where(F.col("pass") == number), "key").orderBy("key").collect()
        if not own:
            continue
        numbers = {t.encode(): i for i, t in enumerate(sorted({t for row in own for t in row["terms"]}))}
        counted = staged(counted_terms(docs, numbers), "counted")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
        weights = np.full(len(numbers), weight(n_docs, 0), np.int64)
        for term, df in frequency.collect():  # at most a row per term of the pass
            weights[term] = weight(n_docs, df)
        queries = [np.array(sorted(numbers[t.encode()] for t in row["terms"]), np.int32) for row in own]
        found = best_of_tasks(counted, queries, weights, n_docs, n_terms, top, block_docs)
        names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(own)], f"query int, item_id {kind}")
        best = ranked(found, ["query"], top).join(F.broadcast(names), "query")  # a row per item of the pass
        results.append(best.select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, results)


_TERMS = "regexp_extract_all(translate({0}, '%s', '%s'), '%s')" % (UPPER, LOWER, TERM)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS terms FROM documents),
held AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM held),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM held) GROUP BY ALL),
q AS (SELECT DISTINCT k, item_id, term FROM (
  SELECT row_number() OVER () AS k, item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*)::BIGINT AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term), totals),
scored AS (
  SELECT k, item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * ({100 - FLAT} + ({FLAT} * n * nd) // nl))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN held USING (r), totals GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= {TOP}
"""
