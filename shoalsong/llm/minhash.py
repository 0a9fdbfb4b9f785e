"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature has 40 positions, each the 16 low bits of one minimum hash; two
signatures differ in as many positions as they have unequal ones. It is split
into 10 chunks of 4. If two signatures differ in at most 19 positions, then by
pigeonhole some chunk has at most one wrong position. One wrong position per
chunk is enumerated: every chunk is indexed four times, each time without one
of its positions. So all pairs within distance 19 share an index key. At a
similarity of 0.8 a pair is further apart with a probability of 2 in 100,000,
at 0.85 of 1 in 10 million. Links are confirmed on the full shingle sets.

Nothing emits all pairs of a group:

1. Documents with equal sets are one class; only classes are compared.
2. Each class is compared with one partner, the index leader it shares most
   keys with. Confirmed links are joined into components.
3. Index keys that still hold more than one component are compared completely,
   block by block; of the pairs of different components within distance 19 a
   task returns a forest that joins the same classes, never all of them.
4. What such forests join is a cell. The sets of a cell, in blocks, meet each
   other, all pairs of different components are counted exactly, and again
   only links that join something are returned.

After that every candidate link is confirmed, refused, or inside one component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalsong.llm import words
from shoalsong.llm.tables import broadcast_if_small, components, staged, unused

CHUNKS, WIDTH = 10, 4
POSITIONS = CHUNKS * WIDTH
MAX_DISTANCE = 2 * CHUNKS - 1
#: Pairs in a cell of the first comparison; signatures of a block under one key; sets of a block in a cell.
FOLLOWERS, BLOCK, SETS = 128, 1024, 512

_random = np.random.RandomState(7)
FACTORS = _random.randint(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _random.randint(0, 2**63, POSITIONS, dtype=np.uint64)
PLACES = _random.randint(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id bigint, text_key string, n_shingles bigint, digest binary, signature binary"


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes; fewer words than `width` are one shingle."""
    size = min(width, len(hashes))
    count = len(hashes) - size + 1
    total = np.full(count, size, np.uint64)
    for i in range(size):
        total += hashes[i : i + count] * PLACES[i]
    return np.unique(words.mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None] * FACTORS + ADDENDS
        np.minimum(low, part.min(axis=0), out=low)
    return (words.mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def text_key():
    return F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per document (doc_id, md5 of its text, n_shingles, digest of its set, signature); the last two are null without words."""
    def run(batches):
        hasher = words.Hasher()
        for batch in batches:
            n = batch.num_rows
            counts, digests, signs = np.zeros(n, np.int64), [None] * n, [None] * n
            for row, hashes in words.row_hashes(batch.column("text"), hasher):
                shingles = shingle_set(hashes, width)
                counts[row], digests[row] = len(shingles), digest(shingles)
                signs[row] = signature(shingles).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(counts), pa.array(digests, pa.binary()),
                 pa.array(signs, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "digest", "signature"])

    return docs.select("doc_id", "text", text_key()).mapInArrow(run, SIGNED)


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, id) for each chunk without each one of its positions; equal positions give equal keys."""
    def run(batches):
        kept = [[i for i in range(WIDTH) if i != out] for out in range(WIDTH)]
        names = np.arange(CHUNKS * WIDTH, dtype=np.int64) << 48
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16)
            signs = signs.reshape(-1, CHUNKS, 1, WIDTH).astype(np.int64)[..., 0, :]
            three = np.stack([signs[..., k] for k in kept], axis=2)
            keys = (three[..., 0] << 32 | three[..., 1] << 16 | three[..., 2]).reshape(-1, CHUNKS * WIDTH) | names
            ids = np.repeat(batch.column("id").to_numpy(), CHUNKS * WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key bigint, id bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the classes in `wanted` (id, doc_id, digest), from one text of each."""
    def run(batches):
        hasher = words.Hasher()
        for batch in batches:
            found = [None] * batch.num_rows
            wanted_digests = batch.column("digest").to_pylist()
            for row, hashes in words.row_hashes(batch.column("text"), hasher):
                shingles = shingle_set(hashes, width)
                if digest(shingles) == wanted_digests[row]:
                    found[row] = shingles.tobytes()
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "shingles"])
            yield out.filter(out.column("shingles").is_valid())

    texts = docs.select(F.col("doc_id").alias("_doc"), "text")
    found = texts.join(broadcast_if_small(wanted), F.col("_doc").eqNullSafe(F.col("doc_id")))
    # A doc_id may stand for several rows with the same text.
    return found.select("id", "digest", "text").mapInArrow(run, "id bigint, shingles binary")


class Forest:
    """Union-find over numbers below n."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class Sets:
    """Shingle sets as numbers, to count what one has in common with all others."""

    def __init__(self, sets: list[bytes]) -> None:
        arrays = [np.frombuffer(x, np.uint64) for x in sets]
        self.size = np.array([len(x) for x in arrays])
        self.end = np.cumsum(self.size)
        known, self.codes = np.unique(np.concatenate(arrays), return_inverse=True)
        self.flags = np.zeros(len(known), bool)

    def similar(self, x: int, percent: int) -> np.ndarray:
        """Which sets are similar enough to set x. No set is empty."""
        own = self.codes[self.end[x] - self.size[x] : self.end[x]]
        self.flags[own] = True
        common = np.add.reduceat(self.flags[self.codes], self.end - self.size, dtype=np.int64)
        self.flags[own] = False
        return 100 * common >= percent * (self.size + self.size[x] - common)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def leader_links(keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of each class with the index leader it shares most keys with."""
    leaders = keys.groupBy("key").agg(F.min("id").alias("leader"))
    shared = keys.join(leaders, "key").where("leader < id").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("id").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    # The followers of a leader are spread over as many cells as their number asks for.
    size = best.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("bigint").alias("cells"))
    spread = F.pmod(F.xxhash64("id"), F.col("cells"))
    pairs = staged(best.join(size, "leader").select("leader", "id", spread.alias("cell")), "pairs")
    followers = pairs.join(sets, "id").select("leader", "cell", "id", "shingles")
    cells = pairs.groupBy("leader", "cell").agg(F.count(F.lit(1)).alias("n"))
    heads = cells.join(sets.withColumnRenamed("id", "leader"), "leader")
    rows = followers.unionByName(heads.select("leader", "cell", F.col("leader").alias("id"), "shingles"))

    def run(table: pa.Table) -> pa.Table:
        ids, leader = table.column("id").to_numpy(), table.column("leader")[0].as_py()
        first = int(np.flatnonzero(ids == leader)[0]) if leader in ids else None
        if first is None or len(ids) < 2:
            return LINKS.empty_table()
        found = Sets(table.column("shingles").to_pylist()).similar(first, percent)
        found[first] = False
        return pa.table([pa.array(np.full(found.sum(), leader)), pa.array(ids[found])], schema=LINKS)

    return rows.groupBy("leader", "cell").applyInArrow(run, "a bigint, b bigint")


def in_blocks(rows: DataFrame, group: str, size: str, limit: int) -> DataFrame:
    """The rows of a group of `size`, for each pair (i, j) of its blocks of about `limit` rows; `own` is the block."""
    blocks = F.ceil(F.col(size) / limit).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", group), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _sides(table: pa.Table):
    """Row numbers of the two blocks of a group, and of all rows a number for their root."""
    own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    _, roots = np.unique(table.column("root").to_numpy(), return_inverse=True)
    return np.flatnonzero(own == i), np.flatnonzero(own == j), roots


def candidates(keys: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """A forest (a, b) over the pairs under one key, of different components, within MAX_DISTANCE."""
    labelled = keys.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    opened = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
    rows = labelled.join(opened.where("lo <> hi").select("key", "n"), "key").join(classes.select("id", "signature"), "id")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        left, right, roots = _sides(table)
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, POSITIONS)
        forest, a, b = Forest(len(ids)), [], []
        there_signs, there_roots = signs[right], roots[right]
        for x in left:
            near = (there_signs != signs[x]).sum(axis=1, dtype=np.uint8) <= MAX_DISTANCE
            for y in right[near & (there_roots != roots[x])]:
                if forest.join(x, y):
                    a.append(ids[x])
                    b.append(ids[y])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)

    each = in_blocks(rows, "key", "n", BLOCK).select("key", "i", "j", "own", "id", "root", "signature")
    return each.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def cell_links(pairs: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between different components among all that `pairs` hold together."""
    cells = components(pairs).withColumnRenamed("root", "cell")
    size = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.join(size, "cell").join(roots, "id", "left").join(sets, "id")
    rows = rows.select("cell", "n", "id", F.coalesce("root", "id").alias("root"), "shingles")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        left, right, roots = _sides(table)
        held = Sets(table.column("shingles").to_pylist())
        forest, a, b = Forest(roots.max() + 1), [], []
        for x in left:
            apart = forest.parent[roots[right]] != forest.root(roots[x])
            if not apart.any():
                continue
            found = held.similar(x, percent)
            for y in right[apart & found[right]]:
                if forest.join(roots[x], roots[y]):
                    a.append(ids[x])
                    b.append(ids[y])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)

    each = in_blocks(rows, "cell", "n", SETS).select("cell", "i", "j", "own", "id", "root", "shingles")
    return each.groupBy("cell", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (doc_id, text): (doc_id, text_key, n_shingles, digest, component_id, kept).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| over their
    sets of distinct `width`-word shingles, lower-cased in A-Z; with fewer
    words, the whole sequence is the one shingle. component_id is the smallest
    doc_id reachable, kept is doc_id = component_id.

    Documents without words (null, empty, white space) are linked with nothing.
    A null doc_id is left out of the minimum; where a component has only such,
    component_id is null and kept is true. Repeated rows are linked like any
    equal documents; rows with equal doc_id have equal `kept`. Other columns of
    `docs` are not looked at. Texts are taken whole, piece by piece.
    """
    signed = staged(signatures(docs, width), "signatures")
    classes = signed.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.min("signature").alias("signature"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    keys = index_keys(classes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    keys = staged(keys.join(shared, "key").select("key", "id"), "keys")
    wanted = classes.join(keys.select("id").distinct(), "id").select("id", "doc_id", "digest")
    sets = shingle_sets(docs, wanted, width)
    sets = staged(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), "sets")

    links = staged(leader_links(keys, sets, percent), "links")
    roots = staged(components(links), "roots")
    pairs = staged(candidates(keys, classes, roots), "pairs")
    if not pairs.isEmpty():
        links = links.union(staged(cell_links(pairs, roots, sets, percent), "links"))
        roots = staged(components(links), "roots")

    labelled = classes.join(roots, "id", "left").select("digest", "doc_id", F.coalesce("root", "id").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = labelled.join(lowest, "root").select(F.col("digest").alias("_digest"), "component_id")
    out = signed.join(found, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "text_key", "n_shingles", "digest", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) that stay: one of each component, all its columns.

    That is a row with the smallest doc_id of the component; if rows share that
    doc_id, the one with the smallest md5 of its text, and of equal rows one.
    Rows without words are no duplicates, but equal ones are one. Other columns
    may have any name. An empty table gives an empty result.
    """
    key, of_id, of_key, n = unused(docs, "_text_key", "_id", "_key", "_n")
    found = near_duplicates(docs, width, percent).where("kept")
    rows = found.groupBy("component_id", "digest", "text_key").agg(
        F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    # Where a component is told apart by its id alone, several texts may have that id.
    first = rows.groupBy("component_id", F.col("digest").isNull().alias("_none"),
                         F.when(F.col("digest").isNull(), F.col("text_key")).alias("_text")).agg(
        F.min("text_key").alias(of_key), F.min_by("doc_id", "text_key").alias(of_id), F.min_by("n", "text_key").alias(n))
    first = staged(first.select(of_id, of_key, n), "kept")
    joined = docs.withColumn(key, text_key()).join(
        broadcast_if_small(first), F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)))
    once = joined.where(F.col(n) == 1).select(*docs.columns)
    more = joined.where(F.col(n) > 1).dropDuplicates(["doc_id", key]).select(*docs.columns)
    return once.unionByName(more)
