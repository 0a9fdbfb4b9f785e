"""Recordings against labelled references.

Inputs are `pooled` (a key column, `embedding array<double>`) and `refs`
(`schemas.REFERENCE_ENTRY`). Only vectors of equal width are compared.

The mean cosine of a vector e to a category is the mean over its references r
of e.r / |e||r|, which is unit(e) . mean(unit(r)). So classification needs one
mean unit vector per category and width and never forms a recording-reference
pair. Only the nearest-site report has to look at single references; it does so
by block matrix products that emit k rows per recording and block.

A reference with a NaN or infinite entry is not comparable and left out; a
recording with one has no label and no nearest references.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalsong import constants as C
from shoalsong.functions import fields
from shoalsong.functions import vectors as V
from shoalsong.operators import cells
from shoalsong.operators.cells import best_per_row, first_k, unit_rows
from shoalsong.operators.embedding import mean_pool

CODES = [code for code, _ in C.CATEGORIES]

# The four-entry arrays below are unfolded with explode_outer: a plain explode
# makes the optimiser add a not-empty filter that evaluates them a second time.


def pool_by_site(refs: DataFrame) -> DataFrame:
    """One entry per site instead of one per file; the lowest ref_id stands for it."""
    named = refs.select("ref_id", *fields.site_defaults(), "num_segments", "embedding")
    sites = ["site_id", "country", "site_type"]
    means = mean_pool(named, *sites).drop("dim", "num_segments")
    totals = named.groupBy(*sites).agg(F.min("ref_id").alias("ref_id"), F.sum("num_segments").alias("num_segments"))
    return totals.join(means, sites).select(
        "ref_id", F.lit(None).cast("string").alias("filename"), *sites[:1], "country", "site_type",
        "num_segments", "embedding")


def finite(refs: DataFrame) -> DataFrame:
    """References that can be compared."""
    return refs.where(F.expr("size(embedding) > 0 AND forall(embedding, x -> abs(x) < double('infinity'))"))


# Entries of all widths together up to which the rows "per width" are broadcast: 64 MB of category vectors.
BROADCAST_ENTRIES = 2 << 20


def _small(per_width: DataFrame, refs: DataFrame) -> DataFrame:
    """Hint to broadcast a table with a row per vector width, if the widths that occur are few enough.

    Measures the references once. Otherwise Spark chooses, and can split the
    vectors of a common width.
    """
    widths = refs.select(F.size("embedding").cast("bigint").alias("n")).distinct()
    entries = widths.agg(F.sum(F.greatest("n", F.lit(1)))).first()[0] or 0
    return F.broadcast(per_width) if entries <= BROADCAST_ENTRIES else per_width


def comparable_references(pooled: DataFrame, refs: DataFrame, key: str = "recording_id") -> DataFrame:
    """How many references each recording is compared with, in all and by category."""
    per_width = (
        finite(refs).select(V.width(F.col("embedding")).alias("dim"), "site_type")
        .groupBy("dim")
        .agg(F.count(F.lit(1)).alias("comparable"),
             F.count_if(F.col("site_type").isin(CODES)).alias("categorised"))
    )
    return (
        pooled.select(key, V.width(F.col("embedding")).alias("dim"))
        .join(_small(per_width, refs), "dim", "left")
        .select(key, "dim",
                F.coalesce("comparable", F.lit(0)).alias("comparable"),
                F.coalesce("categorised", F.lit(0)).alias("categorised"))
    )


def category_vectors(refs: DataFrame) -> DataFrame:
    """Per width, a map from category code to the mean unit vector of its references.

    One row of four vectors per width, whatever the number of references: 40 KB for one of 1280.
    """
    units = finite(refs.where(F.col("site_type").isin(CODES))).select(
        V.width(F.col("embedding")).alias("width"), "site_type", V.unit(F.col("embedding")).alias("vector"))
    return mean_pool(units, "width", "site_type", vector="vector").groupBy(F.col("width").alias("dim")).agg(
        F.map_from_entries(F.collect_list(F.struct("site_type", "vector"))).alias("vectors"))


_NORM = "sqrt(aggregate(embedding, 0D, (acc, x) -> acc + x * x)) AS _norm"


def _category_slots() -> str:
    """SQL: ordinal, site_type, status and mean similarity of the four categories."""
    def slot(i, code, status):
        vector = f"try_element_at(vectors, '{code}')"
        product = f"aggregate(zip_with(embedding, {vector}, (x, y) -> x * y), 0D, (acc, x) -> acc + x)"
        return (f"named_struct('ordinal', {i}, 'site_type', '{code}', 'status', '{status}', 'similarity', "
                f"if({vector} IS NULL, NULL, coalesce(try_divide({product}, _norm), 0D)))")

    return f"array({', '.join(slot(i, *category) for i, category in enumerate(C.CATEGORIES))}) AS categories"


def with_category_similarity(pooled: DataFrame, refs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Add `categories`: status, ordinal and mean similarity (null without
    references) for each of the four categories, in tie-break order. `vectors`
    are the stored `category_vectors` of the references, if there are any."""
    vectors = category_vectors(refs) if vectors is None else vectors
    rest = [c for c in pooled.columns if c != "dim"]
    return (
        pooled.select(*rest, V.width(F.col("embedding")).alias("dim"), F.expr(_NORM))
        .join(_small(vectors, refs), "dim", "left")
        .select(*rest, "dim", F.expr(_category_slots()))
    )


def category_similarity(pooled: DataFrame, refs: DataFrame, key: str = "recording_id") -> DataFrame:
    """Long form of the mean similarity; categories without references are absent."""
    return (
        with_category_similarity(pooled, refs)
        .select(key, F.explode_outer("categories").alias("c"))
        .select(key, "c.site_type", "c.status", "c.similarity")
        .where(F.col("similarity").isNotNull())
    )


def complete_categories(pooled: DataFrame, refs: DataFrame, key: str = "recording_id",
                        default: float = C.EMPTY_CATEGORY_SIMILARITY) -> DataFrame:
    """Every recording with all four categories, missing ones at the default."""
    return (
        with_category_similarity(pooled, refs)
        .select(key, F.explode_outer("categories").alias("c"))
        .select(key, "c.ordinal", "c.status",
                F.coalesce("c.similarity", F.lit(default)).alias("similarity"))
    )


def classify(pooled: DataFrame, refs: DataFrame, default: float = C.EMPTY_CATEGORY_SIMILARITY,
             vectors: DataFrame | None = None) -> DataFrame:
    """Add `probabilities` (ordered array of status and p), `label`, `confidence` and `valid`.

    Row-local after one small broadcast. Probabilities are normalised only when
    their total is positive, ties go to the earlier category, and an empty
    reference table gives the fixed placeholder answer. `valid` tells whether
    the recording had a comparable reference and the numbers are probabilities.
    """
    any_refs = refs.limit(1).agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    placeholder = ", ".join(f"named_struct('status', '{s}', 'p', {p}D)" for s, p in C.PLACEHOLDER_PROBABILITIES)
    similar = with_category_similarity(pooled, refs, vectors)
    kept = similar.drop("categories").columns
    scored = similar.select(
        *kept, "categories", any_refs.alias("_any"),
        F.expr(f"transform(categories, c -> coalesce(c.similarity, {default}D)) AS _scores"))
    summed = scored.select("*", F.expr("aggregate(_scores, 0D, (acc, s) -> acc + s) AS _total"))
    shared = summed.select(
        "*",
        F.expr(f"""
            if(_any,
               transform(categories, (c, i) -> named_struct(
                   'status', c.status, 'p', if(_total > 0, _scores[i] / _total, _scores[i]))),
               array({placeholder})) AS probabilities"""))
    # A NaN must not win the maximum; the earlier category wins a tie.
    ranked = shared.select(
        "*",
        F.expr("""
            array_max(transform(probabilities, (c, i) -> named_struct(
                'p', if(isnan(c.p), NULL, c.p), 'order', -i, 'status', c.status))) AS _best"""))
    return ranked.select(
        *kept, "probabilities", F.expr("if(_best.p IS NULL, NULL, _best.status) AS label"),
        F.col("_best.p").alias("confidence"),
        F.expr("""
            _any AND _total > 0 AND NOT isnan(_total) AND exists(categories, c -> c.similarity IS NOT NULL)
            AND forall(_scores, s -> s >= 0) AS valid"""))


def probabilities_long(classified: DataFrame, key: str = "recording_id") -> DataFrame:
    return classified.select(key, F.explode_outer("probabilities").alias("c")).select(
        key, fields.display_label(F.col("c.status")).alias("status"), F.col("c.p").alias("probability"))


# --- Nearest sites -----------------------------------------------------------

def _pack(vectors: DataFrame, id_column: str, keys: list[str], rows: int) -> DataFrame:
    """Rows (id, dim, embedding) as unit-length matrices of at most `rows` rows.

    Works on whatever Arrow batch the task holds, so it needs no shuffle. `keys`
    are small integer columns that stay constant within a matrix.
    """
    head = ["dim", *keys]
    id_type = vectors.schema[id_column].dataType.simpleString()
    schema = f"dim int, ids array<{id_type}>, matrix binary" + "".join(f", {k} int" for k in keys)

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            tags = np.stack([table.column(h).to_numpy() for h in head], axis=1)
            for tag in np.unique(tags, axis=0):
                where = np.flatnonzero((tags == tag).all(axis=1))
                for start in range(0, len(where), rows):
                    part = table.take(pa.array(where[start:start + rows]))
                    matrix = unit_rows(part.column("embedding").combine_chunks(), int(tag[head.index("dim")]))
                    ids = part.column(id_column).combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(tag[0])], pa.int32()),
                         pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                         pa.array([matrix.tobytes()], pa.binary())]
                        + [pa.array([int(t)], pa.int32()) for t in tag[1:]],
                        ["dim", "ids", "matrix", *keys])

    return vectors.select(id_column, *head, "embedding").mapInArrow(run, schema)


def _nearest_in_blocks(k: int):
    """Arrow function: the k best references of each row of a matrix, over the
    consecutive reference matrices it is paired with."""

    def result(ids, found):
        rows, references, scores = found
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), pa.array(references), pa.array(scores)], ["id", "ref_id", "similarity"])

    def run(batches):
        held_ids, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                width = row["dim"].as_py()
                ids, ref_ids = row["ids"].values, row["ref_ids"].values.to_numpy()
                left, right = (np.frombuffer(row[c].as_buffer()).reshape(-1, width) for c in ("matrix", "ref_matrix"))
                found = best_per_row(left @ right.T, ref_ids, k)
                if held is not None and held_ids.equals(ids):
                    held = first_k(*(np.concatenate(pair) for pair in zip(held, found)), k)
                    continue
                if held is not None:
                    yield result(held_ids, held)
                held_ids, held = ids, found
        if held is not None:
            yield result(held_ids, held)

    return run


def reference_bytes(refs: DataFrame) -> int:
    """Size of the matrix of comparable references; runs one small aggregation."""
    return finite(refs).agg(F.sum(V.width(F.col("embedding")).cast("bigint") * 8)).first()[0] or 0


def reference_cells(refs: DataFrame, block_bytes: int = 32 << 20, matrix_bytes: int | None = None) -> cells.Index:
    """The comparable references written as cells of about `block_bytes`, to be searched any number of times."""
    entries = finite(refs).select("ref_id", V.width(F.col("embedding")).alias("dim"), "embedding")
    if matrix_bytes is None:
        matrix_bytes = reference_bytes(refs)
    return cells.build(entries, block_bytes, max(8, -(-matrix_bytes // block_bytes)))


def nearest_references(
    pooled: DataFrame,
    refs: DataFrame,
    key: str = "recording_id",
    k: int = C.TOP_SITES,
    broadcast_bytes: int = 64 << 20,
    block_bytes: int = 32 << 20,
    matrix_bytes: int | None = None,
    index: cells.Index | None = None,
) -> DataFrame:
    """(key, ref_id, similarity, rank) of the k most similar references, exact.

    The size of the reference matrix decides the join; it is measured with
    `reference_bytes` unless given. Up to `broadcast_bytes` it is broadcast.
    Beyond, the references are written as cells of about `block_bytes` and each
    task reads those that can hold one of the nearest (`operators.cells`);
    recordings are not shuffled. With the stored `index` of the references
    (`reference_cells`) nothing is measured, broadcast or written. Ties go to
    the lower ref_id. `key` must be unique.
    """
    rows = finite(pooled).select(key, V.width(F.col("embedding")).alias("dim"), "embedding")
    if index is not None:
        return cells.nearest(rows, index, key, k)
    entries = finite(refs).select("ref_id", V.width(F.col("embedding")).alias("dim"), "embedding")
    if matrix_bytes is None:
        matrix_bytes = reference_bytes(refs)
    if matrix_bytes > broadcast_bytes:
        return cells.nearest(rows, reference_cells(refs, block_bytes, matrix_bytes), key, k)
    left = _pack(rows, key, [], 1024)
    right = _pack(entries.coalesce(1), "ref_id", [], 4096).select(
        "dim", F.col("ids").alias("ref_ids"), F.col("matrix").alias("ref_matrix"))
    pairs = left.join(F.broadcast(right), "dim")
    candidates = pairs.select("dim", "ids", "matrix", "ref_ids", "ref_matrix").mapInArrow(
        _nearest_in_blocks(k), f"id {pooled.schema[key].dataType.simpleString()}, ref_id bigint, similarity double")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "ref_id")
    return (
        candidates.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(F.col("id").alias(key), "ref_id", "similarity", "rank")
    )


def similar_sites(pooled: DataFrame, refs: DataFrame, key: str = "recording_id",
                  k: int = C.TOP_SITES, **sizes) -> DataFrame:
    """Nearest references with site, country and status."""
    names = refs.select("ref_id", *fields.site_defaults())
    return (
        nearest_references(pooled, refs, key, k, **sizes)
        .join(names, "ref_id")
        .select(key, "rank", "ref_id", "site_id", "country",
                fields.status_of(F.col("site_type")).alias("status"), "similarity")
    )


def similar_sites_or_placeholder(pooled: DataFrame, refs: DataFrame, key: str = "recording_id",
                                 k: int = C.TOP_SITES, **sizes) -> DataFrame:
    """As `similar_sites`, but the fixed three sites when there is no reference at all.

    Whether there is one is looked up first, so the recordings are evaluated once.
    """
    if not refs.isEmpty():
        return similar_sites(pooled, refs, key, k, **sizes).drop("ref_id")
    fixed = F.array(*[
        F.struct(F.lit(i + 1).alias("rank"), F.lit(site).alias("site_id"), F.lit(country).alias("country"),
                 F.lit(status).alias("status"), F.lit(similarity).alias("similarity"))
        for i, (site, similarity, country, status) in enumerate(C.PLACEHOLDER_SITES)])
    return pooled.select(key, F.explode(fixed).alias("s")).select(
        key, "s.rank", "s.site_id", "s.country", "s.status", "s.similarity")


# --- Projection --------------------------------------------------------------


def project_2d(df: DataFrame) -> DataFrame:
    return (df.withColumn("x", V.first_half_mean(F.col("embedding")))
            .withColumn("y", V.second_half_mean(F.col("embedding"))))


def reference_points(refs: DataFrame, n: int = C.REFERENCE_POINTS) -> DataFrame:
    """The first n references in index order, projected; those without a vector give no point."""
    first = refs.orderBy("ref_id").limit(n)
    return project_2d(first.where(F.size("embedding") > 0)).select(
        "ref_id", F.coalesce("site_id", F.lit(C.UNKNOWN_SITE)).alias("site_id"),
        fields.status_of(F.col("site_type")).alias("status"), "x", "y")


def acoustic_space(classified: DataFrame, refs: DataFrame, key: str = "recording_id") -> DataFrame:
    """Scatter data: every recording's point and the reference points."""
    samples = project_2d(classified).select(
        F.col(key).cast("string").alias("point_id"), F.lit("Your Sample").alias("site"),
        fields.display_label(F.col("label")).alias("status"), F.lit("Your Sample").alias("type"), "x", "y")
    references = reference_points(refs).select(
        F.col("ref_id").cast("string").alias("point_id"), F.col("site_id").alias("site"),
        fields.display_label(F.col("status")).alias("status"), F.lit("Reference").alias("type"), "x", "y")
    return references.unionByName(samples)
