"""Segment vectors: inference, guards, pooling and the feature fallback."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from shoalsong.functions import vectors as V

# A factory is called inside the task and returns a batch model:
# (rows, samples) -> (rows, width). Cache it in an importable module of your own
# (functools.cache) to keep one model per Python worker.
Model = Callable[[np.ndarray], np.ndarray]
ModelFactory = Callable[[], Model]


def truncate(vector: Column, width: int) -> Column:
    return F.slice(vector, 1, width)


def flatten_and_truncate(output: Column, width: int) -> Column:
    """First `width` numbers of a nested model output."""
    return F.slice(F.flatten(output), 1, width)


def with_length_check(segments: DataFrame, samples: int, column: str = "samples") -> DataFrame:
    """Flag the segments whose window a model of `samples` inputs accepts."""
    n = F.size(column)
    return segments.withColumn("length_ok", n == samples).withColumn(
        "error",
        F.when(n != samples, F.format_string("Expected %d samples, got %d", F.lit(samples), n)),
    )


def embed_batches(names: list[str], factory: ModelFactory | None, width: int, batch_rows: int = 32):
    """Arrow step: the columns `names` plus `embedding` and `error`.

    Without a factory every embedding is null.

    The model is built once per task and sees `batch_rows` windows at a time. A
    failing batch is retried row by row, so one bad window fails alone; its
    embedding is null and the message kept.
    """
    def infer(model, windows):
        try:
            out = np.asarray(model(np.stack(windows).astype(np.float32)), dtype=np.float64)
            return [(row[:width], None) for row in out.reshape(len(windows), -1)]
        except Exception as problem:
            if len(windows) == 1:
                return [(None, str(problem))]
            return [infer(model, [w])[0] for w in windows]

    def run(batches):
        model, broken = None, None if factory else "no model given"
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                if model is None and broken is None:
                    try:
                        model = factory()
                    except Exception as problem:
                        broken = str(problem)
                if broken is not None:
                    results = [(None, broken)] * part.num_rows
                else:
                    windows = [w.values.to_numpy(zero_copy_only=False) for w in part.column("samples")]
                    results = infer(model, windows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names]
                    + [pa.array([r[0] for r in results], pa.list_(pa.float64())),
                       pa.array([r[1] for r in results], pa.string())],
                    names + ["embedding", "error"])

    return run


def embed_segments(
    segments: DataFrame, factory: ModelFactory, width: int, batch_rows: int = 32
) -> DataFrame:
    """Replace `samples` by `embedding` and `error`; all other columns pass through."""
    keep = [f for f in segments.schema.fields if f.name not in ("samples", "error")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return segments.mapInArrow(
        embed_batches([f.name for f in keep], factory, width, batch_rows),
        schema + ", embedding array<double>, error string")


# Entries summed per aggregation row: few enough for generated code, enough to
# keep the number of rows per vector small.
POOL_BLOCK = 32


def _block_sums(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of `_v` by key and block of entries; null vectors keep their key."""
    blocks = (f"posexplode_outer(transform(sequence(0, (size(_v) - 1) div {POOL_BLOCK}), "
              f"b -> slice(_v, b * {POOL_BLOCK} + 1, {POOL_BLOCK})))")
    cut = vectors.select(*keys, F.expr("size(_v)").alias("_size"), F.expr(blocks).alias("_block", "_entries"))
    return cut.groupBy(*keys, "_block").agg(
        F.count("_entries").alias("_n"), F.min("_size").alias("_lo"), F.max("_size").alias("_hi"),
        *[F.expr(f"sum(get(_entries, {i})) AS _{i}") for i in range(POOL_BLOCK)])


def _collected(prefix: str, condition: str) -> list[Column]:
    """Aggregates that bring the blocks of a key together, of rows meeting `condition`."""
    sums = ", ".join(f"_{i}" for i in range(POOL_BLOCK))
    used = f"_block IS NOT NULL AND {condition}"
    return [
        F.expr(f"max(if({condition}, _n, 0)) AS {prefix}_count"),
        F.expr(f"min(if({used}, _lo, NULL)) AS {prefix}_lo"),
        F.expr(f"max(if({used}, _hi, NULL)) AS {prefix}_width"),
        F.expr(f"collect_list(if({used}, struct(_block, array({sums}) AS sums), NULL)) AS {prefix}_parts"),
    ]


def _mean_of(prefix: str) -> Column:
    return F.expr(f"""
        CASE WHEN {prefix}_count = 0 THEN NULL
             WHEN {prefix}_lo <> {prefix}_width
             THEN NULL
             ELSE transform(slice(flatten(transform(sort_array({prefix}_parts), p -> p.sums)), 1, {prefix}_width),
                            s -> s / {prefix}_count) END""")


def mean_pool(segments: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key, with `dim` and `num_segments`.

    Vectors are summed block by block with combining before the shuffle, so a
    key with any number of segments costs one row per block and map task.
    Segments without a vector are not counted, and a key without any keeps a
    null vector. A key with vectors of mixed width has no mean: its vector and
    dim are null, and other keys are not touched.
    """
    vectors = segments.select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    merged = _block_sums(vectors, list(keys)).groupBy(*keys).agg(*_collected("v", "true"))
    return merged.select(*keys, _mean_of("v").alias(vector), F.expr("if(v_lo = v_width, v_width, NULL)").alias("dim"),
                         F.col("v_count").alias("num_segments"))


def kind_sums(
    segments: DataFrame,
    key: str = "recording_id",
    model_vector: str = "embedding",
    feature_vector: str = "feature_embedding",
) -> DataFrame:
    """Sums of model and feature vectors by key and block: what pooling needs of segments. Sums of
    several parts of the segments merge by `merged_sums`."""
    kinds = F.explode(F.array(
        F.struct(F.lit(False).alias("is_feature"), F.col(model_vector).cast("array<double>").alias("_v")),
        F.struct(F.lit(True).alias("is_feature"), F.col(feature_vector).cast("array<double>").alias("_v"))))
    vectors = segments.select(key, kinds.alias("_k")).select(key, "_k.*")
    return _block_sums(vectors, [key, "is_feature"])


def merged_sums(parts: DataFrame, key: str = "recording_id") -> DataFrame:
    """One row per key, kind and block from the `kind_sums` of any number of parts."""
    return parts.groupBy(key, "is_feature", "_block").agg(
        F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        *[F.sum(f"_{i}").alias(f"_{i}") for i in range(POOL_BLOCK)])


def pooled_sums(sums: DataFrame, key: str = "recording_id") -> DataFrame:
    """The pooled vector per key from the sums of all its segments, as `pool_with_fallback` gives it."""
    merged = sums.groupBy(key).agg(*_collected("m", "NOT is_feature"), *_collected("f", "is_feature"))
    return merged.select(
        key,
        F.when(F.expr("m_count < f_count"), _mean_of("f")).otherwise(_mean_of("m")).alias("embedding"),
        F.expr("if(m_count < f_count, if(f_lo = f_width, f_width, NULL), if(m_lo = m_width, m_width, NULL))").alias("dim"),
        F.col("f_count").alias("num_segments"),
        F.expr("m_count < f_count").alias("synthetic"),
    )


def pool_with_fallback(
    segments: DataFrame,
    key: str = "recording_id",
    model_vector: str = "embedding",
    feature_vector: str = "feature_embedding",
) -> DataFrame:
    """Pooled vector per key; if any segment has no model vector, the feature
    vectors of all segments are pooled instead and `synthetic` is true.

    Both kinds are summed in one aggregation, so the decision needs no second
    pass. Every segment must have a feature vector.
    """
    return pooled_sums(kind_sums(segments, key, model_vector, feature_vector), key)


def embedding_summary(pooled: DataFrame, key: str = "recording_id") -> DataFrame:
    synthetic = F.col("synthetic") if "synthetic" in pooled.columns else F.lit(False)
    return pooled.select(
        key,
        V.width(F.col("embedding")).alias("dimension"),
        "num_segments",
        F.lit("mean").alias("aggregation"),
        synthetic.alias("synthetic"),
    )


# --- Pooling on matrices -----------------------------------------------------

# Running sums that a task holds before it passes them on.
POOL_BYTES = 64 << 20


def _summed_by_key(batch: pa.RecordBatch, keys: list[str]):
    """(key values and width, count, sum vector) of each key and width of a batch (keys, _n, _vector)."""
    lists = batch.column("_vector")
    widths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    table = pa.Table.from_arrays([*(batch.column(k) for k in keys), pa.array(widths), pa.array(np.arange(len(widths)))],
                                 [*(f"k{i}" for i in range(len(keys))), "width", "row"])
    heads = table.column_names[:-1]
    groups = table.group_by(heads, use_threads=False).aggregate([("row", "list")])
    rows = groups.column("row_list").combine_chunks()
    owner = np.empty(len(widths), np.int64)
    owner[rows.flatten().to_numpy()] = np.repeat(np.arange(len(rows)), pc.list_value_length(rows).to_numpy())
    counts = np.bincount(owner, weights=batch.column("_n").to_numpy(), minlength=len(rows)).astype(np.int64)
    sums: list = [None] * len(rows)
    for width in np.unique(widths[widths > 0]):
        of_width = np.flatnonzero(widths == width)
        of_width = of_width[np.argsort(owner[of_width], kind="stable")]
        flat = pc.fill_null(lists.take(pa.array(of_width)).flatten(), 0.0).to_numpy()
        found, starts = np.unique(owner[of_width], return_index=True)
        for group, total in zip(found, np.add.reduceat(flat.reshape(-1, width), starts, axis=0)):
            sums[group] = total
    return zip(zip(*(groups.column(h).to_pylist() for h in heads)), counts.tolist(), sums)


def _fold_sums(keys: list[str], types: list[pa.DataType], ordered: bool):
    """Arrow function: rows (keys, _n, _vector) to one row per key and width, several where the sums held
    exceed `POOL_BYTES`. On rows `ordered` by key, to one row (keys, _vector, _dim, _n) per key with its mean."""
    def rows_of(held):
        heads = list(zip(*held)) if held else [()] * (len(keys) + 1)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(values, t) for values, t in zip(heads, types)),
             pa.array([n for n, _ in held.values()], pa.int64()),
             pa.array([v for _, v in held.values()], pa.list_(pa.float64()))], [*keys, "_n", "_vector"])

    def means_of(held):
        found: dict[tuple, dict] = {}
        for head, value in held.items():
            found.setdefault(head[:-1], {})[head[-1]] = value
        heads = list(zip(*found)) if found else [()] * len(keys)
        widths = [max(of_key) if len(of_key.keys() - {-1}) == 1 and max(of_key) > 0 else None for of_key in found.values()]
        means = [None if w is None else of_key[w][1] / of_key[w][0] for w, of_key in zip(widths, found.values())]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(values, t) for values, t in zip(heads, types)), pa.array(means, pa.list_(pa.float64())),
             pa.array(widths, pa.int32()), pa.array([sum(n for n, _ in of_key.values()) for of_key in found.values()], pa.int64())],
            [*keys, "_vector", "_dim", "_n"])

    def run(batches):
        held, size, out = {}, 0, means_of if ordered else rows_of
        for batch in batches:
            if not batch.num_rows:
                continue
            for head, n, total in _summed_by_key(batch, keys):
                if head in held:
                    before, running = held[head]
                    held[head] = before + n, running if total is None else running + total
                    continue
                held[head] = n, np.zeros(0) if total is None and head[-1] == 0 else total
                size += 64 + (0 if total is None else total.nbytes)
            if size > POOL_BYTES:
                key = list(held)[-1][:-1]
                last = {head: held.pop(head) for head in list(held) if head[:-1] == key} if ordered else {}
                yield out(held)
                held, size = last, 0
        if held:
            yield out(held)

    return run


def mean_pool_matrices(segments: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """`mean_pool` by matrix sums in the task: for wide vectors.

    A task adds up the vectors of a key before the shuffle, so one row per key
    and task is shuffled, whatever the width, and a key with a third of all
    segments costs one row per task. Merging holds one key at a time. Nulls,
    empty tables and mixed widths as in `mean_pool`; null entries count 0,
    and one that is null in all vectors is 0.
    At least one key; names of keys must not start with _.
    """
    names = list(keys)
    rows = segments.select(*names, F.when(F.col(vector).isNull(), 0).otherwise(1).cast("bigint").alias("_n"),
                           F.col(vector).cast("array<double>").alias("_vector"))
    types = [to_arrow_type(rows.schema[k].dataType) for k in names]
    partial = rows.mapInArrow(_fold_sums(names, types, False), rows.schema)
    dealt = partial.repartition(*names).sortWithinPartitions(*names)
    schema = StructType([*(rows.schema[k] for k in names), StructField("_vector", ArrayType(DoubleType())),
                         StructField("_dim", IntegerType()), StructField("_n", LongType())])
    return dealt.mapInArrow(_fold_sums(names, types, True), schema).select(
        *names, F.col("_vector").alias(vector), F.col("_dim").alias("dim"), F.col("_n").alias("num_segments"))
