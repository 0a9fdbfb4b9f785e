"""Near-duplicate vectors by an exact metric range join.

The metric is the angle. Each vector belongs to the cell of its nearest pivot
and is copied to a cell c only if the triangle inequality allows a partner
there: its angle to pivot c may exceed that to its own pivot by twice the limit
at most, and the radius of the cell by the limit. Cells join independently.
Inside a cell vectors lie in rings by their angle to the pivot; rings further
apart than the limit are not compared. Rings are split into blocks, and a group
is one pair of blocks, so no group grows with a cell.

Equal vectors are one class. Groups return counts and a forest of links, never
the pairs. In many dimensions, where vectors without structure are all about
equally far apart, the inequality excludes little and the join does the work of
comparing all blocks; it stays exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalsong.llm.tables import components, staged

#: Classes per pivot, most pivots (they go to the driver), rows of a block.
PER_PIVOT, MAX_PIVOTS, BLOCK = 4096, 256, 8192
#: Rows of a block that are compared with the other block at once.
SLICE = 256
#: Slack for rounding of angles; products this near the limit are summed exactly.
SLACK, NEAR = 1e-6, 1e-9


def kind_of(vectors: DataFrame) -> str:
    """How entries travel: floats, which are doubles exactly, as they came, all else as doubles."""
    return "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, width): the bytes of vectors that have a direction; null for others."""
    kind = kind_of(vectors)

    def run(batches):
        for batch in batches:
            out, widths = [], []
            for value in batch.column("embedding"):
                x = np.array(value.values.to_numpy(zero_copy_only=False), kind) if value.is_valid else np.empty(0)
                good = len(x) and np.isfinite(x).all() and x.any()
                out.append(x.tobytes() if good else None)
                widths.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()), pa.array(out, pa.binary()), pa.array(widths, pa.int32())],
                ["vec_id", "vector", "width"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, vector binary, width int")


def unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: bytes, b: bytes, kind: str) -> float:
    """The cosine of two vectors with exactly rounded sums, the same for (a, b) and (b, a)."""
    x, y = (np.frombuffer(v, kind).astype(np.float64) for v in (a, b))
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def pivots_of(classes: DataFrame, count: int, kind: str) -> dict[int, np.ndarray]:
    """Pivots by width: a bounded sample, those with the smallest hashes."""
    rows = classes.orderBy(F.xxhash64("vector"), "vector").select("width", "vector").limit(count).collect()
    return {w: unit([r["vector"] for r in rows if r["width"] == w], kind) for w in {r["width"] for r in rows}}


def angles(batch, pivots, kind: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per row the angles to the pivots of its width; none if that width has no pivot."""
    widths = batch.column("width").to_numpy()
    vectors = batch.column("vector").to_pylist()
    out: list = [np.empty(0)] * len(widths)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        if w in pivots:
            found = np.arccos(np.clip(unit([vectors[i] for i in at], kind) @ pivots[w].T, -1, 1))
            for i, row in zip(at, found):
                out[i] = row
    return widths, out


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the places linked by (a, b): in the end each has the smallest place it hangs together with.

    `label` must be such a table already, as all places for themselves are.
    """
    a, b = label[a], label[b]
    while True:
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        # Labels never rise above their place, so following them ends at the smallest.
        while True:
            new = label[label]
            if (new == label).all():
                break
            label[:] = new
        a, b = label[a], label[b]


MEMBER = "id bigint, width int, cell int, ring int, home boolean"


def members(classes: DataFrame, pivots: dict, limit: float, kind: str, radius: dict | None = None) -> DataFrame:
    """(id, width, cell, ring, home): the own cell of each class and, with radii by (width, cell),
    the cells it is copied to. A width without pivot is one cell, -1."""
    shared = classes.sparkSession.sparkContext.broadcast((pivots, radius))

    def run(batches):
        pivots, radius = shared.value
        for batch in batches:
            rows = []
            widths, found = angles(batch, pivots, kind)
            for id_, width, to in zip(batch.column("id").to_pylist(), widths.tolist(), found):
                if not len(to):
                    rows.append((id_, width, -1, 0, True))
                    continue
                own = int(to.argmin())
                rows.append((id_, width, own, int(to[own] / limit), True))
                if radius is None:
                    continue
                reach = np.array([radius.get((width, c), -10.0) for c in range(len(to))])
                near = (to - to[own] <= 2 * limit + SLACK) & (to <= limit + reach + SLACK)
                near[own] = False
                rows += [(id_, width, int(c), int(to[c] / limit), False) for c in np.flatnonzero(near)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))],
                ["id", "width", "cell", "ring", "home"])

    return classes.select("id", "width", "vector").mapInArrow(run, MEMBER)


def block_links(classes: DataFrame, placed: DataFrame, min_cosine: float, kind: str, rings_apart: int = 2) -> DataFrame:
    """Rows (id, weight, a, b): per class of a block the rows linked with it, and the links of a forest."""
    cell = ["width", "cell"]
    counts = placed.groupBy(*cell, "ring").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all"),
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("own"))
    # At most a row per pivot and ring, and per width without pivot.
    counts = staged(counts, "counts").withColumnRenamed("ring", "to_ring")
    near = F.abs(F.col("ring") - F.col("to_ring")) <= rings_apart
    rows = placed.join(classes.select("id", "vector", "n"), "id").join(counts, cell).where(near)
    mine = placed.groupBy(*cell, "ring").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("my_all"), F.ceil(F.count_if("home") / BLOCK).cast("int").alias("my_own"))
    rows = rows.join(staged(mine, "counts"), [*cell, "ring"])
    left = rows.where("home and `all` > 0").withColumn("h", F.struct("ring", F.pmod(F.xxhash64("id"), "my_own").alias("s")))
    left = left.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).withColumn(
        "m", F.struct(F.col("to_ring").alias("ring"), F.col("s").cast("bigint").alias("s")))
    right = rows.where("own > 0").withColumn("m", F.struct("ring", F.pmod(F.xxhash64("id"), "my_all").alias("s")))
    right = right.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).withColumn(
        "h", F.struct(F.col("to_ring").alias("ring"), F.col("s").cast("bigint").alias("s")))
    both = left.select(*cell, "h", "m", "id", "vector", "n", F.lit(True).alias("left")).union(
        right.select(*cell, "h", "m", "id", "vector", "n", F.lit(False).alias("left")))

    schema = pa.schema([(c, pa.int64()) for c in ("id", "weight", "a", "b")])

    def run(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy(zero_copy_only=False)
        ids, weight = table.column("id").to_numpy(), table.column("n").to_numpy()
        vectors = table.column("vector").to_pylist()
        at_left, at_right = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(at_left) or not len(at_right):
            return schema.empty_table()
        x, y = (unit([vectors[i] for i in at], kind) for at in (at_left, at_right))
        # Each slice is reduced as it is found; no pairs are kept. Label: the smallest id known to hang together.
        linked, partners = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        known, place = np.unique(ids, return_inverse=True)
        label = np.arange(len(known))
        for i in range(0, len(at_left), SLICE):
            dots = x[i : i + SLICE] @ y.T
            r, c = np.nonzero(dots >= min_cosine - NEAR)
            r_ids, c_ids = at_left[i + r], at_right[c]
            keep = ids[r_ids] != ids[c_ids]
            close = np.flatnonzero(keep & (dots[r, c] < min_cosine + NEAR))
            for k in close:
                keep[k] = cosine(vectors[r_ids[k]], vectors[c_ids[k]], kind) >= min_cosine
            r_ids, c_ids, r = r_ids[keep], c_ids[keep], r[keep]
            if not len(r_ids):
                continue
            linked[at_left[i : i + SLICE]] = np.bincount(r, weights=weight[c_ids], minlength=len(dots)).astype(np.int64)
            partners[r_ids] = True
            merge(label, place[r_ids], place[c_ids])
        if not partners.any():
            return schema.empty_table()
        at_own = np.flatnonzero(partners)
        own, linked = ids[at_own], linked[at_own]
        joined = np.flatnonzero(label != np.arange(len(known)))
        none = pa.nulls
        return pa.table([
            pa.concat_arrays([pa.array(own), none(len(joined), pa.int64())]),
            pa.concat_arrays([pa.array(linked), none(len(joined), pa.int64())]),
            pa.concat_arrays([none(len(own), pa.int64()), pa.array(known[joined])]),
            pa.concat_arrays([none(len(own), pa.int64()), pa.array(known[label[joined]])])], schema=schema)

    return both.groupBy(*cell, "h", "m").applyInArrow(run, "id bigint, weight bigint, a bigint, b bigint")


def near_duplicate_vectors(vectors: DataFrame, min_cosine: float = 0.9) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding): (vec_id, n_links, component_id, kept).

    Two rows are linked if the cosine of their vectors, in double precision, is
    min_cosine or more; vectors of different width never are. n_links counts
    the other rows linked directly, copies included. component_id is the
    smallest vec_id reachable; kept is vec_id = component_id. Vectors that are
    null, empty, zero, or have null or non-finite entries link with nothing. A
    null vec_id is left out of the minimum. Other columns are ignored.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be above 0 and at most 1")
    limit, kind = math.acos(min_cosine) + SLACK, kind_of(vectors)
    rows = staged(usable(vectors), "vectors")
    classes = rows.where("vector is not null").groupBy("vector").agg(
        F.first("width").alias("width"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    pivots = pivots_of(classes, min(MAX_PIVOTS, max(1, math.ceil(classes.count() / PER_PIVOT))), kind)
    # The rings of the own cells bound its radius; one row per pivot.
    rings = members(classes, pivots, limit, kind).where("cell >= 0").groupBy("width", "cell").agg(F.max("ring").alias("ring"))
    radius = {(r["width"], r["cell"]): (r["ring"] + 1) * limit for r in rings.collect()}
    placed = staged(members(classes, pivots, limit, kind, radius), "members")
    links = staged(block_links(classes, placed, min_cosine, kind), "links")
    counts = links.where("id is not null").groupBy("id").agg(F.sum("weight").alias("others"))
    roots = components(links.where("a is not null").select("a", "b"))
    labelled = classes.join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    found = labelled.join(lowest, "root").select(
        "vector", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(found, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
