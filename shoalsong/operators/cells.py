"""Exact nearest references beyond a broadcast: cells of an index in files.

Each reference goes to the nearest of some pivots; the references of a pivot
are a cell, several by hash where they exceed the size of a cell. A cell is a
folder of unit vectors below the shared folder and has the smallest and the
largest angle to its pivot.

Recordings stay in their tasks and are never shuffled. A batch of them is
compared with the cell of its nearest pivot first, then with the others, and a
cell is passed over, for a recording, where the triangle inequality shows that
it can't reach the recording's k-th best so far: no reference is nearer than
angle(recording, pivot) - largest, nor than smallest - angle(recording, pivot).
A cell that no recording of a batch needs is not read. A task holds a batch, a
few cells and a slice of products.

Pivots come from a bounded sample and decide only how much is passed over.
Vectors of length zero and widths without a pivot are cells that are always
compared. Ties go to the lower ref_id.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalsong.sources import workspace
from shoalsong.sources.recordings import open_folder

PIVOTS = 256            # per vector width, at most
SAMPLE_ROWS = 4096      # references from which pivots are chosen ...
SAMPLE_BYTES = 16 << 20  # ... and their bytes
MARGIN = 1e-6           # radians: far above the error of arccos in double precision
HELD_BYTES = 64 << 20   # cells that a task keeps: it passes over all of them in turn, so more are seldom met again
SLICE = 1 << 22         # products at a time
READ_BYTES = 1 << 20    # of a cell that are decoded at a time
ROWS_BYTES = 64 << 20   # recordings at a time


def unit_rows(vectors: pa.Array, width: int):
    """A list column of equal widths as a matrix of unit rows; rows of length zero stay zero."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype(np.float64).reshape(-1, width)
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def best_per_row(scores, ref_ids, k: int):
    """(rows, references, scores) of the k highest scores of each row, exact.

    Scores are compared to 12 places, so equal references tie whatever order
    the product summed in, and ties go to the lower id.
    """
    n = scores.shape[1]
    keep = min(k, n)
    # The k-th highest of the group maxima is a lower bound of the k-th highest score.
    group = max(1, min(64, n // (8 * k)))
    maxima = np.maximum.reduceat(scores, np.arange(0, n, group), axis=1)
    last = maxima.shape[1] - keep
    floor = np.partition(maxima, last, axis=1)[:, last]
    hits = np.flatnonzero(scores >= (floor - 1e-9)[:, None])
    rows, columns = hits // n, hits % n
    values = np.round(scores.ravel()[hits], 12)
    return first_k(rows, ref_ids[columns], values, keep)


def first_k(rows, references, scores, k: int):
    order = np.lexsort((references, -scores, rows))
    rows = rows[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[best], references[order][best], scores[order][best]


def farthest_first(units, count: int):
    """Up to `count` of the rows, each the one farthest from those before; none twice."""
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < count:
        at = int(np.argmin(nearest))
        if nearest[at] > 1 - 1e-9:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, units @ units[at])
    return units[chosen]


def choose_pivots(entries: DataFrame, count: int) -> dict:
    """Per width that the sample holds, a matrix of pivots. Two bounded results reach the driver."""
    n, widest = entries.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not n:
        return {}
    rows = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * widest)))
    # Twice as many as wanted come through, so that the limit seldom falls short.
    chance = min(1.0, 2 * rows / n)
    chosen = F.pmod(F.xxhash64("ref_id"), F.lit(1 << 30)) < int(chance * (1 << 30))
    sample = entries.where(chosen).select("dim", "embedding").limit(rows).toArrow()
    widths, pivots = sample.column("dim").to_numpy(), {}
    for width in np.unique(widths):
        vectors = sample.column("embedding").combine_chunks().take(pa.array(np.flatnonzero(widths == width)))
        units = unit_rows(vectors, int(width))
        units = units[units.any(axis=1)]
        if len(units):
            pivots[int(width)] = farthest_first(units, count)
    return pivots


def assigned(entries: DataFrame, pivots: dict) -> DataFrame:
    """(ref_id, dim, pivot, angle, unit): the nearest pivot, -1 where there is none."""
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            widths = table.column("dim").to_numpy()
            for width in np.unique(widths):
                part = table.take(pa.array(np.flatnonzero(widths == width)))
                units = unit_rows(part.column("embedding").combine_chunks(), int(width))
                pivot, angle = np.full(len(units), -1, np.int32), np.zeros(len(units))
                if int(width) in pivots:
                    cosines = units @ pivots[int(width)].T
                    near = units.any(axis=1)
                    pivot[near] = cosines.argmax(axis=1)[near]
                    angle[near] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))[near]
                yield pa.RecordBatch.from_arrays(
                    [part.column("ref_id").combine_chunks(), pa.array(np.full(len(units), width), pa.int32()), pa.array(pivot),
                     pa.array(angle), pa.array([u.tobytes() for u in units], pa.binary())],
                    ["ref_id", "dim", "pivot", "angle", "unit"])

    return entries.select("ref_id", "dim", "embedding").mapInArrow(
        run, "ref_id bigint, dim int, pivot int, angle double, unit binary")


def write_cells(entries: DataFrame, pivots: dict, folder: str, cell_bytes: int) -> list[tuple]:
    """Write the cells, a folder for each; returns (dim, pivot, part, smallest, largest angle) of all.

    A row per cell reaches the driver: one per pivot and per `cell_bytes` of references. A pivot with
    a third of all references has as many cells as its size takes, in as many tasks.
    """
    spark, found = entries.sparkSession, workspace.new_folder(entries.sparkSession, "assigned")
    rows = assigned(entries, pivots)
    rows.write.parquet(found)
    rows = spark.read.schema(rows.schema).parquet(found)
    sizes = rows.groupBy("dim", "pivot").agg(
        F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / F.lit(cell_bytes)).cast("bigint").alias("parts"))
    keyed = rows.join(sizes, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("ref_id"), "parts"))
    cell = ["dim", "pivot", "part"]
    keyed.drop("parts").repartition(*cell).sortWithinPartitions(*cell).write.partitionBy(*cell).parquet(folder)
    written = spark.read.schema("ref_id bigint, angle double, unit binary, dim int, pivot int, part bigint").parquet(folder)
    return [tuple(r) for r in written.groupBy(*cell).agg(F.min("angle"), F.max("angle")).orderBy(*cell).collect()]


def read_cell(folder: str, dim: int, pivot: int, part: int):
    """(ref_ids, matrix) of one cell."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    system, root = open_folder(folder)
    found = system.get_file_info(FileSelector(f"{root}/dim={dim}/pivot={pivot}/part={part}"))
    files = [pq.ParquetFile(f.path, filesystem=system, pre_buffer=False, buffer_size=READ_BYTES)
             for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".parquet")]
    # Decoded into place, so that a cell is not held twice.
    matrix, ref_ids, at = np.empty((sum(f.metadata.num_rows for f in files), dim)), [], 0
    for file in files:
        with file:
            for batch in file.iter_batches(max(1, READ_BYTES // (8 * dim)), columns=["ref_id", "unit"], use_threads=False):
                units = batch.column("unit").cast(pa.binary(8 * dim))
                rows = np.frombuffer(units.buffers()[1], count=len(units) * dim, offset=units.offset * 8 * dim)
                matrix[at:at + len(units)] = rows.reshape(-1, dim)
                ref_ids.append(batch.column("ref_id"))
                at += len(units)
    return pa.chunked_array(ref_ids, pa.int64()).to_numpy(), matrix


def search(queries, k: int, pivots, cells: list[tuple], load):
    """(rows, references, scores, compared): the k best references of each unit row of `queries`.

    `cells` are those of the rows' width, `load(*cell[:3])` reads one; `compared` counts products.
    """
    n = len(queries)
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor, compared = np.full(n, -np.inf), 0
    angles = np.zeros((n, 1)) if pivots is None else np.arccos(np.clip(queries @ pivots.T, -1, 1))
    plain = ~queries.any(axis=1)

    def reachable(cell):
        """The highest score that a reference of the cell can have."""
        if cell[1] < 0:
            return np.ones(n)
        theta = angles[:, cell[1]]
        gap = np.maximum(np.maximum(theta - cell[4], cell[3] - theta) - MARGIN, 0)
        return np.where(plain, 0.0, np.cos(gap))

    def compare(cell, rows):
        nonlocal held, compared
        ref_ids, matrix = load(*cell[:3])
        step = max(1, SLICE // max(1, len(ref_ids)))
        for start in range(0, len(rows), step):
            some = rows[start:start + step]
            found, references, scores = best_per_row(queries[some] @ matrix.T, ref_ids, k)
            compared += len(some) * len(ref_ids)
            mine = np.isin(held[0], some)
            merged = first_k(*(np.concatenate(p) for p in zip(
                (c[mine] for c in held), (some[found], references, scores))), k)
            held = tuple(np.concatenate([h[~mine], m]) for h, m in zip(held, merged))
            full = np.bincount(merged[0], minlength=n) == k
            lowest = np.full(n, np.inf)
            np.minimum.at(lowest, merged[0], merged[2])
            floor[full] = lowest[full]

    # The nearest pivot's first cell gives a good k-th best early.
    first = {}
    for at, cell in enumerate(cells):
        first.setdefault(cell[1], at)
    of_pivot = np.array([first.get(p, -1) for p in range(angles.shape[1])])
    near = angles.copy()
    near[:, of_pivot < 0] = np.inf
    home = of_pivot[near.argmin(axis=1)]
    for at in np.unique(home[home >= 0]):
        compare(cells[at], np.flatnonzero(home == at))
    for at, cell in enumerate(cells):
        rows = np.flatnonzero((home != at) & (reachable(cell) >= floor - 1e-9))
        if len(rows):
            compare(cell, rows)
    return *first_k(*held, k), compared


@dataclasses.dataclass(frozen=True)
class Index:
    """Stored cells: their folder, the pivots per width, (dim, pivot, part, smallest, largest angle) per width."""

    folder: str
    cell_bytes: int
    pivots: dict
    cells: dict


def build(entries: DataFrame, cell_bytes: int, count: int) -> Index:
    """Write `entries` (ref_id, dim, embedding), vectors without NaN, as cells. `count` is the wanted
    number of pivots per width."""
    folder = workspace.new_folder(entries.sparkSession, "cells")
    pivots = choose_pivots(entries, min(PIVOTS, count))
    cells: dict[int, list] = {}
    for cell in write_cells(entries, pivots, folder, cell_bytes):
        cells.setdefault(cell[0], []).append(cell)
    return Index(folder, cell_bytes, pivots, cells)


def nearest(pooled: DataFrame, index: Index, key: str, k: int) -> DataFrame:
    """(key, ref_id, similarity, rank) of `pooled` (key, dim, embedding), vectors without NaN, in an index."""
    folder, cell_bytes, pivots, cells = index.folder, index.cell_bytes, index.pivots, index.cells
    id_type = pooled.schema[key].dataType.simpleString()

    def run(batches):
        load = functools.lru_cache(max(2, HELD_BYTES // cell_bytes))(functools.partial(read_cell, folder))
        for batch in batches:
            table = pa.Table.from_batches([batch])
            widths = table.column("dim").to_numpy()
            for width in np.intersect1d(widths, list(cells)):
                width = int(width)
                every = np.flatnonzero(widths == width)
                step = max(1, ROWS_BYTES // (8 * width))
                for start in range(0, len(every), step):
                    part = table.take(pa.array(every[start:start + step]))
                    units = unit_rows(part.column("embedding").combine_chunks(), width)
                    rows, references, scores, _ = search(units, k, pivots.get(width), cells[width], load)
                    rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
                    yield pa.RecordBatch.from_arrays(
                        [part.column(key).combine_chunks().take(pa.array(rows)), pa.array(references, pa.int64()),
                         pa.array(scores, pa.float64()), pa.array(rank, pa.int32())], [key, "ref_id", "similarity", "rank"])

    return pooled.select(key, "dim", "embedding").mapInArrow(
        run, f"`{key}` {id_type}, ref_id bigint, similarity double, rank int")
