"""JSON arrays of objects, each file read by byte ranges in many tasks.

Where an entry begins depends on what comes before it: whether a range starts
inside a string, and how deep. The first pass tells for each range, for either
start, whether its quotes change the side, how much its brackets change the
depth, and how many objects open at each depth. These few numbers per range are
added up in order, which gives every range its true start and the position of
its first entry; the second pass cuts out the entries that begin in a range and
reads on to the end of its last one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from shoalsong.sources.recordings import open_folder

RANGE_BYTES = 8 << 20
MAX_TASKS = 10_000
QUOTE, BACKSLASH, OBJECT = ord('"'), ord("\\"), ord("{")
SIGN = np.zeros(256, np.int8)  # 1 opens, -1 closes, 2 is a quote
SIGN[[ord("["), OBJECT]], SIGN[[ord("]"), ord("}")]], SIGN[QUOTE] = 1, -1, 2


def json_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of all .json files of the folder, by path; none if there is nothing."""
    system, root = open_folder(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".json"))


def marks(data, before: int):
    """(positions, signs, object) of the quotes that are not escaped and of all brackets. `before` is the
    number of backslashes that end just in front of the data."""
    at = np.flatnonzero(SIGN[data])
    slashes = np.flatnonzero(data == BACKSLASH)
    run = np.zeros(len(data) + 1, bool) if len(slashes) or before % 2 else None
    if run is not None:
        begins = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) != 1, slashes, -1)) if len(slashes) else slashes
        length = slashes - begins + 1 + np.where(begins == 0, before, 0)
        run[slashes + 1] = length % 2 == 1
        run[0] = before % 2 == 1
        at = at[~((data[at] == QUOTE) & run[at])]
    return at, SIGN[data[at]].astype(np.int64), data[at] == OBJECT


def structure(marked, inside: bool):
    """(positions, depths before, signs, object) of the brackets outside of strings, depths from 0."""
    at, signs, objects = marked
    quotes = signs == 2
    plain = ((np.cumsum(quotes) - quotes + inside) % 2 == 0) & ~quotes
    signs = signs[plain]
    return at[plain], np.cumsum(signs) - signs, signs, objects[plain]


def summary(data, before: int, inside: bool):
    """(side changes, depth change, {depth: objects that open there})."""
    marked = marks(data, before)
    _, depths, signs, objects = structure(marked, inside)
    levels, counts = np.unique(depths[objects], return_counts=True)
    return bool((marked[1] == 2).sum() % 2), int(signs.sum()), list(zip(levels.tolist(), counts.tolist()))


def read_range(handle, start: int, size: int):
    """(bytes of the range, backslashes that end just in front of it)."""
    before, at = 0, start
    while at > 0:
        handle.seek(max(0, at - 4096))
        piece = handle.read(at - max(0, at - 4096))
        kept = len(piece.rstrip(b"\\"))
        before += len(piece) - kept
        if kept:
            break
        at -= len(piece)
    handle.seek(start)
    return np.frombuffer(handle.read(size), np.uint8), before


def entries(handle, start: int, size: int, inside: bool, depth: int, level: int):
    """The objects at depth `level` that begin in the range, as text. One without an end goes to the file's end."""
    data, before = read_range(handle, start, size)
    at, depths, signs, objects = structure(marks(data, before), inside)
    depths = depths + depth
    begins = at[objects & (depths == level)]
    ends = at[(signs == -1) & (depths == level + 1)] + 1
    raw, ending = data.tobytes(), np.searchsorted(ends, begins, "right")
    out = [raw[b:ends[e]] for b, e in zip(begins, ending) if e < len(ends)]
    if len(begins) > len(out):
        out.append(raw[begins[-1]:] + rest(handle, start + len(raw), raw[begins[-1]:]))
    return out


def rest(handle, at: int, opened: bytes, step: int = 1 << 20) -> bytes:
    """What follows an opened object, up to its end."""
    parts, pieces = [], opened
    inside, depth, before = False, 0, 0
    while True:
        data = np.frombuffer(pieces, np.uint8)
        marked = marks(data, before)
        where, depths, signs, _ = structure(marked, inside)
        closed = where[(signs == -1) & (depths + depth == 1)]
        if parts and len(closed):
            parts[-1] = pieces[:closed[0] + 1]
            return b"".join(parts)
        inside ^= bool((marked[1] == 2).sum() % 2)
        depth += int(signs.sum())
        kept = len(pieces.rstrip(b"\\"))
        before = len(pieces) - kept + (0 if kept else before)
        handle.seek(at)
        pieces = handle.read(step)
        if not pieces:
            return b"".join(parts)
        at += len(pieces)
        parts.append(pieces)


def _over_ranges(spark: SparkSession, rows: list[tuple], columns: str, run, schema: str) -> DataFrame:
    frame = spark.createDataFrame(rows, columns).repartition(max(1, min(len(rows), MAX_TASKS)))
    return frame.mapInArrow(run, schema)


def read_objects(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(position, text): the objects of one JSON array per file, in order over the files by path.

    A file that is no array but one object gives that object. A missing path, an empty file and an empty
    array give nothing. Text that is cut off in the last object comes as far as it goes. The driver
    holds a few numbers per range.
    """
    files = json_files(path)
    ranges = [(name, start, min(range_bytes, size - start)) for name, size in files for start in range(0, size, range_bytes)]

    def measure(batches):
        system, _ = open_folder(path)
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                with system.open_input_file(row["file"]) as handle:
                    data, before = read_range(handle, row["start"], row["size"])
                head = data.tobytes()[:4096].lstrip() if row["start"] == 0 else b""
                for inside in (False, True):
                    odd, change, opens = summary(data, before, inside)
                    found.append((row["file"], row["start"], inside, odd, change, opens, head.startswith(b"[")))
            yield pa.RecordBatch.from_arrays([
                pa.array(c, t) for c, t in zip(zip(*found), (
                    pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.map_(pa.int64(), pa.int64()), pa.bool_()))],
                ["file", "start", "inside", "odd", "change", "opens", "array"])

    def cut(batches):
        system, _ = open_folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["file"]) as handle:
                    texts = entries(handle, row["start"], row["size"], row["inside"], row["depth"], row["level"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row["first"], row["first"] + len(texts)), pa.int64()),
                     pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["position", "text"])

    result = "position bigint, text string"
    if not ranges:
        return spark.createDataFrame([], result)
    measured = _over_ranges(
        spark, ranges, "file string, start bigint, size bigint", measure,
        "file string, start bigint, inside boolean, odd boolean, change bigint, opens map<bigint,bigint>, array boolean")
    told = {(r["file"], r["start"], r["inside"]): r for r in measured.collect()}
    starts, position = [], 0
    for name, start, size in ranges:
        if start == 0:
            inside, depth = False, 0
            level = int(told[name, 0, False]["array"])
        row = told[name, start, inside]
        starts.append((name, start, size, inside, depth, level, position))
        position += (row["opens"] or {}).get(level - depth, 0)
        inside, depth = inside != row["odd"], depth + row["change"]
    return _over_ranges(
        spark, starts, "file string, start bigint, size bigint, inside boolean, depth bigint, level bigint, first bigint",
        cut, result)
