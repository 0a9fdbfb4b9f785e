"""Windows of a recording as a table function for SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Windows:
    """Cuts the samples of one recording, in order, into windows; holds less than a window between batches."""

    def __init__(self):
        self.key = self.tail = None
        self.size, self.padded, self.done = 0, False, 0

    def eval(self, samples: pa.RecordBatch, size: pa.Array, padded: pa.Array):
        if not samples.num_rows:
            return
        self.size, self.padded = size[0].as_py(), padded[0].as_py()
        if self.size < 1:
            raise ValueError("a window has at least one sample")
        values = samples.column("v").cast(pa.float64())
        self.key = samples.column("recording_id").slice(0, 1)
        held = pa.concat_arrays([self.tail, values]) if self.tail is not None else values
        whole = len(held) // self.size * self.size
        self.tail = held.slice(whole)
        if whole:
            yield self._rows(held.slice(0, whole))

    def terminate(self):
        rest = 0 if self.tail is None else len(self.tail)
        if self.padded and rest > self.size // 2:
            yield self._rows(pa.concat_arrays([self.tail, pa.array([0.0] * (self.size - rest), pa.float64())]))

    def _rows(self, values):
        first, count = self.done, len(values)
        self.done += count
        spots = range(first, first + count)
        return pa.table({
            "recording_id": pa.concat_arrays([self.key] * count) if count < 2 else self.key.take(pa.array([0] * count)),
            "segment_idx": pa.array([i // self.size for i in spots], pa.int64()),
            "offset": pa.array([i % self.size for i in spots], pa.int64()), "v": values})


def register_windows(spark: SparkSession, name: str = "cut_windows", key_type: str = "bigint") -> None:
    """Registers a table function over sample rows (recording_id, sample_idx, v, ...):

        SELECT * FROM cut_windows(
          TABLE(samples) PARTITION BY recording_id ORDER BY (sample_idx), size, padded)

    with rows (recording_id, segment_idx, offset, v). Samples after the last whole window are dropped;
    with `padded` a tail of more than half a window is filled with zeros. A null sample stays null.
    A recording is read in batches, so its length does not matter to memory; an empty table gives no rows.
    `key_type` is the type of recording_id.
    """
    schema = f"recording_id {key_type}, segment_idx bigint, offset bigint, v double"
    spark.udtf.register(name, F.arrow_udtf(Windows, returnType=schema))
