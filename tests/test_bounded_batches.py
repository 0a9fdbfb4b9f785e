"""Arrow steps pass on bounded batches, however many short rows come in at a time."""

import numpy as np
import pyarrow as pa
import pytest

from shoalsong.constants import SegmentSpec
from shoalsong.operators import features
from shoalsong.sources import wav


@pytest.mark.parametrize("noise", [True, False])
def test_wide_vectors_leave_a_few_at_a_time(noise):
    names, rng = ["rms", "peak", "zcr", "centroid"], np.random.default_rng(3)
    levels = rng.random((2000, 4))
    levels[7, 2] = np.nan
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), *map(pa.array, levels.T)], ["segment_idx", *names])
    step = features.vector_batches(["segment_idx"], 320, noise, 1.0)
    parts = list(step(iter([batch])))
    assert max(p.nbytes for p in parts) < 2 * features.VECTOR_BYTES < 2000 * 4 * 320 * 8
    assert [i for p in parts for i in p.column("segment_idx").to_pylist()] == list(range(2000))
    vectors = [v for p in parts for v in p.column("feature_embedding").to_pylist()]
    alone = [next(step(iter([batch.slice(i, 1)]))).column("feature_embedding").to_pylist()[0] for i in (0, 7, 1999)]
    assert [vectors[i] for i in (0, 7, 1999)] == alone and vectors[7] is None


def test_short_windows_leave_before_the_files_end():
    spec, files, windows = SegmentSpec(rate=4, seconds=1.0), 2500, 3
    data = [np.full(4 * windows, i % 100, "<i2").tobytes() for i in range(files)]
    one = {"sample_rate": 4, "channels": 1, "bits": 16, "audio_format": 1, "n_resampled": 4 * windows, "num_segments": windows}
    batch = pa.RecordBatch.from_pydict({
        "recording_id": [f"r{i}" for i in range(files)], "data": pa.array(data, pa.binary()),
        **{k: [v] * files for k, v in one.items()},
        "error_code": pa.array([None] * files, pa.string()), "error": pa.array([None] * files, pa.string())})
    parts = list(wav.cut_batches(spec)(iter([batch])))
    assert max(p.num_rows for p in parts) <= wav.HELD_WINDOWS < files * windows
    rows = [(r["recording_id"], r["segment_idx"], r["samples"]) for p in parts for r in p.to_pylist()]
    assert rows == [(f"r{i}", j, [i % 100 / 32768] * 4) for i in range(files) for j in range(windows)]
