"""References are built of whole recordings: the size limit of uploads does not hold for them."""

import dataclasses

import duckdb
import numpy as np
import pytest
from compare import difference
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shoalsong.plans import analysis
from shoalsong.plans import bindings as B
from shoalsong.plans import queries as Q
from shoalsong.sources import tables

# Samples of each recording; keys give the rates 4, 2 and 8, so a window has 16, 8 or 32 samples.
SIZES = {0: 16 * 7, 1: 8 * 7 + 3, 2: 32 * 5 + 31, 3: 16 * 4 + 1, 4: 5, 5: 32 * 6, 6: 16, 7: 8 * 4, 8: 32 * 4 + 1}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("events")), np.random.default_rng(4)
    rows = [(int(u), i, float(rng.normal(50, 300))) for u, n in SIZES.items() for i in range(n)]
    con = duckdb.connect()
    con.execute("CREATE TABLE given (user_id BIGINT, i BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?)", [rows[k] for k in rng.permutation(len(rows))])
    con.execute(f"""COPY (SELECT user_id * 1000 + i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i // 2) AS ts, user_id,
                    'view' AS event_type, value, '{{}}' AS props FROM given) TO '{path}/events.parquet' (FORMAT parquet)""")
    return path


@pytest.mark.parametrize("windows", [1, 2, 3, 256])
def test_references_of_any_size(spark, folder, monkeypatch, windows):
    monkeypatch.setattr(B.wav_files, "__defaults__", (100,))
    monkeypatch.setattr(B, "PART_WINDOWS", windows, raising=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert difference(Q.build_ref_tables(spark, folder), con, entry.oracle_sql()["build_ref_tables"]) is None


def test_parts_have_the_windows_of_the_whole(spark, folder, monkeypatch):
    monkeypatch.setattr(B, "PART_WINDOWS", 2)
    free = dataclasses.replace(B.SPEC, min_seconds=0.0, max_seconds=float("inf"))

    def windows(files):
        good = analysis.good_segments(analysis.segments_of(files.drop("recording_id"), free))
        return sorted(tuple(r) for r in good.select("recording_id", "segment_idx", "num_segments", "total_duration", "samples").collect())

    whole, parts = B.wav_files(spark, folder), B.file_parts(spark, folder)
    assert windows(parts) == windows(whole)
    sizes = {r["path"]: r["length"] for r in whole.collect()}
    rows = parts.select("path", "length", "part.first").collect()
    assert {r["path"]: r["length"] for r in rows} == sizes and len(rows) == len({(r["path"], r["first"]) for r in rows}) > len(sizes)


@pytest.mark.parametrize("content", [None, b"RIFF"])
def test_a_recording_without_one_of_its_parts_is_no_reference(spark, folder, monkeypatch, tmp_path, content):
    monkeypatch.setattr(B, "PART_WINDOWS", 2)
    names = {r["recording_id"]: r["path"] for r in B.file_parts(spark, folder).collect()}
    parts, path = B.file_parts(spark, folder).drop("recording_id"), F.col("path")
    for key, first in ((0, 2), (5, 4)):
        hit = (path == names[key]) & (F.col("part.first") == first)
        parts = parts.where(~hit) if content is None else parts.withColumn("content", F.when(hit, F.lit(content)).otherwise(F.col("content")))
    seen = analysis.build_reference_tables(parts, B.SPEC, Q._block_means, str(tmp_path), width=4).collect()
    expected = {0: 0, 1: 7, 2: 5, 3: 4, 4: 0, 5: 0, 6: 1, 7: 4, 8: 4}
    assert len(seen) == len(SIZES) and {r["filename"]: r["num_segments"] for r in seen} == {names[k]: n for k, n in expected.items()}
    index = tables.load_references(spark, str(tmp_path / "index"))
    assert {r["filename"] for r in index.collect()} == {names[k] for k, n in expected.items() if n}
