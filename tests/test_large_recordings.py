"""Recordings whose file would be too large stay as rows, in every query that makes files of samples."""

from conftest import SMALL
from pyspark.sql import functions as F

from shoalsong import constants as C
from shoalsong.plans import analysis
from shoalsong.plans import bindings as B


def test_too_large_recordings_are_error_rows(spark):
    limit = 180
    sizes = {r["recording_id"]: r["length"] for r in B.file_sizes(spark, SMALL).collect()}
    above = {i for i, length in sizes.items() if length > limit}
    files = B.wav_files(spark, SMALL, limit)
    rows = {r["recording_id"]: r for r in files.collect()}
    assert 0 < len(above) < len(sizes) and set(rows) == set(sizes)
    assert all(r["length"] == sizes[i] and (r["content"] is None) == (i in above) for i, r in rows.items())
    letters = analysis.dead_letters(analysis.segments_of(files.drop("recording_id"), B.SPEC, max_bytes=limit))
    found = letters.where(F.col("error_code") == C.FILE_TOO_LARGE).select("recording_id")
    assert {r[0] for r in found.collect()} == {rows[i]["path"] for i in above}


def test_files_do_not_depend_on_the_pieces(spark, monkeypatch):
    whole = {r["path"]: bytes(r["content"]) for r in B.wav_files(spark, SMALL).collect()}
    monkeypatch.setattr(B, "PIECE", 7)
    assert {r["path"]: bytes(r["content"]) for r in B.wav_files(spark, SMALL).collect()} == whole
