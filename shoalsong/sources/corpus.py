"""Collections of recording files."""

from __future__ import annotations

import posixpath
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalsong import schemas


def scan_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """All .wav files below a folder; content is read only where it is used.

    Spark's file scans pass over files of length zero.
    """
    return (
        spark.read.format("binaryFile").schema(schemas.RECORDING_FILE)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(folder)
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def below(path: Column, root: str | None) -> Column:
    """The path below a scan root: what tells recordings of one corpus apart, as files in
    different folders may share a name. Without a root, or outside of it, the path itself."""
    if root is None:
        return path
    scheme = r"^[A-Za-z][\w+.-]*:/*|^/+"
    plain = F.regexp_replace(path, scheme, "/")
    prefix = re.sub(scheme, "/", root).rstrip("/") + "/"
    return F.when(plain.startswith(prefix), F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))).otherwise(path)


def export_recordings(files: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content) as one file each; yields (path, length).

    Tasks write straight to the file system of `folder`. A file's path depends
    on its name alone, so a repeated task replaces what a lost one left.
    """
    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if re.match(r"\w[\w+.-]*:", folder) else "file://" + folder)
        for batch in batches:
            paths, lengths = [], []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                path = posixpath.join(root, name)
                system.create_dir(posixpath.dirname(path), recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content.as_buffer())
                paths.append(path)
                lengths.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["path", "length"])

    return files.select("name", "content").mapInArrow(run, "path string, length bigint")


def with_prefix(objects: DataFrame, path: str = "path") -> DataFrame:
    """Adds `bucket`, the authority of a path such as s3a://bucket/prefix/name, and `prefix`, its first
    folder. A path without an authority has a null bucket, an object in no folder an empty prefix."""
    bucket = F.nullif(F.regexp_extract(path, "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1), F.lit(""))
    key = F.regexp_replace(path, "^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/*", "")
    return objects.withColumn("bucket", bucket).withColumn("prefix", F.regexp_extract(key, "^([^/]+)/", 1))


def storage_rollup(objects: DataFrame, *prefix: str, size: str = "length") -> DataFrame:
    """Objects and bytes per prefix; on a file scan no content is read."""
    return objects.groupBy(*prefix).agg(
        F.count(F.lit(1)).alias("objects"), F.sum(size).cast("bigint").alias("bytes"))
