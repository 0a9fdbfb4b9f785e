"""Stored tables: segments, reference index, job log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalsong import constants as C
from shoalsong import schemas
from shoalsong.sources import json_arrays


def read_if_present(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """The table at `path`, or an empty one of the same schema if there is none."""
    try:
        return spark.read.format(fmt).schema(schema).options(**options).load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments are large rows; readers that leave out `samples` skip their bytes."""
    segments.write.mode("overwrite").option("parquet.block.size", 64 << 20).parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return read_if_present(spark, path, schemas.SEGMENT)


def write_references(refs: DataFrame, path: str) -> None:
    refs.select(*schemas.REFERENCE_ENTRY.names).write.mode("overwrite").parquet(path)


def load_references(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The reference index; `fmt="json"` reads one JSON array per file.

    A JSON index is read by byte ranges in many tasks, and the position of an
    entry, over all files by path, serves as its ref_id. An entry that is no
    valid JSON has a ref_id and nulls.
    """
    if fmt == "parquet":
        return read_if_present(spark, path, schemas.REFERENCE_ENTRY)
    documents = "filename string, site_id string, country string, site_type string, num_segments bigint, " \
                "embedding_file string, mean_embedding array<double>"
    entry = F.from_json("text", documents)
    read = json_arrays.read_objects(spark, path).select(F.col("position").alias("ref_id"), entry.alias("e"))
    return read.select(
        "ref_id", "e.filename", "e.site_id", "e.country", "e.site_type", "e.num_segments",
        F.col("e.mean_embedding").alias("embedding"))


def append_log(items: DataFrame, path: str) -> None:
    """Add put and update items; nothing is overwritten, the latest row of a key counts."""
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.JOB_LOG.fields]
    items.select(*typed).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read_if_present(spark, path, schemas.JOB_LOG)


def lookup_items(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Items whose (pk, sk) is wanted."""
    return items.join(keys.select("pk", "sk").distinct(), ["pk", "sk"], "left_semi")


def lookup_item(items: DataFrame, pk: str, sk: str) -> DataFrame:
    """One key; the filter reaches the file scan."""
    return items.where((F.col("pk") == pk) & (F.col("sk") == sk))


def reference_sites(spark: SparkSession) -> DataFrame:
    """The published site list."""
    return spark.createDataFrame(list(C.REFERENCE_SITES), schemas.SITE)


def country_names(spark: SparkSession) -> DataFrame:
    """Country code, as in file names, to country name."""
    return spark.createDataFrame(list(C.COUNTRY_NAMES), "code string, name string")
