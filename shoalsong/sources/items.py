"""Keyed job items as a table of files: appended as they come, folded per bucket, found by key.

An item table is a folder with

* `deltas/`: one folder per append, put and update rows as they came;
* `base/`: folders with one merged change per item (`status.merged_changes`), in
  buckets by a hash of (pk, sk); the rows of a file are sorted by key and have a
  Bloom filter on pk;
* `manifest/version=N`: which deltas, and which folder per bucket, make up
  version N. A version appears with the commit of its one file, so a reader
  sees the one before or the one after, whatever is being written.

Reading merges base and deltas. Compaction merges the
deltas into the buckets they touch; other buckets stay the files they are. So
the work of a read is bounded by what came since the last compaction, and a
look-up opens the deltas and the buckets of its keys. Old folders are kept for
readers of old versions until `vacuum`. One writer at a time.
"""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalsong import schemas
from shoalsong.operators import status
from shoalsong.sources.recordings import open_folder
from shoalsong.sources.tables import read_if_present

BUCKETS = 64
#: Keys of a look-up that are given to the scan as a condition; more are joined.
PUSHED_KEYS = 1000

MANIFEST = "version bigint, bucket int, folder string"
KEYS = ("pk", "sk")
ITEM_COLUMNS = [n for n in schemas.JOB_ITEM.names if n != "op"]


def bucket_of(buckets: int) -> Column:
    """The bucket of an item."""
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket")


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[str], dict[int, str]]:
    """(version, folders of deltas in order, folder of each bucket) of the newest version, or of a given one."""
    rows = read_if_present(spark, f"{path}/manifest", MANIFEST, basePath=f"{path}/manifest")
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    if not version:
        return 0, [], {}
    # A row per bucket and per append since the last compaction.
    found = rows.where(F.col("version") == version).orderBy("folder").collect()
    deltas = sorted(r["folder"] for r in found if r["bucket"] < 0 and r["folder"])
    return version, deltas, {r["bucket"]: r["folder"] for r in found if r["bucket"] >= 0}


def _publish(spark: SparkSession, path: str, version: int, deltas: list[str], base: dict[int, str]) -> None:
    rows = [(-1, d) for d in deltas] + sorted(base.items()) or [(-1, "")]
    table = spark.createDataFrame(rows, "bucket int, folder string").coalesce(1)
    table.write.mode("error").parquet(f"{path}/manifest/version={version}")


def _new(kind: str, number: int) -> str:
    return f"{kind}/{number:012d}-{uuid.uuid4().hex[:8]}"


def complete(items: DataFrame) -> DataFrame:
    """The rows with all columns of `schemas.JOB_ITEM`."""
    return items.select(*[
        (F.col(f.name) if f.name in items.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.JOB_ITEM.fields])


def append_items(items: DataFrame, path: str) -> None:
    """Add put and update rows (`schemas.JOB_ITEM`); attributes that are missing are null. A failed append
    leaves no trace in the table."""
    spark = items.sparkSession
    version, deltas, base = _manifest(spark, path)
    folder = _new("deltas", version + 1)
    complete(items).write.parquet(f"{path}/{folder}")
    _publish(spark, path, version + 1, [*deltas, folder], base)


def _changes(spark: SparkSession, path: str, deltas: list[str], base: list[str]) -> DataFrame:
    """What these folders hold, as changes: those of deltas as they came, those of the base merged already."""
    empty = status.item_changes(spark.createDataFrame([], schemas.JOB_ITEM))
    found = empty
    if deltas:
        raw = spark.read.schema(schemas.JOB_ITEM).parquet(*[f"{path}/{f}" for f in deltas])
        found = found.unionByName(status.item_changes(raw))
    if base:
        found = found.unionByName(spark.read.schema(empty.schema).parquet(*[f"{path}/{f}" for f in sorted(base)]))
    return found


def _items(changes: DataFrame) -> DataFrame:
    return status.items_of(changes).select(*ITEM_COLUMNS)


def read_items(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The items as they are after all puts and updates, one row per (pk, sk); empty if there is no table."""
    _, deltas, base = _manifest(spark, path, version)
    changes = _changes(spark, path, deltas, [f for f in base.values() if f])
    return _items(status.merged_changes(changes) if deltas else changes)


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The current items of the given (pk, sk). Opens the deltas and, of the base, the buckets of the keys;
    up to PUSHED_KEYS keys reach the scan, where statistics and Bloom filters pass over row groups."""
    _, deltas, base = _manifest(spark, path)
    wanted = keys.select(*KEYS).distinct()
    few = wanted.limit(PUSHED_KEYS + 1).collect()
    touched = [r["bucket"] for r in wanted.select(bucket_of(len(base))).distinct().collect()] if base else []  # one per bucket
    changes = _changes(spark, path, deltas, [base[b] for b in touched if base[b]])
    if len(few) <= PUSHED_KEYS:
        changes = changes.where(F.col("pk").isin(sorted({r["pk"] for r in few if r["pk"] is not None})))
        wanted = F.broadcast(spark.createDataFrame(few, "pk string, sk string"))
    found = changes.join(wanted, list(KEYS), "left_semi")
    return _items(status.merged_changes(found) if deltas else found)


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Fold the deltas into the base: only buckets with new rows are written again.

    The base keeps the time of every attribute, so what comes later than it
    happened is put in its place as if it had come in time. The number of
    buckets is that of the first compaction. An item with a third of all rows
    costs one row per task, as its rows are combined before the shuffle.
    """
    version, deltas, base = _manifest(spark, path)
    if not deltas:
        return
    buckets = len(base) or buckets
    touched = [r["bucket"] for r in _changes(spark, path, deltas, []).select(bucket_of(buckets)).distinct().collect()]
    changes = _changes(spark, path, deltas, [base[b] for b in touched if base.get(b)])
    folded = status.merged_changes(changes).withColumn("bucket", bucket_of(buckets))
    folder = _new("base", version + 1)
    # Ranges of (bucket, key): a bucket is in one file or a few, each with a narrow range of keys.
    dealt = folded.repartitionByRange(max(1, len(touched)), "bucket", *KEYS).sortWithinPartitions("bucket", *KEYS)
    (dealt.write.option("parquet.bloom.filter.enabled#pk", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
     .option("parquet.block.size", 16 << 20).partitionBy("bucket").parquet(f"{path}/{folder}"))
    # Buckets without rows are listed too, so that their number stays.
    whole = {b: base.get(b, "") for b in range(buckets)} | {b: f"{folder}/bucket={b}" for b in touched}
    _publish(spark, path, version + 1, [], whole)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the folders that none of the newest `keep` versions names."""
    newest = _manifest(spark, path)[0]
    kept = set()
    for version in range(max(1, newest - keep + 1), newest + 1):
        _, deltas, base = _manifest(spark, path, version)
        kept |= {f for f in [*deltas, *base.values()] if f}
    system, root = open_folder(path)
    for kind, depth in (("deltas", 2), ("base", 3)):
        found = system.get_file_info(fs.FileSelector(posixpath.join(root, kind), recursive=True, allow_not_found=True))
        for info in found:
            name = posixpath.relpath(info.path, root)
            if info.type == fs.FileType.Directory and name.count("/") == depth - 1 and name not in kept:
                system.delete_dir(info.path)
