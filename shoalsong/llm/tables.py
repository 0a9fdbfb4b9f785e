"""Helpers that several operators share: staged tables, running totals, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoalsong.sources.workspace import new_folder

# A table is broadcast up to this many rows of at most 32 bytes; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: later uses don't repeat the work,
    a lost executor loses nothing, and Spark knows the size when it plans joins."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A hint for tables of ids and numbers, given only if a count shows that they are small."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many _ behind it as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in range(len(taken) + 1) if (n := name + "_" * i).lower() not in taken) for name in names]


def not_null_key(column: Column) -> Column:
    """A string for grouping and joining: null is a value of its own, "" does not equal it."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same key that come before in `order`.

    Exact for keys of any size: rows are dealt by ranges of (key, order), so a
    large key lies in many partitions; each is summed on its own, and the sums
    of earlier partitions, at most one row per key and partition, are added.
    Keys must not be null. Rows equal in key and order follow in any order, but
    in one that is fixed for this call. Columns starting with _ are reserved.
    """
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(df.sparkSession), *keys, *order, "_tie")
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), "running")
    group = [*keys, "_part"]
    sums = dealt.groupBy(*group).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    inside = W.partitionBy(*group).orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(carry, group).withColumn(out, F.col("_local") + F.col("_carry")).select(*df.columns, out)


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, root) for every id of `edges` (a, b): root is the smallest id reachable.

    Alternates large and small stars. Each step is grouped minimums and joins
    on them, so no group of neighbours is ever in one place; the edges of a
    step are written, so its lineage is one read.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = staged(ordered.distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v")))
        now = staged(small.distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root").union(
        now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
