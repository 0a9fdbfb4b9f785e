"""Dashboard and usage roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalsong import constants as C

STATUSES = [status for _, status in C.CATEGORIES]


def filter_sites(sites: DataFrame, country: str = "All", status: str = "All") -> DataFrame:
    """`All` leaves a column unfiltered."""
    if country != "All":
        sites = sites.where(F.col("country") == country)
    if status != "All":
        sites = sites.where(F.col("status") == status)
    return sites


def enrich_sites(entries: DataFrame, countries: DataFrame, code: str = "country") -> DataFrame:
    """Country code to name; an unknown code keeps the default name. The country
    table is left to Spark's size-based choice of join."""
    names = countries.select(F.col("code").alias(code), F.col("name").alias("country_name"))
    return entries.join(names, code, "left").withColumn(
        "country_name", F.coalesce("country_name", F.lit(C.UNKNOWN_COUNTRY)))


def status_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy(F.coalesce("status", F.lit(C.UNKNOWN_STATUS)).alias("status")).agg(
        F.count(F.lit(1)).alias("sites"))


def site_metrics(sites: DataFrame) -> DataFrame:
    status = F.col("status")
    return sites.agg(
        F.count(F.lit(1)).alias("total_sites"),
        F.count_if(status == "healthy").alias("healthy"),
        F.count_if(status == "degraded").alias("degraded"),
        F.count_if(status.isin("restored_early", "restored_mid")).alias("restored"),
    )


def country_status_pivot(sites: DataFrame) -> DataFrame:
    """One column per status, of which `unknown` takes null and any other value;
    the values are given, so no pass collects them."""
    names = [*STATUSES, C.UNKNOWN_STATUS]
    known = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise(F.lit(C.UNKNOWN_STATUS))
    return (sites.withColumn("status", known).groupBy("country").pivot("status", names).agg(F.count(F.lit(1)))
            .na.fill(0, names))


def value_counts(sites: DataFrame, *columns: str) -> DataFrame:
    """Counts per value of each column, most frequent first."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]))
    return (sites.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("field", F.desc("n"), "value"))


def distinct_values(sites: DataFrame, column: str) -> DataFrame:
    return sites.select(column).distinct().orderBy(column)


def recent_errors(logs: DataFrame, functions: DataFrame, hours: int = 1) -> DataFrame:
    """Errors per function in the hours before the newest log row; functions
    without any stay with 0."""
    newest = logs.agg(F.max("ts").alias("now")).scalar()
    counts = (
        logs.where((F.col("level") == "ERROR") & (F.col("ts") > newest - F.expr(f"interval {hours} hours")))
        .groupBy("function").agg(F.count(F.lit(1)).alias("errors"))
    )
    return functions.join(counts, "function", "left").fillna(0, ["errors"])


def item_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("items"))


def _month(ts: str) -> Column:
    return F.date_format(F.date_trunc("month", ts), "yyyy-MM").alias("month")


def monthly_cost(costs: DataFrame, service: str = "service", ts: str = "ts", amount: str = "amount") -> DataFrame:
    return costs.groupBy(_month(ts), service).agg(F.sum(amount).alias("cost"))


def compute_metering(
    invocations: DataFrame,
    rate: float = C.GB_SECOND_RATE,
    free_gb_seconds: float = C.FREE_GB_SECONDS,
    request_rate: float = C.REQUEST_RATE,
    free_requests: int = C.FREE_REQUESTS,
) -> DataFrame:
    """GB-seconds, requests and cost beyond the free tier per month."""
    usage = invocations.groupBy(_month("ts")).agg(
        F.sum(F.col("memory_mb") / 1024 * F.col("seconds")).alias("gb_seconds"),
        F.count(F.lit(1)).alias("requests"),
    )
    return usage.withColumn(
        "cost",
        F.greatest(F.lit(0.0), F.col("gb_seconds") - free_gb_seconds) * rate
        + F.greatest(F.lit(0), F.col("requests") - free_requests) * request_rate,
    )


def index_build_stats(files: DataFrame) -> DataFrame:
    """Files seen, files that gave segments, and segments, by country and site type."""
    return files.groupBy("country", "site_type").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("num_segments") > 0).alias("files_ok"),
        F.sum("num_segments").cast("bigint").alias("segments"),
    )
