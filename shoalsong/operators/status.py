"""Job metadata: an append-only log of (pk, sk) items and what follows from it.

Current state is an aggregate over the log (max_by with map-side combine), not
a window, so a key with any number of updates costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalsong import constants as C


def latest_state(log: DataFrame, *keys: str) -> DataFrame:
    """Last write per key (default pk, sk), ordered by time, then event_id."""
    keys = keys or ("pk", "sk")
    rest = [c for c in log.columns if c not in keys]
    order = F.struct("ts", "event_id")
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*keys, "_s.*")


ITEM_TIME = ("ts", "event_id")


def item_changes(log: DataFrame, *keys: str) -> DataFrame:
    """Each row of a log with `op`, "put" or "update", as a change: `put_at`, when it was a put, `last`, its
    time, and each attribute with its time. Changes of an item merge by `merged_changes`, in any order."""
    keys = keys or ("pk", "sk")
    time = F.struct(*ITEM_TIME)
    rest = [c for c in log.columns if c not in (*keys, *ITEM_TIME, "op")]
    return log.select(
        *keys, F.when(F.col("op") == "put", time).alias("put_at"), time.alias("last"),
        *[F.when(F.col(c).isNotNull(), F.struct(time.alias("at"), F.col(c).alias("value"))).alias(c) for c in rest])


def merged_changes(changes: DataFrame, *keys: str) -> DataFrame:
    """One change per item: the last put, and the newest value of each attribute. Combined before the shuffle."""
    keys = keys or ("pk", "sk")
    return changes.groupBy(*keys).agg(*[F.max(c).alias(c) for c in changes.columns if c not in keys])


def items_of(merged: DataFrame, *keys: str) -> DataFrame:
    """The items that merged changes make: a value older than the last put is gone."""
    keys = keys or ("pk", "sk")
    rest = [c for c in merged.columns if c not in (*keys, "put_at", "last")]
    kept = [F.when(F.col("put_at").isNull() | (F.col(c)["at"] >= F.col("put_at")), F.col(c)["value"]).alias(c) for c in rest]
    return merged.select(*keys, *[F.col("last")[t].alias(t) for t in ITEM_TIME], *kept)


def current_items(log: DataFrame, *keys: str) -> DataFrame:
    """Items after all puts and updates of a log with `op`, "put" or "update".

    A put replaces the item; an update sets the attributes it names, those that
    are not null, and leaves the others as they are. Per attribute that is the
    newest value that is not null among the last put and what follows it.
    """
    return items_of(merged_changes(item_changes(log, *keys), *keys), *keys)


def status_flags(log: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Which items exist per analysis; also the state kept by the streaming form."""
    def has(sk):
        return F.coalesce(F.bool_or(F.col("sk") == sk), F.lit(False))

    return log.groupBy(key).agg(
        has("RESULT").alias("has_result"),
        has("PREPROCESSED").alias("has_preprocessed"),
        has("ERROR").alias("has_error"),
        F.max_by(F.when(F.col("sk") == "ERROR", F.col("error")),
                 F.when(F.col("sk") == "ERROR", F.struct("ts", "event_id"))).alias("last_error"),
    )


def with_status(flags: DataFrame, errors_first: bool = False) -> DataFrame:
    """Add `status` and `error` by precedence.

    A result wins over a preprocessed item, which wins over an error: an error
    after preprocessing stays hidden, as published. `errors_first` shows it.
    """
    complete, processing, failed = F.col("has_result"), F.col("has_preprocessed"), F.col("has_error")
    if errors_first:
        status = F.when(complete, "complete").when(failed, "failed").when(processing, "processing")
    else:
        status = F.when(complete, "complete").when(processing, "processing").when(failed, "failed")
    return (
        flags.withColumn("status", F.coalesce(status, F.lit("not_found")))
        .withColumn("error", F.when(F.col("status") == "failed", F.col("last_error"))
                    .when(F.col("status") == "not_found", F.lit(C.ANALYSIS_NOT_FOUND)))
        .drop("has_result", "has_preprocessed", "has_error", "last_error")
    )


def resolve_status(requests: DataFrame, log: DataFrame, key: str = "analysis_id",
                   errors_first: bool = False) -> DataFrame:
    """Status of every requested analysis; unknown ones are `not_found`. Only
    the log rows of requested analyses are aggregated."""
    flags = status_flags(log.join(requests.select(key), key, "left_semi"), key)
    joined = requests.select(key).join(flags, key, "left")
    return with_status(joined.fillna(False, ["has_result", "has_preprocessed", "has_error"]), errors_first)


def answers(requests: DataFrame, log: DataFrame, results: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Status of every request, with the result document where it is complete."""
    documents = results.drop("status")
    return resolve_status(requests, log, key).join(documents, key, "left").select(
        key, "status", "error",
        *[F.when(F.col("status") == "complete", F.col(c)).alias(c) for c in documents.columns if c != key])


def matched_requests(requests: DataFrame, uploads: DataFrame, key: str = "upload_id") -> DataFrame:
    return requests.join(uploads.select(key), key, "left_semi")


def orphan_requests(requests: DataFrame, uploads: DataFrame, key: str = "upload_id") -> DataFrame:
    return requests.join(uploads.select(key), key, "left_anti").withColumn("error_code", F.lit(C.UPLOAD_NOT_FOUND))


def required_field(requests: DataFrame, column: str, field: str, error_code: str = C.MISSING_UPLOAD_ID) -> DataFrame:
    """Parse `field` out of a JSON body; a missing or empty value gets the error
    code, a body that is not JSON the code of a request that failed."""
    value = F.get_json_object(column, f"$.{field}")
    malformed = F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull()
    return requests.withColumn(field, value).withColumn(
        "error_code", F.when(malformed, F.lit(C.ANALYZE_FAILED))
        .when(value.isNull() | (value == ""), F.lit(error_code)))


def lifecycle_of_log(log: DataFrame, upload: str = "upload_id", key: str = "analysis_id") -> DataFrame:
    """As `upload_lifecycle`, of items of one log (sk, upload_id, analysis_id, ...), where an upload has one analysis.

    One aggregate by upload, combined before the shuffle; nothing is joined. Items without an upload id,
    and of uploads that left no METADATA, are no uploads.
    """
    def seen(sk: str) -> Column:
        return F.coalesce(F.bool_or(F.col("sk") == sk), F.lit(False))

    flags = log.where(F.col(upload).isNotNull()).groupBy(upload).agg(
        seen("METADATA").alias("_known"), seen("RESULT").alias("_done"),
        F.max(F.when(F.col("sk") == "PREPROCESSED", F.col(key))).alias(key))
    linked = F.col(key).isNotNull()
    status = F.when(linked & F.col("_done"), "complete").when(linked, "processing").otherwise("uploaded")
    return flags.where("_known").select(upload, key, status.alias("status"))


def upload_lifecycle(uploads: DataFrame, analyses: DataFrame, results: DataFrame, key: str = "upload_id") -> DataFrame:
    """Uploads with their linked analysis and the status that follows:
    uploaded, processing once linked, complete once a result exists."""
    return (
        uploads.join(analyses, key, "left")
        .join(results.select("analysis_id").distinct().withColumn("_done", F.lit(True)), "analysis_id", "left")
        .withColumn("status", F.when(F.col("_done"), "complete")
                    .when(F.col("analysis_id").isNotNull(), "processing").otherwise("uploaded"))
        .drop("_done")
    )
