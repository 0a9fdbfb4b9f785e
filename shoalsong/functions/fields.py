"""Column expressions for names, keys, labels and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalsong import constants as C


def status_of(site_type: Column) -> Column:
    """Health status of a site type code; any other code is unknown."""
    names = F.create_map(*[F.lit(x) for pair in C.CATEGORIES for x in pair])
    return F.coalesce(F.try_element_at(names, site_type), F.lit(C.UNKNOWN_STATUS))


def filename_parts(filename: Column) -> Column:
    """country, site, site_type, site_id and recorded_at of `country_site_date_time.ext`."""
    base = F.element_at(F.split(filename, "/"), -1)
    # A leading dot does not start an extension, as in path libraries.
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    parts = F.split(stem, "_")
    named = F.size(parts) >= 2
    country = F.when(named, F.get(parts, F.lit(0))).otherwise(F.lit(C.UNKNOWN_SITE))
    site = F.when(named, F.get(parts, F.lit(1))).otherwise(F.lit(C.UNKNOWN_SITE))
    code = F.when(named, F.coalesce(F.nullif(F.substring(site, 1, 1), F.lit("")), F.lit(C.UNKNOWN_SITE_TYPE)))
    stamp = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)))
    return F.struct(
        country.alias("country"),
        site.alias("site"),
        F.coalesce(code, F.lit(C.UNKNOWN_SITE_TYPE)).alias("site_type"),
        F.concat_ws("_", country, site).alias("site_id"),
        F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).alias("recorded_at"),
    )


def display_label(value: Column) -> Column:
    return F.initcap(F.replace(F.coalesce(value, F.lit("Unknown")), F.lit("_"), F.lit(" ")))


def upload_key(upload_id: Column) -> Column:
    return F.concat(F.lit("UPLOAD#"), upload_id.cast("string"))


def analysis_key(analysis_id: Column) -> Column:
    return F.concat(F.lit("ANALYSIS#"), analysis_id.cast("string"))


def key_kind(key: Column) -> Column:
    return F.split_part(key, F.lit("#"), F.lit(1))


def key_id(key: Column) -> Column:
    return F.split_part(key, F.lit("#"), F.lit(2))


def path_id(path: Column) -> Column:
    """Last element of a slash-separated path."""
    return F.element_at(F.split(path, "/"), -1)


def caveat(synthetic: Column) -> Column:
    return F.concat(
        F.lit(C.CAVEAT),
        F.when(synthetic, F.lit(C.SYNTHETIC_CAVEAT)).otherwise(F.lit("")),
    )


def site_defaults() -> list[Column]:
    """Reference columns with the published defaults for missing values."""
    return [
        F.coalesce("site_id", F.lit(C.UNKNOWN_SITE)).alias("site_id"),
        F.coalesce("country", F.lit(C.UNKNOWN_COUNTRY)).alias("country"),
        F.coalesce("site_type", F.lit(C.UNKNOWN_SITE_TYPE)).alias("site_type"),
    ]


def upload_defaults(upload_id: Column) -> list[Column]:
    generated = F.concat(F.lit("upload_"), upload_id.cast("string"), F.lit(".wav"))
    return [
        F.coalesce("filename", generated).alias("filename"),
        F.coalesce("content_type", F.lit(C.DEFAULT_CONTENT_TYPE)).alias("content_type"),
    ]


def round_leaves(column: Column, dtype: T.DataType, decimals: int = C.STORED_DECIMALS) -> Column:
    """Round every floating-point leaf of a nested value, keeping its shape."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.round(column, decimals)
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: round_leaves(x, dtype.elementType, decimals))
    if isinstance(dtype, T.MapType):
        return F.transform_values(column, lambda _, v: round_leaves(v, dtype.valueType, decimals))
    if isinstance(dtype, T.StructType):
        fields = [round_leaves(column[f.name], f.dataType, decimals).alias(f.name) for f in dtype.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def decimal_leaf(column: Column) -> Column:
    """Storage form of a rounded number."""
    return F.round(column, C.STORED_DECIMALS).cast(T.DecimalType(20, C.STORED_DECIMALS))
