"""Column functions that bring names, types and values into one form.  Parsing never fails: it gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of the logical type vocabulary and of truth values.
INT_NAMES = ("int", "integer", "bigint", "smallint", "tinyint", "long", "short", "byte", "int64", "int32")
FLOAT_NAMES = ("float", "double", "decimal", "number", "numeric", "real", "float64", "float32")
BOOL_NAMES = ("bool", "boolean")
DATETIME_NAMES = ("datetime", "date", "time", "timestamp")
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f", "")


def norm_name(c: Column) -> Column:
    """Trimmed, lower case, runs of other characters than a-z and 0-9 as one inner `_`."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_\-]+", "_")


def logical_type(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c)), r"\(.*$", "")
    return F.when(t.isin(*INT_NAMES), "int").when(t.isin(*FLOAT_NAMES), "float").when(t.isin(*BOOL_NAMES), "bool").when(t.isin(*DATETIME_NAMES), "datetime").otherwise("string")


def to_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def to_double(c: Column) -> Column:
    """Plain numbers, with currency signs, thousands commas and blanks dropped and (n) as -n; names, dates and times are none."""
    t = F.trim(c)
    plain = F.regexp_replace(t, r"[,$€£¥₹ ]", "")
    signed = F.regexp_replace(plain, r"^\((.*)\)$", "-$1")
    marks = F.length(t) - F.length(F.regexp_replace(t, "[-/]", ""))
    return F.when(t.rlike("[A-Za-z:]") | (marks >= 2), F.lit(None).cast("double")).otherwise(signed.try_cast("double"))


def to_timestamp(c: Column) -> Column:
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy")
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats))


def utc_iso(c: Column) -> Column:
    """A timestamp in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def cast_to_rule(c: Column, dtype: str) -> Column:
    """A value as the text that a rule of this type compares: integers are rounded half to even."""
    if dtype == "integer":
        return F.bround(c.cast("string").try_cast("double")).cast("long").cast("string")
    if dtype == "float":
        return c.cast("string").try_cast("double").cast("string")
    return c.cast("string")


def unique_names(columns: DataFrame, name: str, order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """columns with `unique_name`: the first of equal names as it is, the next with _1, _2 and so on."""
    at = F.row_number().over(Window.partitionBy(*within, name).orderBy(order))  # names of columns
    return columns.withColumn("_k", at).withColumn("unique_name", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat_ws("_", name, F.col("_k") - 1))).drop("_k")


def canonical_schema(documents: DataFrame, column: str) -> DataFrame:
    """JSON schema documents as (dataset, version, pos, name, type, nullable, primary_key, description).

    Names are normalised, blank ones left out, of equal ones the first stays; what is not given is
    nullable, no key and of version v0.
    """
    shape = "dataset string, name string, version string, columns array<struct<name:string,type:string,nullable:string,primary_key:string,description:string>>"
    d = documents.select(F.from_json(column, shape).alias("d")).select("d.*")
    rows = d.select(F.coalesce("dataset", "name", F.lit("dataset")).alias("dataset"), F.coalesce("version", F.lit("v0")).alias("version"), F.posexplode("columns").alias("pos", "c")).withColumn("name", norm_name(F.col("c.name"))).where("name <> ''")
    first = F.row_number().over(Window.partitionBy("dataset", "version", "name").orderBy("pos"))
    rows = rows.withColumn("_k", first).where("_k = 1")
    truth = lambda c, other: F.coalesce(to_bool(F.col(c)), F.lit(other))
    return rows.select("dataset", "version", "pos", "name", F.coalesce(logical_type(F.col("c.type")), F.lit("string")).alias("type"), truth("c.nullable", True).alias("nullable"), truth("c.primary_key", False).alias("primary_key"), F.coalesce("c.description", F.lit("")).alias("description"))


# Fixed value: parts of names that suggest a key field.
KEY_PARTS = "^id$|_id$|customer|user|device|timestamp|time$|date$|amount|price|total|email"


def key_suggestions(names: DataFrame, by: str, name: str, most: int = 12) -> DataFrame:
    """(by, keys): of each group's names the first `most`, in order, that look like key fields."""
    some = names.where(F.col(name).rlike("(?i)" + KEY_PARTS)).select(by, name).distinct()
    at = F.row_number().over(Window.partitionBy(by).orderBy(name))
    return some.withColumn("_k", at).where(F.col("_k") <= most).groupBy(by).agg(F.sort_array(F.collect_list(name)).alias("keys"))


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Nulls, and columns that rows lack, filled with defaults."""
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in defaults.items()})
