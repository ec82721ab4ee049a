"""Column profiles and observed schemas of many batches at once.

A batch is rows (dataset, batch_id, row_no, payload map<string,string>); profiles are a long table keyed
(dataset, batch_id, column), from one aggregation over exploded cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions import normalise as N

BATCH = ("dataset", "batch_id")


def cells(batches: DataFrame) -> DataFrame:
    return batches.select(*BATCH, "row_no", F.explode("payload").alias("name", "value")).withColumn("column", N.norm_name(F.col("name")))


def column_facts(batches: DataFrame) -> DataFrame:
    """(dataset, batch_id, column, present, null_rate, type, nullable, mean, std, min, max).

    Types by the share of all rows that parse: over 0.8 numbers are float, of which over 0.95 whole are
    int; then timestamps, else string.  Truth words come first of all, and before numbers the timestamps of a
    column whose name speaks of a date or time.  A key that a row lacks is a null there.
    """
    rows = batches.groupBy(*BATCH).agg(F.count("*").alias("n_rows"))
    value = F.col("value")
    number, time = N.to_double(value), N.to_timestamp(value)
    truth = value.isNotNull() & F.lower(F.trim(value)).isin("true", "false")
    facts = cells(batches).groupBy(*BATCH, "column").agg(
        F.count("value").alias("n"),
        F.count(number).alias("n_number"),
        F.count_if(number == F.floor(number)).alias("n_whole"),
        F.count(time).alias("n_time"),
        F.count_if(truth).alias("n_truth"),
        F.avg(number).alias("mean"),
        F.stddev_pop(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
    )
    joined = facts.join(rows, list(BATCH))
    share = lambda c: F.col(c) / F.col("n_rows")
    dated = F.col("column").rlike("date|time|_dt|_ts") & (share("n_time") > 0.8)
    kind = F.when(share("n_truth") > 0.8, "bool").when(dated, "datetime").when((share("n_number") > 0.8) & (F.col("n_whole") / F.col("n_number") > 0.95), "int").when(share("n_number") > 0.8, "float").when(share("n_time") > 0.8, "datetime").otherwise("string")
    numeric = kind.isin("int", "float")
    of = lambda c: F.when(numeric, F.round(c, 6)).alias(c)
    return joined.select(*BATCH, "column", F.lit(True).alias("present"), F.round(1 - share("n"), 6).alias("null_rate"), kind.alias("type"), (F.col("n") < F.col("n_rows")).alias("nullable"), of("mean"), of("std"), of("min"), of("max"))


def first_values(batches: DataFrame, most: int = 20) -> DataFrame:
    """(dataset, batch_id, column, examples array): the first values that aren't null, in the order of rows."""
    at = F.row_number().over(Window.partitionBy(*BATCH, "column").orderBy("row_no"))
    firsts = cells(batches).where("value IS NOT NULL").withColumn("at", at).where(F.col("at") <= most)
    return firsts.groupBy(*BATCH, "column").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("examples"))


def usable_examples(*lists: Column, most: int = 20) -> Column:
    """Of several array<string>, the first that holds anything, without nulls and empty values."""
    some = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), F.array().cast("array<string>"))
    return F.slice(F.filter(some, lambda x: x.isNotNull() & (x != "")), 1, most)


def baseline(canonical: DataFrame, facts: DataFrame, examples: DataFrame) -> DataFrame:
    """Each canonical column (dataset, column, type) with the facts and examples of its data set's baseline batch.

    A column that the batch lacks is not present and has a null rate of 1.
    """
    own = facts.select("dataset", "column", F.lit(True).alias("present"), "null_rate", "mean", "std", "min", "max")
    j = canonical.select("dataset", "column", "type").join(own, ["dataset", "column"], "left").join(examples.select("dataset", "column", "examples"), ["dataset", "column"], "left")
    return j.select("dataset", "column", "type", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("null_rate", F.lit(1.0)).alias("null_rate"), "mean", "std", "min", "max", usable_examples(F.col("examples")).alias("examples"))


def frequent_values(batches: DataFrame, most: int = 8, as_array: bool = False) -> DataFrame:
    """(dataset, batch_id, column, examples): the most frequent trimmed values, ties to the smaller."""
    counts = cells(batches).where("value IS NOT NULL").groupBy(*BATCH, "column", F.trim("value").alias("value")).agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy(*BATCH, "column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("at", at).where(F.col("at") <= most).groupBy(*BATCH, "column").agg(_joined(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), as_array).alias("examples"))


def _joined(values: Column, as_array: bool) -> Column:
    return values if as_array else F.array_join(values, "|")


def aligned(canonical: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of every canonical column in every batch; a column that a batch lacks has null_rate 1 and zeros."""
    batches = facts.select(*BATCH).distinct()
    wanted = batches.join(canonical.select("dataset", "column"), "dataset")
    joined = wanted.join(facts, [*BATCH, "column"], "left")
    return joined.select(*BATCH, "column", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("null_rate", F.lit(1.0)).alias("null_rate"), F.coalesce("mean", F.lit(0.0)).alias("mean"))
