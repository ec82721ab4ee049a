"""Suggested repairs of issue cells, and applying chosen ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.ordered import quantiles
from tabwarden.operators.forests import permutation_importance, predict_missing, train_imputer  # noqa: F401
from tabwarden.operators.issues import Rule


def allowed_alternatives(df: DataFrame, column: str, allowed: Sequence[str], most: int = 3) -> DataFrame:
    """(column, value, rank): allowed values by how often they occur, those that don't last."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    wanted = spark.createDataFrame([(v,) for v in allowed], "value string")
    ranked = wanted.join(counts, "value", "left").withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.coalesce("n", F.lit(0))), "value")))
    return ranked.where(F.col("rank") <= most).select(F.lit(column).alias("column"), "value", "rank")


def numeric_alternatives(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row (column, median, q25, q75) of the values inside the range."""
    inside = quantiles(df.where(F.col(column).between(low, high)).select(F.col(column).alias("v")), ("v",), (0.5, 0.25, 0.75))
    return inside.select("v.q").select(F.lit(column).alias("column"), *(F.round(F.col("q")[i], 6).alias(a) for i, a in enumerate(("median", "q25", "q75"))))


def fallback_alternatives(df: DataFrame, column: str) -> DataFrame:
    """One row (column, median, mean, mode); of equally frequent values the least is the mode."""
    mode = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", F.negative(F.col(column).cast("double")).alias("v"))).alias("m")).select((-F.col("m.v")).alias("mode"))
    middle = quantiles(df.select(F.col(column).alias("v")), ("v",), (0.5,)).select(F.round(F.col("v.q")[0], 6).alias("median"))
    return df.agg(F.round(F.avg(column), 6).alias("mean")).crossJoin(middle).crossJoin(mode).select(F.lit(column).alias("column"), "median", "mean", "mode")


def cap(c: Column, low: float | None, high: float | None) -> Column:
    out = c.cast("double")
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def satisfy_constraint(c: Column, constraint: str) -> Column:
    """A number turned to hold an exact constraint word."""
    if constraint == "positive":
        return F.when(c <= 0, F.abs(c) + F.when(c == 0, F.lit(1)).otherwise(F.lit(0))).otherwise(c)
    if constraint == "negative":
        return F.when(c >= 0, -F.abs(c) - F.when(c == 0, F.lit(1)).otherwise(F.lit(0))).otherwise(c)
    if constraint == "non-negative":
        return F.greatest(c, F.lit(0).cast("double"))
    if constraint == "non-positive":
        return F.least(c, F.lit(0).cast("double"))
    return c


def apply_fixes(df: DataFrame, fixes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """fixes (row_id, column, value, made): of a cell's fixes the one made last, null included; other cells stay."""
    last = F.max_by(F.struct("value"), F.struct("made", "value"))
    wide = fixes.groupBy("row_id").pivot("column", list(columns)).agg(last)
    wide = wide.select("row_id", *(F.col(c).alias(f"fix_{c}") for c in columns))
    joined = df.join(wide, df[key] == wide["row_id"], "left")
    types = dict(df.dtypes)
    fixed = lambda c: F.when(F.col(f"fix_{c}").isNotNull(), F.col(f"fix_{c}.value").try_cast(types[c])).otherwise(F.col(c)).alias(c)
    return joined.select(*(fixed(c) if c in columns else F.col(c) for c in df.columns))


def modes(df: DataFrame, column: str, most: int = 3) -> DataFrame:
    """(column, value, rank): the most frequent values, numbers or texts, ties to the smaller."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "v").limit(most)
    at = F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "v"))  # over `most` rows
    return top.select(F.lit(column).alias("column"), F.col("v").cast("string").alias("value"), at.alias("rank"))


def fixes_table(issues: DataFrame, alternatives: DataFrame, rules: Sequence[Rule], suggestions: DataFrame | None = None) -> DataFrame:
    """Issues with what could replace each value.

    alternatives (column, value, rank): offered for every issue of the column; a cap for values outside a
    rule's range; suggestions (row_id, column, suggestion) of a model, if there are any.
    """
    listed = alternatives.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("alternatives"))
    capped = F.lit(None).cast("double")
    for r in rules:
        if r.low is not None or r.high is not None:
            capped = F.when((F.col("column") == r.column) & (F.col("issue_type") == "invalid"), cap(F.col("current_value").try_cast("double"), r.low, r.high)).otherwise(capped)
    out = issues.join(F.broadcast(listed), "column", "left").withColumn("cap_suggestion", capped)  # a row a column
    if suggestions is None:
        return out.withColumn("ml_suggestion", F.lit(None).cast("string"))
    return out.join(suggestions.withColumnRenamed("suggestion", "ml_suggestion"), ["row_id", "column"], "left")
