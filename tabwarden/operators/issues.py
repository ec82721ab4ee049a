"""Issue detection and the quality score of a table.

A rule is (column, min, max, allowed values); columns without a range rule that are numbers are held
against their interquartile fences.  All statistics of a table come from one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.ordered import quantiles


@dataclass(frozen=True)
class Rule:
    column: str
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()


_SHAPE = "array<struct<column:string,issue_type:string,current_value:string,rule_violated:string>>"


def _issue(column: str, kind: str, rule: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(column).alias("column"), F.lit(kind).alias("issue_type"), F.col(column).cast("string").alias("current_value"), rule.alias("rule_violated")))


def _out(df: DataFrame, key: str, found: list[Column]) -> DataFrame:
    if not found:
        found = [F.lit(None).cast("struct<column:string,issue_type:string,current_value:string,rule_violated:string>")]
    return df.select(F.col(key).alias("row_id"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("row_id", "i.*")


def _missing(columns: Sequence[str]) -> list[Column]:
    return [_issue(c, "missing", F.lit("not null"), F.col(c).isNull()) for c in columns]


def _out_of_range(rules: Sequence[Rule]) -> list[Column]:
    found = []
    for r in rules:
        x = F.col(r.column).cast("string").try_cast("double")
        if r.low is not None:
            found.append(_issue(r.column, "invalid", F.lit(f"min {r.low:g}"), x < r.low))
        if r.high is not None:
            found.append(_issue(r.column, "invalid", F.lit(f"max {r.high:g}"), x > r.high))
    return found


def _not_allowed(rules: Sequence[Rule]) -> list[Column]:
    return [_issue(r.column, "invalid", F.lit("allowed " + "|".join(r.allowed)), F.col(r.column).isNotNull() & ~F.col(r.column).cast("string").isin(*r.allowed)) for r in rules if r.allowed]


def _outliers(columns: Sequence[str]) -> list[Column]:
    found = []
    for c in columns:
        x, f = F.col(c).cast("double"), F.col(f"f_{c}")
        found.append(_issue(c, "outlier", F.lit("iqr"), (f["n"] > 10) & ((x < f["low"]) | (x > f["high"]))))
    return found


def missing(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return _out(df, key, _missing(columns))


def out_of_range(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    return _out(df, key, _out_of_range(rules))


def not_allowed(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    return _out(df, key, _not_allowed(rules))


def fences(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column, the struct (low, high, n) of its interquartile fences, by exact quantiles."""
    raw = quantiles(df, columns, (0.25, 0.75))
    low, high = (lambda c: F.col(f"`{c}`.q")[0]), (lambda c: F.col(f"`{c}`.q")[1])
    return raw.select(*(F.struct((low(c) - 1.5 * (high(c) - low(c))).alias("low"), (high(c) + 1.5 * (high(c) - low(c))).alias("high"), F.col(f"`{c}`.n").alias("n")).alias(f"f_{c}") for c in columns))


def outliers(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return _out(df.crossJoin(F.broadcast(fences(df, columns))), key, _outliers(columns))  # the fences are one row


def detect(df: DataFrame, key: str, columns: Sequence[str], rules: Sequence[Rule], numeric: Sequence[str]) -> DataFrame:
    """All issues of all cells, from one scan beside that of the fences."""
    ranged = {r.column for r in rules if r.low is not None or r.high is not None}
    free = [c for c in numeric if c not in ranged]
    found = [*_missing(columns), *_out_of_range(rules), *_not_allowed(rules), *_outliers(free)]
    return _out(df.crossJoin(F.broadcast(fences(df, free))) if free else df, key, found)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("column", "issue_type").agg(F.count("*").alias("n"))


# Points where the percentage of faulty cells is 0, and under 1, 5, 10 and 20.
COMPLETENESS = (40, 35, 30, 20, 10)
VALIDITY = (40, 35, 25, 15, 5)


def _band(percent: Column, points: Sequence[int]) -> Column:
    out = F.when(percent == 0, F.lit(float(points[0])))
    for under, p in zip((1, 5, 10, 20), points[1:], strict=True):
        out = out.when(percent < under, F.lit(float(p)))
    return out.otherwise(F.greatest(F.lit(0.0), 40 - 2 * percent))


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, duplicates): rows beyond the first of each; nulls are equal."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct, is_constant) of numeric columns."""
    one = df.agg(*(F.count_distinct(c).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in columns))).alias("c")).select("c.*", (F.col("c.n_distinct") == 1).alias("is_constant"))


def quality_report(df: DataFrame, key: str, columns: Sequence[str], rules: Sequence[Rule], numeric: Sequence[str]) -> DataFrame:
    """One row: counts, the three scores, their total and a grade.  An empty table has null scores and the grade `empty`."""
    found = detect(df, key, columns, rules, numeric).agg(F.count_if(F.col("issue_type") == "missing").alias("n_missing"), F.count_if(F.col("issue_type") == "invalid").alias("n_invalid"), F.count_if(F.col("issue_type") == "outlier").alias("n_outlier"))
    same = df.agg(*((F.min(c) == F.max(c)).alias(str(i)) for i, c in enumerate(numeric)))  # one row
    constant = same.select(sum((F.coalesce(F.col(f"`{i}`"), F.lit(False)).cast("long") for i in range(len(numeric))), F.lit(0).cast("long")).alias("n_constant"))
    all_ = duplicate_rows(df, columns).crossJoin(found).crossJoin(constant)  # one row each
    cells = F.col("n_rows") * len(columns)
    p_missing, p_invalid = 100 * F.col("n_missing") / cells, 100 * (F.col("n_invalid") + F.col("n_outlier")) / cells
    p_dup = 100 * F.col("duplicates") / F.col("n_rows")
    full = F.col("n_rows") > 0
    scored = all_.select(
        "*",
        F.when(full, F.round(_band(p_missing, COMPLETENESS), 4)).alias("completeness"),
        F.when(full, F.round(_band(p_invalid, VALIDITY), 4)).alias("validity"),
        F.when(full, F.round(20 - F.least(F.lit(10.0), 2 * p_dup) - F.least(F.lit(5.0), 2.0 * F.col("n_constant")), 4)).alias("consistency"),
    )
    total = F.col("completeness") + F.col("validity") + F.col("consistency")
    grade = F.when(total.isNull(), "empty").when(total >= 90, "A").when(total >= 75, "B").when(total >= 60, "C").when(total >= 40, "D").otherwise("F")
    return scored.withColumn("total", F.round(total, 4)).withColumn("grade", grade)
