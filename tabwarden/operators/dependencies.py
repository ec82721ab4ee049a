"""How columns depend on each other, and which columns are identifiers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.ordered import digamma, neighbours, sums_before
from tabwarden.functions.stored import stored


def _average_rank(df: DataFrame, c: str) -> DataFrame:
    """(value, average rank) from the counts of values; the running sum is over distinct values, in ranges of them."""
    counts = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
    return sums_before(counts, ["v"], "n").select("v", (F.col("before") + (F.col("n") + 1) / 2).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (target, predictor, method, score): the absolute rank correlation of the rows where both are set."""
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    rx, ry = _average_rank(pairs, "x").select(F.col("v").alias("x"), F.col("r").alias("rx")), _average_rank(pairs, "y").select(F.col("v").alias("y"), F.col("r").alias("ry"))
    return pairs.join(rx, "x").join(ry, "y").agg(F.abs(F.corr("rx", "ry")).alias("score")).select(F.lit(x).alias("target"), F.lit(y).alias("predictor"), F.lit("spearman").alias("method"), F.round("score", 4).alias("score"))


def chi_square(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (target, predictor, chi2, dof) of the crosstab of two columns."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("x").agg(F.sum("o").alias("r")), cells.groupBy("y").agg(F.sum("o").alias("c"))
    terms = cells.join(rows, "x").join(cols, "y").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), ((F.count_distinct("x") - 1) * (F.count_distinct("y") - 1)).alias("dof"))
    return terms.select(F.lit(x).alias("target"), F.lit(y).alias("predictor"), F.round(F.col("n") * (F.col("s") - 1), 4).alias("chi2"), "dof")


def chi_square_score(scored: DataFrame) -> DataFrame:
    """chi_square's rows (chi2, dof) as (target, predictor, method, score): one minus the p-value, from the regularised gamma function."""

    @F.pandas_udf("double")
    def p_value(chi2: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([_upper_gamma(d / 2, x / 2) if d > 0 else 1.0 for x, d in zip(chi2, dof, strict=True)])

    return scored.select("target", "predictor", F.lit("chi2").alias("method"), F.round(1 - p_value("chi2", "dof"), 6).alias("score"))


def _upper_gamma(a: float, x: float) -> float:
    """Q(a, x), by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    log = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(log))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(log)


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """One row (target, predictor, method, score): plug-in mutual information of a category and a number in equal-width bins."""
    ends = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))  # a constant has one cell
    cell = F.coalesce(F.least(F.floor((F.col(y) - F.col("lo")) / width), F.lit(bins - 1)), F.lit(0))
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.col(x).alias("x"), cell.alias("y")).agg(F.count("*").alias("o"))  # ends: one row
    rows, cols = cells.groupBy("x").agg(F.sum("o").alias("r")), cells.groupBy("y").agg(F.sum("o").alias("c"))
    n = cells.agg(F.sum("o").alias("n"))
    joined = cells.join(rows, "x").join(cols, "y").crossJoin(F.broadcast(n))
    score = F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("r") * F.col("c"))))
    return joined.agg(score.alias("s")).select(F.lit(x).alias("target"), F.lit(y).alias("predictor"), F.lit("mutual_info").alias("method"), F.round("s", 6).alias("score"))


def neighbour_information(df: DataFrame, x: str, y: str, k: int = 3) -> DataFrame:
    """One row (target, predictor, method, score): mutual information of a category and a number from nearest neighbours (Ross 2014).

    A row's radius is the distance to its k-th nearest of the same category (of fewer, to the last); rows of any
    category that are nearer than that, or equal where it is 0, are counted, itself included.  Categories of one
    row don't count; a constant number or a single category scores 0, as does a table without rows.
    """
    given = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("v")).where("x IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    cells = given.groupBy("x", "v").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("x").agg(F.sum("n").alias("nx")).where("nx > 1")
    cells = stored(cells.join(sizes, "x"), "cells")
    # the k nearest of a category are among the k values before and after, and what stands at the value itself
    near = neighbours(cells, ["x", "v"], ["x", "v", "n"], k)
    mine = lambda a: F.transform(F.filter(a, lambda e: e["x"].eqNullSafe(F.col("x"))), lambda e: F.struct(F.abs(e["v"] - F.col("v")).alias("d"), e["n"].alias("n")))
    there = F.array(F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n")))
    ordered = F.sort_array(F.concat(there, mine(F.col("earlier")), mine(F.col("later"))))
    ki = F.least(F.lit(k).cast("long"), F.col("nx") - 1)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("r"))
    step = lambda acc, e: F.struct((acc["seen"] + e["n"]).alias("seen"), F.when(acc["r"].isNull() & (acc["seen"] + e["n"] >= F.col("ki")), e["d"]).otherwise(acc["r"]).alias("r"))
    radii = near.withColumn("ki", ki).withColumn("r", F.aggregate(ordered, start, step)["r"]).select("x", "v", "n", "nx", "ki", "r")
    radii = stored(radii, "radii")
    # how many stand below both ends: ends are put among the values, before or after what equals them
    value = cells.groupBy("v").agg(F.sum("n").alias("w")).select(F.col("v").alias("t"), F.lit(1).alias("place"), "w", F.lit(0).alias("sign"))
    far = F.col("r") > 0
    ends = F.array(F.struct((F.col("v") + F.col("r")).alias("t"), F.when(far, 0).otherwise(2).alias("place"), F.lit(1).alias("sign")), F.struct((F.col("v") - F.col("r")).alias("t"), F.when(far, 2).otherwise(0).alias("place"), F.lit(-1).alias("sign")))
    asked = radii.select("x", "v", F.explode(ends).alias("e")).select(F.col("e.t").alias("t"), F.col("e.place").alias("place"), F.lit(0).cast("long").alias("w"), F.struct("x", "v").alias("at"), F.col("e.sign").alias("sign"))
    line = value.withColumn("at", F.lit(None).cast(asked.schema["at"].dataType)).select("t", "place", "w", "at", "sign").unionByName(asked)
    counted = sums_before(line, ["t", "place", "at", "sign"], "w").where("at IS NOT NULL")
    inside = counted.groupBy("at").agg(F.sum(F.col("sign") * F.col("before")).alias("m")).select("at.x", "at.v", "m")
    total = radii.join(inside, ["x", "v"]).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (digamma(F.col("ki")) - digamma(F.col("nx")) - digamma(F.col("m")))).alias("s"))
    score = F.greatest(F.coalesce(digamma(F.col("n")) + F.col("s") / F.col("n"), F.lit(0.0)), F.lit(0.0))
    return total.select(F.lit(x).alias("target"), F.lit(y).alias("predictor"), F.lit("mutual_info").alias("method"), F.round(score, 6).alias("score"))


def all_dependencies(df: DataFrame, numeric: Sequence[str], categories: Sequence[str], rows: int = 10, least: float = 0.1) -> DataFrame:
    """The scores over `least` of all pairs of columns that are both set in `rows` rows: numbers by rank, categories by chi-square, both kinds by mutual information of nearest neighbours."""
    columns = [*numeric, *categories]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    joint = df.agg(*(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"{a}|{b}") for a, b in pairs)).first()  # one row
    out = None
    for a, b in pairs:
        if joint[f"{a}|{b}"] < rows:
            continue
        one = spearman(df, a, b) if b in numeric else chi_square_score(chi_square(df, a, b)) if a in categories else neighbour_information(df, b, a).select(F.lit(a).alias("target"), F.lit(b).alias("predictor"), "method", "score")
        out = one if out is None else out.unionByName(one)
    return dependency_table(out, least)


def dependency_table(scores: DataFrame, least: float = 0.1) -> DataFrame:
    return scores.where(F.col("score") > least).orderBy(F.desc("score"), "target", "predictor")


def id_columns(df: DataFrame, columns: Sequence[str], order: Sequence[str], match: str = "substring") -> DataFrame:
    """(column, by_name, distinct_ratio, is_id): by its name, or nearly all values differing."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_distinct(c).alias(c) for c in columns))
    rows = one.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("d")) for c in columns))).alias("c")).select("_n", "c.*")
    name: Column = F.lower("column").contains("id") if match == "substring" else F.array_contains(F.split(F.lower("column"), "_"), "id")
    return rows.select("column", name.alias("by_name"), F.round(F.col("d") / F.col("_n"), 6).alias("distinct_ratio"), (name | (F.col("d") / F.col("_n") > 0.95)).alias("is_id"))


def consecutive_share(df: DataFrame, column: str, order: str, parts: int = 64) -> DataFrame:
    """One row (column, share, is_sequence): consecutive differences of 1 in the order of `order`, stitched over ranges."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    part = F.floor((F.col(order) - F.col("lo")) * parts / (F.col("hi") - F.col("lo") + 1))
    ranged = df.crossJoin(F.broadcast(ends)).select(F.col(column).alias("v"), F.col(order).alias("o"), part.alias("part"))  # ends: one row
    inside = Window.partitionBy("part").orderBy("o", "v")
    steps = ranged.withColumn("d", F.col("v") - F.lag("v").over(inside))
    seams = ranged.groupBy("part").agg(F.min(F.struct("o", "v")).alias("first"), F.max(F.struct("o", "v")).alias("last"))
    seam = seams.select((F.col("first.v") - F.lag("last.v").over(Window.partitionBy().orderBy("part"))).alias("d"))
    total = steps.select("d").unionByName(seam).agg(F.count_if(F.col("d") == 1).alias("ones"), F.count("d").alias("n"))
    return total.select(F.lit(column).alias("column"), F.round(F.col("ones") / F.col("n"), 6).alias("share"), (F.col("ones") / F.col("n") > 0.9).alias("is_sequence"))
