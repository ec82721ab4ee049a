"""Sums and neighbours in the order of a whole table, over ranges, so that no task holds more than a range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.stored import stored


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` with `_part`, the number of the range of `keys` that a row is in."""
    return stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")


def sums_before(df: DataFrame, keys: Sequence[str], weight: str, name: str = "before") -> DataFrame:
    """`df` with the sum of `weight` over all rows before each in the order of `keys`, which tell rows apart."""
    rows = _ranged(df, keys)
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.sum(weight).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"))  # a row a range
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset")


def neighbours(df: DataFrame, keys: Sequence[str], fields: Sequence[str], k: int) -> DataFrame:
    """`df` with `earlier` and `later`: arrays of `fields` of up to `k` rows before and after each in the order of `keys`, the nearest first.

    A range sees the last `k` rows before it and the first `k` after it as well.
    """
    rows = _ranged(df, keys)
    own, back = Window.partitionBy("_part").orderBy(*keys), Window.partitionBy("_part").orderBy(*(F.desc(c) for c in keys))
    kept = list(dict.fromkeys([*keys, *fields]))
    edges = rows.select("_part", *kept).withColumn("_first", F.row_number().over(own)).withColumn("_last", F.row_number().over(back)).where(f"_first <= {k} OR _last <= {k}")  # 2 * k rows a range
    whole = Window.orderBy("_part", "_first")
    some = lambda f, w: F.array_compact(F.array(*(f(F.struct(*kept), i).over(w) for i in range(1, k + 1))))
    around = stored(edges.withColumn("_halo", F.concat(F.when(F.col("_first") == 1, some(F.lag, whole)).otherwise(F.array().cast(f"array<{_shape(rows, kept)}>")), F.when(F.col("_last") == 1, some(F.lead, whole)).otherwise(F.array().cast(f"array<{_shape(rows, kept)}>")))), "halo")
    halo = around.select("_part", F.explode("_halo").alias("_h")).select("_part", "_h.*")
    both = rows.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    near = lambda f: F.array_compact(F.array(*(f(F.struct(*fields), i).over(own) for i in range(1, k + 1))))
    return both.withColumn("earlier", near(F.lag)).withColumn("later", near(F.lead)).where("_own").drop("_own", "_part")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """One row: for each column a struct (n, q array<double>): its values that aren't null, and the exact quantiles, between two values in proportion; null without values.

    The distinct values of all columns are put in order over ranges and only those at the places asked for are taken.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns))))
    counts = df.select(cells.alias("e")).select("e.*").where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    placed = sums_before(counts, ["c", "v"], "n")
    first = stored(placed.groupBy("c").agg(F.sum("n").alias("total"), F.min("before").alias("base")), "column-sizes")  # a row a column
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("share")) for k, q in enumerate(shares))))
    wanted = first.select("c", "base", "total", at.alias("w")).select("c", "base", "total", "w.k", ((F.col("total") - 1) * F.col("w.share")).alias("at"))
    own = F.col("before") - F.col("base")
    inside = lambda place: (own <= place) & (place < own + F.col("n"))
    hit = placed.join(F.broadcast(wanted), "c").where(inside(F.floor("at")) | inside(F.ceil("at")))  # a row a column and share
    ends = hit.groupBy("c", "k").agg(F.first("at").alias("at"), F.first("total").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    between = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi"))
    each = ends.groupBy("c").agg(F.first("total").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", between.alias("v")))), lambda e: e["v"]).alias("q"))
    one = each.agg(*(F.max(F.when(F.col("c") == i, F.struct("n", "q"))).alias(str(i)) for i in range(len(columns))))
    return one.select(*(F.struct(F.coalesce(F.col(f"`{i}`.n"), F.lit(0)).alias("n"), F.col(f"`{i}`.q").alias("q")).alias(c) for i, c in enumerate(columns)))


def _shape(df: DataFrame, columns: Sequence[str]) -> str:
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType.simpleString()


def digamma(x: Column) -> Column:
    """Of a whole number from 1 on, to 1e-12 or so: ten steps up, then the series."""
    y = x + 10.0
    step = F.lit(0.0)
    for j in range(10):
        step = step + 1.0 / (x + float(j))
    z = 1.0 / (y * y)
    return F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - step
