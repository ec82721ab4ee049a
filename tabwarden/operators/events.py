"""Event and audit analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels from low to high, and the payload keys that name a topic.
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
TOPICS = ("text", "image", "audio", "video")


def daily_summary(events: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(ts, kind, risk, level) -> a row a day: counts by kind, mean and highest risk, highest level; a null time is the day `unknown`."""
    rank = F.array_position(F.array(*(F.lit(x) for x in LEVELS)), F.upper("level"))
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown"))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]
    return events.groupBy(day.alias("day")).agg(F.count("*").alias("events"), *counts, F.round(F.avg("risk"), 6).alias("avg_risk"), F.round(F.max("risk"), 6).alias("max_risk"), F.max_by("level", rank).alias("max_level"))


def kpis(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total"), F.count_if(F.col("level") == "HIGH").alias("high"), F.count_if(F.col("kind") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))


def newest(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), "event_id").limit(min(n, 500))


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, flush_no, n): rows of a key that follow each other within `gap` form one batch."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(order) <= F.expr(gap), 0).otherwise(1)
    numbered = events.withColumn("fresh", fresh).withColumn("flush_no", F.sum("fresh").over(Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "flush_no").agg(F.count("*").alias("n"))


def payload_type(value: Column) -> Column:
    """Topic of a raw message: a string is text; an object is what its first known key says; else unknown."""
    is_object = F.trim(value).startswith("{")
    out = F.lit("unknown")
    for k in reversed(TOPICS):
        out = F.when(F.get_json_object(value, f"$.{k}").isNotNull(), F.lit(k)).otherwise(out)
    return F.when(value.isNull(), "unknown").when(is_object, out).otherwise("text")
