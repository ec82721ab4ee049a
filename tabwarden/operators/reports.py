"""What changed in a batch, in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.operators.profile import BATCH

SECTIONS = ("RENAME", "ADD", "REMOVE", "TYPE_CHANGE", "NULLABLE_CHANGE")


def explanations(found: DataFrame, renames: DataFrame) -> DataFrame:
    """The changes with `section`, their place in a report, and `explanation`; a rename has the pair's confidence."""
    sure = renames.select(*BATCH, F.lit("RENAME").alias("kind"), F.col("old_name").alias("column"), "confidence")
    j = found.join(sure, [*BATCH, "kind", "column"], "left")
    c, old, new = F.col("column"), F.col("old"), F.col("new")
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    said = (
        F.when(F.col("kind") == "RENAME", say(c, " -> ", new, ": confidence ", F.coalesce(F.format_string("%.2f", "confidence"), F.lit("-"))))
        .when(F.col("kind") == "ADD", say("new column ", c, " appeared"))
        .when(F.col("kind") == "REMOVE", say("column ", c, " is missing"))
        .when(F.col("kind") == "TYPE_CHANGE", say("type of ", c, " changed: ", old, " -> ", new))
        .otherwise(say("nullability of ", c, " changed: ", old, " -> ", new))
    )
    return j.withColumn("section", F.array_position(F.array(*(F.lit(s) for s in SECTIONS)), F.col("kind"))).withColumn("explanation", said)


def batch_summary(facts: DataFrame, explained: DataFrame) -> DataFrame:
    """(dataset, batch_id, summary): the batch's columns and its changes, a line each."""
    columns = facts.groupBy(*BATCH).agg(F.array_join(F.sort_array(F.collect_list("column")), ", ").alias("columns"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "column", "explanation"))), lambda x: F.concat(F.lit(" - "), x["explanation"])), "\n")
    j = columns.join(explained.groupBy(*BATCH).agg(lines.alias("lines")), list(BATCH), "left")
    drift = F.when(F.col("lines").isNull(), "no drift").otherwise(F.concat(F.lit("drift:\n"), "lines"))
    return j.select(*BATCH, F.concat(F.lit("batch "), "batch_id", F.lit("\ncolumns: "), "columns", F.lit("\n"), drift).alias("summary"))
