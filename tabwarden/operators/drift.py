"""Schema drift of many batches against canonical schemas.

canonical: (dataset, column, type, nullable); facts: as `profile.column_facts` gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.operators.profile import BATCH

#: Kinds of changes, in the order of reports.
ORDER = ("ADD", "REMOVE", "TYPE_CHANGE", "NULLABLE_CHANGE", "RENAME")


def changes(canonical: DataFrame, facts: DataFrame) -> DataFrame:
    """(dataset, batch_id, kind, column, old, new): additions, removals, type and nullability changes."""
    batches = facts.select(*BATCH).distinct()
    wanted = batches.join(canonical.select("dataset", "column", F.col("type").alias("c_type"), F.col("nullable").alias("c_nullable")), "dataset")
    both = wanted.join(facts.select(*BATCH, "column", F.col("type").alias("o_type"), F.col("nullable").alias("o_nullable")), [*BATCH, "column"], "full")
    text = lambda c: F.col(c).cast("string")
    one = lambda when, kind, old, new: F.when(when, F.struct(F.lit(kind).alias("kind"), old.alias("old"), new.alias("new")))
    null = F.lit(None).cast("string")
    found = F.array_compact(
        F.array(
            one(F.col("c_type").isNull(), "ADD", null, text("o_type")),
            one(F.col("o_type").isNull(), "REMOVE", text("c_type"), null),
            one(F.col("c_type") != F.col("o_type"), "TYPE_CHANGE", text("c_type"), text("o_type")),
            one(~F.col("c_nullable") & F.col("o_nullable"), "NULLABLE_CHANGE", text("c_nullable"), text("o_nullable")),
        )
    )
    return both.select(*BATCH, "column", F.explode(found).alias("x")).select(*BATCH, "x.kind", "column", "x.old", "x.new")


def with_renames(found: DataFrame, renames: DataFrame) -> DataFrame:
    """Changes with accepted renames taken out of additions and removals."""
    out = found.join(renames.select(*BATCH, F.col("old_name").alias("column"), F.lit("REMOVE").alias("kind")), [*BATCH, "column", "kind"], "left_anti")
    out = out.join(renames.select(*BATCH, F.col("new_name").alias("column"), F.lit("ADD").alias("kind")), [*BATCH, "column", "kind"], "left_anti")
    renamed = renames.select(*BATCH, F.lit("RENAME").alias("kind"), F.col("old_name").alias("column"), F.col("old_name").alias("old"), F.col("new_name").alias("new"))
    return out.select(*BATCH, "kind", "column", "old", "new").unionByName(renamed)


def report(batches: DataFrame, found: DataFrame) -> DataFrame:
    """One row a batch: drift types in fixed order, counts, names and a sentence."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}")
    names = F.array_join(F.sort_array(F.collect_set(F.col("column"))), ",").alias("columns")
    sums = found.groupBy(*BATCH).agg(*(n(k) for k in ORDER), names)
    out = batches.select(*BATCH).distinct().join(sums, list(BATCH), "left")
    counts = [F.coalesce(F.col(f"n_{k.lower()}"), F.lit(0)).alias(f"n_{k.lower()}") for k in ORDER]
    types = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(F.col(f"n_{k.lower()}"), F.lit(0)) > 0, F.lit(k)) for k in ORDER))), ",")
    return out.select(*BATCH, types.alias("drift_types"), *counts, F.coalesce("columns", F.lit("")).alias("columns"), F.when(types == "", "no drift").otherwise(F.concat(F.lit("drift: "), types)).alias("summary"))
