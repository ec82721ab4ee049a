"""Risk of the changes of a batch, in two modes, and the configuration it depends on.

Changes are (dataset, batch_id, kind, column, old, new), with renames resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.normalise import to_bool
from tabwarden.operators.profile import BATCH

# Severities, settings' scores, weights of meanings, multipliers, penalties and floors.
SEVERITY = {"REMOVE": 1.0, "TYPE_CHANGE": 0.9, "RENAME": 0.7, "NULLABLE_CHANGE": 0.5, "ADD": 0.4}
CRITICALITY = {"low": 0.3, "medium": 0.6, "high": 0.9}
SENSITIVITY = {"none": 0.0, "internal": 0.2, "pii": 0.5, "regulated": 0.8}
MULTIPLIER = {"none": 1.0, "internal": 1.05, "pii": 1.15}
REGULATED = (1.25, 1.35)  # light, strict
PENALTY = {"REMOVE": 0.20, "TYPE_CHANGE": 0.18, "NULLABLE_CHANGE": 0.10, "RENAME": 0.12, "ADD": 0.0}
TOLERATED = {"REMOVE": False, "TYPE_CHANGE": False, "NULLABLE_CHANGE": True, "RENAME": True, "ADD": True}
MEANINGS = ((1.00, ("identifier", "identifier/pk", "pk", "primary key", "primary_key")), (0.90, ("foreign key", "fk", "foreign_key")), (0.80, ("timestamp", "time", "datetime", "date")), (0.70, ("measure", "metric", "amount", "value")))


def _pick(c: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def _word(c: str, other: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))))


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def summary(batches: DataFrame, found: DataFrame) -> DataFrame:
    """One row a batch: counts by kind, affected columns, highest severity; a batch without changes has zeros."""
    n = {k: F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in SEVERITY}
    affected = F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("column", F.when(F.col("kind") == "RENAME", F.col("new"))))))))
    sums = found.groupBy(*BATCH).agg(*n.values(), affected.alias("affected"), F.max(_pick(F.col("kind"), SEVERITY, 0.0)).alias("s_max"))
    out = batches.select(*BATCH).distinct().join(sums, list(BATCH), "left")
    zero = [F.coalesce(f"n_{k.lower()}", F.lit(0)).alias(f"n_{k.lower()}") for k in SEVERITY]
    return out.select(*BATCH, *zero, F.coalesce("affected", F.array().cast("array<string>")).alias("affected"), F.coalesce("s_max", F.lit(0.0)).alias("s_max"))


def uncertainty(renames: DataFrame) -> DataFrame:
    """(dataset, batch_id, uncertainty): how unsure the least sure rename is."""
    return renames.groupBy(*BATCH).agg(F.max(1 - _clip(F.col("confidence"))).alias("uncertainty"))


def resolve_config(datasets: DataFrame, configs: DataFrame) -> DataFrame:
    """Risk settings of each dataset: from configs (dataset, mode, ...), else its own, else defaults.

    A configuration counts as a whole: the first with a mode or any setting.  Both tables have the columns
    mode, dataset_criticality, sensitivity_class, regulation_strictness and key_fields.
    """
    fields = ("mode", "dataset_criticality", "sensitivity_class", "regulation_strictness", "key_fields")
    defaults = {"mode": F.lit("A"), "dataset_criticality": F.lit("Medium"), "sensitivity_class": F.lit("None"), "regulation_strictness": F.lit("Light"), "key_fields": F.array().cast("array<string>")}
    own = datasets.select("dataset", F.struct(*fields).alias("own"), F.col("mode").alias("own_mode"))
    theirs = configs.select("dataset", F.struct(*fields).alias("theirs"))
    some = lambda s: F.when(F.coalesce(*(F.col(f"{s}.{f}").cast("string") for f in fields)).isNotNull(), F.col(s))
    joined = own.join(theirs, "dataset", "left").withColumn("c", F.coalesce(some("theirs"), some("own")))
    out = joined.select("dataset", F.coalesce("c.mode", "own_mode", F.lit("A")).alias("mode"), *(F.coalesce(F.col(f"c.{f}"), defaults[f]).alias(f) for f in fields[1:]))
    mode = F.upper(F.trim("mode"))
    return out.withColumn("mode", F.when(mode.isin("A", "B"), mode).otherwise("A")).withColumn("key_fields_count", F.size("key_fields"))


def mode_a(summed: DataFrame, config: DataFrame, unsure: DataFrame) -> DataFrame:
    """risk, level, suggested_route and floor of each batch; config as `resolve_config` gives it."""
    j = summed.join(config, "dataset", "left").join(unsure, list(BATCH), "left")
    n = sum((F.col(f"n_{k.lower()}") for k in SEVERITY), F.lit(0))
    t = F.least(F.lit(1.0), F.col("s_max") + 0.08 * F.log(1.0 + n))
    sens = _word("sensitivity_class", "none")
    lower = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    keys = F.filter(lower(F.coalesce("key_fields", F.array().cast("array<string>"))), lambda x: x != "")
    hit = F.arrays_overlap(keys, lower(F.col("affected"))).cast("double")
    base = _clip(0.55 * t + 0.20 * _pick(_word("dataset_criticality", "medium"), CRITICALITY, 0.6) + 0.20 * _pick(sens, SENSITIVITY, 0.0) + 0.05 * hit)
    risk = _clip(base + 0.10 * F.coalesce("uncertainty", F.lit(0.0)))
    strict = _word("regulation_strictness", "light") == "strict"
    either = lambda a, b: F.when(strict, F.lit(a)).otherwise(F.lit(b))
    floor = F.when(F.col("n_remove") + F.col("n_type_change") > 0, either(0.85, 0.75)).when(F.col("n_rename") + F.col("n_nullable_change") > 0, either(0.70, 0.60)).when(F.col("n_add") > 0, either(0.50, 0.40))
    floor = F.when(sens == "regulated", floor)
    risk = F.round(F.greatest(risk, F.coalesce(floor, F.lit(0.0))), 6)
    level = F.when(risk >= 0.70, "high").when(risk >= 0.35, "medium").otherwise("low")
    return j.select(*BATCH, risk.alias("risk"), level.alias("level"), F.when(risk >= 0.35, "staging").otherwise("production").alias("suggested_route"), floor.alias("floor"))


def meaning_weight(c: Column) -> Column:
    out = F.lit(0.60)
    for weight, words in reversed(MEANINGS):
        out = F.when(F.lower(F.trim(c)).isin(*words), F.lit(weight)).otherwise(out)
    return out


def contributions(found: DataFrame, renames: DataFrame, config: DataFrame, fields: DataFrame) -> DataFrame:
    """Each change with its risk.  fields (dataset, column, field_criticality, semantic_type, and allow_remove, allow_type_change, allow_nullable_change, allow_rename as text), config as `resolve_config` gives it."""
    sure = renames.select(*BATCH, F.lit("RENAME").alias("kind"), F.col("old_name").alias("column"), "confidence")
    j = found.join(config, "dataset", "left").join(fields, ["dataset", "column"], "left").join(sure, [*BATCH, "kind", "column"], "left")
    level = lambda c: F.least(F.greatest(F.coalesce(F.nullif(F.col(c).try_cast("int"), F.lit(0)), F.lit(3)), F.lit(1)), F.lit(5)) / 5.0
    importance = 0.5 * level("dataset_criticality") + 0.5 * level("field_criticality")
    sens, strict = _word("sensitivity_class", "none"), _word("regulation_strictness", "light") == "strict"
    factor = F.when(sens == "regulated", F.when(strict, REGULATED[1]).otherwise(REGULATED[0])).otherwise(_pick(sens, MULTIPLIER, 1.0))
    penalty = F.lit(0.0)
    for kind, allow in (("REMOVE", "allow_remove"), ("TYPE_CHANGE", "allow_type_change"), ("NULLABLE_CHANGE", "allow_nullable_change"), ("RENAME", "allow_rename")):
        allowed = F.coalesce(to_bool(F.col(allow)), F.lit(TOLERATED[kind]))
        penalty = F.when((F.col("kind") == kind) & ~allowed, F.lit(PENALTY[kind])).otherwise(penalty)
    unsure = F.when(F.col("kind") == "RENAME", 0.15 * (1 - _clip(F.coalesce("confidence", F.lit(1.0))))).otherwise(0.0)
    r = _clip(_pick(F.col("kind"), SEVERITY, 0.0) * importance * meaning_weight(F.coalesce("semantic_type", F.lit("Dimension"))) * factor + penalty + unsure)
    floor = F.when((sens == "regulated") & strict & F.col("kind").isin("REMOVE", "TYPE_CHANGE"), 0.80).otherwise(0.0)
    return j.select(*BATCH, "kind", "column", "old", "new", penalty.alias("p_tol"), F.round(unsure, 6).alias("p_conf"), r.alias("r"), floor.alias("floor"))


def mode_b(batches: DataFrame, contributed: DataFrame, most: int = 10) -> DataFrame:
    """One row a batch: 1 - product(1 - r), levels, and the `most` worst changes; without changes the risk is 0."""
    at = F.row_number().over(Window.partitionBy(*BATCH).orderBy(F.desc("r"), "kind", "column"))
    scored = contributed.withColumn("at", at)
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("at") <= most, F.struct("at", "kind", "column")))), lambda x: F.concat_ws(":", x["kind"], x["column"])), ",")
    sums = scored.groupBy(*BATCH).agg(F.greatest(1 - F.product(1 - F.col("r")), F.max("floor")).alias("raw"), top.alias("drivers"))
    out = batches.select(*BATCH).distinct().join(sums, list(BATCH), "left")
    risk = F.round(_clip(F.coalesce("raw", F.lit(0.0))), 6)
    level = F.when(risk >= 0.80, "high").when(risk >= 0.40, "medium").otherwise("low")
    reason = F.concat(F.lit("combined risk = "), F.format_string("%.3f", risk))
    return out.select(*BATCH, risk.alias("risk"), level.alias("level"), F.when(risk >= 0.40, "staging").otherwise("production").alias("suggested_route"), F.coalesce("drivers", F.lit("")).alias("drivers"), reason.alias("reason"))
