"""Forests that predict missing cells, as tables of nodes.

A forest is trained by Spark and then kept as a written table of nodes with what its features are, so that it
applies anywhere, without model objects in a plan: tasks walk the nodes (at most trees * 2 ** (depth + 1) of
them) for batches of rows.  Each prediction is the base of its trees plus what every split on the way added,
which is credited to the split's column.

Defined cases.  A missing number is the median of the known ones, a missing category the most frequent (ties to
the smaller); a category that training didn't see is none of the known.  Equal class shares go to the class that
sorts first.  A column with fewer than 10 known cells, with no dependence on another or with over MOST_LABELS
kinds has no forest, and its missing cells get no prediction.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tabwarden.functions.stored import shared_folder, stored
from tabwarden.operators.dependencies import all_dependencies

#: Kinds of a category that are features of their own, the most frequent, and of one that is predicted.
MOST_CATEGORIES, MOST_LABELS = 64, 1000
LEAST_ROWS = 10
_STEP = 4096


@dataclass(frozen=True)
class Forest:
    target: str
    numeric: tuple[str, ...]
    categories: tuple[str, ...]
    fills: dict = field(hash=False)
    kinds: dict = field(hash=False)
    #: Classes in order, None for a number.
    labels: tuple[str, ...] | None
    #: (tree, node, feature, threshold, left, right, value array<double>)
    nodes: DataFrame = field(hash=False, compare=False)

    @property
    def columns(self) -> list[str]:
        """The column of each feature."""
        return [*self.numeric, *(c for c in self.categories for _ in self.kinds[c])]

    def features(self) -> Column:
        number = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(self.fills[c]))) for c in self.numeric]
        kind = [(F.coalesce(F.col(c).cast("string"), F.lit(self.fills[c])) == F.lit(v)).cast("double") for c in self.categories for v in self.kinds[c]]
        return F.array(*number, *kind)


def _frequent(df: DataFrame, column: str, most: int) -> list[str]:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    return [r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(most).collect()]


def train_imputer(df: DataFrame, target: str, numeric: Sequence[str], categories: Sequence[str], target_is_category: bool, trees: int = 50, depth: int = 10, seed: int = 42) -> Forest:
    """A forest that predicts `target` from the other columns, learned from the rows of `df` that have it."""
    known = df.where(F.col(target).isNotNull())
    medians = known.agg(*(F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c) for c in numeric)).first() if numeric else {}
    kinds = {c: _frequent(known, c, MOST_CATEGORIES) for c in categories}
    fills = {c: medians[c] if medians[c] is not None else 0.0 for c in numeric} | {c: (kinds[c] or [""])[0] for c in categories}
    labels = tuple(sorted(_frequent(known, target, MOST_LABELS))) if target_is_category else None
    forest = Forest(target, tuple(numeric), tuple(categories), fills, kinds, labels, df)
    label = (F.array_position(F.array(*map(F.lit, labels)), F.col(target).cast("string")) - 1).cast("double") if labels else F.col(target).cast("double")
    rows = stored(known.select(forest.features().alias("x"), label.alias("label")).where("label >= 0" if labels else "NOT isnan(label)"), "forest-rows")
    learner = RandomForestClassifier if labels else RandomForestRegressor
    model = learner(numTrees=trees, maxDepth=depth, seed=seed).fit(rows.select(array_to_vector("x").alias("features"), "label"))
    path = f"{shared_folder(df.sparkSession)}/forest-{uuid.uuid4().hex}"
    model.save(path)
    node = F.col("nodeData")
    whole = F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, b: a + b)
    value = F.transform(node["impurityStats"], lambda n: n / whole) if labels else F.array(node["prediction"])
    inner = node["leftChild"] >= 0
    nodes = df.sparkSession.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), F.when(inner, node["split"]["featureIndex"]).otherwise(-1).alias("feature"),
        F.coalesce(F.when(inner, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))), F.lit(0.0)).alias("threshold"), node["leftChild"].alias("left"), node["rightChild"].alias("right"), value.alias("value"),
    )
    return Forest(target, tuple(numeric), tuple(categories), fills, kinds, labels, nodes)


def _arrays(nodes: DataFrame) -> tuple[np.ndarray, ...]:
    """(roots, feature, threshold, left, right, value) of all trees in one line."""
    rows = sorted(nodes.collect(), key=lambda r: (r["tree"], r["node"]))  # trees * 2 ** (depth + 1) at most
    first: dict[int, int] = {}
    for i, r in enumerate(rows):
        first.setdefault(r["tree"], i - r["node"])
    place = lambda side: np.array([first[r["tree"]] + r[side] if r[side] >= 0 else i for i, r in enumerate(rows)])
    return np.array(list(first.values())), np.array([r["feature"] for r in rows]), np.array([r["threshold"] for r in rows]), place("left"), place("right"), np.array([r["value"] for r in rows])


def predictions(forest: Forest, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Each row of `df`: `keep`, and suggestion, score (the class's share, or the number), base and contributions (column, value), which add up to the score."""
    rows = df.select(*keep, forest.features().alias("_x"))
    columns = list(dict.fromkeys(forest.columns))
    of = np.array([columns.index(c) for c in forest.columns])
    labels = forest.labels
    shared = df.sparkSession.sparkContext.broadcast(_arrays(forest.nodes))
    part = StructType([StructField("column", StringType()), StructField("value", DoubleType())])
    schema = StructType([*(rows.schema[c] for c in keep), StructField("suggestion", StringType()), StructField("score", DoubleType()), StructField("base", DoubleType()), StructField("contributions", ArrayType(part))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, feature, threshold, left, right, value = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, _STEP):
                batch = whole.slice(lo, _STEP)
                n = batch.num_rows
                line = np.arange(n)
                x = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                paths, total = [], np.zeros((n, value.shape[1]))
                for root in roots.tolist():
                    at = np.full(n, root)
                    path = [at]
                    while (left[at] != at).any():
                        at = np.where(left[at] == at, at, np.where(x[line, np.maximum(feature[at], 0)] <= threshold[at], left[at], right[at]))
                        path.append(at)
                    total += value[at]
                    paths.append(path)
                best = np.argmax(total, axis=1)
                score = total[line, best] / len(roots)
                credit = np.zeros((n, len(columns)))
                for path in paths:
                    for a, b in zip(path, path[1:], strict=False):
                        moved = np.flatnonzero(a != b)
                        credit[moved, of[feature[a[moved]]]] += value[b[moved], best[moved]] - value[a[moved], best[moved]]
                credit /= len(roots)
                base = value[roots].mean(axis=0)[best]
                said = pa.array([labels[k] for k in best] if labels else [repr(float(s)) for s in score], pa.string())
                parts = pa.StructArray.from_arrays([pa.array(columns * n, pa.string()), pa.array(credit.ravel())], ["column", "value"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(columns)), parts)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), said, pa.array(score), pa.array(base), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def explained(found: DataFrame, most: int = 5) -> DataFrame:
    """Predictions with `explanation`: the base and the `most` columns that moved the prediction most, ties by name."""
    ranked = F.slice(F.sort_array(F.transform("contributions", lambda e: F.struct((-F.abs(e["value"])).alias("a"), e["column"].alias("c"), e["value"].alias("v")))), 1, most)
    said = F.transform(ranked, lambda e: F.concat(e["c"], F.when(e["v"] < 0, " lowers it by ").otherwise(" raises it by "), F.format_string("%.4f", F.abs(e["v"]))))
    return found.withColumn("explanation", F.concat(F.format_string("%.4f", "score"), F.lit(" from "), F.format_string("%.4f", "base"), F.lit(": "), F.array_join(said, "; ")))


def predict_missing(forest: Forest, df: DataFrame, key: str, target: str) -> DataFrame:
    """(row_id, suggestion) of the rows whose target is missing; only those are predicted."""
    missing = df.where(F.col(target).isNull()).withColumn("row_id", F.col(key))
    return predictions(forest, missing, ["row_id"]).select("row_id", "suggestion")


def training_plan(df: DataFrame, numeric: Sequence[str], categories: Sequence[str], least: float = 0.1) -> list[tuple[str, list[str]]]:
    """(column, what it depends on, the strongest first) of each column with missing cells, in the order of imputing: those of fewest missing cells first.

    Rows of this plan are columns; dependences count both ways.
    """
    columns = [*numeric, *categories]
    counts = df.agg(*(F.count(c).alias(c) for c in columns), F.count("*").alias("_n")).first()
    short = [c for c in columns if counts[c] < counts["_n"] and counts[c] >= LEAST_ROWS]
    if not short:
        return []
    scores: dict[str, list[tuple[float, str]]] = {}
    for r in all_dependencies(df, numeric, categories, LEAST_ROWS, least).collect():
        scores.setdefault(r["target"], []).append((-r["score"], r["predictor"]))
        scores.setdefault(r["predictor"], []).append((-r["score"], r["target"]))
    plan = [(c, [p for _, p in sorted(scores.get(c, []))]) for c in sorted(short, key=lambda c: (-counts[c], c))]
    return [(c, reads) for c, reads in plan if reads]


def impute_all(df: DataFrame, key: str, numeric: Sequence[str], categories: Sequence[str], rows: int = 20_000, chained: bool = False, plan: Sequence[tuple[str, Sequence[str]]] | None = None, trees: int = 50, depth: int = 10) -> tuple[DataFrame, dict[str, Forest]]:
    """(row_id, column, suggestion, score, base, contributions) of every missing cell whose column has a forest, and the forests.

    Each column's forest reads the columns of its plan and learns from about `rows` of its known rows, chosen by
    the hash of `key`.  With `chained`, columns that come later in the plan read what was imputed before.
    """
    plan = training_plan(df, numeric, categories) if plan is None else plan
    out, forests, now = None, {}, df
    for target, reads in plan:
        known = now.where(F.col(target).isNotNull())
        n, distinct = known.agg(F.count("*"), F.approx_count_distinct(target)).first()
        if n < LEAST_ROWS or (target in categories and distinct > MOST_LABELS):
            continue
        share = min(1 << 40, (rows << 40) // n + 1)
        sample = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < share)
        forest = train_imputer(sample, target, [c for c in reads if c in numeric], [c for c in reads if c in categories], target in categories, trees, depth)
        forests[target] = forest
        missing = now.where(F.col(target).isNull()).withColumn("row_id", F.col(key)).withColumn("_column", F.lit(target))
        found = predictions(forest, missing, ["row_id", "_column"]).withColumnRenamed("_column", "column")
        if chained:
            found = stored(found, "imputed")
            filled = found.select(F.col("row_id").alias(key), F.col("suggestion").try_cast(dict(df.dtypes)[target]).alias("_filled"))
            now = stored(now.join(filled, key, "left").withColumn(target, F.coalesce(target, "_filled")).drop("_filled"), "filled")
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = "suggestion string, score double, base double, contributions array<struct<column:string,value:double>>"
        out = df.select(F.col(key).alias("row_id"), F.lit("").alias("column")).limit(0).selectExpr("*", *(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (x.strip().split(" ", 1) for x in empty.split(", "))))
    return out, forests


def permutation_importance(forest: Forest, df: DataFrame, target: str, features: Sequence[str], seed: int = 42) -> DataFrame:
    """(feature, importance): how much the share of right predictions falls when one feature's values are dealt anew.

    Values are dealt by joining rows with rows in another hashed order, within hashed parts.
    """
    numbered = df.where(F.col(target).isNotNull()).withColumn("_id", F.monotonically_increasing_id())
    known = stored(numbered.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(64))), "importance")
    rank = lambda salt: F.expr(f"row_number() OVER (PARTITION BY _part ORDER BY xxhash64({salt}, _id), _id)")
    right = lambda d: predictions(forest, d, [target]).agg(F.avg((F.col("suggestion") == F.col(target).cast("string")).cast("double")).alias("share"))
    whole = right(known)
    out = None
    for k, f in enumerate(features):
        dealt = known.withColumn("_at", rank(seed)).drop(f).join(known.select("_part", rank(seed + 1 + k).alias("_at"), f), ["_part", "_at"])
        row = right(dealt).select(F.lit(f).alias("feature"), "share")
        out = row if out is None else out.unionByName(row)
    return out.crossJoin(F.broadcast(whole.withColumnRenamed("share", "full"))).select("feature", F.round(F.col("full") - F.col("share"), 6).alias("importance"))  # whole: one row
