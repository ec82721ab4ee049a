"""Rename detection: which removed column an added one continues.

Facts are as `profile.column_facts` gives them, changes as `drift.changes`.  Candidates are columns by
columns of one batch, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.normalise import norm_name
from tabwarden.functions.stored import stored
from tabwarden.operators.profile import BATCH

# Words that stand for `id`, name parts of semantic classes, thresholds, abbreviations.
ID_WORDS = ("code", "identifier", "ident", "pk", "key", "no", "number", "ref", "reference", "uid", "guid", "uuid")
ID_PARTS = ("id", "uuid", "guid", "pk", "key", "code", "ref", "reference", "number", "no")
DATE_PARTS = ("date", "time", "ts", "timestamp", "datetime")
LEAST_THRESHOLD, MOST_THRESHOLD = 0.58, 0.66
EMBEDDING_THRESHOLD = 0.55
FEATURES = ("name_sim", "token_jaccard", "emb_sim", "type_compat", "null_rate_diff", "mean_diff", "std_diff", "range_overlap")
ABBREVIATIONS = {"qty": "quantity", "amt": "amount", "num": "number", "addr": "address", "dob": "birthdate", "cust": "customer", "acct": "account", "bal": "balance", "ts": "timestamp", "desc": "description"}
NUMERIC = ("int", "float")


def heuristic_threshold(threshold: float) -> float:
    """Without a learned scorer, thresholds are held between two limits."""
    return min(max(threshold, LEAST_THRESHOLD), MOST_THRESHOLD)


def _mapped(words: Column, table: dict[str, str]) -> Column:
    lookup = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(lookup, w), w))


def name_tokens(c: Column) -> Column:
    """Words of a name, camel case split, the words for `id` as one."""
    apart = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    return F.array_distinct(_mapped(F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda x: x != ""), {w: "id" for w in ID_WORDS}))


def _jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def token_jaccard(a: Column, b: Column) -> Column:
    """1 if both have no words, 0 if one has none."""
    return _jaccard(name_tokens(a), name_tokens(b))


def name_similarity(a: Column, b: Column) -> Column:
    """0.6 Jaccard of the normalised names' words + 0.4 shared characters over the longer name."""
    x, y = norm_name(a), norm_name(b)
    letters = F.split(F.lit("abcdefghijklmnopqrstuvwxyz0123456789_"), "")
    count = lambda s, ch: F.length(s) - F.length(F.replace(s, ch))
    shared = F.aggregate(F.transform(letters, lambda ch: F.least(count(x, ch), count(y, ch))), F.lit(0), lambda acc, n: acc + n)
    return F.when(x == y, F.lit(1.0)).otherwise(0.6 * _jaccard(F.array_distinct(F.split(x, "_")), F.array_distinct(F.split(y, "_"))) + 0.4 * shared / F.greatest(F.length(x), F.length(y), F.lit(1)))


def abbreviation_similarity(a: Column, b: Column) -> Column:
    """0.55 edit similarity + 0.30 Jaccard of the words with abbreviations written out + 0.15 common prefix over the longer name."""
    x, y = norm_name(a), norm_name(b)
    longer = F.greatest(F.length(x), F.length(y), F.lit(1))
    full = lambda c: F.array_distinct(_mapped(F.split(c, "_"), ABBREVIATIONS))
    prefix = F.size(F.filter(F.sequence(F.lit(1), longer), lambda i: (i <= F.least(F.length(x), F.length(y))) & (F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i))))
    return F.when(x == y, F.lit(1.0)).otherwise(0.55 * (1 - F.levenshtein(x, y) / longer) + 0.30 * _jaccard(full(x), full(y)) + 0.15 * prefix / longer)


def type_compatible(a: Column, b: Column) -> Column:
    return (a == b) | (a.isin(*NUMERIC) & b.isin(*NUMERIC))


def semantic_class(name: Column, kind: Column, match: str = "substring") -> Column:
    """date, id, numeric, string or other; parts of names are looked for anywhere (`substring`) or as words (`token`)."""
    n = F.lower(name)
    if match == "token":
        has = lambda parts: n.rlike("(^|[^a-z0-9])(" + "|".join(parts) + ")($|[^a-z0-9])")
    else:
        has = lambda parts: n.rlike("|".join(parts))
    return F.when(kind == "datetime", "date").when(has(ID_PARTS), "id").when(has(DATE_PARTS), "date").when(kind.isin(*NUMERIC), "numeric").when(kind == "string", "string").otherwise("other")


def _cut(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def embedding(texts: DataFrame, text: str) -> DataFrame:
    """(text, bucket, w): hashed character n-grams (3 to 5) of the lower-cased, padded text, in 256 buckets, scaled to length 1."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text)), r"[ \t\r\n\f]+", " "), F.lit(" "))
    grams = []
    for n in (3, 4, 5):
        at = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        grams.append(F.transform(at, _cut(padded, n)))
    each = texts.select(text).distinct().select(text, F.explode(F.concat(*grams)).alias("g"))
    counts = each.groupBy(text, F.conv(F.substring(F.md5("g"), 1, 2), 16, 10).cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("hits"))
    length = F.sqrt(F.sum(F.col("hits") * F.col("hits")).over(Window.partitionBy(text)))
    return counts.select(text, "bucket", (F.col("hits") / length).alias("w"))


def description(name: Column, kind: Column, null_rate: Column, examples: Column) -> Column:
    """What is embedded for a column: its name, type, share of nulls and examples (array<string>)."""
    quoted = F.array_join(F.transform(F.slice(examples, 1, 10), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return F.concat(F.lit("column_name="), name, F.lit("\ntype="), kind, F.lit("\nnull_rate="), F.format_string("%.3f", F.coalesce(null_rate, F.lit(0.0))), F.lit("\nexamples=["), F.coalesce(quoted, F.lit("")), F.lit("]\n"))


def candidates(found: DataFrame, baseline: DataFrame, facts: DataFrame, examples: DataFrame, top: int = 12, scorer: Scorer | None = None, range_overlap: bool = False) -> DataFrame:
    """For each removed column, the `top` added ones most like it, with their features and score.

    baseline (dataset, column, type, null_rate, mean, std, min, max, examples) describes the canonical columns;
    examples (dataset, batch_id, column, examples) the observed ones.  Small tables, both written.
    """
    removed = found.where("kind = 'REMOVE'").select(*BATCH, F.col("column").alias("old_name"), F.col("old").alias("old_type"))
    added = found.where("kind = 'ADD'").select(*BATCH, F.col("column").alias("new_name"), F.col("new").alias("new_type"))
    profile = ("null_rate", "mean", "std", "min", "max", "examples")
    b = baseline.select("dataset", F.col("column").alias("old_name"), *(F.col(c).alias(f"b_{c}") for c in profile))
    o = facts.join(examples, [*BATCH, "column"], "left").select(*BATCH, F.col("column").alias("new_name"), *(F.col(c).alias(f"o_{c}") for c in profile))
    pairs = removed.join(added, list(BATCH)).join(b, ["dataset", "old_name"], "left").join(o, [*BATCH, "new_name"], "left")
    pairs = pairs.withColumn("old_text", description(F.col("old_name"), F.col("old_type"), F.col("b_null_rate"), F.col("b_examples"))).withColumn("new_text", description(F.col("new_name"), F.col("new_type"), F.col("o_null_rate"), F.col("o_examples")))
    pairs = stored(pairs, "match-pairs")
    e = embedding(pairs.select(F.col("old_text").alias("t")).unionByName(pairs.select(F.col("new_text").alias("t"))), "t")
    x, y = e.select(F.col("t").alias("old_text"), "bucket", F.col("w").alias("a")), e.select(F.col("t").alias("new_text"), "bucket", F.col("w").alias("b"))
    cosine = pairs.select("old_text", "new_text").distinct().join(x, "old_text").join(y, ["new_text", "bucket"]).groupBy("old_text", "new_text").agg(F.sum(F.col("a") * F.col("b")).alias("emb"))
    joined = pairs.join(cosine, ["old_text", "new_text"], "left").withColumn("emb_sim", F.round(F.coalesce("emb", F.lit(0.0)), 6))
    both = F.col("old_type").isin(*NUMERIC) & F.col("new_type").isin(*NUMERIC)
    diff = lambda c: F.round(F.when(both, F.coalesce(F.abs(F.col(f"b_{c}") - F.col(f"o_{c}")), F.lit(0.0))).otherwise(0.0), 6)
    overlap = F.lit(0.0)
    if range_overlap:
        shared = F.least("b_max", "o_max") - F.greatest("b_min", "o_min")
        overlap = F.when(both, F.coalesce(F.greatest(shared, F.lit(0.0)) / F.nullif(F.greatest("b_max", "o_max") - F.least("b_min", "o_min"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    old, new = F.col("old_name"), F.col("new_name")
    featured = joined.withColumns(
        {
            "name_sim": F.round(name_similarity(old, new), 6),
            "token_jaccard": F.round(token_jaccard(old, new), 6),
            "type_compat": type_compatible(F.col("old_type"), F.col("new_type")).cast("double"),
            "null_rate_diff": F.round(F.abs(F.coalesce("b_null_rate", F.lit(0.0)) - F.coalesce("o_null_rate", F.lit(0.0))), 6),
            "mean_diff": diff("mean"),
            "std_diff": diff("std"),
            "range_overlap": F.round(overlap, 6),
            "same_class": semantic_class(old, F.col("old_type")) == semantic_class(new, F.col("new_type")),
        }
    )
    if scorer is None:
        scored = featured.withColumn("score", F.round(heuristic_score(), 6))
    else:
        scored = featured.withColumn("score", F.round(scorer.score(), 6))
    at = F.row_number().over(Window.partitionBy(*BATCH, "old_name").orderBy(F.desc("emb_sim"), "new_name"))
    return scored.withColumn("rank", at).where(F.col("rank") <= top).select(*BATCH, "old_name", "new_name", *FEATURES, "same_class", "score", "rank")


def heuristic_score() -> Column:
    """Of the features, 0 for incompatible types."""
    c = F.col
    raw = 0.28 * c("name_sim") + 0.18 * c("token_jaccard") + 0.22 * c("emb_sim") + 0.10 * c("type_compat") + 0.07 * c("range_overlap") + 0.05 / (1 + c("mean_diff")) + 0.05 / (1 + c("std_diff")) + 0.05 * (1 - F.least(c("null_rate_diff"), F.lit(1.0)))
    return F.when(c("type_compat") == 0, F.lit(0.0)).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


@dataclass(frozen=True)
class Scorer:
    """A logistic model of the features, applied as column arithmetic."""

    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        margin = F.lit(self.intercept)
        for w, c in zip(self.weights, FEATURES, strict=True):
            margin = margin + F.col(c) * w
        return 1 / (1 + F.exp(-margin))


def train_scorer(labelled: DataFrame, penalty: float = 0.01, rounds: int = 25) -> Scorer:
    """labelled (the eight features, label 0 or 1) -> a model whose probability of 1 is the score.

    Newton's method on the mean log loss with a squared penalty of the standardised weights; each round is one
    aggregation whose sums (the features squared) come to the driver.  A feature that doesn't vary has no weight.
    """
    k = len(FEATURES)
    stats = labelled.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURES)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(FEATURES))).first()
    if not stats["n"]:
        raise ValueError("no labelled pairs")
    mean, std = (np.array([stats[f"{x}{i}"] for i in range(k)]) for x in "ms")
    live = std > 1e-12
    scale = np.where(live, std, 1.0)
    x = [F.lit(1.0), *((F.col(c) - float(m)) / float(s) for c, m, s in zip(FEATURES, mean, scale, strict=True))]
    w = np.zeros(k + 1)
    ridge = np.append(0.0, np.where(live, penalty, 1.0))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((x[i] * float(w[i]) for i in range(1, k + 1)), F.lit(float(w[0])))))
        rows = labelled.select(*(c.alias(f"x{i}") for i, c in enumerate(x)), p.alias("p"), F.col("label").cast("double").alias("y"))
        up = F.col("p") * (1 - F.col("p"))
        sums = rows.agg(*(F.avg((F.col("p") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(k + 1)), *(F.avg(up * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1))).first()
        slope = np.array([sums[f"g{i}"] for i in range(k + 1)]) + ridge * w
        curve = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + np.diag(ridge) + 1e-9 * np.eye(k + 1)
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    weights = np.where(live, w[1:] / scale, 0.0)
    return Scorer(tuple(weights.tolist()), float(w[0] - weights @ mean))


def acceptable(threshold: float, embedding_threshold: float = EMBEDDING_THRESHOLD) -> Column:
    """Score or similarity pass, and neither guard objects: meanings that differ, names that have nothing in common."""
    c = F.col
    other_meaning = ~c("same_class") & (c("score") < max(threshold, 0.95)) & ~((c("emb_sim") >= 0.80) & (c("token_jaccard") >= 0.25))
    unrelated = (c("token_jaccard") < 0.20) & (c("name_sim") < 0.55) & ~((c("emb_sim") >= 0.80) & c("same_class"))
    return ((c("score") >= threshold) | (c("emb_sim") >= embedding_threshold)) & ~other_meaning & ~unrelated


def assign(scored: DataFrame, threshold: float = LEAST_THRESHOLD, embedding_threshold: float = EMBEDDING_THRESHOLD) -> DataFrame:
    """(dataset, batch_id, old_name, new_name, confidence): greedy one-to-one by score, similarity and names.

    Confidence is the score where that passes, else the similarity that did.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("a"), (-F.col("emb_sim")).alias("b"), "old_name", "new_name")))
    shape = "struct<olds:array<string>,news:array<string>,pairs:array<struct<old_name:string,new_name:string,confidence:double>>>"
    none = F.array().cast("array<string>")
    empty = F.struct(none.alias("olds"), none.alias("news"), F.array().cast("array<struct<old_name:string,new_name:string,confidence:double>>").alias("pairs")).cast(shape)

    def step(acc: Column, x: Column) -> Column:
        free = ~F.array_contains(acc["olds"], x["old_name"]) & ~F.array_contains(acc["news"], x["new_name"])
        pair = F.struct(x["old_name"].alias("old_name"), x["new_name"].alias("new_name"), F.when(-x["a"] >= threshold, -x["a"]).otherwise(-x["b"]).alias("confidence"))
        grown = F.struct(F.array_append(acc["olds"], x["old_name"]).alias("olds"), F.array_append(acc["news"], x["new_name"]).alias("news"), F.array_append(acc["pairs"], pair).alias("pairs"))
        return F.when(free, grown).otherwise(acc).cast(shape)

    good = scored.where(acceptable(threshold, embedding_threshold)).groupBy(*BATCH).agg(order.alias("ordered"))  # columns of a batch
    return good.select(*BATCH, F.explode(F.aggregate("ordered", empty, step)["pairs"]).alias("p")).select(*BATCH, "p.*")


def candidate_report(scored: DataFrame, renames: DataFrame, threshold: float = LEAST_THRESHOLD, most: int = 50) -> DataFrame:
    """The best `most` candidates of each batch, with what became of them and the thresholds."""
    at = F.row_number().over(Window.partitionBy(*BATCH).orderBy(F.desc("score"), F.desc("emb_sim"), "old_name", "new_name"))
    taken = renames.select(*BATCH, "old_name", "new_name", F.lit(True).alias("accepted"))
    out = scored.withColumn("place", at).where(F.col("place") <= most).join(taken, [*BATCH, "old_name", "new_name"], "left")
    return out.withColumn("accepted", F.coalesce("accepted", F.lit(False))).withColumn("threshold", F.lit(threshold)).withColumn("emb_threshold", F.lit(EMBEDDING_THRESHOLD))
