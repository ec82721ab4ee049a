"""Queries of the cleaning operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.operators import dependencies, fixes, forests, issues
from tabwarden.operators.issues import Rule
from tabwarden.plans.register import Registry, table

R = Registry()

COLUMNS = ("quantity", "discount", "tax", "price", "returnflag", "linestatus")
NUMERIC = ("quantity", "discount", "tax", "price")
RULES = (Rule("quantity", 1, 45), Rule("discount", 0, 0.09), Rule("returnflag", allowed=("A", "N")))

_LINES = """lines AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS quantity, l_discount AS discount, l_tax AS tax, l_extendedprice AS price,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag END AS returnflag, l_linestatus AS linestatus FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with some cells missing."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linenumber") != 6, F.col("l_returnflag")).alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
    )


_MISSING = " UNION ALL ".join(f"SELECT row_id, '{c}' AS \"column\", 'missing' AS issue_type, CAST(NULL AS VARCHAR) AS current_value, 'not null' AS rule_violated FROM lines WHERE {c} IS NULL" for c in COLUMNS)
_RANGE = " UNION ALL ".join(f"SELECT row_id, '{c}' AS \"column\", 'invalid' AS issue_type, CAST({c} AS VARCHAR) AS current_value, '{rule}' AS rule_violated FROM lines WHERE {c} {op}" for c, op, rule in (("quantity", "< 1", "min 1"), ("quantity", "> 45", "max 45"), ("discount", "< 0", "min 0"), ("discount", "> 0.09", "max 0.09")))
_ALLOWED = "SELECT row_id, 'returnflag' AS \"column\", 'invalid' AS issue_type, returnflag AS current_value, 'allowed A|N' AS rule_violated FROM lines WHERE returnflag NOT IN ('A', 'N')"
_FENCE = lambda c: f"f_{c} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM lines)"
_OUT = lambda c: f"SELECT row_id, '{c}' AS \"column\", 'outlier' AS issue_type, CAST({c} AS VARCHAR) AS current_value, 'iqr' AS rule_violated FROM lines, f_{c} WHERE n > 10 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
_ALL = f"WITH {_LINES}, {_FENCE('tax')}, {_FENCE('price')}, issues AS ({_MISSING} UNION ALL {_RANGE} UNION ALL {_ALLOWED} UNION ALL {_OUT('tax')} UNION ALL {_OUT('price')})"


@R.query(f"WITH {_LINES} {_MISSING}")
def issues_missing(spark, sf_dir):
    return issues.missing(lines(spark, sf_dir), "row_id", COLUMNS)


@R.query(f"WITH {_LINES} {_RANGE}")
def issues_range(spark, sf_dir):
    return issues.out_of_range(lines(spark, sf_dir), "row_id", RULES)


@R.query(f"WITH {_LINES} {_ALLOWED}")
def issues_allowed(spark, sf_dir):
    return issues.not_allowed(lines(spark, sf_dir), "row_id", RULES)


@R.query(
    """WITH f AS (SELECT quantile_cont(o_totalprice * o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice * o_totalprice, 0.75) AS q3 FROM orders)
SELECT o_orderkey AS row_id, 'squared' AS "column", 'outlier' AS issue_type, 'iqr' AS rule_violated FROM orders, f
WHERE o_totalprice * o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice * o_totalprice > q3 + 1.5 * (q3 - q1)"""
)
def issues_iqr(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * F.col("o_totalprice")).alias("squared"))
    return issues.outliers(t, "o_orderkey", ("squared",)).drop("current_value")


@R.query(f'{_ALL} SELECT "column", issue_type, count(*) AS n FROM issues GROUP BY ALL')
def issue_counts(spark, sf_dir):
    return issues.issue_counts(issues.detect(lines(spark, sf_dir), "row_id", COLUMNS, RULES, NUMERIC))


_GROUPS = "SELECT count(*) AS n FROM lines GROUP BY " + ", ".join(COLUMNS)


@R.query(f"WITH {_LINES} SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM ({_GROUPS})")
def duplicate_rows(spark, sf_dir):
    return issues.duplicate_rows(lines(spark, sf_dir), COLUMNS)


@R.query(f"WITH {_LINES} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) = 1 AS is_constant FROM lines" for c in NUMERIC))
def constant_columns(spark, sf_dir):
    return issues.constant_columns(lines(spark, sf_dir), NUMERIC)


_BANDS = lambda p, pts: f"CASE WHEN {p} = 0 THEN {pts[0]} WHEN {p} < 1 THEN {pts[1]} WHEN {p} < 5 THEN {pts[2]} WHEN {p} < 10 THEN {pts[3]} WHEN {p} < 20 THEN {pts[4]} ELSE greatest(0.0, 40 - 2 * {p}) END"
_QUALITY = f"""{_ALL}, i AS (SELECT count(*) FILTER (issue_type = 'missing') AS n_missing, count(*) FILTER (issue_type = 'invalid') AS n_invalid, count(*) FILTER (issue_type = 'outlier') AS n_outlier FROM issues),
d AS (SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM ({_GROUPS})),
k AS (SELECT {' + '.join(f'CAST(count(DISTINCT {c}) = 1 AS BIGINT)' for c in NUMERIC)} AS n_constant FROM lines),
p AS (SELECT *, 100.0 * n_missing / (n_rows * {len(COLUMNS)}) AS pm, 100.0 * (n_invalid + n_outlier) / (n_rows * {len(COLUMNS)}) AS pv, 100.0 * duplicates / n_rows AS pd FROM d, i, k),
s AS (SELECT n_rows, duplicates, n_missing, n_invalid, n_outlier, n_constant, round(CAST({_BANDS('pm', issues.COMPLETENESS)} AS DOUBLE), 4) AS completeness,
 round(CAST({_BANDS('pv', issues.VALIDITY)} AS DOUBLE), 4) AS validity, round(CAST(20 - least(10.0, 2 * pd) - least(5.0, 2.0 * n_constant) AS DOUBLE), 4) AS consistency FROM p)
SELECT *, round(completeness + validity + consistency, 4) AS total, CASE WHEN completeness + validity + consistency >= 90 THEN 'A' WHEN completeness + validity + consistency >= 75 THEN 'B'
 WHEN completeness + validity + consistency >= 60 THEN 'C' WHEN completeness + validity + consistency >= 40 THEN 'D' ELSE 'F' END AS grade FROM s"""


@R.query(_QUALITY)
def quality_report(spark, sf_dir):
    return issues.quality_report(lines(spark, sf_dir), "row_id", COLUMNS, RULES, NUMERIC)


_CAPPED = _QUALITY.replace("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS quantity, l_discount AS discount", "CASE WHEN l_linenumber = 7 THEN NULL ELSE least(greatest(l_quantity, 1), 45) END AS quantity, least(greatest(l_discount, 0), 0.09) AS discount")


@R.query(f"SELECT 'before' AS stage, * FROM ({_QUALITY}) UNION ALL SELECT 'after' AS stage, * FROM ({_CAPPED})")
def quality_before_after(spark, sf_dir):
    """The whole report before and after all values out of range are capped."""
    before = lines(spark, sf_dir)
    after = before.withColumns({r.column: fixes.cap(F.col(r.column), float(r.low), float(r.high)) for r in RULES if r.high is not None})
    report = lambda t, stage: issues.quality_report(t, "row_id", COLUMNS, RULES, NUMERIC).select(F.lit(stage).alias("stage"), "*")
    return report(before, "before").unionByName(report(after, "after"))


@R.query(f"""{_ALL}, a AS (SELECT * FROM (VALUES ('returnflag', 'A|N'), ('quantity', (SELECT string_agg(CAST(q AS VARCHAR), '|' ORDER BY n DESC, q) FROM (SELECT quantity AS q, count(*) AS n FROM lines WHERE quantity IS NOT NULL GROUP BY 1 ORDER BY n DESC, q LIMIT 3)))) v("column", alternatives))
SELECT row_id, i."column", issue_type, current_value, rule_violated, alternatives, CASE WHEN issue_type = 'invalid' AND i."column" = 'quantity' THEN least(greatest(CAST(current_value AS DOUBLE), 1), 45) WHEN issue_type = 'invalid' AND i."column" = 'discount' THEN least(greatest(CAST(current_value AS DOUBLE), 0), 0.09) END AS cap_suggestion FROM issues i LEFT JOIN a ON a."column" = i."column" """)
def fixes_table(spark, sf_dir):
    t = lines(spark, sf_dir)
    allowed = spark.createDataFrame([("returnflag", "A", 1), ("returnflag", "N", 2)], "column string, value string, rank int")
    out = fixes.fixes_table(issues.detect(t, "row_id", COLUMNS, RULES, NUMERIC), allowed.unionByName(fixes.modes(t, "quantity")), RULES)
    return out.withColumn("alternatives", F.array_join("alternatives", "|")).drop("ml_suggestion")


@R.query("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rank FROM orders GROUP BY o_orderpriority QUALIFY rank <= 3")
def alternatives_text_modes(spark, sf_dir):
    return fixes.modes(table(spark, sf_dir, "orders"), "o_orderpriority")


@R.query(
    """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY ALL), r AS (SELECT x, sum(o) AS r FROM c GROUP BY x), k AS (SELECT y, sum(o) AS c FROM c GROUP BY y),
t AS (SELECT round(CAST(sum(o) * (sum(o * o / (r * c)) - 1) AS DOUBLE), 4) AS chi2 FROM c JOIN r USING (x) JOIN k USING (y)) SELECT 'l_returnflag' AS target, 'l_linestatus' AS predictor, 'chi2' AS method, round(1 - exp(-chi2 / 2), 6) AS score FROM t"""
)
def deps_chi2_score(spark, sf_dir):
    """Two degrees of freedom, where the p-value is exp(-chi2 / 2)."""
    return dependencies.chi_square_score(dependencies.chi_square(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))


@R.query()
def dependency_table(spark, sf_dir):
    """All pairs of columns of lineitem that depend on each other."""
    return dependencies.all_dependencies(lines(spark, sf_dir), ("quantity", "price", "tax"), ("returnflag", "linestatus"))


@R.query(
    """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 7 THEN o_totalprice + 100000000 WHEN o_orderkey % 500 = 9 THEN -100000000 ELSE o_totalprice END AS price FROM orders), f AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM v)
SELECT o_orderkey AS row_id, 'price' AS "column", 'outlier' AS issue_type, 'iqr' AS rule_violated FROM v, f WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)"""
)
def issues_iqr_found(spark, sf_dir):
    """Prices of which some are far off."""
    k = F.col("o_orderkey") % 500
    price = F.when(k == 7, F.col("o_totalprice") + 100000000).when(k == 9, F.lit(-100000000.0)).otherwise(F.col("o_totalprice"))
    return issues.outliers(table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price")), "o_orderkey", ("price",)).drop("current_value")


_IDS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@R.query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", contains(lower('{c}'), 'id') AS by_name, round(count(DISTINCT {c}) / count(*), 6) AS distinct_ratio, contains(lower('{c}'), 'id') OR count(DISTINCT {c}) / count(*) > 0.95 AS is_id FROM customer" for c in _IDS))
def id_columns(spark, sf_dir):
    return dependencies.id_columns(table(spark, sf_dir, "customer"), _IDS, ("c_custkey",))


@R.query(
    """WITH d AS (SELECT o_orderkey - lag(o_orderkey) OVER (ORDER BY o_orderkey) AS d FROM orders)
SELECT 'o_orderkey' AS "column", round(count(*) FILTER (d = 1) / count(d), 6) AS share, count(*) FILTER (d = 1) / count(d) > 0.9 AS is_sequence FROM d"""
)
def sequential_id(spark, sf_dir):
    return dependencies.consecutive_share(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey")


@R.query(
    """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem),
k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM r)
SELECT 'l_quantity' AS target, 'l_extendedprice' AS predictor, 'spearman' AS method, round(abs(corr(rx, ry)), 4) AS score FROM k"""
)
def deps_spearman(spark, sf_dir):
    return dependencies.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@R.query(
    """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY ALL), r AS (SELECT x, sum(o) AS r FROM c GROUP BY x), k AS (SELECT y, sum(o) AS c FROM c GROUP BY y)
SELECT 'l_returnflag' AS target, 'l_linestatus' AS predictor, round(CAST(sum(o) * (sum(o * o / (r * c)) - 1) AS DOUBLE), 4) AS chi2, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof FROM c JOIN r USING (x) JOIN k USING (y)"""
)
def deps_chi2(spark, sf_dir):
    return dependencies.chi_square(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@R.query(
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT o_orderpriority AS x, least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) AS y, count(*) AS o FROM orders, e GROUP BY ALL),
r AS (SELECT x, sum(o) AS r FROM c GROUP BY x), k AS (SELECT y, sum(o) AS c FROM c GROUP BY y), n AS (SELECT sum(o) AS n FROM c)
SELECT 'o_orderpriority' AS target, 'o_totalprice' AS predictor, 'mutual_info' AS method, round(CAST(sum(o / n * ln(o * n / (r * c))) AS DOUBLE), 6) AS score FROM c JOIN r USING (x) JOIN k USING (y), n"""
)
def deps_mutual_info(spark, sf_dir):
    return dependencies.mutual_information(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


_NEIGHBOURS = """WITH p AS (SELECT o_orderpriority AS x, CAST(o_totalprice AS DOUBLE) AS v, count(*) OVER (PARTITION BY o_orderpriority) AS nx FROM orders),
d AS (SELECT x, v, nx, least(3, nx - 1) AS ki, list_sort(list_filter([v - lag(v, 1) OVER w, v - lag(v, 2) OVER w, v - lag(v, 3) OVER w, lead(v, 1) OVER w - v, lead(v, 2) OVER w - v, lead(v, 3) OVER w - v], lambda e: e IS NOT NULL)) AS near FROM p WHERE nx > 1 WINDOW w AS (PARTITION BY x ORDER BY v)),
r AS (SELECT *, near[ki] AS r FROM d), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER (ORDER BY v) - n AS under FROM (SELECT v, count(*) AS n FROM d GROUP BY v)),
far AS (SELECT r.nx, r.ki, coalesce(a.upto, 0) - coalesce(b.upto, 0) AS m FROM (SELECT *, v + r AS hi, v - r AS lo FROM r WHERE r > 0) r ASOF LEFT JOIN c a ON r.hi > a.v ASOF LEFT JOIN c b ON r.lo >= b.v),
here AS (SELECT nx, ki, upto - under AS m FROM r JOIN c USING (v) WHERE r = 0), m AS (SELECT * FROM far UNION ALL SELECT * FROM here),
psi AS (SELECT i, sum(CASE WHEN i > 1 THEN 1.0 / (i - 1) ELSE 0 END) OVER (ORDER BY i) - 0.5772156649015329 AS p FROM range(1, (SELECT count(*) + 2 FROM orders)) t(i)),
s AS (SELECT count(*) AS n, sum(k.p - x.p - w.p) AS s FROM m JOIN psi k ON k.i = m.ki JOIN psi x ON x.i = m.nx JOIN psi w ON w.i = m.m)
SELECT 'o_orderpriority' AS target, 'o_totalprice' AS predictor, 'mutual_info' AS method, round(CAST(greatest(p + s / n, 0) AS DOUBLE), 6) AS score FROM s JOIN psi ON i = n"""


@R.query(_NEIGHBOURS)
def deps_neighbour_info(spark, sf_dir):
    return dependencies.neighbour_information(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@R.query(_NEIGHBOURS.replace("o_orderpriority AS x, CAST(o_totalprice AS DOUBLE) AS v", "l_returnflag AS x, CAST(l_quantity AS DOUBLE) AS v").replace("PARTITION BY o_orderpriority", "PARTITION BY l_returnflag").replace("FROM orders", "FROM lineitem").replace("'o_orderpriority'", "'l_returnflag'").replace("'o_totalprice'", "'l_quantity'"))
def deps_neighbour_info_ties(spark, sf_dir):
    """A number of few values, so that most neighbours are equal."""
    return dependencies.neighbour_information(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@R.query(
    """WITH w AS (SELECT unnest(['R', 'A', 'N', 'X']) AS value), c AS (SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT w.value, row_number() OVER (ORDER BY coalesce(n, 0) DESC, w.value) AS rank FROM w LEFT JOIN c USING (value)) SELECT 'l_returnflag' AS "column", value, rank FROM r WHERE rank <= 3"""
)
def alternatives_allowed(spark, sf_dir):
    return fixes.allowed_alternatives(table(spark, sf_dir, "lineitem"), "l_returnflag", ("R", "A", "N", "X"))


@R.query("SELECT 'l_quantity' AS \"column\", round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.75), 6) AS q75 FROM lineitem WHERE l_quantity BETWEEN 5 AND 45")
def alternatives_numeric(spark, sf_dir):
    return fixes.numeric_alternatives(table(spark, sf_dir, "lineitem"), "l_quantity", 5, 45)


@R.query(
    """WITH c AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1), m AS (SELECT CAST(v AS DOUBLE) AS mode FROM c ORDER BY n DESC, v LIMIT 1)
SELECT 'p_size' AS "column", (SELECT round(CAST(median(p_size) AS DOUBLE), 6) FROM part) AS median, (SELECT round(avg(p_size), 6) FROM part) AS mean, mode FROM m"""
)
def alternatives_fallback(spark, sf_dir):
    return fixes.fallback_alternatives(table(spark, sf_dir, "part"), "p_size")


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_quantity, 5.0), 45.0) AS capped FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45")
def cap_to_boundary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where("l_quantity < 5 OR l_quantity > 45")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", fixes.cap(F.col("l_quantity"), 5.0, 45.0).alias("capped"))


@R.query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 40 ELSE p_size END AS p_size, CASE WHEN p_partkey % 10 = 0 THEN 'checked' ELSE p_type END AS p_type FROM part")
def apply_fixes(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    chosen = t.where("p_size > 40").select(F.col("p_partkey").alias("row_id"), F.lit("p_size").alias("column"), F.lit("40").alias("value"), F.lit(2).alias("made"))
    chosen = chosen.unionByName(t.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("row_id"), F.lit("p_type").alias("column"), F.lit("checked").alias("value"), F.lit(1).alias("made")))
    # an earlier fix of the same cells
    chosen = chosen.unionByName(t.where("p_size > 40").select(F.col("p_partkey").alias("row_id"), F.lit("p_size").alias("column"), F.lit("9").alias("value"), F.lit(1).alias("made")))
    return fixes.apply_fixes(t, chosen, "p_partkey", ("p_size", "p_type"))


@R.query("SELECT s_suppkey, CASE WHEN s_acctbal - 5000 <= 0 THEN abs(s_acctbal - 5000) + (CASE WHEN s_acctbal = 5000 THEN 1 ELSE 0 END) ELSE s_acctbal - 5000 END AS positive, least(s_acctbal - 5000, 0.0) AS non_positive FROM supplier")
def constraint_adjust(spark, sf_dir):
    x = F.col("s_acctbal") - 5000
    return table(spark, sf_dir, "supplier").select("s_suppkey", fixes.satisfy_constraint(x, "positive").alias("positive"), fixes.satisfy_constraint(x, "non-positive").alias("non_positive"))


@R.query()
def impute_forest(spark, sf_dir, rows: int = 20_000):
    """Predictions for the missing return flags of lineitem; the forest learns from about `rows` of the known rows."""
    t = lines(spark, sf_dir)
    known = t.where("returnflag IS NOT NULL")
    n = known.count()
    model = fixes.train_imputer(known.sample(min(1.0, rows / max(n, 1)), seed=42), "returnflag", ("quantity", "discount", "price"), ("linestatus",), True)
    return fixes.predict_missing(model, t, "row_id", "returnflag")


def _imputed(spark, sf_dir) -> DataFrame:
    t = lines(spark, sf_dir)
    return forests.explained(forests.impute_all(t, "row_id", ("quantity", "discount", "price"), ("returnflag", "linestatus"))[0])


@R.query()
def impute_columns(spark, sf_dir):
    """Every missing cell of lineitem, by a forest a column that reads what the column depends on."""
    return _imputed(spark, sf_dir).select("row_id", "column", "suggestion", F.round("score", 9).alias("score"))


@R.query()
def impute_explained(spark, sf_dir):
    """What moved each prediction: base, contributions of columns, and the first five in words."""
    return _imputed(spark, sf_dir).select("row_id", "column", "score", "base", F.expr("aggregate(contributions, 0D, (a, e) -> a + e.value)").alias("moved"), "explanation")
