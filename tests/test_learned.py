"""Forests as tables of nodes against a walk by hand, the scorer, and information from neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwarden.functions.ordered import digamma, neighbours, sums_before
from tabwarden.operators import dependencies, forests, matching
from tabwarden.plans import cleaning

SF = "/root/testdata/sf0.001"


def walk(nodes, x):
    """(mean value of the leaves, mean value of the roots, what each feature added) of one row, by a walk by hand."""
    trees = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["node"]] = n
    end, start, added = 0, 0, {}
    for tree in trees.values():
        n = tree[0]
        start = start + np.array(n["value"])
        while n["left"] >= 0:
            after = tree[n["left"] if x[n["feature"]] <= n["threshold"] else n["right"]]
            added[n["feature"]] = added.get(n["feature"], 0) + np.array(after["value"]) - np.array(n["value"])
            n = after
        end = end + np.array(n["value"])
    return end / len(trees), start / len(trees), {f: v / len(trees) for f, v in added.items()}


def held_by_hand(forest, table, found, key):
    nodes = forest.nodes.collect()
    rows = {r[key]: r["x"] for r in table.select(key, forest.features().alias("x")).collect()}
    for r in found:
        end, start, added = walk(nodes, rows[r["row_id"]])
        k = int(np.argmax(end))
        assert r["score"] == pytest.approx(end[k], abs=1e-9) and r["base"] == pytest.approx(start[k], abs=1e-9)
        assert r["suggestion"] == forest.labels[k] if forest.labels else float(r["suggestion"]) == pytest.approx(end[0], abs=1e-9)
        want = {}
        for f, v in added.items():
            want[forest.columns[f]] = want.get(forest.columns[f], 0) + v[k]
        got = {e["column"]: e["value"] for e in r["contributions"]}
        assert {c: v for c, v in got.items() if abs(v) > 1e-12} == pytest.approx({c: v for c, v in want.items() if abs(v) > 1e-12}, abs=1e-9)
        assert sum(got.values()) + r["base"] == pytest.approx(r["score"], abs=1e-9)


def odd_table(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        a, b = rng.random() * 10, rng.choice("xyz")
        c = 3 * a + {"x": 0, "y": 20, "z": 40}[b] + rng.random()
        rows.append((i, a if i % 11 else None, b if i % 13 else None, c if i % 7 else None, "hi" if c > 30 else "lo", rng.random(), float("nan") if i % 50 == 3 else 1.0))
    return spark.createDataFrame([(*r[:4], r[4] if r[0] % 5 else None, *r[5:]) for r in rows], "id long, a double, b string, c double, d string, e double, f double")


@pytest.fixture(scope="module")
def imputed(spark):
    t = odd_table(spark).cache()
    found, made = forests.impute_all(t, "id", ("a", "c", "e"), ("b", "d"), trees=8, depth=5)
    return t, forests.explained(found).collect(), made


def test_every_column_with_missing_cells_is_predicted(imputed):
    t, found, made = imputed
    missing = {(r["id"], c) for r in t.collect() for c in ("a", "b", "c", "d") if r[c] is None}
    assert {(r["row_id"], r["column"]) for r in found} == missing and set(made) == {"a", "b", "c", "d"}
    for column, forest in made.items():
        held_by_hand(forest, t, [r for r in found if r["column"] == column], "id")
    truth = [(r["suggestion"], "hi" if s["c"] > 30 else "lo") for r in found if r["column"] == "d" for s in [next(x for x in t.collect() if x["id"] == r["row_id"])] if s["c"] is not None]
    assert sum(a == b for a, b in truth) / len(truth) > 0.9


def test_explanations_name_what_moved_most(imputed):
    _, found, _ = imputed
    for r in found[:50]:
        head, tail = r["explanation"].split(": ", 1)
        assert head == f"{r['score']:.4f} from {r['base']:.4f}"
        order = sorted(((-abs(e["value"]), e["column"], e["value"]) for e in r["contributions"]))[:5]
        assert tail == "; ".join(f"{c} {'lowers' if v < 0 else 'raises'} it by {abs(v):.4f}" for _, c, v in order)


def test_later_columns_read_what_was_imputed(spark):
    t = odd_table(spark)
    found, made = forests.impute_all(t, "id", ("a", "c"), ("b",), chained=True, plan=[("a", ["b"]), ("c", ["a", "b"])], trees=4, depth=4)
    rows = {(r["row_id"], r["column"]): r for r in found.collect()}
    filled = {i: float(r["suggestion"]) for (i, c), r in rows.items() if c == "a"}
    source = {r["id"]: r for r in t.collect()}
    nodes = made["c"].nodes.collect()
    for (i, c), r in rows.items():
        if c == "c":
            b = source[i]["b"] or made["c"].fills["b"]
            a = source[i]["a"] if source[i]["a"] is not None else filled[i]
            assert r["score"] == pytest.approx(walk(nodes, [a, *(float(b == v) for v in made["c"].kinds["b"])])[0][0])


def test_columns_that_cannot_be_learned(spark):
    t = spark.createDataFrame([(i, None, float(i), "k") for i in range(20)], "id long, a double, b double, c string")
    found, made = forests.impute_all(t, "id", ("a", "b"), ("c",))
    assert found.count() == 0 and not made
    whole = t.drop("a")
    assert forests.impute_all(whole, "id", ("b",), ("c",))[0].columns == ["row_id", "column", "suggestion", "score", "base", "contributions"]
    assert forests.impute_all(t.limit(0), "id", ("a", "b"), ("c",))[0].count() == 0


def test_queries_predict_every_missing_cell_of_lineitem(spark):
    t = cleaning.lines(spark, SF)
    got = cleaning.impute_explained(spark, SF).collect()
    planned = [c for c, _ in forests.training_plan(t, ("quantity", "discount", "price"), ("returnflag", "linestatus"))]
    assert "returnflag" in planned  # quantity depends on nothing here, so it has no forest
    want = {(r["row_id"], c) for r in t.collect() for c in planned if r[c] is None}
    assert {(r["row_id"], r["column"]) for r in got} == want
    assert all(r["base"] + r["moved"] == pytest.approx(r["score"], abs=1e-9) for r in got)
    one = {(r["row_id"], r["column"]): r["score"] for r in cleaning.impute_columns(spark, SF).collect()}
    assert one == {(r["row_id"], r["column"]): pytest.approx(r["score"], abs=1e-8) for r in got}
    flags = cleaning.impute_forest(spark, SF).collect()
    assert {r["row_id"] for r in flags} == {i for i, c in want if c == "returnflag"} and {r["suggestion"] for r in flags} <= {"A", "N", "R"}


def test_scorer_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 8))
    x[:, 3] = 1.0
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.standard_normal(300) > 1).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], ", ".join(f"{c} double" for c in (*matching.FEATURES, "label")))
    m = matching.train_scorer(df)
    std = x.std(axis=0)

    def loss(w, b):
        z = x @ w + b
        return float(np.mean(np.log1p(np.exp(z)) - y * z) + 0.005 * np.sum((w * std) ** 2))

    w = np.array(m.weights)
    best = loss(w, m.intercept)
    assert w[3] == 0 and all(loss(w + 0.01 * d, m.intercept + e) >= best - 1e-9 for d in np.vstack([np.eye(8), -np.eye(8)]) for e in (-0.01, 0, 0.01))
    got = df.select(m.score().alias("p")).toPandas()["p"].to_numpy()
    assert got == pytest.approx(1 / (1 + np.exp(-(x @ w + m.intercept))), abs=1e-12)


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute_information(rows, k=3):
    by = {}
    for x, v in rows:
        by.setdefault(x, []).append(v)
    rows = [(x, v) for x, v in rows if len(by[x]) > 1]
    total = 0
    for x, v in rows:
        ki = min(k, len(by[x]) - 1)
        r = sorted(abs(u - v) for u in by[x])[ki]  # itself is the first
        m = sum(v - r < u < v + r for _, u in rows) if r > 0 else sum(u == v for _, u in rows)
        total += psi(ki) - psi(len(by[x])) - psi(m)
    return max(psi(len(rows)) + total / len(rows), 0) if rows else 0


def information_rows(kind):
    rng = random.Random(2)
    if kind == "apart":
        return [(c, rng.gauss({"a": 0, "b": 2, "c": 5}[c], 1)) for c in rng.choices("aaab" "c", k=2000)]
    if kind == "ties":
        return [(rng.choice("ab"), float(rng.randrange(12))) for _ in range(700)]
    if kind == "constant":
        return [(rng.choice("ab"), 4.0) for _ in range(100)]
    if kind == "single":
        return [("a", 1.0), ("b", 2.0), ("c", 3.0), ("c", 5.0), ("d", 9.0), ("d", 9.5), ("d", 1e12)]
    return [("a", float(i)) for i in range(50)]


@pytest.mark.parametrize("kind", ["apart", "ties", "constant", "single", "one category"])
def test_information_of_neighbours(spark, kind):
    rows = information_rows(kind)
    df = spark.createDataFrame([*rows, (None, 1.0), ("a", None), ("a", float("nan"))], "c string, v double")
    got = dependencies.neighbour_information(df, "c", "v").first()["score"]
    assert got == pytest.approx(brute_information(rows), abs=1.5e-6)
    if kind == "constant":
        assert got == 0 and dependencies.mutual_information(df.where("v = 4"), "c", "v").first()["score"] == 0
    assert kind != "apart" or dependencies.neighbour_information(df.limit(0), "c", "v").first()["score"] == 0


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_neighbours_and_sums_over_ranges(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        values = sorted({(random.Random(i).choice("ab"), (i * 37) % 101) for i in range(90)})
        df = spark.createDataFrame([(*v, i % 5) for i, v in enumerate(values)], "x string, v long, n long")
        got = {(r["x"], r["v"]): (r["earlier"], r["later"]) for r in neighbours(df, ["x", "v"], ["x", "v"], 3).collect()}
        for i, v in enumerate(values):
            before, after = got[v]
            assert [tuple(e) for e in before] == values[max(0, i - 3) : i][::-1] and [tuple(e) for e in after] == values[i + 1 : i + 4]
        sums = {(r["x"], r["v"]): r["before"] for r in sums_before(df, ["x", "v"], "n").collect()}
        assert sums == {v: sum(j % 5 for j in range(i)) for i, v in enumerate(values)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_digamma(spark):
    got = spark.range(1, 3000, 7).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(psi(r["id"]), abs=1e-10) for r in got)
    assert math.isclose(spark.range(1).select(digamma(F.lit(10**12)).alias("p")).first()["p"], math.log(10**12), abs_tol=1e-9)
