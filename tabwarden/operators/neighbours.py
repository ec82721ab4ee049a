"""Exact nearest vectors through an index of cells.

Some vectors are chosen as centres; every vector lies in the cell of its nearest centre, with its distance to it.
A query first searches its nearest cell.  With what it has found there, the triangle inequality leaves out all
cells, and in the others all vectors, that can't be nearer: a vector's distance to the query is at least the
difference of their distances to the centre.  Nothing is approximate: what is left out can't be in the result.

Defined cases.  Rows without a vector, or with an entry that is null or no finite number, are left out of both
sides.  Equal distances go to the smaller vec_id.  With fewer than k vectors all of them are found.  Vectors of
another length than the centres' are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.stored import stored

#: Centres at most, and the vectors and queries that meet in one group, about.
CELLS, VECTORS, QUERIES = 1024, 20_000, 4_000
_FOUND = "query_id {q}, vec_id {v}, distance double"


def _whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.size("v") > 0).where(F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _slack(*sizes: np.ndarray) -> float:
    """More than rounding can make of distances between vectors of these lengths."""
    return 1e-6 * (1 + max(float(s.max(initial=0)) for s in sizes))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = column.flatten().to_numpy(zero_copy_only=False)
    if len(out) != width * len(column):
        raise ValueError(f"vectors of {width} entries are needed")
    return out.reshape(-1, width)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, cells: int = CELLS) -> DataFrame:
    """queries (query_id, q), vectors (vec_id, embedding) -> (query_id, vec_id, distance, rank): the k nearest by squared length of the difference."""
    return searched(queries, vectors, k, cells)[0]


def searched(queries: DataFrame, vectors: DataFrame, k: int = 5, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """As `nearest`, and the visits that queries paid to other cells than their nearest."""
    spark = vectors.sparkSession
    all_vectors = stored(_whole(vectors, "vec_id", "embedding"), "vectors")
    asked = stored(_whole(queries, "query_id", "q"), "queries")
    found_schema = _FOUND.format(q=asked.schema["query_id"].dataType.simpleString(), v=all_vectors.schema["vec_id"].dataType.simpleString())
    n, n_asked = all_vectors.count(), asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], found_schema + ", rank int"), spark.createDataFrame([], "query_id long, cell int")
    some = min(cells, max(1, int(n**0.5)))
    chosen = all_vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(some).select("v").collect()  # CELLS rows at most
    centres = np.unique(np.array([r["v"] for r in chosen]), axis=0)
    width = centres.shape[1]
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column("v"), width), shared.value)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "v", "cell", "far"])

    placed = stored(all_vectors.mapInArrow(assign, f"vec_id {all_vectors.schema['vec_id'].dataType.simpleString()}, v array<double>, cell int, far double"), "cells")
    about = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # a row a cell
    size = np.array([about[c]["n"] if c in about else 0 for c in range(len(centres))])
    radius = np.array([about[c]["radius"] if c in about else 0.0 for c in range(len(centres))])
    blocks = -(-size // VECTORS)
    parts = -(-n_asked // QUERIES)
    block_of = F.element_at(F.array(*(F.lit(max(1, int(b))) for b in blocks)), F.col("cell") + 1)
    indexed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), block_of).cast("int"))

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column("v"), width)
                d = _distances(q, shared.value)
                home = np.where(size[None, :] > 0, d, np.inf).argmin(axis=1)
                if first:
                    row, cell = np.arange(len(q)), home
                    bound = np.full(len(q), np.inf)
                else:
                    reach = batch.column("bound").to_numpy(zero_copy_only=False)
                    near = (d - radius[None, :] <= reach[:, None] + _slack(d)) & (size[None, :] > 0)
                    near[np.arange(len(q)), home] = False
                    row, cell = np.nonzero(near)
                    bound = reach[row]
                times = blocks[cell]
                at = np.repeat(np.arange(len(row)), times)
                block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                row, cell, bound = row[at], cell[at], bound[at]
                take = pa.array(row)
                for lo in range(0, len(row), 1 << 14):
                    cut = slice(lo, lo + (1 << 14))
                    some = take.slice(lo, 1 << 14)
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(some), batch.column("v").take(some), pa.array(cell[cut].astype(np.int32)), pa.array(block[cut].astype(np.int32)), pa.array(d[row[cut], cell[cut]]), pa.array(bound[cut])], names=["query_id", "v", "cell", "block", "to_centre", "bound"])

        return run

    def meet(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(there):
            b = np.stack(there["v"].to_numpy())
            far, ids = there["far"].to_numpy(), there["vec_id"].to_numpy()
            for lo in range(0, len(asking), 256):
                part = asking.iloc[lo : lo + 256]
                a = np.stack(part["v"].to_numpy())
                d = _distances(a, b)
                slack = _slack(d, far)
                allowed = np.abs(part["to_centre"].to_numpy()[:, None] - far[None, :]) <= part["bound"].to_numpy()[:, None] + slack
                d = np.where(allowed, d, np.inf)
                # those that rounding could put among the k nearest are measured again, entry by entry
                kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                row, col = np.nonzero((d <= kth[:, None] + slack) & np.isfinite(d))
                exact = ((a[row] - b[col]) ** 2).sum(axis=1)
                one = pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "vec_id": ids[col], "distance": exact})
                out.append(one.sort_values(["query_id", "distance", "vec_id"]).groupby("query_id", sort=False).head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})

    visit_schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, v array<double>, cell int, block int, to_centre double, bound double"

    def search(visiting: DataFrame, cells_of: DataFrame) -> DataFrame:
        # a group is a block of a cell and a part of the queries
        left = visiting.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        right = cells_of.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ["cell", "block", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, found_schema)

    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    home = stored(best(search(asked.mapInArrow(visits(True), visit_schema), indexed)).drop("rank"), "home")
    reached = home.groupBy("query_id").agg(F.max("distance").alias("d"), F.count("*").alias("n"))
    bounds = asked.join(reached, "query_id", "left").select("query_id", "v", F.when(F.coalesce("n", F.lit(0)) >= k, F.sqrt("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    visiting = bounds.mapInArrow(visits(False), visit_schema)
    found = best(home.unionByName(search(visiting, indexed)))
    return found.select("query_id", "vec_id", "distance", F.col("rank").cast("int").alias("rank")), visiting
