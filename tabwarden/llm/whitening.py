"""Whitening of embedding vectors by the principal components of a whole table.

Three scans find the whitening: sums, then products of centred vectors, then, from the whitened vectors
themselves, how far their covariance is from the identity.  Tasks add up what is of the size of a dimension
or of two; only that reaches the driver, which finds the components.  They come from spectral divide and
conquer: the polar factor of the covariance less a shift, found by the QR-based dynamically weighted Halley
iteration, is a sign matrix, so half of it plus the identity projects on the eigenvalues above the shift; the
two invariant subspaces are split again until each is one component.  The components are then small enough
to be sent with the last scan, which whitens.

Defined cases.  A row whose vector is null or has a null, NaN or infinite entry, or one whose whole number
leaves 53 bits, is left out, and so is an empty vector.  Vectors of several lengths are an error.  Ids may
be null or repeat; equal rows count as often as they occur.  A component without variance has null whitened
values and doesn't count for the identity error.  Where the exact deviation leaves 38 digits, it is null.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

#: Whole numbers: an entry times SCALE, rounded down, plus SHIFT.
SCALE, SHIFT = 64.0, 1_000_000
#: The longest vectors; their products are this squared, 8 bytes each, on the driver.
MOST_DIMENSIONS = 4096
_BOUND = 2.0**53


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its sign matrix."""
    n = len(a)
    eye = np.eye(n)
    x = a / np.linalg.norm(a)
    r = np.abs(np.diag(np.linalg.qr(x, mode="r")))
    low = float(max(r.min() / np.sqrt(n), 1e-17))  # at most a little over the least singular value, and the iteration mends the rest
    for _ in range(40):
        root = (4 * (1 - low**2) / low**4) ** (1 / 3) if low < 1 else 0.0
        h = np.sqrt(1 + root)
        wa = h + np.sqrt(max(8 - 4 * root + 8 * (2 - low**2) / (low**2 * h), 0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if wc > 100:
            q, _ = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * x.T @ x, x.T).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 1e-15 * n or (low > 1 - 1e-15 and moved < 1e-9):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """(an orthogonal basis, how many of its vectors span the upper eigenvalues), None where all are equal."""
    n = len(a)
    middle, eye = np.trace(a) / n, np.eye(n)
    spread = np.linalg.norm(a - middle * eye)
    if spread <= 4e-16 * scale * np.sqrt(n):
        return None
    best = None
    for step in (0.0, 0.01, -0.017, 0.043, -0.061, 0.11):  # the mean lies between eigenvalues; a shift too near to one moves on
        shift = middle + step * spread / np.sqrt(n)
        upper = (eye + polar_factor(a - shift * eye)) / 2
        k = int(round(float(np.trace(upper))))
        if not 0 < k < n:
            continue
        draw = np.random.default_rng(n).standard_normal((n, n))
        for _ in range(2):
            draw = np.linalg.qr(np.concatenate([upper @ draw[:, :k], draw[:, k:] - upper @ draw[:, k:]], axis=1))[0]
        off = np.linalg.norm(draw[:, :k].T @ a @ draw[:, k:])
        if best is None or off < best[0]:
            best = off, draw, k
        if off <= 1e-14 * scale:
            break
    if best is None:
        raise ArithmeticError("no shift splits the spectrum")
    return best[1], best[2]


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest, unit eigenvectors as columns) of a symmetric matrix, by divide and conquer."""
    scale = float(np.linalg.norm(a)) or 1.0
    basis, open_blocks, done = np.eye(len(a)), [(0, len(a))], []
    while open_blocks:
        lo, hi = open_blocks.pop()
        if hi - lo == 1:
            done.append(lo)
            continue
        part = basis[:, lo:hi]
        block = part.T @ a @ part
        found = _split((block + block.T) / 2, scale)
        if found is None:
            done += range(lo, hi)
            continue
        basis[:, lo:hi] = part @ found[0]
        open_blocks += [(lo, lo + found[1]), (lo + found[1], hi)]
    for _ in range(2):  # mends what rounding left between components, to first order
        inner, outer = np.eye(len(a)) - basis.T @ basis, basis.T @ a @ basis
        values = np.diag(outer) / (1 - np.diag(inner))
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > 1e-11 * scale
        basis = basis + basis @ np.where(far, (outer + values[None, :] * inner) / np.where(far, gap, 1), inner / 2)
        basis = basis @ (3 * np.eye(len(a)) - basis.T @ basis) / 2
    values = np.einsum("ij,ik,kj->j", basis, a, basis, optimize=True)
    order = np.argsort(-values, kind="stable")
    basis = basis[:, order]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)
    return values[order], basis / np.linalg.norm(basis, axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Whole numbers of a batch of vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1) + SHIFT


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, in whole numbers of 64 bits or, where they don't hold it, of any size."""
    if (int(np.abs(x).max(initial=0)) * n + max(map(abs, sums))) < 1 << 63:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that stay, with entries as doubles."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.size("v") > 0).where(F.forall("v", lambda c: F.coalesce(F.abs(c * SCALE) < _BOUND, F.lit(False))))  # NaN is greater than all


def _summed(rows: DataFrame, work, width: int) -> np.ndarray:
    """The sum of the arrays of doubles (n lists of `width`) that `work` makes of each batch of vectors, added up in tasks and then over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = work(_matrix(batch.column("v")))
                total = one if total is None else total + one
        if total is not None:
            line, at = np.divmod(np.arange(total.size), width)
            yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(at), pa.array(total.ravel())], names=["line", "at", "value"])

    parts = rows.select("v").mapInArrow(run, "line long, at long, value double")
    found = parts.groupBy("line", "at").agg(F.sum("value").alias("value")).toArrow()  # a row an entry of the matrix
    out = np.zeros((int(pc.max(found["line"]).as_py()) + 1, width))
    out[found["line"].to_numpy(), found["at"].to_numpy()] = found["value"].to_numpy()
    return out


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """(id, component, n, deviation decimal, whitened, explained, identity_error) of every row that stays and each of the first components."""
    rows = valid_vectors(table, id_col, vector_col)
    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kinds = (IntegerType(), LongType(), DecimalType(38, 0), DoubleType(), DoubleType(), DoubleType())
    schema = StructType([StructField("id", rows.schema["id"].dataType), *(StructField(a, k) for a, k in zip(names, kinds, strict=True))])

    widths = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"))
    about = widths.first()  # one row
    n, width = about["n"], about["most"]
    if not n:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    if about["least"] != width or width > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {about['least']} to {width} entries; one length of up to {MOST_DIMENSIONS} is needed")
    sums = _exact_sums(rows, width)

    products = _summed(rows, lambda x: (z := _centred(x, n, sums).astype(np.float64) / n).T @ z, width)
    covariance = products / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = spectral_components(covariance)
    trace = float(np.trace(covariance))
    count = min(components, width)
    live = values[:count] > max(trace, 0) * width * 1e-16
    weights = vectors[:, :count] / np.sqrt(np.where(live, values[:count], 1))
    explained = values[:count] / (trace or 1.0)

    def white(x: np.ndarray) -> np.ndarray:
        return (_centred(x, n, sums).astype(np.float64) / n) @ weights

    seen = _summed(rows, lambda x: np.concatenate([(w := white(x)).T @ w, w.sum(axis=0)[None, :]]), count)
    mean = seen[count] / n
    off = np.abs(seen[:count] / n - np.outer(mean, mean) - np.eye(count))[live][:, live]
    error = float(off.max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            z = _centred(x, n, sums)
            if z.dtype != object and int(np.abs(z).max()) ** 2 * width >= 1 << 63:
                z = z.astype(object)
            far = [int(v) for v in (z * z).sum(axis=1)]
            deviation = pa.array([v if v < 10**38 else None for v in far], pa.decimal128(38, 0))
            w = (z.astype(np.float64) / n) @ weights
            row = pa.array(np.repeat(np.arange(len(x)), count))
            times = len(row)
            value = pa.array(w.ravel(), mask=np.tile(~live, len(x)))
            columns = [batch.column("id").take(row), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(times, n)), deviation.take(row), value, pa.array(np.tile(explained, len(x))), pa.array(np.full(times, error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _exact_sums(rows: DataFrame, width: int) -> list[int]:
    """The sum of every dimension, in whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                fits = int(np.abs(x).max()) * len(x) < 1 << 63
                total = [a + int(b) for a, b in zip(total, (x if fits else x.astype(object)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array(total, pa.decimal128(38, 0))], names=["at", "total"])

    parts = rows.select("v").mapInArrow(run, "at long, total decimal(38,0)")
    found = dict(map(tuple, parts.groupBy("at").agg(F.sum("total").alias("total")).collect()))  # a row a dimension
    return [int(found[i]) for i in range(width)]
