"""Operator 11: whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers x = floor(64 * c) + ``SHIFT`` (held in +-4e18, so that no entry overflows).  The fit list
holds each distinct x-vector once.  Spark sums it twice: n and the sums S first, then the scatter of x less its rounded mean.
Tasks add up products in doubles, which stay whole and exact while n * largest^2 < 2^53, so their order does not matter; the
driver gets one d x d matrix, whose size depends on the dimension only, and makes the covariance of it with whole numbers.

The scatter is factored with diagonal pivoting, P'VP = LL'.  Jacobi rotations from the right then make the columns of
the triangular factor orthogonal: their squared norms are the eigenvalues, the columns over their norms the components.
Components whose eigenvalue is not above d * 2^-52 of the largest have no whitening and are left out, so a list of equal
vectors (or none) gives no rows.

Rows whose vector is null or holds null or non-finite entries are left out.  The space has the most common length
(of equally common ones the longest); vectors of other lengths are left out too.  Repeated rows give repeated results,
a null id stays null; other columns are ignored.  A deviation too large for a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm.common import free, materialize, table

SHIFT = 1_000_000
#: Rows that a task multiplies at once.
STEP = 4096


def whole_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): the usable rows' vectors as whole numbers."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col(key).alias(key), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * 64, F.lit(4e18)), F.lit(-4e18))) + SHIFT)
    return rows.where(F.size("v") == (common[0]["d"] if common else 0)).select(key, x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, _matrix(part["x"])


def _summed(matrices: DataFrame) -> np.ndarray:
    """Rows (i, values) -> the sums of equal i as one matrix; Spark adds them up before the driver sees them."""
    sums = matrices.select("i", F.posexplode("values").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = sums.toPandas()
    if not len(found):
        return np.zeros((0, 0))
    out = np.zeros((int(found["i"].max()) + 1, int(found["j"].max()) + 1), found["v"].dtype)
    out[found["i"], found["j"]] = found["v"]
    return out


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of each dimension, as digits since they may be too large for a long."""
    total = None
    for _, x in _steps(batches):
        if len(x):
            whole = x if int(max(x.max(), -x.min())) < 2**63 // len(x) else x.astype(object)
            total = [a + b for a, b in zip(total or [0] * x.shape[1], whole.sum(0).tolist(), strict=True)]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(map(str, total)))], ["j", "s"])


def _products(of):
    """One row of sums of products for each dimension and task, where ``of`` makes a step's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, x in _steps(batches):
            if len(x):
                z = of(x)
                total = total + z.T @ z
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "values"])

    return run


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """The factor L (rows in the order of v's) with v = LL', its columns by falling pivots; stops at the rank."""
    rest, columns = np.array(v, float), []
    least = np.finfo(float).eps * len(v) * max(rest.diagonal().max(initial=0.0), 0.0)
    while len(columns) < len(v):
        p = int(rest.diagonal().argmax())
        if not rest[p, p] > least:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        columns.append(column)
        rest = rest - np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0  # pivoted rows are zero from here on: the factor is triangular in pivot order
    return np.stack(columns, 1) if columns else np.zeros((len(v), 0))


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns as rounds of disjoint pairs (a round-robin tournament)."""
    seats, out = [*range(n), *([-1] * (n % 2))], []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], seats[:half - 1:-1], strict=True) if a >= 0 and b >= 0]
        out.append((np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, unit columns) of the factor's columns after rotating them orthogonal, by falling norm."""
    a = factor.T.copy()  # a row for each column
    rounds = _rounds(len(a)) if len(a) > 1 else []
    for _ in range(most_sweeps):
        worst = 0.0
        for p, q in rounds:
            x, y = a[p], a[q]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            size = np.sqrt(xx * yy)
            turn = np.abs(xy) > 1e-16 * size
            worst = max(worst, float((np.abs(xy)[size > 0] / size[size > 0]).max(initial=0.0)))
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)[:, None]
            s = np.where(turn, t, 0.0)[:, None] * c
            a[p], a[q] = c * x - s * y, s * x + c * y
        if worst < 1e-15:
            break
    e = (a * a).sum(1)
    order = np.argsort(-e, kind="stable")
    return e[order], (a[order] / np.sqrt(np.where(e[order] > 0, e[order], 1.0))[:, None])


def exact_covariance(n: int, products: np.ndarray, rest: list[int]) -> np.ndarray:
    """(n * products - rest rest') / n^2 in whole numbers, each entry rounded once."""
    whole = products.astype(object) if np.abs(products).max(initial=0) < 2**53 else None
    if whole is None:
        r = np.array(rest, float) / n
        return products / n - np.outer(r, r)
    return np.array([[(n * int(whole[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(len(rest))] for i in range(len(rest))])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    most = max(abs(n * int(v) - s) for v, s in [*zip(x.max(0), sums, strict=True), *zip(x.min(0), sums, strict=True)])
    if most * most * len(sums) < 2**63 and n * int(np.abs(x).max()) < 2**63:
        far = n * x - np.array(sums, np.int64)
        return (far * far).sum(1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in found]


def whiten(embeddings: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """embeddings -> (key, component, n, deviation, whitened, explained, identity_error), a row for each usable row and component."""
    rows = whole_vectors(embeddings, key, vector)
    fit = materialize(rows.select("x").distinct(), "fit")
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n = fit.count()
    sums = fit.mapInArrow(_totals, "j int, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("j")
    sums = [int(r["s"]) for r in sums.collect()]  # one for each dimension
    mean = [(2 * s + n) // (2 * n) for s in sums]
    shift = np.array(mean, np.int64)
    centred = lambda x: (x - shift).astype(float)
    products = _summed(fit.mapInArrow(_products(centred), "i int, values array<double>"))
    rest = [s - n * m for s, m in zip(sums, mean, strict=True)]
    covariance = exact_covariance(n, products, rest) if n else np.zeros((0, 0))
    e, vectors = one_sided_jacobi(pivoted_cholesky(covariance))
    held = e > np.finfo(float).eps * len(sums) * e.max(initial=0.0)
    e, vectors = e[held][:components], vectors[held][:components]
    explained = (e / max(float(covariance.trace()), 1e-300)).tolist() if n else []
    off, scale = np.array([r / n for r in rest]) if n else np.zeros(0), (vectors / np.sqrt(e)[:, None]).T
    whitened = lambda x: (centred(x) - off) @ scale
    error = 0.0
    if len(e):
        error = float(np.abs(_summed(fit.mapInArrow(_products(whitened), "i int, values array<double>")) / n - np.eye(len(e))).max())
    k = len(e)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _steps(batches):
            if not k or not len(x):
                continue
            take = pa.array(np.repeat(np.arange(len(x)), k))
            again = lambda values, of: pa.array(np.tile(values, len(x)), of)
            columns = [
                part[key].take(take), again(np.arange(1, k + 1), pa.int32()), pa.array(np.full(len(x) * k, n)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(take), pa.array(whitened(x).ravel()), again(explained, pa.float64()),
                pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    found = rows.mapInArrow(project, schema)
    free(fit)
    return found


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
