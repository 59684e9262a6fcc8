"""Whitening of integer vectors with eigenvectors refined from float32 to higher precision.

Statistics are distributed: sums and the centred covariance are accumulated per task and folded by row of the matrix. The
eigenvectors of the covariance (a d x d matrix, d the vectors' length) are first found in float32, which is fast but good
for six digits only, and then corrected by the matrix-multiplication iteration of Ogita and Aishima in extended precision.
The iteration divides by differences of eigenvalues, so eigenvalues that lie close together are treated as a cluster: the
matrix is solved anew in the cluster's own subspace, where their differences are no longer small beside the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parapet.llm.common import written

#: Entries become whole numbers of 1/SCALE.
SCALE = 256
COMPONENTS = 4
#: Precision of the iteration: 64 bits of mantissa where the machine has them, 53 elsewhere.
HIGH = np.longdouble
ROUNDS = 12
#: Eigenvalues closer than this share of the largest belong to one cluster.
CLOSE = 1e-4
#: Beyond this an entry has no exact neighbour as a double, and no long either.
LARGEST = float(2 ** 62)


# --- eigenvectors --------------------------------------------------------------------------------------------------

def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of neighbours in ascending ``values`` that lie within ``gap`` of each other."""
    ends = np.flatnonzero(np.diff(values) > gap) + 1
    return np.split(np.arange(len(values)), ends)


def _refined(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step of the iteration: columns nearer to orthonormal eigenvectors.

    For pairs whose eigenvalues cannot be told apart at the present error the columns are only made orthogonal.
    """
    unit = np.eye(len(a), dtype=a.dtype)
    r = unit - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    norm = lambda m: np.sqrt((m * m).sum())
    least = 2 * (norm(off) + norm(a) * norm(r))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= min(least, CLOSE * np.abs(values).max() if len(values) else 0)
    near |= np.eye(len(a), dtype=bool)
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
    return x + x @ e


def _solved(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a small symmetric matrix by rotations in the precision of the matrix (cyclic Jacobi)."""
    a, n = a.copy(), len(a)
    v = np.eye(n, dtype=a.dtype)
    for _ in range(60):
        off = np.abs(a - np.diag(np.diag(a)))
        if n < 2 or off.max() <= np.finfo(a.dtype).eps * np.abs(a).max():
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if a[p, q] == 0:
                    continue
                t = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(t * t + 1))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.array([[c, t * c], [-t * c, c]], a.dtype)
                a[:, [p, q]] = a[:, [p, q]] @ turn
                a[[p, q], :] = turn.T @ a[[p, q], :]
                v[:, [p, q]] = v[:, [p, q]] @ turn
    return v


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns made orthonormal; ``x`` is nearly so, thus x (x'x)^(-1/2) by Newton's iteration converges."""
    for _ in range(ROUNDS):
        r = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x
        x = x + x @ r / 2
        if np.abs(r).max() < 8 * np.finfo(x.dtype).eps:
            break
    return x


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, good to double precision.

    A matrix of zeros, or of no rows, gives zeros and unit vectors. Equal eigenvalues give any orthonormal basis of
    their space; every column's largest entry is positive, so that equal input gives equal output.
    """
    n = len(matrix)
    a = np.asarray(matrix, HIGH)
    top = np.abs(a).max() if n else HIGH(0)
    if not top:
        return np.zeros(n), np.eye(n)
    a = (a + a.T) / (2 * top)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    x = _orthonormal(x)
    for _ in range(ROUNDS):
        better = _refined(a, x)
        change = np.abs(better - x).max()
        x = better
        if change < 64 * np.finfo(HIGH).eps:
            break
    x = _orthonormal(x)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(values, kind="stable")
    values, x = values[order], x[:, order]
    for own in _clusters(values, CLOSE * np.abs(values).max()):
        if len(own) > 1:  # the cluster's subspace is good; inside it, solve for the differences from its middle
            basis = _orthonormal(x[:, own])
            middle = values[own].mean()
            inner = basis.T @ (a @ basis - middle * basis)
            x[:, own] = basis @ _solved((inner + inner.T) / 2)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    values, x = values[order] * top, x[:, order]
    sign = np.sign(x[np.abs(x).argmax(0), np.arange(n)])
    return values.astype(np.float64), (x * np.where(sign == 0, 1, sign)).astype(np.float64)


# --- distributed statistics ----------------------------------------------------------------------------------------

@dataclass
class Fit:
    """What the projection needs: exact count and sums, components (rows), their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def whole(vector: Column) -> Column:
    """Entries as long: ``floor(SCALE * entry)``; null where the vector is null, empty or holds an entry that is null, not
    finite or too large for a long."""
    value = vector.cast("array<double>")
    bad = F.exists(value, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * F.lit(float(SCALE)) >= F.lit(LARGEST)))
    return F.when(~bad & (F.size(value) > 0), F.transform(value, lambda c: F.floor(c * F.lit(float(SCALE)))))


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 per row, exact; null where it is beyond a long."""
    widest = max((max(abs(n * int(x[:, j].max()) - s), abs(n * int(x[:, j].min()) - s)) for j, s in enumerate(sums)), default=0)
    if widest * widest * max(len(sums), 1) < 2 ** 63 and n * max(int(x.max()), -int(x.min()), 1) < 2 ** 63:
        d = n * x - np.asarray(sums, np.int64)
        return (d * d).sum(1).tolist()
    exact = ((n * x.astype(object) - np.asarray(sums, object)) ** 2).sum(1).tolist()
    return [v if v < 2 ** 63 else None for v in exact]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, each entry rounded once where the whole numbers are below 2^53."""
    whole_part = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole_part) - rest


def _folded(partial: DataFrame) -> DataFrame:
    """Arrays ``v`` added up per ``i``: one row per task and matrix row, summed entry by entry."""
    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v, HIGH) for v in table.column("v").to_pylist()], axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([total.astype(np.float64).tolist()], pa.list_(pa.float64()))})

    return partial.groupBy("i").applyInArrow(add, "i int, v array<double>")


def _gathered(rows: DataFrame, transform, size: int) -> np.ndarray:
    """Sum over all rows of y y' with y = transform(x): per task in blocks, then per matrix row."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), HIGH)
        for batch in batches:
            if batch.num_rows:
                y = transform(_rows(batch.column("x")))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(
            [r.tolist() for r in total.astype(np.float64)], pa.list_(pa.float64()))], ["i", "v"])

    found = _folded(rows.select("x").mapInArrow(part, "i int, v array<double>")).collect()  # d rows, d the vectors' length
    out = np.zeros((size, size))
    for row in found:
        out[row["i"]] = row["v"]
    return out


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit:
    """Whitening from distinct whole-number vectors (column ``x``, all of one length, read twice).

    Components whose eigenvalue is no more than rounding (1e-12 of the largest) are left out: nothing varies along them.
    """
    length = distinct.select(F.size("x").alias("d")).first()
    if length is None:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    d = length["d"]
    totals = distinct.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}")
                                                           for j in range(d)]).first()
    n, sums = totals["n"], [int(totals[f"s{j}"]) for j in range(d)]
    covariance = _gathered(distinct, lambda x: _centred(x, n, sums), d) / n
    values, vectors = eigen(covariance)
    kept = [j for j in range(min(components, d)) if values[j] > 1e-12 * values[0]]
    return Fit(n, sums, vectors[:, kept].T.copy(), values[kept], float(np.trace(covariance)))


def _whitened(x: np.ndarray, model: Fit) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ model.components.T / np.sqrt(model.values)


def identity_error(distinct: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all distinct vectors."""
    size = len(model.values)
    if not size:
        return 0.0
    # a constant beside the coordinates gives their sums, so that the means come from the same pass
    both = _gathered(distinct, lambda x: np.column_stack([_whitened(x, model), np.ones(len(x))]), size + 1) / model.n
    covariance = both[:size, :size] - np.outer(both[size, :size], both[size, :size])
    return float(np.abs(covariance - np.eye(size)).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per vector and component.

    Entries become ``floor(256 * entry)`` as long. Vectors that are null, empty, or hold an entry that is null, not finite
    or too large for a long are left out, and so are those of another length than the commonest (ties: the
    shorter). Mean and covariance are over distinct vectors, each once, so copies change nothing; every remaining row is
    projected, repeated rows and null ids too. ``deviation`` beyond a long is null. Fewer components come out where the
    vectors are shorter or vary in fewer directions; without any variation, or in an empty table, there are no rows.
    Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return _nothing(vectors)
    rows = rows.filter(F.size("x") == sizes["d"])
    distinct = written(rows.select("x").distinct(), "vectors")
    model = fit(distinct, components)
    if not len(model.values):
        return _nothing(vectors)
    error = identity_error(distinct, model)
    explained = model.values / model.trace
    count = len(explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _rows(batch.column("x")), batch.num_rows
            repeated = pa.array(np.repeat(np.arange(rows), count))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(repeated), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * count, model.n, np.int64)),
                pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(repeated),
                pa.array(_whitened(x, model).reshape(-1)), pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * count, error))], NAMES)

    return rows.mapInArrow(project, SCHEMA)


SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def _nothing(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], SCHEMA)
