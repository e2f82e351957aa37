"""Whitening of embeddings by a bidiagonal qd solver.

Tasks reduce their centred rows by QR, a block at a time, to a triangle as wide as the vectors, and triangles of many tasks are reduced
the same way over a few shuffles of a bounded fan-in. What is left is one square triangle R with R'R = n times the covariance: only its
width, never the number of rows, decides its size. Householder reflections make R bidiagonal. dqds on the squares of the bidiagonal finds
the squares of its singular values to high relative accuracy, and twisted factorisations of the tridiagonal B'B give a vector for each.
Vectors of values that lie close together are made orthogonal inside their cluster by solving once more with the twisted factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import settle

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32

#: Rows that a task centres and reduces at once, and triangles that one task takes.
BLOCK, FAN_IN = 8_192, 32

EPS = np.finfo(float).eps
#: Values nearer to each other than this share of the largest are a cluster.
CLUSTER = 1e-3


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, W): R = U B W' with B upper bidiagonal, by Householder reflections from both sides."""
    a, n = np.array(r, float), r.shape[1]
    w = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0.0)
        if not size or not np.abs(x[1:]).max(initial=0.0):
            return None
        v = x / size
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        return v / np.sqrt(v @ v)

    for k in range(n):
        if (v := reflector(a[k:, k].copy())) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2 and (v := reflector(a[k, k + 1 :].copy())) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential qd sweep with a shift; (q, e), or None if the shift was too large."""
    out_q, out_e = np.empty(len(q)), np.empty(len(e))
    d = q[0] - shift
    for i in range(len(e)):
        if not d >= 0:
            return None
        out_q[i] = d + e[i]
        ratio = q[i + 1] / out_q[i]
        out_e[i], d = e[i] * ratio, d * ratio - shift
    if not d >= 0:
        return None
    out_q[-1] = d
    return out_q, out_e


def _below_least(q: np.ndarray, e: np.ndarray) -> float:
    """A bound just under the least value: one over the sum of the values' reciprocals, without a subtraction."""
    x = total = 0.0
    for i in range(len(q)):
        if not q[i]:
            return 0.0
        x = (1.0 + (e[i - 1] * x if i else 0.0)) / q[i]
        total += x
    return (1 - 8 * len(q) * EPS) / total


def qd_values(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The squares of the singular values of the bidiagonal with squared diagonal q and squared superdiagonal e, falling.

    dqds: shifts below the least value keep every quantity positive, so all values come with high relative accuracy.
    """
    todo, found = [(np.array(q, float), np.array(e, float), 0.0)], []
    while todo:
        q, e, shifted = todo.pop()
        for _ in range(100 * len(q) + 100):
            if len(q) <= 1:
                break
            tiny = np.flatnonzero(e <= EPS * EPS * (q[1:] + shifted))
            if len(tiny) and tiny[-1] == len(e) - 1:  # the last value stands alone
                found.append(q[-1] + shifted)
                q, e = q[:-1], e[:-1]
                continue
            if len(tiny):
                at = tiny[-1]
                todo.append((q[: at + 1], e[:at], shifted))
                q, e = q[at + 1 :], e[at + 1 :]
            if q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()  # read from the other end, the values are the same
            shift = _below_least(q, e)
            step = _sweep(q, e, shift) if shift else None
            if step is None:
                shift, step = 0.0, _sweep(q, e, 0.0)
            q, e, shifted = *step, shifted + shift
        else:
            raise ArithmeticError("dqds did not converge")
        found.extend(q + shifted)
    return np.sort(np.array(found))[::-1]


@dataclass
class Twisted:
    """A twisted factorisation of B'B less a value: from the top down to the twist, from the bottom up to it."""

    down: np.ndarray
    down_factor: np.ndarray
    up: np.ndarray
    up_factor: np.ndarray
    at: int
    pivot: float

    @classmethod
    def of(cls, q: np.ndarray, e: np.ndarray, value: float) -> Twisted:
        n, least = len(q), EPS * EPS * (q.max() + value) + np.finfo(float).tiny
        off = np.sqrt(q[:-1] * e)
        safe = lambda x: x if abs(x) > least else least
        s, down, down_factor = np.empty(n), np.empty(n), np.empty(n - 1)
        s[0] = -value
        for i in range(n - 1):
            down[i] = safe(q[i] + s[i])
            down_factor[i] = off[i] / down[i]
            s[i + 1] = e[i] * s[i] / down[i] - value
        down[-1] = safe(q[-1] + s[-1])
        p, up, up_factor = np.empty(n), np.empty(n), np.empty(n - 1)
        p[-1] = q[-1] - value
        for i in range(n - 2, -1, -1):
            up[i + 1] = safe(e[i] + p[i + 1])
            up_factor[i] = off[i] / up[i + 1]
            p[i] = p[i + 1] * q[i] / up[i + 1] - value
        up[0] = safe(p[0])
        pivots = s + p + value
        at = int(np.abs(pivots).argmin())
        return cls(down, down_factor, up, up_factor, at, safe(pivots[at]))

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.down))
        z[self.at] = 1.0
        for i in range(self.at - 1, -1, -1):
            z[i] = -self.down_factor[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] = -self.up_factor[i] * z[i]
        return z / np.sqrt(z @ z)

    def solve(self, y: np.ndarray) -> np.ndarray:
        x, n = y.copy(), len(y)
        for i in range(self.at):
            x[i + 1] -= self.down_factor[i] * x[i]
        for i in range(n - 1, self.at, -1):
            x[i - 1] -= self.up_factor[i - 1] * x[i]
        x[: self.at] /= self.down[: self.at]
        x[self.at + 1 :] /= self.up[self.at + 1 :]
        x[self.at] /= self.pivot
        for i in range(self.at - 1, -1, -1):
            x[i] -= self.down_factor[i] * x[i + 1]
        for i in range(self.at, n - 1):
            x[i + 1] -= self.up_factor[i] * x[i]
        return x / np.sqrt(x @ x)


def tridiagonal_vectors(q: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of B'B for its largest values, given as they fall."""
    out, first = np.zeros((len(q), len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * values[k - 1]:
            first = k
        factors = Twisted.of(q, e, value)
        z = factors.vector()
        if k > first:
            before = out[:, first:k]
            for _ in range(4):  # what earlier vectors of the cluster hold is taken out, and the rest solved again
                for _ in range(2):
                    z -= before @ (before.T @ z)
                if (size := np.sqrt(z @ z)) < 1e-8:
                    z = np.cos(np.arange(len(z)) * (k + 1.0) + k)  # any vector outside will do
                    continue
                z = factors.solve(z / size)
            for _ in range(2):
                z -= before @ (before.T @ z)
                z /= np.sqrt(z @ z)
        out[:, k] = z
    return out


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all squares of singular values of R, those of its first right singular vectors, these vectors as columns).

    Directions whose square is under 1e-20 of the largest are rounding and have no vector.
    """
    size = np.abs(r).max(initial=0.0)
    if not size:
        return np.zeros(r.shape[1]), np.zeros(0), np.zeros((r.shape[1], 0))
    b, c, w = bidiagonal(r / size)
    q, e = b * b, c * c
    values = qd_values(q, e)
    kept = values[:most][values[:most] > 1e-20 * values[0]]
    # B'B with its signs is the one of squares alone, rows and columns turned
    signs = np.cumprod(np.concatenate([[1.0], np.where(b[:-1] * c < 0, -1.0, 1.0)]))
    return values * size**2, kept * size**2, w @ (signs[:, None] * tridiagonal_vectors(q, e, kept))


@dataclass
class Whitening:
    """What fitting learns: the number of rows, exact sums by dimension, and the whitening directions with their variances."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S as whole numbers, x - S / n)."""
        return _centred(vectors, self.n, self.sums)

    def whiten(self, vectors: pd.Series) -> np.ndarray:
        return self.centred(vectors)[1] @ self.directions / np.sqrt(self.variances)


def whole(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each entry as double; null for a missing vector or one with a missing or non-finite entry."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    exact = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")) + F.lit(offset).cast("long"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), exact)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.full((len(vectors), width), OFFSET, np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _centred(vectors: pd.Series, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    exact = _matrix(vectors, len(sums)) * n - sums
    return exact, exact / n


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """The vectors of a task, ``BLOCK`` rows at a time."""
    held: list = []
    for frame in batches:
        for at in range(0, len(frame), BLOCK):
            held.append(frame["vector"].iloc[at : at + BLOCK])
            if sum(map(len, held)) >= BLOCK:
                yield pd.concat(held, ignore_index=True)
                held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _total(rows: DataFrame, part, shape: tuple[int, ...], kind: str) -> np.ndarray:
    """The sum over all rows of ``part`` (vectors of a block to a table of ``shape``): one table for each task, added up by place."""
    size = int(np.prod(shape))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for vectors in _blocks(batches):
            found = part(vectors).reshape(-1)
            total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"place": np.arange(size), "amount": total})

    added = rows.select("vector").mapInPandas(parts, f"place int, amount {kind}").groupBy("place").agg(F.sum("amount").alias("amount"))
    out = np.zeros(size, np.int64 if kind == "long" else float)
    for row in added.collect():  # one number for each place of the table
        out[row.place] = row.amount
    return out.reshape(shape)


def _triangle(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    width = len(sums)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for vectors in _blocks(batches):
            r = np.linalg.qr(np.concatenate([r, _centred(vectors, n, sums)[1]]), mode="r")
        if len(r):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [r.reshape(-1)]})

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        stacked = np.concatenate([np.asarray(r).reshape(-1, width) for _, r in sorted(zip(frame["part"], frame["r"]), key=lambda x: x[0])])
        return pd.DataFrame({"part": [int(frame["part"].min()) // FAN_IN], "r": [np.linalg.qr(stacked, mode="r").reshape(-1)]})

    parts = settle(rows.select("vector").mapInPandas(reduced, "part long, r array<double>"), "whitening-triangles")
    while parts.limit(2).count() > 1:
        parts = settle(parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(merged, "part long, r array<double>"), "whitening-triangles")
    r = np.array(parts.first().r).reshape(-1, width)
    return np.concatenate([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Learns from all ``rows`` (vector: array of long, see :func:`whole`; rows without one don't count).

    Vectors shorter than the longest are filled up with entries of 0. Directions without variance are left out, so fewer rows or
    dimensions than ``components`` give fewer; no row gives none.
    """
    rows = rows.where("vector is not null")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not n or not width:
        return Whitening(n, np.zeros(width, np.int64), np.zeros((width, 0)), np.zeros(0), 0.0)
    sums = _total(rows, lambda v: _matrix(v, width).sum(axis=0), (width,), "long")
    values, kept, directions = principal(_triangle(rows, n, sums), components)
    model = Whitening(n, sums, directions, kept / n, float(values.sum() / n))
    k = len(kept)
    if k:
        mean = _total(rows, lambda v: model.whiten(v).sum(axis=0), (k,), "double") / n

        def squares(vectors: pd.Series) -> np.ndarray:
            y = model.whiten(vectors) - mean
            return y.T @ y

        model.identity_error = float(np.abs(_total(rows, squares, (k, k), "double") / n - np.eye(k)).max())
    return model


def _deviations(exact: np.ndarray) -> list:
    """Exact sums of squares by row; null where one exceeds a long."""
    if float(np.abs(exact).max(initial=0)) ** 2 * max(exact.shape[1], 1) < 2.0**62:
        return (exact * exact).sum(axis=1).tolist()
    found = [sum(int(x) * int(x) for x in row) for row in exact]
    return [x if x < 1 << 63 else None for x in found]


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row that has a vector and each component, from 1.

    ``deviation`` is the exact sum over the dimensions of (n x - S)^2, null where it exceeds a long. Repeated rows come repeatedly,
    missing vec_ids stay missing.
    """

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                exact, centred = model.centred(part["vector"])
                y = centred @ model.directions / np.sqrt(model.variances)
                yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64"), "deviation": pd.array(_deviations(exact), "Int64"), "y": list(y)})

    found = rows.where("vector is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInPandas(projected, "vec_id long, deviation long, y array<double>")
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.variances]).cast("array<double>")
    out = found.select("vec_id", "deviation", F.posexplode("y").alias("component", "whitened"))
    return out.select("vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(shares, F.col("component")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
