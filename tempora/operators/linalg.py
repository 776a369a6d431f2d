"""Linear algebra: large matrices as rows (i, j, v), small dense ones in NumPy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of (i, j, v) matrices: a join on the inner index, partial sums before the second shuffle."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select("i", "j", (F.col("v") * sign).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def to_coo(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("i"), F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("j", "v"))


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """X'X as (i, j, v) in one pass: all products are partial sums, nothing is shuffled but one row a task."""
    n = len(columns)
    sums = df.agg(*[F.sum(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)])
    entries = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{min(i, j)}_{max(i, j)}").alias("v")) for i in range(n) for j in range(n)]
    return sums.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def gram_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X on the driver: columns squared numbers, whatever the rows."""
    out = np.zeros((len(columns),) * 2)
    for r in gram(df, columns).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def cross_product(df: DataFrame, columns: list[str], y: str) -> np.ndarray:
    row = df.agg(*[F.sum(F.col(c).cast("double") * F.col(y).cast("double")) for c in columns]).first()
    return np.array([v or 0.0 for v in row])


def ridge(df: DataFrame, columns: list[str], y: str, weight: float = 1e-3) -> dict[str, float]:
    """Coefficients of (X'X + weight I)^-1 X'y."""
    g = gram_matrix(df, columns) + weight * np.eye(len(columns))
    return dict(zip(columns, np.linalg.solve(g, cross_product(df, columns, y)).tolist(), strict=True))


def variance_inflation(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Diagonal of (X'X)^-1."""
    return dict(zip(columns, np.diag(np.linalg.inv(gram_matrix(df, columns))).tolist(), strict=True))


def without_inflated(df: DataFrame, columns: list[str], limit: float = 10.0) -> list[str]:
    return [c for c, v in variance_inflation(df, columns).items() if v < limit]


def condition_number(df: DataFrame, columns: list[str], floor: float = 1e-12) -> float:
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(gram_matrix(df, columns)), 0))
    return float(s.max() / max(s.min(), floor))


# Dense kernels on lists of rows
def determinant(m) -> float:
    return float(np.linalg.det(np.asarray(m, float)))


def inverse(m) -> np.ndarray:
    return np.linalg.inv(np.asarray(m, float))


def cholesky(m) -> np.ndarray:
    return np.linalg.cholesky(np.asarray(m, float))


def lu(m) -> tuple[np.ndarray, np.ndarray]:
    """Lower (unit diagonal) and upper factor, without row exchanges."""
    u = np.array(m, float)
    low = np.eye(len(u))
    for k in range(len(u) - 1):
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return low, u


def qr(m) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(np.asarray(m, float))
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * s, r * s[:, None]


def least_squares(a, b) -> np.ndarray:
    return np.linalg.lstsq(np.asarray(a, float), np.asarray(b, float), rcond=None)[0]


def tridiagonal(m) -> np.ndarray:
    """Similar tridiagonal matrix of a symmetric one, by Householder reflections."""
    a = np.array(m, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        norm = np.linalg.norm(v)
        if norm:
            h = np.eye(n)
            h[k + 1 :, k + 1 :] -= 2 * np.outer(v, v) / norm**2
            a = h @ a @ h
    return a


def solve(augmented) -> np.ndarray:
    """Solution of [A | b]."""
    m = np.asarray(augmented, float)
    return np.linalg.solve(m[:, :-1], m[:, -1])


def relax(a, b, method: str = "jacobi", omega: float = 1.0, tolerance: float = 1e-6, rounds: int = 1000) -> np.ndarray:
    """jacobi, or seidel with over-relaxation by omega."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    x, d = np.zeros(len(b)), np.diag(a)
    for _ in range(rounds):
        before = x.copy()
        if method == "jacobi":
            x = (b - a @ x + d * x) / d
        else:
            for i in range(len(b)):
                x[i] = (1 - omega) * x[i] + omega * (b[i] - a[i] @ x + d[i] * x[i]) / d[i]
        if np.abs(x - before).sum() < tolerance:
            break
    return x


def dense_kernel(df: DataFrame, key: str, matrix: str, kernel) -> DataFrame:
    """A kernel over a column of small matrices, batch by batch: (key, result)."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "result": [np.atleast_1d(kernel([list(r) for r in m])).ravel().tolist() for m in pdf[matrix]]})

    return df.select(key, matrix).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, result array<double>")
