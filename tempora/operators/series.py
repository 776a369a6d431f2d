"""Year series (entity, year, value): filling, fitting to anchors, trimming."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _around(entity: str, x: str) -> tuple:
    w = Window.partitionBy(entity).orderBy(x)
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)


def linear_fill(series: DataFrame, entity: str, x: str, v: str) -> DataFrame:
    """Every whole x from the first to the last knot of each entity, linear between knots."""
    span = series.groupBy(entity).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    grid = span.select(entity, F.explode(F.sequence("_a", "_b")).alias(x)).join(series.select(entity, x, v), [entity, x], "left")
    back, ahead = _around(entity, x)
    knot = F.when(F.col(v).isNotNull(), F.struct(F.col(x).alias("x"), F.col(v).cast("double").alias("v")))
    both = grid.select(entity, x, F.last(knot, True).over(back).alias("_l"), F.first(knot, True).over(ahead).alias("_r"))
    step = F.try_divide((F.col("_r.v") - F.col("_l.v")) * (F.col(x) - F.col("_l.x")), F.col("_r.x") - F.col("_l.x"))
    return both.select(entity, x, (F.col("_l.v") + F.coalesce(step, F.lit(0.0))).alias(v))


def fill_negatives(series: DataFrame, entity: str, x: str, v: str) -> DataFrame:
    """Negative values become the last one that was not negative; null before there is one."""
    back, _ = _around(entity, x)
    return series.withColumn(v, F.last(F.when(F.col(v) >= 0, F.col(v)), True).over(back))


def fit_to_anchors(reference: DataFrame, anchors: DataFrame, entity: str, x: str, v: str) -> DataFrame:
    """The reference series times the linearly interpolated ratio anchor / reference between anchors; outside them as it is.

    A ratio over 0 counts 1, or 0 where the anchor is 0 too.
    """
    joined = reference.join(anchors.select(entity, x, F.col(v).alias("_gt")), [entity, x], "left")
    ratio = F.when(F.col(v) == 0, F.when(F.col("_gt") == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(F.col("_gt"), F.col(v)))
    back, ahead = _around(entity, x)
    knot = F.when(F.col("_gt").isNotNull(), F.struct(F.col(x).alias("x"), ratio.alias("r")))
    both = joined.withColumns({"_l": F.last(knot, True).over(back), "_r": F.first(knot, True).over(ahead)})
    at = F.col("_l.r") + F.coalesce(F.try_divide((F.col("_r.r") - F.col("_l.r")) * (F.col(x) - F.col("_l.x")), F.col("_r.x") - F.col("_l.x")), F.lit(0.0))
    inside = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.select(entity, x, F.when(F.col("_gt").isNotNull(), F.col("_gt")).when(inside, F.col(v) * at).otherwise(F.col(v)).alias(v))


def trim(series: DataFrame, entity: str, x: str, v: str, value: float = 0.0) -> DataFrame:
    """Without the runs of `value` at either end."""
    w = Window.partitionBy(entity)
    real = F.when(F.col(v) != value, F.col(x))
    return series.withColumns({"_a": F.min(real).over(w), "_b": F.max(real).over(w)}).where(F.col(x).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def expand(series: DataFrame, entity: str, x: str, v: str, value: float = 0.0) -> DataFrame:
    """`value` also right after the knot before it and right before the knot after it."""
    w = Window.partitionBy(entity).orderBy(x)
    here = series.withColumns({"_p": F.lag(x).over(w), "_n": F.lead(x).over(w)}).where(F.col(v) == value)
    pad = here.select(entity, F.explode(F.array(F.col("_p") + 1, F.col("_n") - 1)).alias(x), F.lit(value).alias(v)).where(f"{x} is not null")
    return series.select(entity, x, v).unionByName(pad.join(series.select(entity, x), [entity, x], "left_anti").distinct())


def world_totals(estimates: DataFrame, x: str, v: str) -> DataFrame:
    """Sources combined year by year with the weighted geometric mean."""
    from ..functions.maths import weighted_geometric_mean

    return estimates.groupBy(x).agg(weighted_geometric_mean(F.col(v)).alias(v))


def natural_spline(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through the knots (ascending xs), by the tridiagonal system of second derivatives."""
    n = len(xs)
    if n < 3:
        return np.interp(at, xs, ys)
    h = np.diff(xs).astype(float)
    slope = np.diff(ys) / h
    diag, rhs = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope)
    m = np.zeros(n)
    for i in range(1, n - 2):  # forward sweep over the inner knots
        f = h[i] / diag[i - 1]
        diag[i] -= f * h[i]
        rhs[i] -= f * rhs[i - 1]
    for i in range(n - 2, 0, -1):
        m[i] = (rhs[i - 1] - h[i] * m[i + 1]) / diag[i - 1]
    k = np.clip(np.searchsorted(xs, at, "right") - 1, 0, n - 2)
    a, b = (xs[k + 1] - at) / h[k], (at - xs[k]) / h[k]
    return a * ys[k] + b * ys[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6


def log_spline(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Spline of the logarithms (values up to 0 as 1e-6), held between the neighbouring knots' values."""
    order = np.argsort(xs)
    xs, ys = np.asarray(xs, float)[order], np.asarray(ys, float)[order]
    at = np.trunc(np.asarray(at, float))
    out = np.exp(natural_spline(xs, np.log(np.where(ys > 0, ys, 1e-6)), at))
    k = np.clip(np.searchsorted(xs, at, "right") - 1, 0, max(len(xs) - 2, 0))
    j = np.minimum(k + 1, len(xs) - 1)
    return np.clip(out, np.minimum(ys[k], ys[j]), np.maximum(ys[k], ys[j]))


def spline_fill(series: DataFrame, entity: str, x: str, v: str, curve: Callable = log_spline) -> DataFrame:
    """Every whole x of each entity's domain by the log spline; one entity's knots fit one task easily."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().drop_duplicates(x).sort_values(x)
        if pdf.empty:
            return pdf
        at = np.arange(int(pdf[x].min()), int(pdf[x].max()) + 1)
        return pd.DataFrame({entity: pdf[entity].iloc[0], x: at, v: curve(pdf[x].to_numpy(), pdf[v].to_numpy(), at)})

    kind = series.schema[entity].dataType.simpleString()
    return series.select(entity, F.col(x).cast("int").alias(x), F.col(v).cast("double").alias(v)).groupBy(entity).applyInPandas(fill, f"{entity} {kind}, {x} int, {v} double")


def melt_years(wide: DataFrame, keys: list[str], pattern: str = r"^(AD|BC)_(\d+)$") -> DataFrame:
    """AD_n and BC_n columns to rows (keys, year, value), null and empty cells left out."""
    import re

    cols = [c for c in wide.columns if re.match(pattern, c)]
    long = wide.select(*keys, *[F.col(c).try_cast("double").alias(c) for c in cols]).unpivot(keys, cols, "_c", "value")
    year = F.regexp_extract("_c", pattern, 2).cast("int") * F.when(F.col("_c").startswith("BC"), -1).otherwise(1)
    return long.select(*keys, year.alias("year"), "value").where("value is not null")


def merge_duplicates(long: DataFrame, keys: list[str], v: str = "value") -> DataFrame:
    from ..functions.maths import weighted_geometric_mean

    return long.groupBy(*keys).agg(weighted_geometric_mean(F.col(v)).alias(v))


def growth(x0: Column, y0: Column, x1: Column, y1: Column, x: Column) -> Column:
    """Exponential through two knots."""
    return y0 * F.exp(F.try_divide(F.ln(y1) - F.ln(y0), x1 - x0) * (x - x0))
