"""Numbers, ranges and their formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import UNARY, number


def safe(c: Column, default: float = 0.0) -> Column:
    return number(c, default)


def sigfig(x: Column, n: int) -> Column:
    """x rounded to n significant figures."""
    power = F.pow(F.lit(10.0), F.lit(n - 1) - F.floor(F.log10(F.abs(F.nullif(x, F.lit(0.0))))))
    return F.coalesce(F.signum(x) * F.floor(F.abs(x) * power + 0.5) / power, F.lit(0.0))


def fixed(x: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f", F.round(x, places))


def logarithm(base: Column, x: Column) -> Column:
    return F.ln(x) / F.ln(base)


def factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(1.0), lambda s, i: s * i)


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))


def root(x: Column, n: int) -> Column:
    """n-th root; of negative numbers for odd n only."""
    return F.when((x < 0) & F.lit(n % 2 == 0), F.lit(None).cast("double")).otherwise(F.signum(x) * F.pow(F.abs(x), 1.0 / n))


def unzero(x: Column, default: float = 1.0) -> Column:
    return F.when(x == 0, F.lit(default)).otherwise(x)


def alphabetise(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", "abcdefghij")


def numerise(c: Column) -> Column:
    return F.translate(c, "abcdefghij", "0123456789").try_cast("double")


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th … 11th."""
    suffix = F.when(F.abs(n % 100).between(11, 13), "th").when(F.abs(n % 10) == 1, "st").when(F.abs(n % 10) == 2, "nd").when(F.abs(n % 10) == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def deordinal(c: Column) -> Column:
    return F.regexp_extract(c, r"^(-?\d+)(?:st|nd|rd|th)$", 1).try_cast("int")


def german(x: Column, places: int = 0) -> Column:
    """1.234.567,5 style."""
    return F.translate(F.format_number(x, places), ",.", ".,")


def geometric_mean(a: Column) -> Column:
    """(product) ** (1 / n) of an array; 0 for an empty one."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.pow(F.aggregate(a, F.lit(1.0), lambda s, v: s * v), F.lit(1.0) / F.size(a)))


def weighted_geometric_mean(v: Column) -> Column:
    """Aggregate: share of positive values times their geometric mean, less the same of negative ones; zeros count in the shares."""
    part = lambda x: F.coalesce(F.exp(F.avg(F.when(x > 0, F.ln(F.when(x > 0, x))))), F.lit(0.0)) * F.count_if(x > 0)
    return F.coalesce(F.try_divide(part(v) - part(-v), F.count(v)), F.lit(0.0))


def as_range(a: Column, b: Column | None = None) -> Column:
    b = a if b is None else b
    return F.array(F.least(a, b), F.greatest(a, b))


def range_midpoint(r: Column) -> Column:
    return (F.get(r, F.lit(0)) + F.get(r, F.lit(1))) / 2


def range_scalar(r: Column, op: str, k: float) -> Column:
    """A range under add, subtract, multiply, divide, exponentiate or root, its ends in order."""
    return F.array_sort(F.transform(r, lambda v: UNARY[op](v, F.lit(float(k)))))


def range_range(a: Column, b: Column, op: str) -> Column:
    return F.array_sort(F.zip_with(a, b, lambda x, y: UNARY[op](x, y)))


def random_between(low: float, high: float, seed: int, whole: bool = True) -> Column:
    x = F.rand(seed) * (high - low) + low
    return F.round(x) if whole else x


def split_randomly(x: Column, parts: int, seed: int) -> Column:
    """`parts` random shares that add up to x."""
    weights = F.array(*[F.rand(seed + i) + 1e-9 for i in range(parts)])
    return F.transform(weights, lambda w: x * w / F.aggregate(weights, F.lit(0.0), lambda s, v: s + v))


#: Easing curves on [0, 1] by name; each family by its power or function, as In, Out and InOut.
def ease(x: Column, kind: str) -> Column:
    """linear, or {quadratic, cubic, quartic, quintic, sinusoidal, exponential, circular}{In, Out, InOut}."""
    if kind == "linear":
        return x
    family = next(f for f in ("quadratic", "cubic", "quartic", "quintic", "sinusoidal", "exponential", "circular") if kind.startswith(f))
    mode = kind[len(family) :]
    power = {"quadratic": 2, "cubic": 3, "quartic": 4, "quintic": 5}.get(family)

    def rise(t: Column) -> Column:
        if power:
            return F.pow(t, F.lit(float(power)))
        if family == "sinusoidal":
            return 1 - F.cos(t * 1.5707963267948966)
        if family == "exponential":
            return F.when(t == 0, F.lit(0.0)).otherwise(F.pow(F.lit(1024.0), t - 1))
        return 1 - F.sqrt(F.greatest(1 - t * t, F.lit(0.0)))

    if mode == "In":
        return rise(x)
    if mode == "Out":
        return 1 - rise(1 - x)
    return F.when(x < 0.5, rise(2 * x) / 2).otherwise(1 - rise(2 - 2 * x) / 2)
