"""Arrays: element-wise equations, reshaping, search and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..equation import compile_expression, divide

UNARY = {"add": lambda n, k: n + k, "subtract": lambda n, k: n - k, "multiply": lambda n, k: n * k, "divide": divide, "exponentiate": lambda n, k: F.pow(n, k), "root": lambda n, k: F.signum(n) * F.pow(F.abs(n), 1 / k)}


def number(c: Column, default: float | None = 0.0) -> Column:
    """Double of anything, the default for what is no finite number."""
    d = c.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(default).cast("double")).otherwise(d)


def operate(a: Column, equation: str) -> Column:
    """Each element n mapped by an equation in n."""
    return F.transform(a, lambda n: compile_expression(equation, {"n": n}))


def operate_arrays(a: Column, b: Column, equation: str, missing: float = 0.0) -> Column:
    """Elements paired by position, i from the first and x from the second; what the shorter array lacks is `missing`."""
    fill = lambda v: F.coalesce(v, F.lit(missing))
    return F.zip_with(a, b, lambda i, x: compile_expression(equation, {"i": fill(i), "x": fill(x)}))


def arithmetic(a: Column, op: str, k: float) -> Column:
    """add, subtract, multiply, divide, exponentiate or root each element by a scalar."""
    return F.transform(a, lambda n: UNARY[op](n, F.lit(float(k))))


def arithmetic_arrays(a: Column, b: Column, op: str) -> Column:
    return F.zip_with(a, b, lambda i, x: UNARY[op](F.coalesce(i, F.lit(0.0)), F.coalesce(x, F.lit(0.0))))


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def absolute_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda i, x: F.abs(F.coalesce(i, F.lit(0.0)) - F.coalesce(x, F.lit(0.0))))


def average(a: Column) -> Column:
    return F.try_divide(total(a), F.size(F.filter(a, lambda v: v.isNotNull())))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))


def midpoint(a: Column) -> Column:
    """(max + min) / 2; 0 for an empty array."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise((F.array_max(a) + F.array_min(a)) / 2)


def reshape(a: Column, *dims: int) -> Column:
    """A flat array as nested ones of the given inner lengths."""
    for d in reversed(dims):
        a = _chunks(a, d)
    return a


def _chunks(a: Column, d: int) -> Column:
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(d)), lambda i: i < F.size(a))
    return F.transform(starts, lambda i: F.slice(a, i + 1, d))


def flatten_deep(a: Column, levels: int) -> Column:
    return reduce(lambda c, _: F.flatten(c), range(levels), a)


def cardinality(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def is_empty(a: Column) -> Column:
    return (F.size(a) == 0) | F.forall(a, lambda v: v.isNull())


def unique(a: Column) -> Column:
    return F.array_distinct(a)


def reverse(a: Column) -> Column:
    return F.reverse(a)


def move(a: Column, old: int, new: int) -> Column:
    """The element at `old` (from 0) put at `new`."""
    rest = F.concat(F.slice(a, 1, old), F.slice(a, old + 2, F.size(a)))
    return F.concat(F.slice(rest, 1, new), F.slice(a, old + 1, 1), F.slice(rest, new + 1, F.size(a)))


def truncate(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def to_map(a: Column) -> Column:
    """Position (from 0) to element."""
    return F.map_from_entries(F.transform(a, lambda v, i: F.struct(i.cast("string"), v)))


def to_array(c: Column) -> Column:
    return F.array(c)


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def shuffle(a: Column, seed: int = 0) -> Column:
    return F.shuffle(a, seed)


def filled_domain(low: Column, high: Column) -> Column:
    return F.sequence(low.cast("int"), high.cast("int"))


def linear_sequence(start: float, stop: float, step: float) -> Column:
    n = int((stop - start) / step + 1e-9)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(start) + i * F.lit(step))


def generated(n: int, equation: str) -> Column:
    """Equation in n over 0 … n - 1."""
    return operate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double")), equation)


def repeat(a: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(a, times))


def repeat_each(a: Column, times: int) -> Column:
    return F.flatten(F.transform(a, lambda v: F.array_repeat(v, times)))


def elements(a: Column, **want) -> Column:
    """Elements that meet all conditions: eq, geq, leq, less, greater, range=(lo, hi), not_range=(lo, hi), indexes, not_indexes, in_set."""
    tests = {
        "eq": lambda v, i, w: v == w, "geq": lambda v, i, w: v >= w, "leq": lambda v, i, w: v <= w, "less": lambda v, i, w: v < w, "greater": lambda v, i, w: v > w,
        "range": lambda v, i, w: v.between(*w), "not_range": lambda v, i, w: (v < w[0]) | (v > w[1]),
        "indexes": lambda v, i, w: i.isin(*w), "not_indexes": lambda v, i, w: ~i.isin(*w), "in_set": lambda v, i, w: v.isin(*w),
    }
    return F.filter(a, lambda v, i: reduce(Column.__and__, [tests[k](v, i, w) for k, w in want.items()], F.lit(True)))


def containing(a: Column, text: str) -> Column:
    return F.filter(a, lambda v: v.cast("string").contains(text))


def pick(a: Column, indexes: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, indexes)), lambda i: F.get(a, i))


def closest(a: Column, x: Column) -> Column:
    """The element at the least distance, the first of equals."""
    scored = F.transform(a, lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"), v.alias("v")))
    return F.array_min(scored)["v"]


def clamp_to_domain(a: Column, x: Column) -> Column:
    return F.greatest(F.array_min(a), F.least(F.array_max(a), x))


def bracket(a: Column, x: Column) -> Column:
    """The two neighbouring knots around x, at the edges the outermost pair; null with fewer than two knots."""
    knots = F.array_sort(F.array_distinct(a))
    below = F.greatest(F.least(F.size(F.filter(knots, lambda v: v <= x)), F.size(knots) - 1), F.lit(1))
    return F.when(F.size(knots) >= 2, F.slice(knots, below, 2))


def sort_by(a: Column, mode: str = "descending") -> Column:
    """ascending, descending (default) or alphabetical."""
    if mode == "alphabetical":
        return F.transform(F.array_sort(F.transform(a, lambda v: F.struct(v.cast("string").alias("s"), v.alias("v")))), lambda p: p["v"])
    return F.sort_array(a, mode == "ascending")


def lagrange(xs: Column, ys: Column, x: Column) -> Column:
    """Value at x of the polynomial through all knots."""
    points = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    term = lambda p, i: p["y"] * F.aggregate(F.transform(points, lambda q, j: F.when(i == j, F.lit(1.0)).otherwise((x - q["x"]) / (p["x"] - q["x"]))), F.lit(1.0), lambda s, v: s * v)
    return F.aggregate(F.transform(points, term), F.lit(0.0), lambda s, v: s + v)


def linear(xs: Column, ys: Column, x: Column) -> Column:
    """Between two knots linear; outside them exponential growth while both values are positive, else linear."""
    x0, x1, y0, y1 = F.get(xs, F.lit(0)), F.get(xs, F.lit(1)), F.get(ys, F.lit(0)), F.get(ys, F.lit(1))
    straight = y0 + (x - x0) * F.try_divide(y1 - y0, x1 - x0)
    growth = y0 * F.exp(F.try_divide(F.ln(F.when(y1 > 0, y1)) - F.ln(F.when(y0 > 0, y0)), x1 - x0) * (x - x0))
    return F.when(x.between(x0, x1), straight).when((y0 > 0) & (y1 > 0), growth).otherwise(straight)


# Small matrices as arrays of rows
def matrix_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, lambda x, y: x + y))


def matrix_subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, lambda x, y: x - y))


def matrix_augment(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda r, s: F.concat(r, s))


def matrix_transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))


def matrix_multiply(a: Column, b: Column) -> Column:
    dot = lambda r, s: F.aggregate(F.zip_with(r, s, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    return F.transform(a, lambda r: F.transform(matrix_transpose(b), lambda c: dot(r, c)))


def matrix_minor(m: Column, row: int, column: int) -> Column:
    return F.transform(F.filter(m, lambda _, i: i != row), lambda r: F.filter(r, lambda _, j: j != column))


def from_cell(cell: Column) -> Column:
    """"AB12" to [28, 12]; [0, 0] when it is no cell name."""
    letters, row = F.regexp_extract(cell, "^([A-Za-z]+)([0-9]+)$", 1), F.regexp_extract(cell, "^([A-Za-z]+)([0-9]+)$", 2)
    column = F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda s, c: s * 26 + F.ascii(c) - 64)
    return F.when(letters != "", F.array(column, row.try_cast("int"))).otherwise(F.array(F.lit(0), F.lit(0)))


def is_type(a: Column, kind: str) -> Column:
    """Whether all elements, given as text, read as `number` or `boolean`; any text is a `string`."""
    fits = {"number": lambda v: v.try_cast("double").isNotNull(), "boolean": lambda v: v.isin("true", "false"), "string": lambda v: v.isNotNull()}[kind]
    return F.forall(a, fits)


def has_header(first_row: Column) -> Column:
    """Whether every cell of a table's first row is text rather than a number."""
    return F.forall(first_row, lambda v: v.isNotNull() & v.try_cast("double").isNull())
