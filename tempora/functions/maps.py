"""Maps of numbers, and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..equation import compile_expression


def operate(m: Column, equation: str) -> Column:
    """Each value n mapped by an equation in n."""
    return F.transform_values(m, lambda _, n: compile_expression(equation, {"n": n}))


def operate_maps(a: Column, b: Column, equation: str) -> Column:
    """Values paired by key, i and x; a key that one side lacks counts 0 there."""
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return F.map_zip_with(a, b, lambda _, i, x: compile_expression(equation, {"i": zero(i), "x": zero(x)}))


def merge(a: Column, b: Column, mode: str = "sum") -> Column:
    """Both maps in one: equal keys summed, or `overwrite` (right wins), or `difference` (right wins where it differs, else the key goes)."""
    if mode == "sum":
        return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x + y, x, y))
    if mode == "overwrite":
        return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
    return F.map_filter(F.map_zip_with(a, b, lambda _, x, y: F.when(~x.eqNullSafe(y), F.coalesce(y, x))), lambda _, v: v.isNotNull())


def concat_left_wins(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, y))


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def maximum(m: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(m)), F.lit(float("-inf")))


def minimum(m: Column) -> Column:
    return F.coalesce(F.array_min(F.map_values(m)), F.lit(float("inf")))


def domain(m: Column) -> Column:
    """[least, greatest] numeric key."""
    keys = F.transform(F.map_keys(m), lambda k: k.try_cast("double"))
    return F.array(F.array_min(keys), F.array_max(keys))


def as_fraction(m: Column) -> Column:
    """Values over their maximum; 0 when that is 0."""
    return F.transform_values(m, lambda _, v: F.coalesce(F.try_divide(v, maximum(m)), F.lit(0.0)))


def as_share(m: Column, of: float = 100.0, ceil: bool = False) -> Column:
    value = lambda v: F.coalesce(F.try_divide(v, total(m)) * of, F.lit(0.0))
    return F.transform_values(m, lambda _, v: F.ceil(value(v)).cast("double") if ceil else value(v))


def invert_fraction(m: Column) -> Column:
    return F.transform_values(m, lambda _, v: 1 - v)


def without_zeroes(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v != 0)


def cleaned(m: Column) -> Column:
    """Without null and zero values."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != 0))


def modified(m: Column, key: str, by: float, delete_negative: bool = False) -> Column:
    """`by` added to the value at `key`, which may be new; with `delete_negative` a value of at most 0 goes."""
    out = F.map_zip_with(m, F.create_map(F.lit(key), F.lit(float(by))), lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return F.map_filter(out, lambda k, v: (k != key) | (v > 0)) if delete_negative else out


def shifted_ranges(m: Column, by: float) -> Column:
    return F.transform_values(m, lambda _, r: F.transform(r, lambda v: v + by))


def changed_range(m: Column, key: str, bound: str, by: float) -> Column:
    """`by` added to the min, the max or both bounds of the range at `key`."""
    lo, hi = (float(by) if bound in (b, "both") else 0.0 for b in ("min", "max"))
    return F.transform_values(m, lambda k, r: F.when(k == key, F.array(F.get(r, F.lit(0)) + lo, F.get(r, F.lit(1)) + hi)).otherwise(r))


def sorted_entries(m: Column, by: str = "key", descending: bool = False) -> Column:
    """Entries as an array of structs, by key, numeric_key or value."""
    order = {"key": lambda e: e["key"], "numeric_key": lambda e: e["key"].try_cast("double"), "value": lambda e: e["value"]}[by]
    wrapped = F.sort_array(F.transform(F.map_entries(m), lambda e: F.struct(order(e).alias("o"), e.alias("e"))), not descending)
    return F.transform(wrapped, lambda w: w["e"])


def has_keys(m: Column, keys: list[str], every: bool = True) -> Column:
    test = F.forall if every else F.exists
    return test(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(m, k))


def negative_difference(before: Column, after: Column) -> Column:
    """What turns `after` back into `before`: for each key that differs its earlier value, null where there was none."""
    both = F.map_zip_with(before, after, lambda _, x, y: F.struct(x.alias("x"), (~x.eqNullSafe(y)).alias("differs")))
    return F.transform_values(F.map_filter(both, lambda _, v: v["differs"]), lambda _, v: v["x"])


def apply_difference(state: Column, difference: Column) -> Column:
    """A state with a difference laid over it; null values delete their keys."""
    return F.map_filter(F.map_concat(F.map_filter(state, lambda k, _: ~F.map_contains_key(difference, k)), difference), lambda _, v: v.isNotNull())


def nearest_signed(m: Column, key: Column, positive: bool = True) -> Column:
    """The value > 0 (or < 0) whose numeric key lies nearest to `key`; of equals that of the larger key."""
    entries = F.filter(F.map_entries(m), lambda e: e["value"] > 0 if positive else e["value"] < 0)
    at = lambda e: e["key"].cast("double")
    return F.array_min(F.transform(entries, lambda e: F.struct(F.abs(at(e) - key).alias("d"), (-at(e)).alias("k"), e["value"].alias("v"))))["v"]


def average_deviation(base: Column, other: Column) -> Column:
    """Mean over `other` of value / base value at the same key (1 where the base has none)."""
    ratios = F.transform(F.map_entries(other), lambda e: F.try_divide(e["value"], F.coalesce(F.nullif(F.element_at(base, e["key"]), F.lit(0.0)), F.lit(1.0))))
    return F.try_divide(F.aggregate(ratios, F.lit(0.0), lambda s, v: s + v), F.size(ratios))


def json_path(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, "$." + path)


def json_equal(a: Column, b: Column) -> Column:
    return F.to_json(a) == F.to_json(b)


def depth(doc: Column) -> Column:
    """Nesting depth of a JSON document: the most open braces and brackets outside strings."""
    bare = F.regexp_replace(F.regexp_replace(doc, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("most"))
    return F.when(bare == "", 0).otherwise(F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"]))


def values_list(m: Column) -> Column:
    return F.map_values(m)


def sub_keys(doc: Column, only_objects: bool = False) -> Column:
    """All keys of a JSON document at any depth, in its order; with `only_objects` those whose value is an object."""
    key = r'"((?:[^"\\]|\\.)*)"\s*:' + (r"\s*\{" if only_objects else "")
    return F.regexp_extract_all(doc, F.lit(key), F.lit(1))


def serialise(value: Column) -> Column:
    """A value as JSON text, nulls kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def strictly_equal(a: Column, b: Column) -> Column:
    """Equal values of one type; nulls equal each other."""
    return a.eqNullSafe(b) & (F.typeof(a) == F.typeof(b))
