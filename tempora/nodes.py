"""The dataflow language: named node types as Column builders, and programs of nodes run as one lazy plan.

A program is a list of (id, node, inputs). An input is "@id" (another node's
value), "$column", or a literal. `if_then` keeps the rows where its first input
holds, `for_loop` repeats rows with an index, `object_iterate` gives one row per
entry; all others add a value. Order in the list does not matter; a cycle is an
error. A subprogram becomes a node type of its own by `custom`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .equation import divide, remainder
from .functions import arrays, maps, maths
from .operators.graph import layers

Builder = Callable[..., Column]


def _text(c: Column) -> Column:
    return c.cast("string")


def _truth(c: Column) -> Column:
    """Nothing, "", "0", "false" and NaN are false."""
    return ~F.coalesce(_text(c).isin("", "0", "0.0", "false", "NaN"), F.lit(True))


def _position(a: Column, v: Column) -> Column:
    return F.array_position(a, v) - 1


_EASINGS = ["linear"] + [f + m for f in ("quadratic", "cubic", "quartic", "quintic", "sinusoidal", "exponential", "circular") for m in ("In", "Out", "InOut")]

NODES: dict[str, Builder] = {
    # comparison and logic
    "is_equal": lambda a, b: _text(a) == _text(b),
    "is_strictly_equal": lambda a, b: a.eqNullSafe(b),
    "is_not_equal": lambda a, b: _text(a) != _text(b),
    "is_not_strictly_equal": lambda a, b: ~a.eqNullSafe(b),
    "geq": lambda a, b: a >= b, "greater_than": lambda a, b: a > b, "leq": lambda a, b: a <= b, "less_than": lambda a, b: a < b,
    "and": lambda a, b: _truth(a) & _truth(b), "or": lambda a, b: _truth(a) | _truth(b), "not": lambda a: ~_truth(a), "xor": lambda a, b: _truth(a) != _truth(b),
    "true": lambda: F.lit(True), "false": lambda: F.lit(False), "null": lambda: F.lit(None), "undefined": lambda: F.lit(None),
    # numbers
    "add_numbers": lambda a, b: a + b, "subtract_numbers": lambda a, b: a - b, "multiply_numbers": lambda a, b: a * b, "divide_numbers": divide, "modulo_numbers": remainder, "exponentiate_numbers": lambda a, b: F.pow(a, b),
    # text
    "add_strings": lambda a, b: F.concat(_text(a), _text(b)), "string_length": F.length,
    "string_startswith": lambda a, b: a.startswith(b), "string_endswith": lambda a, b: a.endswith(b),
    "string_matches": lambda a, p: F.regexp_extract_all(a, F.concat(F.lit("("), p, F.lit(")")), F.lit(1)),
    "string_replace": lambda a, x, y: F.when(a.contains(x), F.concat(F.substr(a, F.lit(1), F.position(x, a) - 1), y, F.substr(a, F.position(x, a) + F.length(x)))).otherwise(a),
    "string_replace_all": lambda a, x, y: F.replace(a, x, y), "split_string": lambda a, d: F.split(a, F.concat(F.lit("\\Q"), d, F.lit("\\E"))),
    # arrays
    "array_concatenate": lambda a, b: F.concat(a, b), "array_indexof": _position, "array_length": F.size, "array_reverse": F.reverse,
    "array_push": lambda a, v: F.array_append(a, v), "array_unshift": lambda a, v: F.array_prepend(a, v), "array_pop": lambda a: F.element_at(a, -1), "array_shift": lambda a: F.get(a, F.lit(0)),
    "array_splice": lambda a, at, n: F.concat(F.slice(a, F.lit(1), at), F.slice(a, at + n + 1, F.greatest(F.size(a) - at - n, F.lit(0)))),
    "join_array": lambda a, d: F.aggregate(F.transform(a, _text), F.lit(None).cast("string"), lambda s, v: F.when(s.isNull(), v).otherwise(F.concat(s, d, v))),
    # maps
    "concatenate_objects": lambda a, b: maps.merge(a, b, "overwrite"), "get_object_keys": F.map_keys, "get_object_values": F.map_values,
    # casts
    "convert_to_number": lambda c: arrays.number(c), "convert_to_string": _text, "convert_to_boolean": _truth, "convert_to_any": lambda c: c, "convert_to_array": lambda c: F.array(c),
    "convert_to_string_array": lambda c: F.transform(F.split(_text(c), ","), lambda v: F.trim(v)), "convert_to_number_array": lambda c: F.transform(F.split(_text(c), ","), lambda v: arrays.number(v)),
    # pass-through
    "log_info": lambda c: c, "log_warn": lambda c: c, "log_error": lambda c: c, "set_timeout": lambda c, *_: c,
    **{f"set_{k}": lambda c: c for k in ("any", "array", "boolean", "number", "string", "object")}, **{f"get_{k}": lambda c: c for k in ("any", "array", "boolean", "number", "string", "object")},
    **{name: (lambda x, name=name: maths.ease(x, name)) for name in _EASINGS},
}
ROW_NODES = ("if_then", "for_loop", "object_iterate")


def custom(name: str, program: list[tuple], inputs: list[str], output: str) -> None:
    """A program as a node type: `inputs` are the names that it reads as "$name", `output` the id of its value."""

    def build(*given: Column) -> Column:
        values = dict(zip(inputs, given, strict=True))
        return _values(program, lambda n: values[n])[output]

    NODES[name] = build


def remove_custom(name: str) -> None:
    NODES.pop(name, None)


def _order(program: list[tuple]) -> list[tuple]:
    by_id = {p[0]: p for p in program}
    found = layers([(x[1:], p[0]) for p in program for x in p[2] if isinstance(x, str) and x.startswith("@")], list(by_id))
    if found is None:
        raise ValueError("the program has a cycle")
    return [by_id[n] for layer in found for n in layer]


def _input(x, values: dict[str, Column], column: Callable[[str], Column]):
    if isinstance(x, str) and x.startswith("@"):
        return values[x[1:]]
    return column(x[1:]) if isinstance(x, str) and x.startswith("$") else F.lit(x)


def _values(program: list[tuple], column: Callable[[str], Column]) -> dict[str, Column]:
    values: dict[str, Column] = {}
    for key, node, inputs in _order(program):
        values[key] = NODES[node](*[_input(x, values, column) for x in inputs])
    return values


def run(df: DataFrame, program: list[tuple], outputs: list[str]) -> DataFrame:
    """df with the values of the nodes in `outputs` as columns; row nodes act in dependency order before what reads them."""
    values: dict[str, Column] = {}
    for key, node, inputs in _order(program):
        given = [_input(x, values, F.col) for x in inputs]
        name = f"_{key}"
        if node == "if_then":
            df = df.where(F.coalesce(_truth(given[0]), F.lit(False)))
            values[key] = given[1] if len(given) > 1 else F.lit(True)
        elif node == "for_loop":
            df = df.withColumn(name, F.explode(F.sequence(F.lit(0), given[0].cast("int") - 1)))
            values[key] = F.col(name)
        elif node == "object_iterate":
            df = df.select("*", F.explode(given[0]).alias(f"{name}_key", f"{name}_value"))
            values[key] = F.struct(F.col(f"{name}_key").alias("key"), F.col(f"{name}_value").alias("value"))
        else:
            df = df.withColumn(name, NODES[node](*given))
            values[key] = F.col(name)
    return df.select(*[c for c in df.columns if not c.startswith("_")], *[values[o].alias(o) for o in outputs])
