"""A small equation language compiled to Columns; nothing is ever evaluated as code.

    expression  := comparison of sums, products, powers (**), unary minus, calls and names
    assignments := name = expression ; name = expression

Names may carry a scope ("i$Score"). Division by zero gives ±Infinity or NaN,
the remainder has the sign of the dividend, and powers bind to the right.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_$][\w$.]*)|(\*\*|<=|>=|==|!=|[-+*/%(),<>=;]))")

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"),
    "round": lambda x: F.floor(x + 0.5).cast("double"), "trunc": lambda x: F.signum(x) * F.floor(F.abs(x)), "sign": F.signum,
    "log": lambda x: F.ln(x), "log2": F.log2, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan, "atan2": F.atan2,
    "min": lambda *x: F.least(*x), "max": lambda *x: F.greatest(*x), "pow": lambda a, b: F.pow(a, b),
}
CONSTANTS = {"PI": 3.141592653589793, "E": 2.718281828459045}


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is ±Infinity, 0/0 NaN."""
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def remainder(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(float("nan"))).otherwise(F.try_mod(a, b))


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 10]!r} in equation")
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("sign", m[3]))
        at = m.end()
    return out


class _Parser:
    BINDING = {"<": 1, "<=": 1, ">": 1, ">=": 1, "==": 1, "!=": 1, "+": 2, "-": 2, "*": 3, "/": 3, "%": 3, "**": 5}

    def __init__(self, text: str, names: Callable[[str], Column]):
        self.rest, self.names = tokens(text), names

    def peek(self) -> str | None:
        return self.rest[0][1] if self.rest else None

    def take(self, expected: str | None = None) -> tuple[str, str]:
        if not self.rest or (expected and self.rest[0][1] != expected):
            raise ValueError(f"expected {expected or 'more'}, found {self.peek()!r}")
        return self.rest.pop(0)

    def expression(self, least: int = 0) -> Column:
        left = self.operand()
        while (op := self.peek()) in self.BINDING and self.BINDING[op] > least:
            self.take()
            right = self.expression(self.BINDING[op] - (op == "**"))
            left = self.apply(op, left, right)
        return left

    def operand(self) -> Column:
        kind, text = self.take()
        if kind == "number":
            return F.lit(float(text))
        if text == "-":
            return -self.expression(4)
        if text == "+":
            return self.expression(4)
        if text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind != "name":
            raise ValueError(f"unexpected {text!r}")
        short = text.removeprefix("Math.")
        if self.peek() == "(":
            if short not in FUNCTIONS:
                raise ValueError(f"unknown function {text!r}")
            self.take()
            args = []
            while self.peek() != ")":
                args.append(self.expression())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return FUNCTIONS[short](*args)
        return F.lit(CONSTANTS[short]) if short in CONSTANTS else self.names(text)

    @staticmethod
    def apply(op: str, a: Column, b: Column) -> Column:
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "%": lambda: remainder(a, b), "**": lambda: F.pow(a, b),
            "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b,
        }[op]()


def compile_expression(text: str, names: dict[str, Column] | Callable[[str], Column]) -> Column:
    """The Column of one expression; unknown names raise."""
    parser = _Parser(text, names if callable(names) else lambda n: _lookup(names, n))
    out = parser.expression()
    if parser.rest:
        raise ValueError(f"left over: {parser.peek()!r}")
    return out


def _lookup(names: dict[str, Column], name: str) -> Column:
    if name not in names:
        raise ValueError(f"unknown name {name!r}")
    return names[name]


def compile_assignments(text: str, names: dict[str, Column] | Callable[[str], Column]) -> dict[str, Column]:
    """{target: Column} of "a = …; b = …", in order; later ones see earlier ones."""
    found: dict[str, Column] = {}
    lookup = names if callable(names) else lambda n: _lookup(names, n)
    for part in filter(str.strip, text.split(";")):
        target, sign, body = re.match(r"\s*([\w$.]+)\s*(=)(?!=)(.*)", part, re.S).groups() if re.match(r"\s*[\w$.]+\s*=(?!=)", part) else (None, "", part)
        if not sign:
            raise ValueError(f"no assignment in {part!r}")
        found[target] = compile_expression(body, lambda n: found[n] if n in found else lookup(n))
    return found
