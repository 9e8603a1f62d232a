"""Scalar functors of rule programs as Column expressions.

Conventions: ``match`` is a whole-string match; ``contains`` has the needle first; ``substr`` counts from
0; ``/`` and ``%`` truncate towards zero and give null (no row) for a zero divisor; ``ord`` is a symbol's number in the
engine's table of ordinals (a join), and the text itself where only the order of symbols is asked for. ``x = range(a, b)``
gives each number from a up to b, b left out. Strings are measured in characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def match(pattern: Column | str, text: Column) -> Column:
    if isinstance(pattern, str):
        return text.rlike(f"^(?:{pattern})$")
    return F.regexp_like(text, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))


def contains(needle: Column | str, text: Column) -> Column:
    return text.contains(needle)


def substr(text: Column, start: Column | int, length: Column | int) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    start, length = as_column(start).cast("int"), as_column(length).cast("int")
    return F.when((start < 0) | (length <= 0), F.lit("")).otherwise(F.substring(text, start + 1, length))


def strlen(text: Column) -> Column:
    return F.length(text).cast("long")


def cat(*parts: Column) -> Column:
    return F.concat(*parts)


def to_number(text: Column) -> Column:
    """The number that the text is, or null."""
    return text.try_cast("long")


def to_string(number: Column) -> Column:
    return number.cast("string")


def ord_(symbol: Column) -> Column:
    return symbol


def div(a: Column, b: Column) -> Column:
    a, b = a.cast("long"), b.cast("long")
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def mod(a: Column, b: Column) -> Column:
    a, b = a.cast("long"), b.cast("long")
    return F.when(b != 0, a % F.when(b != 0, b))


#: by name: (function of columns, result type)
FUNCTORS: dict[str, tuple[Callable[..., Column], str]] = {
    "cat": (cat, "symbol"),
    "ord": (ord_, "symbol"),
    "strlen": (strlen, "number"),
    "substr": (substr, "symbol"),
    "to_number": (to_number, "number"),
    "to_string": (to_string, "symbol"),
    "min": (lambda *x: F.least(*x), "number"),
    "max": (lambda *x: F.greatest(*x), "number"),
    "band": (lambda a, b: a.cast("long").bitwiseAND(b.cast("long")), "number"),
    "bor": (lambda a, b: a.cast("long").bitwiseOR(b.cast("long")), "number"),
    "bxor": (lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")), "number"),
    "bnot": (lambda a: F.bitwise_not(a.cast("long")), "number"),
}


#: the values that arithmetic by name gives; none for another operator
_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a.cast("long") + b.cast("long"),
    "-": lambda a, b: a.cast("long") - b.cast("long"),
    "*": lambda a, b: a.cast("long") * b.cast("long"),
    "/": div,
    "%": mod,
}


def calculate(operator: Column, a: Column, b: Column) -> Column:
    """What the operator that a column names makes of two numbers."""
    out = F
    for sign, value in _ARITHMETIC.items():
        out = out.when(operator == sign, value(a, b))
    return out


FUNCTORS["@calculate"] = (calculate, "number")


def register(name: str, function: Callable[..., Column], result: str = "symbol") -> None:
    """Makes a function of columns callable in rules as ``@name(...)``; for a Python UDF pass its wrapped form."""
    FUNCTORS[f"@{name}"] = (function, result)
