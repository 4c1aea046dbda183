"""Two-valued predicates over columns that may be null.

A predicate on an absent value is false, under OR, XOR and negation too. Equality is of bits: 0.0
and -0.0 differ, NaN equals NaN. NaN is in no range with a bound. ``is_some`` narrows: its column
must be present whatever tree it stands in. Plain comparisons stay as they are, so that Parquet
scans still push them down.

What a comparison means follows from the column's type, never from the operand's: a predicate is
built when it meets the schema, where operands that the type does not take raise TypeMismatch. An
integer operand of a floating-point column is that float; a float of an integer column is refused.
"""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CrossSource, TypeMismatch

Make = Callable[[T.StructType], Column]


@dataclass(frozen=True)
class Predicate:
    """A condition, made for a schema, and the columns that must be present besides; ``source``
    guards combinations, ``parts`` are what it was combined from."""

    make: Make
    present: tuple[str, ...] = field(default=())
    source: str | None = None
    parts: tuple["Predicate", ...] = ()

    def _with(self, other: "Predicate", combine: Callable[[Column, Column], Column], lift: bool = True) -> "Predicate":
        if None not in (self.source, other.source) and self.source != other.source:
            raise CrossSource(f"{self.source} and {other.source} are different sources")
        held = (lambda c: F.coalesce(c, F.lit(False))) if lift else (lambda c: c)
        make = lambda schema: combine(held(self.make(schema)), held(other.make(schema)))
        return Predicate(make, tuple(dict.fromkeys(self.present + other.present)), self.source or other.source, (self, other))

    def __and__(self, other: "Predicate") -> "Predicate":
        return self._with(other, lambda a, b: a & b, lift=False)

    def __or__(self, other: "Predicate") -> "Predicate":
        return self._with(other, lambda a, b: a | b)

    def __xor__(self, other: "Predicate") -> "Predicate":
        return self._with(other, lambda a, b: a != b)

    def unpack(self) -> tuple["Predicate", "Predicate"]:
        """The two predicates that this one was combined from."""
        if len(self.parts) != 2:
            raise TypeMismatch("a predicate of one column has no parts")
        return self.parts

    def of(self, source: str) -> "Predicate":
        return Predicate(self.make, self.present, source, self.parts)

    def column(self, schema: T.StructType) -> Column:
        """The whole condition, for a filter of rows of the schema."""
        return reduce(lambda a, c: a & F.col(f"`{c}`").isNotNull(), self.present, self.make(schema))


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


_TAKES = {
    T.BooleanType: (bool,),
    T.StringType: (str,),
    T.FloatType: (int, float),
    T.DoubleType: (int, float),
    T.DecimalType: (int, decimal.Decimal),
    T.TimestampType: (str, datetime.date),
    T.TimestampNTZType: (str, datetime.date),
    T.DateType: (str, datetime.date),
    T.BinaryType: (bytes, bytearray),
}


def operand(schema: T.StructType, name: str, value: Any) -> Any:
    """The value as the column's type compares it; raises TypeMismatch if it does not."""
    kind = schema[name].dataType
    takes = (int,) if isinstance(kind, T.IntegralType) else _TAKES.get(type(kind))
    if value is None or takes is None:
        return value
    if not isinstance(value, takes) or isinstance(value, bool) != isinstance(kind, T.BooleanType):
        raise TypeMismatch(f"{name} is {kind.simpleString()}; {value!r} is not")
    return float(value) if is_float(kind) else value


def literal(schema: T.StructType, name: str, value: Any) -> Column:
    kind = schema[name].dataType
    return F.lit(value).cast(kind) if isinstance(kind, T.FloatType) else F.lit(value)


def _equal(schema: T.StructType, name: str, value: Any) -> Column:
    c, value = _c(name), operand(schema, name, value)
    if isinstance(value, float) and value == 0:
        # no plain equality: the optimizer would put the literal in the place of c everywhere
        return (c >= 0.0) & (c <= 0.0) & (c.cast("string") == F.lit(value).cast("string"))
    return c == literal(schema, name, value)


def range_(name: str, low: Any = None, high: Any = None, low_open: bool = False, high_open: bool = True) -> Predicate:
    """low <= value < high; a bound of None is none; the flags leave out or take in the bound."""

    def make(schema: T.StructType) -> Column:
        c, a, b = _c(name), *(operand(schema, name, x) for x in (low, high))
        if any(isinstance(x, float) and math.isnan(x) for x in (a, b)):
            return F.lit(False)
        out = c.isNotNull()
        if a is not None:
            out = (c > literal(schema, name, a)) if low_open else (c >= literal(schema, name, a))
        if b is not None:
            upper = (c < literal(schema, name, b)) if high_open else (c <= literal(schema, name, b))
            out = upper if a is None else out & upper
        if a is not None and b is None and is_float(schema[name].dataType):
            out = out & ~F.isnan(c)
        return out

    return Predicate(make)


def eq(name: str, value: Any) -> Predicate:
    return Predicate(lambda schema: _equal(schema, name, value))


def ne(name: str, value: Any) -> Predicate:
    def make(schema: T.StructType) -> Column:
        if is_float(schema[name].dataType) and operand(schema, name, value) == 0:
            return _c(name).isNotNull() & ~_equal(schema, name, value)
        return _c(name) != literal(schema, name, operand(schema, name, value))

    return Predicate(make)


def one_of(name: str, values: Iterable[Any]) -> Predicate:
    """Membership in a list, sorted list or set of values."""
    values = list(values)

    def make(schema: T.StructType) -> Column:
        mine = [operand(schema, name, v) for v in values]
        floats = is_float(schema[name].dataType)
        zeros = {math.copysign(1, v) for v in mine if floats and v == 0}
        others = [literal(schema, name, v) for v in mine if not (floats and v == 0)]
        parts = [_c(name).isin(others)] if others else []
        parts += [_equal(schema, name, math.copysign(0.0, sign)) for sign in zeros]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)

    return Predicate(make)


def none_of(name: str, values: Iterable[Any]) -> Predicate:
    """Present and in none of the values."""
    inside = one_of(name, values)
    return Predicate(lambda schema: _c(name).isNotNull() & ~inside.make(schema))


def is_some(name: str) -> Predicate:
    return Predicate(lambda schema: F.lit(True), (name,))


def is_none(name: str) -> Predicate:
    return Predicate(lambda schema: _c(name).isNull())


def mask(name: str) -> Predicate:
    """A boolean column that is true, or any other column that is present."""
    return Predicate(lambda schema: F.coalesce(_c(name), F.lit(False)) if isinstance(schema[name].dataType, T.BooleanType) else _c(name).isNotNull())


def always() -> Predicate:
    return Predicate(lambda schema: F.lit(True))


def where_(condition: Column | Callable, *names: str) -> Predicate:
    """A condition, or a function of pandas Series for what columns cannot express. The function
    gets the named columns, of rows with all of them present; the others are false."""
    if isinstance(condition, Column):
        return Predicate(lambda schema: F.coalesce(condition, F.lit(False)))
    if not names:
        raise TypeMismatch("a function needs the names of its columns")

    def make(schema: T.StructType) -> Column:
        test = F.pandas_udf(condition, "boolean")
        present = reduce(lambda a, b: a & b, (_c(n).isNotNull() for n in names))
        return present & F.coalesce(test(*map(_c, names)), F.lit(False))

    return Predicate(make)


def all_(*parts: Predicate) -> Predicate:
    return reduce(lambda a, b: a & b, parts)


def any_(*parts: Predicate) -> Predicate:
    return reduce(lambda a, b: a | b, parts)


def xor_(*parts: Predicate) -> Predicate:
    return reduce(lambda a, b: a ^ b, parts)
