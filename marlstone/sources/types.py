"""Column types of an archive and their Spark counterparts.

Integers keep their width and sign by a range check on write; 128-bit values are decimal(38,0)
and raise outside of it. Nested options are one nullable level, as they are when stored.
"""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch


@dataclass(frozen=True)
class Type:
    """A type by name; ``spark`` is what it is stored as."""

    name: str

    @property
    def spark(self) -> T.DataType:
        return {"bool": T.BooleanType(), "char": T.StringType(), "string": T.StringType(), "f32": T.FloatType(), "f64": T.DoubleType()}[self.name]

    nullable = False

    def violated(self, c: Column) -> Column | None:
        """True where a present value is out of the type's range; None if it cannot be."""
        return F.length(c) != 1 if self.name == "char" else None


BOOL, CHAR, STRING, F32, F64 = map(Type, ("bool", "char", "string", "f32", "f64"))


@dataclass(frozen=True)
class Int(Type):
    """i8 to i128 and u8 to u128; ``name`` is one of these."""

    def __post_init__(self):
        if self.name[:1] not in ("i", "u") or self.name[1:] not in ("8", "16", "32", "64", "128"):
            raise TypeMismatch(f"no integer type {self.name}")

    @property
    def bits(self) -> int:
        return int(self.name[1:])

    @property
    def spark(self) -> T.DataType:
        signed = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType(), 128: T.DecimalType(38, 0)}
        unsigned = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0), 128: T.DecimalType(38, 0)}
        return (signed if self.name[0] == "i" else unsigned)[self.bits]

    def violated(self, c: Column) -> Column | None:
        if self.name[0] == "i":
            return None
        most = F.lit(str(2**self.bits - 1)).cast("decimal(20,0)") if self.bits <= 64 else None
        return (c < 0) if most is None else (c < 0) | (c > most)


@dataclass(frozen=True)
class NonZero(Int):
    """An integer that is never zero."""

    def violated(self, c: Column) -> Column | None:
        base = super().violated(c)
        return c == 0 if base is None else base | (c == 0)


@dataclass(frozen=True)
class Seq(Type):
    """A sequence of items of one type."""

    name: str = "seq"
    item: Type = STRING

    @property
    def spark(self) -> T.DataType:
        return T.ArrayType(self.item.spark, self.item.nullable)

    def violated(self, c: Column) -> Column | None:
        if isinstance(self.item, NonZero):
            raise TypeMismatch("a sequence of non-zero integers cannot be written")
        if self.item.violated(F.lit(None)) is None:
            return None
        return F.exists(c, lambda x: F.coalesce(self.item.violated(x), F.lit(False)))


@dataclass(frozen=True)
class Opt(Type):
    """A value or none; nested options are one level."""

    name: str = "opt"
    item: Type = STRING
    nullable = True

    @property
    def spark(self) -> T.DataType:
        return self.item.spark

    def violated(self, c: Column) -> Column | None:
        return self.item.violated(c)


def stored(t: Type, value):
    """A Python value as Spark takes it for the type: wide integers as decimals."""
    if isinstance(t, Opt):
        return None if value is None else stored(t.item, value)
    if isinstance(t, Seq):
        return None if value is None else [stored(t.item, x) for x in value]
    return Decimal(value) if isinstance(value, int) and isinstance(t.spark, T.DecimalType) else value


def restored(t: Type, value):
    """What Spark gives for a stored value, as the Python value of the type."""
    if value is None:
        return None
    if isinstance(t, Opt):
        return restored(t.item, value)
    if isinstance(t, Seq):
        return [restored(t.item, x) for x in value]
    return int(value) if isinstance(value, Decimal) else value


def to_json(t: Type) -> object:
    kind = type(t).__name__
    return {"opt": to_json(t.item)} if kind == "Opt" else {"seq": to_json(t.item)} if kind == "Seq" else {"nonzero": t.name} if kind == "NonZero" else t.name


def from_json(x) -> Type:
    if isinstance(x, str):
        return Int(x) if x[1:].isdigit() and x[0] in "iu" else Type(x)
    (kind, inner), = x.items()
    return NonZero(inner) if kind == "nonzero" else (Opt if kind == "opt" else Seq)(item=from_json(inner))


def schema_of(cls: type) -> dict[str, Type]:
    """The columns of a dataclass, from its annotations: Type objects by typing.Annotated, or
    bool, int (i64), float (f64), str, list[...] and ``X | None``."""

    def one(a) -> Type:
        if typing.get_origin(a) is typing.Annotated:
            return next(x for x in typing.get_args(a)[1:] if isinstance(x, Type))
        args = typing.get_args(a)
        if type(None) in args:
            return Opt(item=one(next(x for x in args if x is not type(None))))
        if typing.get_origin(a) is list:
            return Seq(item=one(args[0]))
        try:
            return {bool: BOOL, int: Int("i64"), float: F64, str: STRING}[a]
        except KeyError:
            raise TypeMismatch(f"no column type for {a!r}") from None

    if not dataclasses.is_dataclass(cls) or not dataclasses.fields(cls):
        raise TypeMismatch("a record is a dataclass with named fields")
    hints = typing.get_type_hints(cls, include_extras=True)
    return {f.name: one(hints[f.name]) for f in dataclasses.fields(cls)}


def spark_schema(columns: Mapping[str, Type]) -> T.StructType:
    """Columns by name."""
    return T.StructType([T.StructField(k, columns[k].spark, True) for k in sorted(columns)])
