"""Lazy row queries: filters, positional windows, joins and terminals in declared order.

A frame is a DataFrame with a unique long column that orders its rows; windows over an order that
is not unique are not defined. ``skip``, ``take``, ``stride`` and ``nth`` count the rows that are
left where they stand in the chain; ``limit`` and ``offset`` cut the final result, in either order
of calls. A dense order (consecutive numbers, with no filter before) is cut by its values, which
Parquet pushes down; an archive reads only the files that hold them. Short windows behind filters
keep the least rows of the order; other positions come from counts of ranges of the order, never
from a window over all rows in one task.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CrossSource, IndexOverflow, NotFound, TypeMismatch
from ..functions import predicates as p
from ..functions.predicates import Predicate

#: Values of the order in one range, which one task sorts, and ranges in one range of ranges, in
#: bits; of the latter there are 2 ** 22 at most.
RANGE_BITS = 21
#: No table has as many rows: a dense order has one level of ranges.
MOST_ROWS = 1 << (2 * RANGE_BITS)
#: Values up to which a set is compared in the filter; longer ones are joined.
IN_FILTER = 500
#: Rows up to which a window behind filters is the least of a sort.
LEAST_ROWS = 100_000


@dataclass(frozen=True)
class Frame:
    """``source`` names what predicates may be combined over; ``types`` are checked if given;
    ``total`` is the row count where it is known without a scan, ``first`` the order's value at
    position 0 where it is dense, ``span`` a number that no value of the order reaches. ``scan``
    gives the rows anew from fewer files, before ``wheres``; ``skipped`` are the rows before a skip
    and its count."""

    rows: DataFrame
    source: str
    order: str
    dense: bool = False
    types: Mapping[str, Any] | None = None
    total: int | None = None
    cut: tuple[int | None, int] = (None, 0)
    shown: tuple[str, ...] | None = None
    first: int = 0
    span: int | None = None
    scan: Any = None
    wheres: tuple[Column, ...] = ()
    skipped: tuple[DataFrame, int] | None = None

    # -- projection

    def select(self, *names: str) -> "Frame":
        for n in names:
            self._known(n)
        return replace(self, shown=tuple(names))

    def column(self, name: str, type_: Any = None) -> "Handle":
        """A handle on one column; its type is compared once, without widening."""
        self._typed(name, type_)
        return Handle(self, name)

    # -- filters

    def where(self, predicate: Predicate) -> "Frame":
        if predicate.source not in (None, self.source):
            raise CrossSource(f"a predicate of {predicate.source} on {self.source}")
        return self._where(predicate.column(self.rows.schema))

    def filter(self, condition: Column | Callable, *names: str) -> "Frame":
        for n in names:
            self._known(n)
        return self.where(p.where_(condition, *names))

    def range(self, name: str, low: Any = None, high: Any = None, low_open: bool = False, high_open: bool = True) -> "Frame":
        return self._on(name, p.range_(name, low, high, low_open, high_open), [(low, high, low_open, high_open)])

    def eq(self, name: str, value: Any) -> "Frame":
        return self._on(name, p.eq(name, value), [(value, value, False, False)])

    equal = eq

    def ne(self, name: str, value: Any) -> "Frame":
        return self._on(name, p.ne(name, value))

    def one_of(self, name: str, values: Iterable[Any]) -> "Frame":
        values = list(values)
        if len(values) <= IN_FILTER:
            return self._on(name, p.one_of(name, values), [(v, v, False, False) for v in values])
        keys, key = self._set(name, values)
        return self._filtered(self.rows.join(keys, key == keys["_key"], "left_semi"))

    one_of_sorted = one_of_set = one_of

    def none_of(self, name: str, values: Iterable[Any]) -> "Frame":
        values = list(values)
        if len(values) <= IN_FILTER:
            return self._on(name, p.none_of(name, values))
        keys, key = self._set(name, values)
        return self._filtered(self.rows.where(F.col(f"`{name}`").isNotNull()).join(keys, key == keys["_key"], "left_anti"))

    none_of_sorted = none_of_set = none_of

    def is_some(self, name: str) -> "Frame":
        return self._on(name, p.is_some(name))

    def is_none(self, name: str) -> "Frame":
        return self._on(name, p.is_none(name))

    def mask(self, name: str) -> "Frame":
        return self._on(name, p.mask(name))

    # -- windows

    def skip(self, n: int) -> "Frame":
        if self.dense:
            total = None if self.total is None else max(0, self.total - n)
            return self._between(self.first + n, None, total)
        base, before = self.skipped or (self.rows, 0)
        kept = self._filtered(_placed(base, self.order, self.span).where(F.col("__pos") >= before + n).drop("__pos"))
        return replace(kept, skipped=(base, before + n))

    def take(self, n: int) -> "Frame":
        if self.dense:
            return self._between(self.first, self.first + n, None if self.total is None else min(n, self.total))
        base, before = self.skipped or (self.rows, 0)
        return self._filtered(self._window(base, before, n))

    def get(self, low: int = 0, high: int | None = None) -> "Frame":
        """The rows at positions low <= position < high."""
        out = self.skip(low) if low else self
        return out if high is None else out.take(max(0, high - low))

    def stride(self, n: int) -> "Frame":
        """Every nth row of what is left, from the first; 0 is 1."""
        n = max(1, n)
        if self.dense:
            return self._filtered(self.rows.where((F.col(self.order) - self.first) % n == 0))
        return self._filtered(self._positions().where(F.col("__pos") % n == 0).drop("__pos"))

    def limit(self, n: int) -> "Frame":
        return replace(self, cut=(n if self.cut[0] is None else min(n, self.cut[0]), self.cut[1]))

    def offset(self, n: int) -> "Frame":
        return replace(self, cut=(self.cut[0], self.cut[1] + n))

    def nth_frame(self, n: int) -> "Frame":
        return self.skip(n).take(1)

    def nth(self, n: int) -> Row | None:
        """The row of position n, None behind the end."""
        return self.nth_frame(n).df.first()

    # -- joins

    def semi_join(self, name: str, other: "Frame | Handle", other_name: str | None = None) -> "Frame":
        """Rows whose value is among the other's; copies there do not multiply. Where both sides
        are optional, none matches none."""
        keys, whole, kind = self._join_keys(name, other, other_name)
        c = F.col(f"`{name}`").cast(kind)
        return self._filtered(self.rows.join(keys, c.eqNullSafe(keys["_key"]) if whole else c == keys["_key"], "left_semi"))

    def anti_join(self, name: str, other: "Frame | Handle", other_name: str | None = None) -> "Frame":
        """Rows whose value is not among the other's. An absent value is dropped, unless both sides
        are optional: then none matches none."""
        keys, whole, kind = self._join_keys(name, other, other_name)
        c = F.col(f"`{name}`").cast(kind)
        rows = self.rows if whole else self.rows.where(c.isNotNull())
        return self._filtered(rows.join(keys, c.eqNullSafe(keys["_key"]) if whole else c == keys["_key"], "left_anti"))

    def join(self, other: "Frame", name: str, other_name: str) -> "Frame":
        """Inner join with the columns of both, whose names must differ; in this frame's order
        (rows with more than one partner by the partner's order)."""
        _common(self.rows.schema, name, other.rows.schema, other_name)
        mine, theirs = self._named(), other._named()
        if both := set(mine) & set(theirs):
            raise TypeMismatch(f"both sides have {sorted(both)}; select or rename first")
        right = other._final(other.rows).select(*[F.col(f"`{c}`") for c in theirs], F.col(other.order).alias("__other"))
        left = self._final(self.rows).select(*[F.col(f"`{c}`") for c in mine], F.col(self.order).alias("__mine"))
        joined = left.join(right, left[name] == right[other_name])
        types = None if self.types is None or other.types is None else {**self.types, **other.types}
        return Frame(joined, f"{self.source}*{other.source}", "__mine", types=types, shown=tuple([*mine, *theirs]))

    # -- terminals

    @property
    def df(self) -> DataFrame:
        """The result, unordered."""
        return self._final(self.rows).select(*[F.col(f"`{c}`") for c in self._named()])

    @property
    def df_with_order(self) -> DataFrame:
        return self._final(self.rows)

    @property
    def ordered(self) -> DataFrame:
        """The result in row order."""
        also = ["__other"] if "__other" in self.rows.columns else []
        return self._final(self.rows).orderBy(self.order, *also).select(*[F.col(f"`{c}`") for c in self._named()])

    def collect(self) -> list[Row]:
        return self.ordered.collect()

    def iter(self) -> Iterator[Row]:
        return self.ordered.toLocalIterator()

    def records(self, cls: type) -> Iterator[Any]:
        """The result in row order as records of a dataclass, whose fields name the columns that
        are read; raises NotFound or TypeMismatch if a column is not there or of another type."""
        from ..sources.types import restored, schema_of

        fields = schema_of(cls)
        for name, kind in fields.items():
            self._typed(name, kind)
        names = [f.name for f in dataclasses.fields(cls)]
        for row in self.select(*names).iter():
            yield cls(**{n: restored(fields[n], v) for n, v in zip(names, row)})

    __iter__ = iter

    def read(self, predicate: Predicate) -> DataFrame:
        """All rows with their outcome under a predicate: include, exclude, or absent where a
        column that must be present is not."""
        absent = F.lit(False)
        for c in predicate.present:
            absent = absent | F.col(f"`{c}`").isNull()
        verdict = F.when(absent, "absent").when(F.coalesce(predicate.make(self.rows.schema), F.lit(False)), "include").otherwise("exclude")
        return self._final(self.rows).select(*[F.col(f"`{c}`") for c in self._named()], verdict.alias("outcome"))

    def count(self) -> int:
        return self.total if self.total is not None and self.cut == (None, 0) else self._final(self.rows).count()

    def distinct(self, *names: str) -> DataFrame:
        return self.df.select(*names or self._named()).distinct()

    def sorted_set(self, name: str) -> DataFrame:
        return self.distinct(name).orderBy(name)

    def first_index(self, keys: Iterable[str], bits: int | None = None) -> DataFrame:
        """(keys, index): the position of the first row of each key. With ``bits`` raises
        IndexOverflow if any row's position, repeats included, is beyond that width."""
        keys = list(keys)
        rows = self._final(self._positions())
        if bits is not None and (last := rows.agg(F.max("__pos")).first()[0]) is not None and last >= 1 << bits:
            raise IndexOverflow(f"index {last} does not fit {bits} bits")
        return rows.groupBy(*keys).agg(F.min("__pos").cast("long").alias("index"))

    # -- inside

    def _named(self) -> list[str]:
        return list(self.shown) if self.shown else [c for c in self.rows.columns if not c.startswith("__")]

    def _known(self, name: str) -> None:
        if name not in self.rows.columns:
            raise NotFound(f"{self.source} has no column {name}")

    def _typed(self, name: str, type_: Any) -> None:
        self._known(name)
        if type_ is None:
            return
        have = (self.types or {}).get(name)
        plain = self.rows.schema[name].dataType.simpleString()
        if (have != type_) if have is not None and not isinstance(type_, str) else plain != getattr(getattr(type_, "spark", None), "simpleString", lambda: type_)():
            raise TypeMismatch(f"{name} is {have or plain}, not {type_}")

    def _on(self, name: str, predicate: Predicate, intervals: list[tuple] | None = None) -> "Frame":
        """Filters by a predicate of one column; ``intervals`` (low, high, low open, high open) are
        where its values lie."""
        self._known(name)
        condition = predicate.column(self.rows.schema)
        if intervals is not None and self.scan is not None and self.cut == (None, 0):
            scan = self.scan.pruned(name, intervals)
            if scan is not self.scan:
                rows = scan.rows()
                for c in self.wheres:
                    rows = rows.where(c)
                return replace(self, rows=rows, scan=scan)._where(condition)
        return self._where(condition)

    def _where(self, condition: Column) -> "Frame":
        out = self._filtered(self.rows.where(condition))
        return replace(out, scan=self.scan, wheres=(*self.wheres, condition))

    def _filtered(self, rows: DataFrame) -> "Frame":
        span = MOST_ROWS if self.span is None and self.dense else self.span
        return replace(self, rows=rows, dense=False, total=None, first=0, span=span, scan=None, wheres=(), skipped=None)

    def _between(self, low: int, high: int | None, total: int | None) -> "Frame":
        """The rows of a dense order from low to before high."""
        if self.scan is not None and not self.wheres:
            scan = self.scan.between(low, high)
            return replace(self, rows=scan.rows(), scan=scan, total=total, first=low)
        at = F.col(self.order)
        rows = self.rows.where(at >= low) if low > self.first else self.rows
        rows = rows if high is None else rows.where(at < high)
        return replace(self, rows=rows, total=total, first=low)

    def _final(self, rows: DataFrame) -> DataFrame:
        most, first = self.cut
        if most is None and not first:
            return rows
        if self.dense:
            at = F.col(self.order)
            rows = rows.where(at >= self.first + first) if first else rows
            return rows if most is None else rows.where(at < self.first + first + most)
        return self._window(rows, first, most)

    def _window(self, rows: DataFrame, first: int, most: int | None) -> DataFrame:
        if most is not None and first + most <= LEAST_ROWS:
            least = rows.orderBy(self.order)
            return (least.offset(first) if first else least).limit(most)
        at = F.col("__pos")
        placed = _placed(rows, self.order, self.span).where(at >= first)
        return (placed if most is None else placed.where(at < first + most)).drop("__pos")

    def _positions(self) -> DataFrame:
        """The rows with __pos, their position."""
        if self.dense:
            return self.rows.withColumn("__pos", F.col(self.order) - self.first)
        return _placed(self.rows, self.order, self.span)

    def _set(self, name: str, values: list) -> tuple[DataFrame, Column]:
        """(the values as _key, the column as it is compared with them)."""
        self._known(name)
        schema = self.rows.schema
        kind = schema[name].dataType
        values = [p.operand(schema, name, v) for v in values]
        keys = self.rows.sparkSession.createDataFrame([(v,) for v in values], f"_key {kind.simpleString()}")
        if p.is_float(kind):  # joins take 0.0 and -0.0 for one; their text is not
            return keys.select(F.col("_key").cast("string").alias("_key")), F.col(f"`{name}`").cast("string")
        return keys, F.col(f"`{name}`")

    def _join_keys(self, name: str, other: "Frame | Handle", other_name: str | None) -> tuple[DataFrame, bool, T.DataType]:
        if isinstance(other, Handle):
            other, other_name = other.frame, other.name
        self._known(name)
        other._known(other_name)
        kind = _common(self.rows.schema, name, other.rows.schema, other_name)
        keys = other._final(other.rows).select(F.col(f"`{other_name}`").cast(kind).alias("_key"))
        return keys, self._optional(name) and other._optional(other_name), kind

    def _optional(self, name: str) -> bool:
        t = (self.types or {}).get(name)
        return bool(getattr(t, "nullable", False))


def _common(mine: T.StructType, name: str, theirs: T.StructType, other_name: str) -> T.DataType:
    """The type that keys are compared in: theirs and ours if they are the same, for integers of
    different widths or signs one that holds both. Floating-point columns are refused."""
    for schema, n in ((mine, name), (theirs, other_name)):
        if n not in schema.names:
            raise NotFound(f"no column {n}")
    a, b = mine[name].dataType, theirs[other_name].dataType
    if p.is_float(a) or p.is_float(b):
        raise TypeMismatch("floating-point columns have no order of keys")
    if a == b:
        return a
    whole = lambda t: isinstance(t, T.IntegralType) or isinstance(t, T.DecimalType) and not t.scale
    if whole(a) and whole(b):
        return T.LongType() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else T.DecimalType(38, 0)
    if a.simpleString() != b.simpleString():
        raise TypeMismatch(f"{name} is {a.simpleString()}, {other_name} is {b.simpleString()}")
    return a


def _placed(rows: DataFrame, order: str, span: int | None = None) -> DataFrame:
    """Rows with __pos, their position. The order's values are counted in ranges, these in ranges
    of ranges, up to what one task can sum; places add up from there down to the rows of a range."""
    levels = [k * RANGE_BITS for k in range(1, 3) if k == 1 or span is None or (span - 1) >> (k * RANGE_BITS)]
    of = lambda bits: f"__range{bits}"
    rows = rows.withColumns({of(b): F.shiftright(F.col(order).cast("long"), b) for b in levels})
    sums, below = {}, rows.select(*map(of, levels), F.lit(1).cast("long").alias("_n"))
    for i, b in enumerate(levels):
        sums[b] = below = below.groupBy(*map(of, levels[i:])).agg(F.sum("_n").alias("_n"))
    start = None
    for i in reversed(range(len(levels))):
        up = [of(b) for b in levels[i + 1 :][:1]]
        before = Window.partitionBy(*up).orderBy(of(levels[i])).rowsBetween(Window.unboundedPreceding, -1)  # a task has the ranges of one range
        own = sums[levels[i]].withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if start is not None:
            own = own.join(start, up).withColumn("_before", F.col("_before") + F.col("__start"))
        start = own.select(of(levels[i]), F.col("_before").alias("__start"))
    low = of(levels[0])
    place = Window.partitionBy(low).orderBy(order)
    placed = rows.join(start, low).withColumn("__pos", F.col("__start") + F.row_number().over(place) - 1)
    return placed.drop("__start", *map(of, levels))


@dataclass(frozen=True)
class Handle:
    """One column of a frame: predicates over it for combination, or a chain of its own."""

    frame: Frame
    name: str

    def _of(self, predicate: Predicate) -> Predicate:
        predicate.make(self.frame.rows.schema)  # refuses operands that the column does not take
        return predicate.of(self.frame.source)

    def range(self, *args: Any, **more: Any) -> Predicate:
        return self._of(p.range_(self.name, *args, **more))

    def eq(self, value: Any) -> Predicate:
        return self._of(p.eq(self.name, value))

    def ne(self, value: Any) -> Predicate:
        return self._of(p.ne(self.name, value))

    def one_of(self, values: Iterable[Any]) -> Predicate:
        return self._of(p.one_of(self.name, values))

    def none_of(self, values: Iterable[Any]) -> Predicate:
        return self._of(p.none_of(self.name, values))

    def is_some(self) -> Predicate:
        return self._of(p.is_some(self.name))

    def is_none(self) -> Predicate:
        return self._of(p.is_none(self.name))

    def any(self) -> Predicate:
        return self._of(p.always())

    def iter(self) -> Iterator[Any]:
        return (r[0] for r in self.frame.select(self.name).iter())

    def mask(self) -> Predicate:
        return self._of(p.mask(self.name))

    def get(self, low: int = 0, high: int | None = None) -> "Handle":
        """The column at positions low <= position < high."""
        return Handle(self.frame.get(low, high), self.name)

    def distinct(self) -> DataFrame:
        return self.frame.distinct(self.name)

    def first_index(self, bits: int | None = None) -> DataFrame:
        return self.frame.first_index([self.name], bits)
