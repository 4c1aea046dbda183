"""Row queries on literal tables, and against a plain row model."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlstone.errors import CrossSource, IndexOverflow, NotFound, TypeMismatch
from marlstone.functions import eq, is_none, is_some, ne, none_of, one_of, range_
from marlstone.operators import Frame
from marlstone.sources import F64, Int, Opt


def column(spark, values, kind="long", nullable=False):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"__ord long, v {kind}")
    return Frame(rows, "t", "__ord", dense=True, types={"v": Opt(item=F64)} if nullable else {})


def got(frame):
    return [r[0] for r in frame.select("v").collect()]


# Inputs and results that pin the meaning of filters and windows.
TENS = [10, 20, 30, 40]
EIGHT = [10, 20, 30, 40, 50, 60, 70, 80]
MIXED = [10, 10, 10, 10, 50, 60, 70, 80]


@pytest.mark.parametrize(
    ("values", "build", "want"),
    [
        (TENS, lambda f: f, TENS),
        (TENS, lambda f: f.range("v", 15, 35), [20, 30]),
        (TENS[:3], lambda f: f.range("v", 20, 30), [20]),
        (TENS[:3], lambda f: f.range("v", 20, 30, high_open=False), [20, 30]),
        ([0, 1, 2, 10, 11, 12], lambda f: f.range("v", 9, 20), [10, 11, 12]),
        (TENS[:3], lambda f: f.eq("v", 20), [20]),
        (TENS[:3], lambda f: f.ne("v", 20), [10, 30]),
        (TENS[:3], lambda f: f.one_of("v", [20, 30]), [20, 30]),
        (TENS[:3], lambda f: f.none_of("v", [20]), [10, 30]),
        (TENS[:3], lambda f: f.one_of_sorted("v", [1, 4, 7, 12]), []),
        ([8, 9], lambda f: f.one_of_set("v", [1, 4, 7, 12]), []),
        (TENS, lambda f: f.one_of_set("v", range(0, 100_000, 20)), [20, 40]),
        (TENS, lambda f: f.none_of_set("v", range(0, 100_000, 20)), [10, 30]),
        ([7] * 3, lambda f: f.range("v", 5, 10), [7] * 3),
        ([7] * 3, lambda f: f.eq("v", 100), []),
        ([7] * 3, lambda f: f.ne("v", 7), []),
        ([7] * 3, lambda f: f.ne("v", 9), [7] * 3),
        (EIGHT, lambda f: f.skip(0).take(8), EIGHT),
        (EIGHT, lambda f: f.skip(2).take(3), [30, 40, 50]),
        (EIGHT, lambda f: f.skip(5).take(2), [60, 70]),
        (EIGHT, lambda f: f.skip(9), []),
        (EIGHT, lambda f: f.take(9), EIGHT),
        (EIGHT, lambda f: f.skip(2).skip(4), [70, 80]),
        (MIXED, lambda f: f.range("v", 50).skip(2), [70, 80]),
        (MIXED, lambda f: f.skip(2).range("v", 50), [50, 60, 70, 80]),
        (MIXED, lambda f: f.take(6).range("v", 50), [50, 60]),
        (EIGHT, lambda f: f.limit(3).offset(2), [30, 40, 50]),
        (EIGHT, lambda f: f.offset(2).range("v", 30).limit(3), [50, 60, 70]),
        ([0, 1, 2, 3, 4, 5], lambda f: f.stride(2), [0, 2, 4]),
        ([0, 1, 2, 3], lambda f: f.stride(0), [0, 1, 2, 3]),
        ([0, 1, 2, 3, 4, 5], lambda f: f.range("v", 1).stride(2), [1, 3, 5]),
        (TENS, lambda f: f.filter(lambda s: s % 20 == 0, "v"), [20, 40]),
        (TENS, lambda f: f.filter(F.col("v") > 25), [30, 40]),
    ],
)
def test_long_columns(spark, values, build, want):
    assert got(build(column(spark, values))) == want


@pytest.mark.parametrize(
    ("build", "want"),
    [
        (lambda f: f.eq("v", 20.0), [20.0]),
        (lambda f: f.is_some("v").eq("v", 20.0), [20.0]),
        (lambda f: f.is_none("v"), [None]),
        (lambda f: f.is_some("v"), [1.0, 20.0]),
        (lambda f: f.ne("v", 20.0), [1.0]),
        (lambda f: f.none_of("v", [20.0]), [1.0]),
        (lambda f: f.where(eq("v", 20.0) ^ is_none("v")), [None, 20.0]),
        (lambda f: f.where(is_some("v") | is_none("v")), [1.0, 20.0]),
        (lambda f: f.where(ne("v", 1.0) | range_("v", None, 2.0)), [1.0, 20.0]),
    ],
)
def test_optional_column(spark, build, want):
    assert got(build(column(spark, [1.0, None, 20.0], "double", True))) == want


def test_floats_by_bits(spark):
    f = column(spark, [1.5, float("nan"), 2.5], "double")
    found = got(f.one_of("v", [float("nan"), 2.5]))
    assert math.isnan(found[0]) and found[1:] == [2.5]
    assert got(f.range("v", 2.0)) == [2.5]
    assert got(f.range("v", None, 2.0)) == [1.5]
    z = column(spark, [0.0, -0.0, 1.0], "double")
    assert str(got(z.eq("v", 0.0))) == "[0.0]" and str(got(z.eq("v", -0.0))) == "[-0.0]"
    assert str(got(z.ne("v", 0.0))) == "[-0.0, 1.0]"
    assert str(got(z.one_of("v", [-0.0, 1.0]))) == "[-0.0, 1.0]"
    assert str(got(z.none_of("v", [-0.0]))) == "[0.0, 1.0]"


def test_floats_do_not_depend_on_the_operands_type(spark):
    f = column(spark, [1.5, float("nan"), 9.0, -0.0, 0.0], "double")
    assert got(f.range("v", 5)) == got(f.range("v", 5.0)) == [9.0]
    assert str(got(f.eq("v", 0))) == str(got(f.one_of("v", [0]))) == "[0.0]"
    assert str(got(f.ne("v", 0))) == "[1.5, nan, 9.0, -0.0]"
    assert str(got(f.none_of("v", [0, 9]))) == "[1.5, nan, -0.0]"
    many = [0, 9.0, float("nan"), *range(1000, 1600)]
    assert str(got(f.one_of_set("v", many))) == "[nan, 9.0, 0.0]" and str(got(f.none_of_set("v", many))) == "[1.5, -0.0]"
    assert got(f.range("v", float("nan"))) == got(f.range("v", None, float("nan"))) == []
    single = column(spark, [0.1, 0.2, float("nan")], "float")
    assert len(got(single.eq("v", 0.1))) == 1 and len(got(single.range("v", 0.1, 0.2))) == 1 and len(got(single.range("v", 0))) == 2


def test_handles_are_gated_by_type(spark):
    rows = spark.createDataFrame([(0, 3, "x", True, 1.0)], "__ord long, i int, s string, b boolean, d double")
    f = Frame(rows, "t", "__ord", dense=True)
    i, s, b, d = (f.column(x) for x in "isbd")
    wrong = [lambda: i.eq("3"), lambda: i.eq(3.5), lambda: i.eq(True), lambda: i.range(None, 3.5), lambda: i.one_of([3, "3"]), lambda: i.none_of([3.5]), lambda: s.eq(3), lambda: s.range(1), lambda: b.eq(1), lambda: d.eq("1"), lambda: d.ne(True)]
    wrong += [lambda: f.eq("i", 3.5), lambda: f.one_of("i", [3, 3.5]), lambda: f.range("i", None, "x"), lambda: f.one_of_set("i", [*range(600), "x"]), lambda: f.filter(lambda x: x > 1)]
    for call in wrong:
        with pytest.raises(TypeMismatch):
            call()
    assert f.where(i.eq(3) & s.eq("x") & b.mask() & d.eq(1)).df.count() == 1


def test_combinations_give_back_their_parts(spark):
    f = column(spark, TENS)
    both = f.column("v").range(20) & f.column("v").ne(30)
    assert got(f.where(both)) == [20, 40]
    assert [got(f.where(x)) for x in both.unpack()] == [[20, 30, 40], [10, 20, 40]]
    with pytest.raises(TypeMismatch):
        f.column("v").eq(1).unpack()
    assert [r.v for r in f.column("v").get(1, 3).frame.collect()] == [20, 30] and got(f.get(2)) == [30, 40] and got(f.get(3, 1)) == []


def test_joins_of_integers_of_different_widths(spark):
    left, right = column(spark, [1, 2, 300], "long"), column(spark, [2, 300], "short")
    assert got(left.semi_join("v", right, "v")) == [2, 300] and got(left.anti_join("v", right, "v")) == [1]
    assert got(left.semi_join("v", column(spark, [Decimal(300)], "decimal(20,0)"), "v")) == [300]
    with pytest.raises(TypeMismatch):
        left.semi_join("v", column(spark, ["2"], "string"), "v")
    with pytest.raises(NotFound):
        left.semi_join("v", right, "w")


@pytest.mark.parametrize("orders", [range(0, 900, 3), [1 << 40, 5, -7, 1 << 62, -(1 << 62), (1 << 40) + 1, 1 << 17, 3 << 33]])
@pytest.mark.parametrize("span", [None, 1 << 20])
def test_positions_of_a_sparse_order(spark, orders, span, monkeypatch):
    from marlstone.operators import frame as module

    monkeypatch.setattr(module, "LEAST_ROWS", 0)
    orders = [x for x in orders if span is None or 0 <= x < span]
    rows = spark.createDataFrame([(o, i) for i, o in enumerate(orders)], "__ord long, v long").repartition(3)
    want = [i for _, i in sorted((o, i) for i, o in enumerate(orders))]
    f = Frame(rows, "t", "__ord", span=span)
    assert got(f.skip(2)) == want[2:] and got(f.skip(1).take(4)) == want[1:5] and got(f.stride(3)) == want[::3] and got(f.limit(3).offset(2)) == want[2:5]
    assert {r.v: r["index"] for r in f.first_index(["v"]).collect()} == {v: i for i, v in enumerate(want)}


def test_positions_take_no_window_over_all_rows(spark):
    f = column(spark, list(range(50))).range("v", 3)
    plan = f.stride(2).df._jdf.queryExecution().toString()
    assert plan.count("Exchange SinglePartition") == 1  # of the ranges of ranges alone
    short = f.skip(5).take(3).df._jdf.queryExecution().toString()
    assert "Window" not in short and "Join" not in short


def test_rows_of_several_columns(spark):
    rows = spark.createDataFrame([(i, a, b, c) for i, (a, b, c) in enumerate(zip([1, 1, 2, 2, 3, 3], [4, 4, 5, 5, 6, 6], [7, 7, 8, 8, 9, 9]))], "__ord long, a int, b int, c int")
    f = Frame(rows, "t", "__ord", dense=True)
    a, b, c = (f.column(x) for x in "abc")
    assert f.where(a.eq(100) & b.any()).collect() == []
    assert [r.a for r in f.where(a.one_of([2, 3]) & (b.eq(5) | c.any())).collect()] == [2, 2, 3, 3]
    other = Frame(rows, "u", "__ord", dense=True)
    with pytest.raises(CrossSource):
        a.eq(1) & other.column("a").eq(1)
    with pytest.raises(CrossSource):
        f.where(other.column("a").eq(1))


def test_joins(spark):
    left, keys = column(spark, TENS), column(spark, [20, 40, 40])
    assert got(left.semi_join("v", keys, "v")) == [20, 40]
    assert got(left.anti_join("v", keys.column("v"))) == [10, 30]
    assert got(column(spark, [7] * 3).semi_join("v", column(spark, [99]), "v")) == []
    some = column(spark, [1, None, 3])
    assert got(some.anti_join("v", column(spark, [3]), "v")) == [1]
    opt = lambda x: Frame(column(spark, x).rows, "t", "__ord", dense=True, types={"v": Opt(item=Int("i64"))})
    assert got(opt([1, None, 3]).anti_join("v", opt([3, None]), "v")) == [1]
    assert got(opt([1, None, 3]).semi_join("v", opt([3, None]), "v")) == [None, 3]
    with pytest.raises(TypeMismatch):
        column(spark, [1.0], "double").semi_join("v", column(spark, [1.0], "double"), "v")
    right = Frame(spark.createDataFrame([(0, 20, "x"), (1, 20, "y")], "__ord long, k long, w string"), "r", "__ord")
    assert [tuple(r) for r in left.join(right, "v", "k").collect()] == [(20, 20, "x"), (20, 20, "y")]
    with pytest.raises(TypeMismatch):
        left.join(keys, "v", "v")


def test_terminals(spark):
    f = column(spark, [10, 20, 10, 30])
    assert {r[0] for r in f.distinct("v").collect()} == {10, 20, 30}
    assert [r[0] for r in f.sorted_set("v").collect()] == [10, 20, 30]
    assert {r[0]: r[1] for r in f.first_index(["v"]).collect()} == {10: 0, 20: 1, 30: 3}
    assert {r[0]: r[1] for r in f.ne("v", 20).first_index(["v"]).collect()} == {10: 0, 30: 2}
    with pytest.raises(IndexOverflow):
        f.first_index(["v"], bits=1)
    assert f.nth(3).v == 30 and f.nth(4) is None and list(r.v for r in f.iter()) == [10, 20, 10, 30]
    assert list(f.column("v").iter()) == [10, 20, 10, 30] and f.count() == 4 and f.limit(2).count() == 2
    outcomes = column(spark, [1.0, None, 20.0], "double", True).read(is_some("v") & eq("v", 20.0))
    assert [r.outcome for r in outcomes.collect()] == ["exclude", "absent", "include"]


def test_errors(spark):
    f = column(spark, [1])
    for call in (lambda: f.eq("w", 1), lambda: f.column("w"), lambda: f.select("w")):
        with pytest.raises(NotFound):
            call()
    for call in (lambda: f.eq("v", "x"), lambda: f.eq("v", True), lambda: f.column("v", "int")):
        with pytest.raises(TypeMismatch):
            call()
    assert f.column("v", "bigint").name == "v"


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id as __ord", "id as v", "id * 2 as w").write.parquet(path)
    f = Frame(spark.read.parquet(path), "t", "__ord", dense=True)
    plan = f.skip(10).range("v", 20, 30).select("v").df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(v,20)" in plan and "GreaterThanOrEqual(__ord,10)" in plan
    assert "w:bigint" not in plan.split("ReadSchema")[1]


def test_against_row_model(spark):
    rng = random.Random(5)
    for _ in range(6):
        values = [rng.choice([None, *range(6)]) for _ in range(rng.randint(0, 30))]
        frame, rows = column(spark, values), list(values)
        for _ in range(rng.randint(1, 4)):
            n, lo, hi = rng.randint(0, 6), rng.randint(0, 5), rng.randint(0, 6)
            step = rng.choice(["skip", "take", "stride", "range", "ne", "xor", "set"])
            if step == "skip":
                frame, rows = frame.skip(n), rows[n:]
            elif step == "take":
                frame, rows = frame.take(n), rows[:n]
            elif step == "stride":
                frame, rows = frame.stride(n), rows[:: max(1, n)]
            elif step == "range":
                frame, rows = frame.range("v", lo, hi), [x for x in rows if x is not None and lo <= x < hi]
            elif step == "ne":
                frame, rows = frame.ne("v", lo), [x for x in rows if x is not None and x != lo]
            elif step == "xor":
                frame = frame.where(range_("v", lo) ^ one_of("v", [0, hi]))
                rows = [x for x in rows if x is not None and (x >= lo) != (x in (0, hi))]
            else:
                frame, rows = frame.where(none_of("v", [lo, hi]) | is_none("v")), [x for x in rows if x is None or x not in (lo, hi)]
        assert got(frame) == rows
