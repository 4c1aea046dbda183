"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Annotated

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Collision, CrossSource
from ..functions import predicates as p
from ..operators.frame import Frame
from ..scratch import fresh_dir
from ..sources.archive import Archive, Binary
from ..sources.types import BOOL, CHAR, F32, F64, STRING, Int, NonZero, Opt, Seq
from ..streaming import follow

#: Keys that are the dense positions of their table's rows.
POSITIONS = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id"}
_FOUND: dict[str, tuple[Callable, str | None]] = {}


def frame(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    """A driver table; in key order where its key numbers its rows. The order of the others is not
    unique: no query here takes a window of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    order = POSITIONS.get(name)
    return Frame(df, name, order or df.columns[0], dense=order is not None)


def nullable_events(spark: SparkSession, sf_dir: str) -> Frame:
    """events with v, its value where it is no error, and k, its user where it is no click."""
    f = frame(spark, sf_dir, "events")
    rows = f.rows.select("event_id", "user_id", "event_type", "value", F.when(F.col("event_type") != "error", F.col("value")).alias("v"), F.when(F.col("event_type") != "click", F.col("user_id")).alias("k"))
    return Frame(rows, "events", "event_id", dense=True, types={"v": Opt(item=F64), "k": Opt(item=Int("i64"))})


_NULLABLE = "(SELECT event_id, user_id, event_type, value, CASE WHEN event_type <> 'error' THEN value END AS v, CASE WHEN event_type <> 'click' THEN user_id END AS k FROM events)"


def query(sql: str | None):
    def add(f: Callable) -> Callable:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


# -- filters


def _simple(name: str, table: str, columns: str, make: Callable[[Frame], Frame], where: str) -> None:
    names = [c.strip() for c in columns.split(",")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(frame(spark, sf_dir, table)).select(*names).df

    run.__name__ = name
    _FOUND[name] = (run, f"SELECT {columns} FROM {table} WHERE {where}")


_LINE = "l_orderkey, l_linenumber, l_quantity, l_extendedprice"
_simple("range_half_open", "lineitem", _LINE, lambda f: f.range("l_quantity", 10.0, 20.0), "l_quantity >= 10 AND l_quantity < 20")
_simple("range_inclusive", "lineitem", _LINE, lambda f: f.range("l_quantity", 10.0, 20.0, high_open=False), "l_quantity BETWEEN 10 AND 20")
_simple("range_open_below", "lineitem", _LINE, lambda f: f.range("l_quantity", 10.0, 20.0, low_open=True, high_open=False), "l_quantity > 10 AND l_quantity <= 20")
_simple("range_from", "lineitem", _LINE, lambda f: f.range("l_quantity", 45.0), "l_quantity >= 45")
_simple("range_to", "lineitem", _LINE, lambda f: f.range("l_quantity", None, 5.0), "l_quantity < 5")
_simple("range_unbounded", "part", "p_partkey, p_size", lambda f: f.range("p_size"), "p_size IS NOT NULL")
_simple("range_inverted", "part", "p_partkey, p_size", lambda f: f.range("p_size", 20, 10), "p_size >= 20 AND p_size < 10")
_simple("range_string", "part", "p_partkey, p_brand", lambda f: f.range("p_brand", "Brand#2", "Brand#4"), "p_brand >= 'Brand#2' AND p_brand < 'Brand#4'")
_simple("range_timestamp", "events", "event_id, event_type", lambda f: f.range("ts", "2024-01-05 00:00:00", "2024-01-10 00:00:00"), "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
_simple("eq_int", "orders", "o_orderkey, o_custkey, o_totalprice", lambda f: f.eq("o_custkey", 7), "o_custkey = 7")
_simple("eq_string", "lineitem", _LINE, lambda f: f.eq("l_returnflag", "R"), "l_returnflag = 'R'")
_simple("ne_string", "events", "event_id, event_type", lambda f: f.ne("event_type", "click"), "event_type <> 'click'")
_simple("one_of_int", "part", "p_partkey, p_size", lambda f: f.one_of("p_size", [1, 7, 42, 99]), "p_size IN (1, 7, 42, 99)")
_simple("one_of_sorted_string", "orders", "o_orderkey, o_orderpriority", lambda f: f.one_of_sorted("o_orderpriority", ["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_simple("one_of_set_large", "orders", "o_orderkey, o_custkey", lambda f: f.one_of_set("o_custkey", range(0, 30_000, 3)), "o_custkey IN (SELECT 3 * i FROM range(10000) t(i))")
_simple("one_of_set_joined", "orders", "o_orderkey, o_custkey", lambda f: f.one_of_set("o_custkey", range(0, 60_000, 5)), "o_custkey IN (SELECT 5 * i FROM range(12000) t(i))")
_simple("none_of_string", "events", "event_id, event_type", lambda f: f.none_of("event_type", ["click", "view"]), "event_type NOT IN ('click', 'view')")
_simple("none_of_sorted_string", "orders", "o_orderkey, o_orderpriority", lambda f: f.none_of_sorted("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')")
_simple("none_of_set_int", "part", "p_partkey, p_size", lambda f: f.none_of_set("p_size", range(1, 40)), "p_size NOT BETWEEN 1 AND 39")
_simple("filter_expression", "lineitem", _LINE, lambda f: f.filter(F.col("l_extendedprice") > 1000 * F.col("l_quantity")), "l_extendedprice > 1000 * l_quantity")
_simple("filter_function", "part", "p_partkey, p_size", lambda f: f.filter(lambda s: s % 7 == 3, "p_size"), "p_size % 7 = 3")
_simple("filter_chain", "lineitem", _LINE, lambda f: f.eq("l_returnflag", "A").range("l_quantity", 10.0, 30.0).ne("l_linestatus", "O"), "l_returnflag = 'A' AND l_quantity >= 10 AND l_quantity < 30 AND l_linestatus <> 'O'")


@query("SELECT l_orderkey, l_linenumber, d AS l_discount FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS d FROM lineitem) WHERE NOT isnan(d) AND d >= 0.05")
def range_without_nan(spark, sf_dir):
    f = frame(spark, sf_dir, "lineitem")
    rows = f.rows.withColumn("l_discount", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_discount")))
    return Frame(rows, "lineitem", f.order).range("l_discount", 0.05).select("l_orderkey", "l_linenumber", "l_discount").df


_ZERO = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN CAST('-0.0' AS DOUBLE) ELSE l_discount END AS d FROM lineitem)"


def _zeros(spark, sf_dir) -> Frame:
    rows = frame(spark, sf_dir, "lineitem").rows
    return Frame(rows.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.lit(-0.0)).otherwise(F.col("l_discount")).alias("d")), "lineitem", "l_orderkey")


@query(f"SELECT l_orderkey, l_linenumber FROM {_ZERO} WHERE d = 0 AND NOT signbit(d)")
def eq_float_signed_zero(spark, sf_dir):
    return _zeros(spark, sf_dir).eq("d", 0.0).select("l_orderkey", "l_linenumber").df


@query(f"SELECT l_orderkey, l_linenumber FROM {_ZERO} WHERE NOT (d = 0 AND signbit(d))")
def ne_float_negative_zero(spark, sf_dir):
    return _zeros(spark, sf_dir).ne("d", -0.0).select("l_orderkey", "l_linenumber").df


@query(f"SELECT l_orderkey, l_linenumber FROM {_ZERO} WHERE d = 0 AND NOT signbit(d)")
def eq_int_zero_on_double(spark, sf_dir):
    return _zeros(spark, sf_dir).eq("d", 0).select("l_orderkey", "l_linenumber").df


@query(f"SELECT l_orderkey, l_linenumber FROM {_ZERO} WHERE d = 0.05 OR d = 0 AND NOT signbit(d)")
def one_of_int_zero(spark, sf_dir):
    return _zeros(spark, sf_dir).one_of("d", [0, 0.05, 7]).select("l_orderkey", "l_linenumber").df


@query(f"SELECT l_orderkey, l_linenumber FROM {_ZERO} WHERE NOT (d = 0 AND NOT signbit(d)) AND d < 0.1")
def none_of_floats_joined(spark, sf_dir):
    return _zeros(spark, sf_dir).none_of_set("d", [0, *(0.1 + i for i in range(600))]).range("d", None, 0.1).select("l_orderkey", "l_linenumber").df


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS d FROM lineitem) WHERE NOT isnan(d) AND d >= 30")
def range_int_bound_nan(spark, sf_dir):
    f = frame(spark, sf_dir, "lineitem")
    rows = f.rows.withColumn("d", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity")))
    return Frame(rows, "lineitem", f.order).range("d", 30).select("l_orderkey", "l_linenumber").df


def _events(where: Callable[[Frame], Frame], sql: str, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return where(nullable_events(spark, sf_dir)).select("event_id", "event_type", "v").df

    run.__name__ = name
    _FOUND[name] = (run, f"SELECT event_id, event_type, v FROM {_NULLABLE} WHERE {sql}")


_P, _Q = "coalesce(v >= 50, false)", "coalesce(event_type = 'view', false)"


def _low() -> p.Predicate:
    return p.range_("v", 50.0)


def _view() -> p.Predicate:
    return p.eq("event_type", "view")


_events(lambda f: f.is_some("v"), "v IS NOT NULL", "is_some")
_events(lambda f: f.is_none("v"), "v IS NULL", "is_none")
_events(lambda f: f.ne("v", 50.0), "v <> 50", "ne_nullable")
_events(lambda f: f.none_of("k", [1, 2, 3]), "k IS NOT NULL AND k NOT IN (1, 2, 3)", "none_of_nullable")
_events(lambda f: f.mask("v"), "v IS NOT NULL", "mask_present")
_events(lambda f: f.where(_low() & _view()), f"{_P} AND {_Q}", "and_nullable")
_events(lambda f: f.where(_low() | _view()), f"{_P} OR {_Q}", "or_nullable")
_events(lambda f: f.where(_low() ^ _view()), f"{_P} <> {_Q}", "xor_nullable")
_events(lambda f: f.where((_low() | _view()) & p.ne("event_type", "click")), f"({_P} OR {_Q}) AND event_type <> 'click'", "nested_or_and")
_events(lambda f: f.where((_low() ^ _view()) | p.eq("k", 5)), f"({_P} <> {_Q}) OR coalesce(k = 5, false)", "nested_xor_or")
_events(lambda f: f.where(p.is_some("k") | _view()), "k IS NOT NULL", "is_some_inside_or")


@query(f"SELECT event_id, event_type FROM {_NULLABLE} WHERE v >= 50")
def unpacked_part(spark, sf_dir):
    f = nullable_events(spark, sf_dir)
    both = f.column("v").range(50) & f.column("event_type").eq("view")
    return f.where(both.unpack()[0]).select("event_id", "event_type").df


@query("SELECT count(*) > 0 AS refused FROM events")
def cross_source_refused(spark, sf_dir):
    events, orders = frame(spark, sf_dir, "events"), frame(spark, sf_dir, "orders")
    try:
        events.column("event_type").eq("view") & orders.column("o_custkey").eq(7)
    except CrossSource:
        return events.rows.agg((F.count("*") > 0).alias("refused"))
    raise AssertionError("predicates of two sources were combined")


@query(f"SELECT event_id, CASE WHEN k IS NULL THEN 'absent' WHEN coalesce(v >= 50, false) THEN 'include' ELSE 'exclude' END AS outcome FROM {_NULLABLE}")
def read_outcomes(spark, sf_dir):
    return nullable_events(spark, sf_dir).select("event_id").read(p.range_("v", 50.0) & p.is_some("k"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25")
def mask_boolean(spark, sf_dir):
    rows = frame(spark, sf_dir, "lineitem").rows.withColumn("big", F.col("l_quantity") > 25)
    return Frame(rows, "lineitem", "l_orderkey").mask("big").select("l_orderkey", "l_linenumber").df


# -- windows


_RANKED = "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE event_type = 'view')"


def _window(name: str, make: Callable[[Frame], Frame], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(frame(spark, sf_dir, "events")).select("event_id", "event_type").df

    run.__name__ = name
    _FOUND[name] = (run, f"SELECT event_id, event_type FROM {sql}")


_view_only = lambda f: f.eq("event_type", "view")
_window("skip_then_filter", lambda f: _view_only(f.skip(100)), "events WHERE event_id >= 100 AND event_type = 'view'")
_window("take_then_filter", lambda f: _view_only(f.take(500)), "events WHERE event_id < 500 AND event_type = 'view'")
_window("filter_then_skip", lambda f: _view_only(f).skip(100), f"{_RANKED} WHERE pos >= 100")
_window("filter_then_take", lambda f: _view_only(f).take(100), f"{_RANKED} WHERE pos < 100")
_window("filter_skip_take", lambda f: _view_only(f).skip(50).take(25), f"{_RANKED} WHERE pos >= 50 AND pos < 75")
_window("skip_twice", lambda f: f.skip(20).skip(40), "events WHERE event_id >= 60")
_window("get_range", lambda f: f.get(40, 90), "events WHERE event_id >= 40 AND event_id < 90")
_window("filter_get_range", lambda f: _view_only(f).get(30, 60), f"{_RANKED} WHERE pos >= 30 AND pos < 60")
_window("filter_skip_stride", lambda f: _view_only(f).skip(10).stride(3), f"{_RANKED} WHERE pos >= 10 AND (pos - 10) % 3 = 0")
_window("skip_take_stride", lambda f: f.skip(100).take(400).stride(7), "events WHERE event_id >= 100 AND event_id < 500 AND (event_id - 100) % 7 = 0")
_window("limit_offset", lambda f: _view_only(f.limit(100).offset(50)), f"{_RANKED} WHERE pos >= 50 AND pos < 150")
_window("nth", lambda f: f.nth_frame(42), "events WHERE event_id = 42")
_window("filter_nth", lambda f: _view_only(f).nth_frame(42), f"{_RANKED} WHERE pos = 42")
_window("stride", lambda f: f.stride(7), "events WHERE event_id % 7 = 0")
_window("filter_stride", lambda f: _view_only(f).stride(7), f"{_RANKED} WHERE pos % 7 = 0")
_window("stride_zero", lambda f: _view_only(f).stride(0), f"{_RANKED}")


# -- joins


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join(spark, sf_dir):
    building = frame(spark, sf_dir, "customer").eq("c_mktsegment", "BUILDING").column("c_custkey")
    return frame(spark, sf_dir, "orders").semi_join("o_custkey", building).select("o_orderkey", "o_custkey").df


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_join(spark, sf_dir):
    building = frame(spark, sf_dir, "customer").eq("c_mktsegment", "BUILDING")
    return frame(spark, sf_dir, "orders").anti_join("o_custkey", building, "c_custkey").select("o_orderkey", "o_custkey").df


@query(f"SELECT event_id, k FROM {_NULLABLE} e WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.k AND c.c_nationkey < 12)")
def anti_join_nullable(spark, sf_dir):
    keys = frame(spark, sf_dir, "customer").range("c_nationkey", None, 12)
    return nullable_events(spark, sf_dir).anti_join("k", keys, "c_custkey").select("event_id", "k").df


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def semi_join_of_widths(spark, sf_dir):
    poor = frame(spark, sf_dir, "customer").range("c_acctbal", None, 0)  # an int against a bigint
    return frame(spark, sf_dir, "events").semi_join("user_id", poor, "c_nationkey").select("event_id", "user_id").df


def _optional_keys(spark, sf_dir) -> Frame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("ck"))
    return Frame(rows, "customer", "c_custkey", dense=True, types={"ck": Opt(item=Int("i64"))})


_OPT_KEYS = "(SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS ck FROM customer)"


@query(f"SELECT event_id, k FROM {_NULLABLE} e WHERE EXISTS (SELECT 1 FROM {_OPT_KEYS} c WHERE c.ck IS NOT DISTINCT FROM e.k)")
def semi_join_none_matches_none(spark, sf_dir):
    return nullable_events(spark, sf_dir).semi_join("k", _optional_keys(spark, sf_dir), "ck").select("event_id", "k").df


@query(f"SELECT event_id, k FROM {_NULLABLE} e WHERE NOT EXISTS (SELECT 1 FROM {_OPT_KEYS} c WHERE c.ck IS NOT DISTINCT FROM e.k)")
def anti_join_none_matches_none(spark, sf_dir):
    return nullable_events(spark, sf_dir).anti_join("k", _optional_keys(spark, sf_dir), "ck").select("event_id", "k").df


@query("SELECT o_orderkey, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 100000 AND c_acctbal < 0")
def inner_join(spark, sf_dir):
    orders = frame(spark, sf_dir, "orders").range("o_totalprice", 100000.0)
    customers = frame(spark, sf_dir, "customer").range("c_acctbal", None, 0.0)
    return orders.join(customers, "o_custkey", "c_custkey").select("o_orderkey", "o_totalprice", "c_custkey", "c_name").df


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def join_composition(spark, sf_dir):
    nations = frame(spark, sf_dir, "nation").join(frame(spark, sf_dir, "region"), "n_regionkey", "r_regionkey").eq("r_name", "ASIA")
    customers = frame(spark, sf_dir, "customer").join(nations, "c_nationkey", "n_nationkey")
    return frame(spark, sf_dir, "orders").join(customers, "o_custkey", "c_custkey").select("o_orderkey", "c_name", "n_name", "r_name").df


# -- terminals


@query("SELECT DISTINCT event_type FROM events")
def distinct_column(spark, sf_dir):
    return frame(spark, sf_dir, "events").column("event_type").distinct()


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error'")
def sorted_distinct(spark, sf_dir):
    return frame(spark, sf_dir, "events").eq("event_type", "error").sorted_set("user_id")


@query('SELECT user_id, min(event_id) AS "index" FROM events GROUP BY user_id')
def first_index(spark, sf_dir):
    return frame(spark, sf_dir, "events").first_index(["user_id"], bits=32)


@query("""SELECT event_type, CAST(min(pos) AS BIGINT) AS "index" FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE user_id < 50) GROUP BY event_type""")
def first_index_filtered(spark, sf_dir):
    return frame(spark, sf_dir, "events").range("user_id", None, 50).first_index(["event_type"])


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem").rows.agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name FROM region")
def collect_rows(spark, sf_dir):
    found = frame(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return spark.createDataFrame(found.collect(), found.df.schema)


@query("SELECT vec_id, embedding FROM embeddings")
def array_project(spark, sf_dir):
    return frame(spark, sf_dir, "embeddings").select("vec_id", "embedding").df


@query("SELECT event_id, user_id, event_type FROM events")
def iter_composite(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", "user_id", "event_type").ordered


# -- archives


_EVENT = {"event_id": Int("i64"), "user_id": Int("i64"), "event_type": STRING, "value": Opt(item=F64)}


def _event_archive(spark: SparkSession, sf_dir: str) -> Archive:
    """An archive with events in two segments."""
    archive = Archive.new(spark, fresh_dir(spark, "archive"))
    archive.schema("events", _EVENT)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(*_EVENT)
    half = rows.count() // 2
    archive.write_frame("events", rows.where(F.col("event_id") < half), ["event_id"])
    archive.write_frame("events", rows.where(F.col("event_id") >= half), ["event_id"])
    return archive


@query("SELECT event_id, user_id, event_type, value FROM events")
def multi_segment_roundtrip(spark, sf_dir):
    return Archive.open(spark, _event_archive(spark, sf_dir).path).query("events").df


@query('SELECT event_id, event_id AS "position" FROM events')
def archive_ordinals(spark, sf_dir):
    f = _event_archive(spark, sf_dir).query("events")
    return f.df_with_order.select("event_id", F.col(f.order).alias("position"))


@query("SELECT event_id, value FROM events WHERE event_id >= 2990 AND event_id < 3020 AND value >= 10")
def archive_window_filter(spark, sf_dir):
    return _event_archive(spark, sf_dir).query("events").skip(2990).take(30).range("value", 10.0).select("event_id", "value").df


@query("SELECT count(*) AS n FROM events")
def archive_count(spark, sf_dir):
    return spark.createDataFrame([(_event_archive(spark, sf_dir).count("events"),)], "n long")


@query("SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id < 160")
def archive_range_pruned(spark, sf_dir):
    return _event_archive(spark, sf_dir).query("events").range("event_id", 100, 160).select("event_id", "value").df


@query("SELECT event_id, user_id, event_type, value FROM events")
def follow_archive(spark, sf_dir):
    archive, out = _event_archive(spark, sf_dir), fresh_dir(spark, "followed")
    stream = follow(archive, "events").writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_dir(spark, "offsets"))
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(*_EVENT)


@query("SELECT 'names' AS name, CAST(length(string_agg(r_name, ' ')) AS BIGINT) AS n, string_agg(r_name, ' ' ORDER BY r_regionkey) AS content FROM region")
def binary_roundtrip(spark, sf_dir):
    archive = Archive.new(spark, fresh_dir(spark, "binaries"))
    names = [r.r_name for r in frame(spark, sf_dir, "region").select("r_name").collect()]  # five regions
    binary = Binary("names")
    for i, name in enumerate(names):
        binary.push((" " * (i > 0) + name).encode())
    n = archive.write(binary)
    return spark.createDataFrame([("names", n, Archive.open(spark, archive.path).binary("names").decode())], "name string, n long, content string")


def _customers(spark, sf_dir) -> tuple[Archive, DataFrame]:
    archive = Archive.new(spark, fresh_dir(spark, "customers"))
    archive.schema("customers", {"c_custkey": Int("i64"), "c_name": STRING, "c_nationkey": Int("i32")})
    return archive, spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey < 12")
def two_writers(spark, sf_dir):
    """Of two writers that start from one manifest the second loses, and leaves nothing behind."""
    first, rows = _customers(spark, sf_dir)
    second = Archive.open(spark, first.path)
    first.write_frame("customers", rows.where("c_nationkey < 12"), ["c_custkey"])
    try:
        second.write_frame("customers", rows.where("c_nationkey >= 12"), ["c_custkey"])
    except Collision:
        return Archive.open(spark, first.path).query("customers").df
    raise AssertionError("both writers published")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def rebuild_recovers(spark, sf_dir):
    archive, rows = _customers(spark, sf_dir)
    archive.write_frame("customers", rows.where("c_nationkey < 12"), ["c_custkey"])
    archive.write_frame("customers", rows.where("c_nationkey >= 12"), ["c_custkey"])
    archive._save(f"manifest/{archive._number:08d}.json", "damaged")
    return Archive.rebuild(spark, archive.path).query("customers").df


@query("SELECT * FROM (VALUES ('owner', 'x'), ('unit', 'kelvin')) t(name, content)")
def properties_roundtrip(spark, sf_dir):
    archive = Archive.new(spark, fresh_dir(spark, "properties"))
    archive.set_properties(owner="y", unit="kelvin")
    archive.set_properties(owner="x")
    return spark.createDataFrame(sorted(Archive.open(spark, archive.path).properties().items()), "name string, content string")


@dataclass
class Nation:
    n_nationkey: Annotated[int, Int("u16")]
    n_name: str
    n_regionkey: Annotated[int, Int("u8")]
    near: bool
    codes: list[int]
    note: str | None


@query("SELECT n_nationkey, n_name, n_regionkey, n_regionkey < 2 AS near, [CAST(n_nationkey AS BIGINT), n_regionkey] AS codes, CASE WHEN n_regionkey > 0 THEN n_name END AS note FROM nation")
def records_roundtrip(spark, sf_dir):
    """Records pushed one by one and read back as records: 25 nations."""
    archive = Archive.new(spark, fresh_dir(spark, "records"))
    stage = archive.schema("nations", Nation)
    for r in frame(spark, sf_dir, "nation").collect():
        stage.push(Nation(r.n_nationkey, r.n_name, r.n_regionkey, r.n_regionkey < 2, [r.n_nationkey, r.n_regionkey], r.n_name if r.n_regionkey else None))
    archive.write(stage)
    found = [tuple(vars(x).values()) for x in Archive.open(spark, archive.path).query("nations").records(Nation)]
    return spark.createDataFrame(found, "n_nationkey int, n_name string, n_regionkey int, near boolean, codes array<bigint>, note string")


_TYPES = {"key": NonZero("i64"), "wide": Int("i128"), "unsigned": Opt(item=Int("u64")), "larger": Opt(item=Int("u128")), "single": F32, "letter": CHAR, "flag": BOOL, "sizes": Seq(item=Int("u8")), "maybe": Opt(item=Opt(item=Seq(item=STRING)))}


@query("""
SELECT p_partkey + 1 AS key, CAST(CAST(p_partkey - 1000 AS HUGEINT) * 10000000000000000000 * 1000000000000 AS VARCHAR) AS wide, CAST(CAST(p_partkey AS HUGEINT) + 18446744073709000000 AS VARCHAR) AS unsigned,
       CAST(CAST(p_size * 0.5 AS FLOAT) AS DOUBLE) AS single, substr(p_name, 1, 1) AS letter, p_size > 25 AS flag, CAST(p_size + p_size + 1 AS BIGINT) AS sizes, CASE WHEN p_size % 3 <> 0 THEN p_brand || p_type END AS maybe FROM part
""")
def archive_types(spark, sf_dir):
    """Values of all types; of ``unsigned``, what 64 bits do not hold is ``larger`` in the archive."""
    archive = Archive.new(spark, fresh_dir(spark, "types"))
    archive.schema("t", _TYPES)
    size, unsigned = F.col("p_size"), F.expr("p_partkey + cast('18446744073709000000' as decimal(20,0))")
    over = unsigned > F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    made = {
        "key": F.col("p_partkey") + 1,
        "wide": F.expr("cast(cast(p_partkey - 1000 as decimal(20,0)) * cast('10000000000000000000' as decimal(20,0)) as decimal(26,0)) * cast(1000000000000 as decimal(13,0))").cast("decimal(38,0)"),
        "unsigned": F.when(~over, unsigned.cast("decimal(20,0)")),
        "larger": F.when(over, unsigned.cast("decimal(38,0)")),
        "single": (size * 0.5).cast("float"),
        "letter": F.substring("p_name", 1, 1),
        "flag": size > 25,
        "sizes": F.array(size.cast("short"), (size + 1).cast("short")),
        "maybe": F.when(size % 3 != 0, F.array("p_brand", "p_type")),
    }
    archive.write_frame("t", spark.read.parquet(f"{sf_dir}/part.parquet").select(*[c.alias(k) for k, c in made.items()]))
    found = archive.query("t").df
    text = {"wide": F.col("wide").cast("string"), "unsigned": F.coalesce("unsigned", "larger").cast("string"), "single": F.col("single").cast("double"), "maybe": F.array_join("maybe", "")}
    return found.withColumns(text | {"sizes": F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)}).drop("larger")


@query("""
WITH known AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0),
have AS (SELECT event_type, user_id, min(pos) AS i FROM known GROUP BY ALL),
fresh AS (SELECT event_type, user_id, (SELECT count(*) FROM known) + row_number() OVER (ORDER BY min(event_id)) - 1 AS i
  FROM events r WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.event_type = r.event_type AND h.user_id = r.user_id) GROUP BY event_type, user_id)
SELECT event_id, CAST(coalesce(h.i, f.i) AS BIGINT) AS "index" FROM events LEFT JOIN have h USING (event_type, user_id) LEFT JOIN fresh f USING (event_type, user_id)
""")
def get_or_insert_indices(spark, sf_dir):
    """A dictionary of what users with even numbers clicked and viewed meets all events."""
    archive = Archive.new(spark, fresh_dir(spark, "dictionary"))
    archive.schema("words", {"event_type": STRING, "user_id": Int("i64")})
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id")
    known = rows.where(F.col("event_type").isin("click", "view") & (F.col("user_id") % 2 == 0))
    archive.write_frame("words", known.repartitionByRange("event_id").sortWithinPartitions("event_id").select("event_type", "user_id"))
    return archive.get_or_insert("words", rows, "event_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FOUND["range_inclusive"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}
