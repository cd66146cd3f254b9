"""Queries over streams and tables: windows, joins, aggregates, window functions, set operations, user-defined functions, SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as S

from millrace import functions as F
from millrace.context import Context
from millrace.expr import WindowFrame, col, lit
from millrace.frame import DataFrame as Frame
from millrace.plans.tables import table
from millrace.session import SessionContext
from millrace.sources.timeunits import MILLIS, TIMESTAMP
from millrace.stream import DataStream
from millrace.udf import Accumulator, udaf, udf

Query = Callable[[SparkSession, str], DataFrame]
DAY, HOUR = 86_400_000, 3_600_000
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def keeper(queries: dict[str, Query], sqls: dict[str, str]):
    """A decorator, which takes the SQL of a query, that enters both under the function's name."""

    def query(sql: str | None = None):
        def keep(f: Query) -> Query:
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = sql
            return f

        return keep

    return query


query = keeper(QUERIES, SQL)


def events(spark: SparkSession, d: str) -> DataStream:
    return Context(spark).from_table(table(spark, d, "events"), "ts", TIMESTAMP)


def measured(spark: SparkSession, d: str, topic: str | None = None) -> DataStream:
    t = table(spark, d, "measurements").filter((S.col("occurred_at_ms") >= 10**12) & S.col("sensor_name").isNotNull() & ~S.isnan("reading"))
    return Context(spark).from_table(t.filter(S.col("topic") == topic) if topic else t, "occurred_at_ms", MILLIS)


def plain(s: DataStream) -> DataFrame:
    """Without hidden columns; timestamps without a zone, as the tables have them."""
    df = s.visible
    return df.select(*[S.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else S.col(c) for c, k in df.dtypes])


def frame(spark: SparkSession, d: str, name: str) -> Frame:
    return Frame(table(spark, d, name))


def r6(e, name: str):
    return F.round(e, 6).alias(name)


# windows

_W = "make_timestamp((epoch_ms({ts}) // {n}) * {n} * 1000)"
_DAYW = _W.format(ts="ts", n=DAY)
_END = "+ INTERVAL 1 DAY"


@query(f"SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, {_DAYW} AS window_start_time, {_DAYW} {_END} AS window_end_time FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    aggs = [F.count(col("value")).alias("n"), F.min(col("value")).alias("lo"), F.max(col("value")).alias("hi"), F.avg(col("value")).alias("mean")]
    return plain(events(spark, d).window([col("event_type")], aggs, DAY).with_column("mean", F.round(col("mean"), 6)))


@query(f"SELECT * FROM (SELECT event_type, count(*) AS n, {_DAYW} AS window_start_time, {_DAYW} {_END} AS window_end_time FROM events GROUP BY ALL) WHERE window_end_time <= (SELECT max(ts) FROM events)")
def window_tumbling_closed(spark, d):
    return plain(events(spark, d).window(["event_type"], [F.count_star().alias("n")], DAY, closed_only=True))


@query(f"""SELECT event_type, count(*) AS n, max(value) AS hi, s AS window_start_time, s {_END} AS window_end_time
FROM (SELECT *, make_timestamp(((epoch_ms(ts) // 43200000) - i) * 43200000 * 1000) AS s FROM events, generate_series(0, 1) AS g(i)) GROUP BY ALL""")
def window_sliding(spark, d):
    return plain(events(spark, d).window(["event_type"], [F.count_star().alias("n"), F.max(col("value")).alias("hi")], DAY, 12 * HOUR))


@query(f"SELECT count(*) AS n, round(sum(value), 4) AS total, {_W.format(ts='ts', n=HOUR)} AS window_start_time, {_W.format(ts='ts', n=HOUR)} + INTERVAL 1 HOUR AS window_end_time FROM events GROUP BY ALL")
def window_global(spark, d):
    return plain(events(spark, d).window([], [F.count_star().alias("n"), F.sum(col("value")).alias("total")], HOUR).with_column("total", F.round(col("total"), 4)))


@query(f"SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, count(*) AS n, {_DAYW} AS window_start_time, {_DAYW} {_END} AS window_end_time FROM events GROUP BY ALL")
def window_agg_filter(spark, d):
    return plain(events(spark, d).window(["event_type"], [F.count(col("value"), filter=col("value") > 50).alias("big"), F.count_star().alias("n")], DAY))


@query(f"SELECT event_type, count(DISTINCT user_id) AS users, {_DAYW} AS window_start_time, {_DAYW} {_END} AS window_end_time FROM events GROUP BY ALL")
def window_distinct(spark, d):
    return plain(events(spark, d).window(["event_type"], [F.count(col("user_id"), distinct=True).alias("users")], DAY))


@query(f"SELECT event_type, round(median(value), 6) AS med, round(stddev_samp(value), 6) AS sd, {_DAYW} AS window_start_time, {_DAYW} {_END} AS window_end_time FROM events GROUP BY ALL")
def window_stats(spark, d):
    w = events(spark, d).window(["event_type"], [F.median(col("value")).alias("med"), F.stddev(col("value")).alias("sd")], DAY)
    return plain(w.with_column("med", F.round(col("med"), 6)).with_column("sd", F.round(col("sd"), 6)))


@query(f"SELECT * FROM (SELECT event_type, max(value) AS hi, {_DAYW} AS window_start_time, {_DAYW} {_END} AS window_end_time FROM events GROUP BY ALL) WHERE hi > 120")
def window_having(spark, d):
    return plain(events(spark, d).window(["event_type"], [F.max(col("value")).alias("hi")], DAY).filter(col("hi") > 120))


_SENSOR = """{t} AS (SELECT lower(trim(sensor_name, ' ')) AS sensor_name, make_timestamp((occurred_at_ms // 3600000) * 3600000000) AS s, max(reading) AS {v}
FROM measurements WHERE topic = '{t}' AND occurred_at_ms >= 1000000000000 AND sensor_name IS NOT NULL AND NOT isnan(reading) AND reading BETWEEN -100 AND 200 GROUP BY ALL)"""


def _hourly(spark: SparkSession, d: str, topic: str, name: str) -> DataStream:
    s = measured(spark, d, topic).filter(col("reading").between(-100, 200)).with_column("sensor_name", F.lower(F.trim(col("sensor_name"))))
    return s.window(["sensor_name"], [F.max(col("reading")).alias(name)], HOUR)


@query(f"""WITH {_SENSOR.format(t="temperature", v="temperature_max")}, {_SENSOR.format(t="humidity", v="humidity_max")}
SELECT a.sensor_name, temperature_max, humidity_max, a.s AS window_start_time FROM temperature a JOIN humidity b ON a.sensor_name = b.sensor_name AND a.s = b.s""")
def window_join(spark, d):
    h = _hourly(spark, d, "humidity", "humidity_max").with_column_renamed("sensor_name", "humidity_sensor").with_column_renamed("window_start_time", "humidity_start").with_column_renamed("window_end_time", "humidity_end")
    t = _hourly(spark, d, "temperature", "temperature_max")
    j = t.join(h, "inner", ["sensor_name", "window_start_time", "window_end_time"], ["humidity_sensor", "humidity_start", "humidity_end"])
    return plain(j.select(["sensor_name", "temperature_max", "humidity_max", "window_start_time"]))


@query("""SELECT driver_id, max(imu_measurement.gps.speed) AS max_speed, min(imu_measurement.gps.altitude) AS min_altitude, count(imu_measurement) AS n, s AS window_start_time
FROM (SELECT *, make_timestamp(((occurred_at_ms // 3600000) - i) * 3600000000) AS s FROM driver_imu, generate_series(0, 3) AS g(i) WHERE occurred_at_ms IS NOT NULL) GROUP BY driver_id, s""")
def window_nested_fields(spark, d):
    s = Context(spark).from_table(table(spark, d, "driver_imu"), "occurred_at_ms", MILLIS)
    gps = col("imu_measurement").field("gps")
    aggs = [F.max(gps.field("speed")).alias("max_speed"), F.min(gps.field("altitude")).alias("min_altitude"), F.count(col("imu_measurement")).alias("n")]
    return plain(s.window(["driver_id"], aggs, 4 * HOUR, HOUR).drop_columns(["window_end_time"]))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS b, event_id FROM events),
k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, count(*) AS n, min(ts) AS window_start_time, max(ts) + INTERVAL 6 HOUR AS window_end_time FROM (SELECT user_id, k, date_trunc('millisecond', ts) AS ts FROM k) GROUP BY user_id, k""")
def window_session(spark, d):
    return plain(events(spark, d).session_window(["user_id"], [F.count_star().alias("n")], 6 * HOUR))


@query(f"""SELECT count(*) AS n, CAST(sum(c) AS BIGINT) AS total, w AS window_start_time FROM (SELECT event_type, count(*) AS c, {_W.format(ts="ts", n=HOUR)} AS s, make_timestamp((epoch_ms(s) // {DAY}) * {DAY} * 1000) AS w FROM events GROUP BY ALL) GROUP BY w""")
def window_over_window(spark, d):
    hours = events(spark, d).window(["event_type"], [F.count_star().alias("c")], HOUR)
    return plain(hours.window([], [F.count_star().alias("n"), F.sum(col("c")).alias("total")], DAY).drop_columns(["window_end_time"]))


# rows


@query("SELECT event_id, user_id, value * 2 + 1 AS twice, upper(event_type) AS kind FROM events WHERE value > 40 AND event_type <> 'error'")
def scan_project_filter(spark, d):
    s = events(spark, d).filter((col("value") > 40) & (col("event_type") != "error")).with_column("twice", col("value") * 2 + 1)
    return s.select([col("event_id"), col("user_id"), col("twice"), F.upper(col("event_type")).alias("kind")]).visible


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    from millrace.sources.kafka import TopicReader
    from millrace.sources.schemas import from_json_sample

    reader = TopicReader("props", from_json_sample('{"k": 1}'), "json")
    t = table(spark, d, "events").select("event_id", S.col("props").cast("binary").alias("value"), S.col("ts").cast("timestamp").alias("timestamp"))
    parsed = t.select("event_id", S.from_json(S.col("value").cast("string"), reader.schema).alias("p"))
    return parsed.select("event_id", "p.k")


# joins


def _orders(spark, d):
    return frame(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").filter(col("o_totalprice") > 100000)


def _customers(spark, d):
    return frame(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").filter(col("c_acctbal") > 0)


_O, _C = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000)", "(SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0)"


def _join(how: str, kind: str):
    cols = "o_orderkey, o_totalprice" if how in ("semi", "anti") else "o_orderkey, o_totalprice, c_custkey, c_name"

    def f(spark, d):
        return _orders(spark, d).join(_customers(spark, d), (["o_custkey"], ["c_custkey"]), how).select(*cols.split(", ")).df

    f.__name__ = f"join_{how}"
    query(f"SELECT {cols} FROM {_O} {kind} JOIN {_C} ON o_custkey = c_custkey")(f)


for _how, _kind in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("semi", "SEMI"), ("anti", "ANTI")):
    _join(_how, _kind)


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 100")
def join_on_theta(spark, d):
    s = DataStream(table(spark, d, "supplier"))
    return s.join_on(table(spark, d, "nation"), "inner", [col("s_nationkey") == col("n_nationkey"), col("s_acctbal") > col("n_nationkey") * 100]).select(["s_suppkey", "n_name"]).visible


@query("SELECT event_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 5000")
def join_stream_table(spark, d):
    j = events(spark, d).join(frame(spark, d, "customer"), "left", ["user_id"], ["c_custkey"], filter=col("c_acctbal") > 5000)
    return j.select(["event_id", "c_name"]).visible


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, d):
    return frame(spark, d, "region").cross_join(frame(spark, d, "nation")).select("r_name", "n_name").df


# aggregates


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 6) AS avg_disc,
round(avg(l_quantity), 6) AS mean_qty, min(l_tax) AS lo, max(l_tax) AS hi, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def agg_basic(spark, d):
    q, x = col("l_quantity"), col("l_extendedprice") * (1 - col("l_discount"))
    t = frame(spark, d, "lineitem").filter(S.col("l_shipdate") <= S.lit("1998-09-02").cast("timestamp_ntz"))
    t = t.aggregate(
        ["l_returnflag", "l_linestatus"],
        [F.sum(q).alias("sum_qty"), F.sum(x).alias("revenue"), F.avg(col("l_discount")).alias("avg_disc"), F.mean(q).alias("mean_qty"), F.min(col("l_tax")).alias("lo"), F.max(col("l_tax")).alias("hi"), F.count_star().alias("n"), F.count(col("l_suppkey"), distinct=True).alias("suppliers")],
    )
    return t.select("l_returnflag", "l_linestatus", F.round(col("sum_qty"), 2).alias("sum_qty"), F.round(col("revenue"), 4).alias("revenue"), r6(col("avg_disc"), "avg_disc"), r6(col("mean_qty"), "mean_qty"), "lo", "hi", "n", "suppliers").df


_STATS = {"stddev": "stddev_samp", "stddev_pop": "stddev_pop", "stddev_samp": "stddev_samp", "var": "var_samp", "var_pop": "var_pop", "var_samp": "var_samp", "var_sample": "var_samp", "median": "median"}
_TWO = {"corr": "corr", "covar": "covar_samp", "covar_pop": "covar_pop", "covar_samp": "covar_samp"}


@query("SELECT l_returnflag, " + ", ".join(f"round({v}(l_discount), 6) AS a_{k}" for k, v in _STATS.items()) + ", " + ", ".join(f"round({v}(l_quantity, l_discount), 6) AS a_{k}" for k, v in _TWO.items()) + ", round(median(DISTINCT l_quantity), 6) AS median_distinct FROM lineitem GROUP BY ALL")
def agg_stats(spark, d):
    one = [getattr(F, k)(col("l_discount")).alias(f"a_{k}") for k in _STATS]
    two = [getattr(F, k)(col("l_quantity"), col("l_discount")).alias(f"a_{k}") for k in _TWO]
    t = frame(spark, d, "lineitem").aggregate("l_returnflag", [*one, *two, F.median(col("l_quantity"), distinct=True).alias("median_distinct")])
    return t.select("l_returnflag", *[r6(col(c), c) for c in t.df.columns[1:]]).df


_REGR = ("regr_avgx", "regr_avgy", "regr_count", "regr_intercept", "regr_r2", "regr_slope", "regr_sxx", "regr_sxy", "regr_syy")


@query("SELECT l_returnflag, " + ", ".join(f"round(CAST({k}(l_quantity, l_tax) AS DOUBLE), 4) AS {k}" for k in _REGR) + " FROM lineitem GROUP BY ALL")
def agg_regr(spark, d):
    t = frame(spark, d, "lineitem").aggregate("l_returnflag", [getattr(F, k)(col("l_quantity"), col("l_tax")).alias(k) for k in _REGR])
    return t.select("l_returnflag", *[F.round(col(k).cast(float), 4).alias(k) for k in _REGR]).df


@query("""SELECT l_returnflag, bit_and(l_orderkey) AS ba, bit_or(l_orderkey) AS bo, bit_xor(l_orderkey) AS bx, bit_xor(DISTINCT l_linenumber)::BIGINT AS bxd, bool_and(l_quantity > 1) AS all_, bool_or(l_quantity > 49) AS any_ FROM lineitem GROUP BY ALL""")
def agg_bits_bools(spark, d):
    k = col("l_orderkey")
    aggs = [F.bit_and(k).alias("ba"), F.bit_or(k).alias("bo"), F.bit_xor(k).alias("bx"), F.bit_xor(col("l_linenumber"), distinct=True).alias("bxd"), F.bool_and(col("l_quantity") > 1).alias("all_"), F.bool_or(col("l_quantity") > 49).alias("any_")]
    return frame(spark, d, "lineitem").aggregate("l_returnflag", aggs).df


@query("""SELECT c_nationkey, first(c_name ORDER BY c_acctbal DESC, c_custkey) AS first_, last(c_name ORDER BY c_acctbal DESC, c_custkey) AS last_, list(c_custkey ORDER BY c_acctbal DESC, c_custkey)[2] AS second_,
array_to_string(list(c_custkey ORDER BY c_custkey DESC), ',') AS keys, string_agg(c_mktsegment, '|' ORDER BY c_custkey) AS segments, len(list(DISTINCT c_mktsegment)) AS n_segments, min(c_custkey) FILTER (WHERE c_acctbal < 0) AS first_poor FROM customer GROUP BY ALL""")
def agg_ordered(spark, d):
    by = [col("c_acctbal").sort(ascending=False), col("c_custkey").sort()]
    aggs = [
        F.first_value(col("c_name"), order_by=by).alias("first_"), F.last_value(col("c_name"), order_by=by).alias("last_"), F.nth_value(col("c_custkey"), 2, order_by=by).alias("second_"),
        F.array_agg(col("c_custkey"), order_by=[col("c_custkey").sort(ascending=False)]).alias("ks"), F.string_agg(col("c_mktsegment"), "|", order_by=[col("c_custkey")]).alias("segments"),
        F.array_agg(col("c_mktsegment"), distinct=True).alias("ss"), F.first_value(col("c_custkey"), filter=col("c_acctbal") < 0, order_by=[col("c_custkey")]).alias("first_poor"),
    ]
    t = frame(spark, d, "customer").aggregate("c_nationkey", aggs)
    return t.select("c_nationkey", "first_", "last_", "second_", F.array_to_string(col("ks"), ",").alias("keys"), "segments", F.array_length(col("ss")).alias("n_segments"), "first_poor").df


@query()
def agg_approx(spark, d):
    x = col("l_extendedprice")
    aggs = [F.approx_distinct(col("l_partkey")).alias("parts"), F.approx_median(x).alias("med"), F.approx_percentile_cont(x, 0.9).alias("p90"), F.approx_percentile_cont_with_weight(x, col("l_linenumber"), 0.5).alias("weighted")]
    return frame(spark, d, "lineitem").aggregate("l_returnflag", aggs).df


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS parts_near, true AS median_near, true AS p90_near, true AS weighted_near FROM lineitem GROUP BY ALL")
def agg_approx_bounds(spark, d):
    """Whether the sketches of :func:`agg_approx` are within their bounds of the exact values."""
    x, w = S.col("l_extendedprice"), S.col("l_linenumber").cast("bigint")
    exact = table(spark, d, "lineitem").groupBy("l_returnflag").agg(S.count_distinct("l_partkey").alias("n"), *[S.percentile(x, q).alias(c) for q, c in ((0.495, "m0"), (0.505, "m1"), (0.895, "h0"), (0.905, "h1"))], S.percentile(x, 0.5, w).alias("wm"))
    t = agg_approx(spark, d).join(exact, "l_returnflag")
    near = [((S.col("parts") - S.col("n")) / S.col("n")).between(-0.2, 0.2), S.col("med").between(S.col("m0"), S.col("m1")), S.col("p90").between(S.col("h0"), S.col("h1")), S.col("weighted") == S.col("wm")]
    names = ("parts_near", "median_near", "p90_near", "weighted_near")
    return t.select("l_returnflag", S.col("n").alias("parts"), *[c.alias(n) for c, n in zip(near, names)])


# window functions


@query("""SELECT c_custkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER v AS INTEGER) AS rk, CAST(dense_rank() OVER v AS INTEGER) AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, CAST(ntile(4) OVER w AS INTEGER) AS nt
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), v AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""")
def over_rank(spark, d):
    p, by = [col("c_nationkey")], [col("c_acctbal").sort(ascending=False), col("c_custkey")]
    seg = [col("c_mktsegment")]
    return frame(spark, d, "customer").select(
        "c_custkey", F.row_number(p, by).alias("rn"), F.rank(p, seg).alias("rk"), F.dense_rank(p, seg).alias("dr"), F.round(F.percent_rank(p, by), 6).alias("pr"), F.round(F.cume_dist(p, by), 6).alias("cd"), F.ntile(4, p, by).alias("nt")
    ).df


@query("""SELECT o_orderkey, lead(o_totalprice, 1, 0.0) OVER w AS nxt, lag(o_totalprice, 2) OVER w AS prev, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def over_lead_lag(spark, d):
    p, by, x = [col("o_custkey")], [col("o_orderkey")], col("o_totalprice")
    return frame(spark, d, "orders").select(
        "o_orderkey", F.lead(x, 1, 0.0, p, by).alias("nxt"), F.lag(x, 2, None, p, by).alias("prev"), F.first_value(col("o_orderkey")).over(p, by).alias("f"),
        F.last_value(col("o_orderkey")).over(p, by).alias("l"), F.nth_value(col("o_orderkey"), 2).partition_by(*p).order_by(*by).build().alias("n2"),
    ).df


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS rows3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS grp, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top, CAST(sum(1) OVER w AS BIGINT) AS running
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def over_frames(spark, d):
    p, by = [col("o_custkey")], [col("o_orderkey")]
    t = frame(spark, d, "orders").select(
        "o_orderkey",
        F.sum(col("o_totalprice")).over(p, by, WindowFrame("rows", 2, 0)).alias("rows3"),
        F.window("count", [lit(1)], p, by, WindowFrame("range", 1000, 1000)).alias("near"),
        F.window("count", [lit(1)], p, [col("o_orderstatus")], WindowFrame("groups", 1, 0)).alias("grp"),
        F.max(col("o_totalprice")).over(p).alias("top"),
        F.sum(lit(1)).over(p, by).alias("running"),
    )
    return t.with_column("rows3", F.round(col("rows3"), 2)).df


# tables


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def sort_limit_offset(spark, d):
    return frame(spark, d, "orders").select("o_orderkey", "o_totalprice").sort(F.order_by(col("o_totalprice"), ascending=False), col("o_orderkey")).limit(25, 5).df


def _keys(spark, d):
    return frame(spark, d, "lineitem").select(col("l_orderkey").alias("k")), frame(spark, d, "orders").select(col("o_orderkey").alias("k"))


_A, _B = "SELECT l_orderkey AS k FROM lineitem", "SELECT o_orderkey AS k FROM orders"


@query(f"{_A} UNION ALL {_B}")
def set_union(spark, d):
    a, b = _keys(spark, d)
    return a.union(b).df


@query(f"{_A} UNION {_B}")
def set_union_distinct(spark, d):
    a, b = _keys(spark, d)
    return a.union_distinct(b).df


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, d):
    a, b = _keys(spark, d)
    return a.intersect(b).df


@query(f"{_A} EXCEPT ALL {_B}")
def set_except_all(spark, d):
    a, b = _keys(spark, d)
    return a.except_all(b).df


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(spark, d):
    return frame(spark, d, "lineitem").select_columns("l_returnflag", "l_linestatus", "l_linenumber").distinct().df


@query("SELECT run_id, channel_tag, unnest(assigned_partitions) AS assigned_partitions FROM stream_reads")
def unnest(spark, d):
    return frame(spark, d, "stream_reads").select("run_id", "channel_tag", "assigned_partitions").unnest_column("assigned_partitions", preserve_nulls=False).df


@query("SELECT doc_id, p AS parent FROM documents, unnest(parent_shas) AS t(p)")
def unnest_two(spark, d):
    t = frame(spark, d, "documents").select("doc_id", col("parent_shas").alias("parent"), col("parent_shas").alias("again"))
    return t.unnest_columns("parent", "again").filter(col("parent").is_not_null()).select("doc_id", "parent").df


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)) GROUP BY 1")
def sql_cte_subquery(spark, d):
    ctx = SessionContext(spark=spark)
    for t in ("orders", "lineitem", "customer"):
        ctx.register_table(f"_{t}", table(spark, d, t))
    return ctx.sql("""WITH big AS (SELECT l_orderkey FROM _lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)
      SELECT o_orderpriority, count(*) AS n FROM _orders WHERE o_orderkey IN (SELECT l_orderkey FROM big)
      AND EXISTS (SELECT 1 FROM _customer WHERE c_custkey = o_custkey AND c_acctbal > (SELECT avg(c_acctbal) FROM _customer)) GROUP BY o_orderpriority""").df


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def sql_cube(spark, d):
    ctx = SessionContext(spark=spark)
    ctx.register_parquet("_cube", f"{d}/lineitem.parquet")
    return ctx.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM _cube GROUP BY CUBE (l_returnflag, l_linestatus)").df


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def sql_grouping_sets(spark, d):
    ctx = SessionContext(spark=spark)
    ctx.register_table("_sets", table(spark, d, "orders"))
    return ctx.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM _sets GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())").df


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#(1|2)[0-9]$') AND p_type LIKE '%S%' AND p_name ILIKE '%A%'")
def filter_patterns(spark, d):
    return frame(spark, d, "part").filter(col("p_brand").similar_to("Brand#(1|2)[0-9]"), col("p_type").like("%S%"), col("p_name").ilike("%A%")).select("p_partkey").df


# user-defined functions


@query("SELECT event_id, value + 20 AS shifted, value > 50 AS big FROM events")
def udf_scalar(spark, d):
    shift = udf(lambda x: pc.add(x, 20.0), [pa.float64()], pa.float64(), "immutable", "sample_udf")
    big = udf(lambda x: pc.greater(x, 50.0), [pa.float64()], pa.bool_(), "stable", "is_big")
    return events(spark, d).select([col("event_id"), shift(col("value")).alias("shifted"), big(col("value")).alias("big")]).visible


class CountByName(Accumulator):
    """Counts names into a map."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def update(self, values: pa.Array) -> None:
        for x in pc.value_counts(values).to_pylist():
            if x["values"] is not None:
                self.counts[x["values"]] = self.counts.get(x["values"], 0) + x["counts"]

    def merge(self, states: list[pa.Array]) -> None:
        for part in states[0].to_pylist():
            for k, n in part["counts"]:
                self.counts[k] = self.counts.get(k, 0) + n

    def state(self) -> list[pa.Scalar]:
        return [pa.scalar({"counts": list(self.counts.items())}, COUNTS)]

    def evaluate(self) -> pa.Scalar:
        return pa.scalar({"counts": list(self.counts.items())}, COUNTS)


COUNTS = pa.struct([("counts", pa.map_(pa.string(), pa.int64()))])
count_by_name = udaf(CountByName, [pa.string()], COUNTS, [COUNTS], "immutable", "count_by_name")


@query(f"""SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts, window_start_time FROM (SELECT event_type, count(*) AS n, {_DAYW} AS window_start_time FROM events GROUP BY ALL) GROUP BY window_start_time""")
def udaf_counter(spark, d):
    w = events(spark, d).window([], [count_by_name(col("event_type")).alias("c")], DAY)
    df = plain(w.drop_columns(["window_end_time"]))
    pairs = S.array_sort(S.transform(S.map_entries("c.counts"), lambda e: S.concat(e["key"], S.lit("="), e["value"].cast("string"))))
    return df.select(S.array_join(pairs, ",").alias("counts"), "window_start_time")
