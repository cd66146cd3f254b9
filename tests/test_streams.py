"""Streams over files, one file a batch: windows, late rows, joins, restarts, time units, user-defined aggregates, sinks."""

import json
import os

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from millrace import Context, FeastDataStream, col, udf
from millrace import functions as F
from millrace.plans.engine_queries import count_by_name
from millrace.sources.schemas import from_json_sample
from millrace.sources.timeunits import MILLIS, SECONDS, iso8601

SCHEMA = from_json_sample('{"occurred_at_ms": 100, "sensor_name": "foo", "reading": 0.5}')
S1 = [[(0, "a", 1), (500, "b", 2), (900, "a", 3)], [(1100, "a", 5), (1200, "b", 6)], [(2500, "a", 7)], [(5000, "a", 8)], [(9000, "a", 8)]]


def write(folder, batches, start=0, make=lambda r: {"occurred_at_ms": r[0], "sensor_name": r[1], "reading": float(r[2])}):
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches, start):
        p = f"{folder}/{i:03}.json"
        with open(p, "w") as f:
            f.writelines(json.dumps(make(r)) + "\n" for r in rows)
        os.utime(p, (1_000_000 + 10 * i,) * 2)


def run(stream, name):
    out = []
    stream.sink(lambda b: out.extend(b.to_pylist()), trigger={"availableNow": True}, name=name)
    return out


def source(spark, folder, checkpoint, unit=MILLIS, schema=SCHEMA, column="occurred_at_ms", kind=None):
    c = Context(spark, kind or __import__("millrace").DataStream).with_checkpoint(str(checkpoint), rocksdb=False)
    return c.from_files(str(folder), schema, column, unit, max_files_per_trigger=1)


def ms(t):
    return int(t.timestamp() * 1000)


def AGGS():
    return [F.count(col("reading")).alias("n"), F.avg(col("reading")).alias("mean")]


def windows(rows):
    return sorted((ms(r["window_start_time"]), r["sensor_name"], r["n"]) for r in rows)


def test_tumbling_and_order_of_columns(spark, tmp_path):
    write(tmp_path / "in", S1)
    s = source(spark, tmp_path / "in", tmp_path / "cp").window([col("sensor_name")], AGGS(), 1000)
    assert s.schema().names == ["sensor_name", "n", "mean", "window_start_time", "window_end_time"]
    assert windows(run(s, "t")) == [(0, "a", 2), (0, "b", 1), (1000, "a", 1), (1000, "b", 1), (2000, "a", 1), (5000, "a", 1)]


def test_late_row_is_dropped(spark, tmp_path):
    write(tmp_path / "in", [*S1[:4], [(6000, "a", 8)], [(100, "a", 99)], [(9000, "a", 8)]])
    got = run(source(spark, tmp_path / "in", tmp_path / "cp").window(["sensor_name"], AGGS(), 1000), "l")
    assert windows(got) == [(0, "a", 2), (0, "b", 1), (1000, "a", 1), (1000, "b", 1), (2000, "a", 1), (5000, "a", 1), (6000, "a", 1)]


def test_sliding(spark, tmp_path):
    write(tmp_path / "in", S1)
    got = run(source(spark, tmp_path / "in", tmp_path / "cp").window(["sensor_name"], AGGS(), 2000, 1000), "s")
    assert windows(got) == [(-1000, "a", 2), (-1000, "b", 1), (0, "a", 3), (0, "b", 2), (1000, "a", 2), (1000, "b", 1), (2000, "a", 1), (4000, "a", 1), (5000, "a", 1)]


def test_boundary(spark, tmp_path):
    write(tmp_path / "in", [[(0, "a", 1)], [(1000, "a", 2)], [(2000, "a", 3)]])
    got = run(source(spark, tmp_path / "in", tmp_path / "cp").window(["sensor_name"], AGGS(), 1000), "b")
    assert windows(got) == [(0, "a", 1), (1000, "a", 1)]


@pytest.mark.parametrize("kind", ["inner", "left", "anti"])
def test_windows_join(spark, tmp_path, kind):
    write(tmp_path / "in", S1)
    write(tmp_path / "in2", [[r for r in b if kind == "inner" or r[1] == "a"] or [(b[0][0], "z", 0)] for b in S1])
    a = source(spark, tmp_path / "in", tmp_path / "cp").window(["sensor_name"], AGGS(), 1000)
    b = source(spark, tmp_path / "in2", tmp_path / "cp").window(["sensor_name"], [F.max(col("reading")).alias("hi")], 1000)
    for old in ("sensor_name", "window_start_time", "window_end_time"):
        b = b.with_column_renamed(old, f"r_{old}")
    got = run(a.join(b, kind, ["sensor_name", "window_start_time", "window_end_time"], ["r_sensor_name", "r_window_start_time", "r_window_end_time"]), "j" + kind)
    closed = [(0, "a", 2), (0, "b", 1), (1000, "a", 1), (1000, "b", 1), (2000, "a", 1), (5000, "a", 1)]
    if kind == "inner":
        assert windows(got) == closed
    elif kind == "left":
        assert set(windows(got)) <= set(closed) and {w for w in closed if w[1] == "a"} <= set(windows(got))
    else:
        assert {w[1] for w in windows(got)} == {"b"}


def test_restart_goes_on(spark, tmp_path):
    write(tmp_path / "in", S1[:2])
    first = run(source(spark, tmp_path / "in", tmp_path / "cp").window(["sensor_name"], AGGS(), 1000), "r")
    write(tmp_path / "in", S1[2:], start=2)
    again = run(source(spark, tmp_path / "in", tmp_path / "cp").window(["sensor_name"], AGGS(), 1000), "r")
    assert windows(first + again) == [(0, "a", 2), (0, "b", 1), (1000, "a", 1), (1000, "b", 1), (2000, "a", 1), (5000, "a", 1)]


@pytest.mark.parametrize("unit, make", [(SECONDS, lambda v: v // 1000), (iso8601("%Y-%m-%dT%H:%M:%S"), lambda v: f"1970-01-01T00:00:{v // 1000:02}")])
def test_time_units(spark, tmp_path, unit, make):
    write(tmp_path / "in", S1, make=lambda r: {"at": make(r[0]), "sensor_name": r[1], "reading": r[2]})
    schema = from_json_sample({"at": make(0), "sensor_name": "a", "reading": 0.5})
    got = run(source(spark, tmp_path / "in", tmp_path / "cp", unit, schema, "at").window(["sensor_name"], AGGS(), 1000), "u")
    assert windows(got) == [(0, "a", 2), (0, "b", 1), (1000, "a", 1), (1000, "b", 1), (2000, "a", 1), (5000, "a", 1)]


def test_stream_is_batch_on_closed_windows(spark, tmp_path):
    write(tmp_path / "in", S1)
    aggs = [F.count(col("reading"), distinct=True).alias("n"), F.median(col("reading")).alias("med"), F.stddev(col("reading")).alias("sd"), F.count(col("reading"), filter=col("reading") > 2).alias("big")]
    live = run(source(spark, tmp_path / "in", tmp_path / "cp").window(["sensor_name"], aggs, 1000), "e")
    table = spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    still = Context(spark).from_table(table, "occurred_at_ms", MILLIS).window(["sensor_name"], aggs, 1000, closed_only=True).visible.toArrow().to_pylist()
    key = lambda r: (r["window_start_time"], r["sensor_name"])
    assert sorted(live, key=key) == sorted(still, key=key)


def test_udaf_keeps_state(spark, tmp_path):
    write(tmp_path / "in", [[(0, "a", 1)], [(100, "b", 2), (200, "a", 1)], [(2500, "a", 3)], [(9000, "a", 1)], [(9500, "a", 1)]])
    got = run(source(spark, tmp_path / "in", tmp_path / "cp").window([], [count_by_name(col("sensor_name")).alias("c")], 1000), "a")
    assert [(ms(r["window_start_time"]), dict(r["c"]["counts"])) for r in sorted(got, key=lambda r: r["window_start_time"])] == [(0, {"a": 2, "b": 1}), (2000, {"a": 1})]


def test_udf_and_steps_keep_the_event_time(spark, tmp_path):
    write(tmp_path / "in", S1)
    more = udf(lambda x: pc.add(x, 20.0), [pa.float64()], pa.float64(), "immutable", "more")
    s = source(spark, tmp_path / "in", tmp_path / "cp").select(["sensor_name", more(col("reading")).alias("reading")]).filter(col("reading") > 22)
    got = run(s.with_column("twice", col("reading") * 2).drop_columns(["twice"]).window(["sensor_name"], [F.max(col("reading")).alias("n")], 1000), "m")
    assert windows(got) == [(0, "a", 23.0), (1000, "a", 25.0), (1000, "b", 26.0), (2000, "a", 27.0), (5000, "a", 28.0)]


def test_feast(spark, tmp_path):
    write(tmp_path / "in", S1)
    pushed = []

    class Store:
        def push(self, name, df, to):
            pushed.append((name, len(df), list(df.columns)))
            if len(pushed) == 1:
                raise RuntimeError("the store is away")

    s = source(spark, tmp_path / "in", tmp_path / "cp", kind=FeastDataStream)
    assert s.get_feast_schema() == [("occurred_at_ms", "Int64"), ("sensor_name", "String"), ("reading", "Float64")]
    w = s.window(["sensor_name"], AGGS(), 1000)
    assert isinstance(w, FeastDataStream)
    w.write_feast_feature(Store(), "src", trigger={"availableNow": True})
    assert sum(n for _, n, _ in pushed) == 6 and pushed[0][0] == "src" and "_event_time" not in pushed[0][2]


def test_bad_windows(spark):
    s = Context(spark).from_table(spark.createDataFrame([(1,)], "t long"), "t", MILLIS)
    with pytest.raises(ValueError):
        s.window([], [F.count_star().alias("n")], 0)
    with pytest.raises(ValueError):
        s.window([], [F.count_star().alias("n")], 10, -1)
    with pytest.raises(ValueError):
        s.join(s, "sideways", ["t"], ["t"])


def test_event_times_before_1970_and_null(spark):
    t = spark.createDataFrame([(-1500,), (None,), (-500,)], "t long")
    got = Context(spark).from_table(t, "t", MILLIS).window([], [F.count_star().alias("n")], 1000).visible.toArrow().to_pylist()
    assert sorted((ms(r["window_start_time"]), r["n"]) for r in got) == [(-2000, 1), (-1000, 1)]


def test_kslack(spark, tmp_path):
    from millrace.streaming.kslack import kslack

    write(tmp_path / "in", [[(1000, "a", 1), (3000, "a", 3)], [(2000, "a", 2), (9000, "a", 9)], [(30000, "a", 1)], [(31000, "a", 1)], [(1500, "a", 7)], [(60000, "a", 1)], [(90000, "a", 1)]])
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    from pyspark.sql import functions as S

    out = kslack(s.withColumn("at", S.timestamp_millis("occurred_at_ms")), ["sensor_name"], "at", "reading", 10_000, "5 seconds")
    rows = []
    q = out.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, _: rows.extend(d.toArrow().to_pylist())).trigger(availableNow=True).start()
    q.awaitTermination()
    first = [r for r in rows if r["window_start_ms"] == 0]
    assert [r["n"] for r in first if r["kind"] == "provisional"][:2] == [2, 4]
    final = [r for r in first if r["kind"] == "final"]
    # in event-time order 1, 2, 3, 9: the largest rise is 6, whatever the order of arrival
    assert len(final) == 1 and (final[0]["n"], final[0]["total"], final[0]["first"], final[0]["last"], final[0]["rise"]) == (4, 15.0, 1.0, 9.0, 6.0)
