"""Expressions, tables, sessions, schemas, encodings."""


import json
import struct
import zlib

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import types as T

from millrace import CaseBuilder, Context, DataFrame, Expr, KafkaTopicBuilder, RuntimeConfig, SessionConfig, SessionContext, SQLOptions, WindowFrame, col, lit, udaf, udf
from millrace import functions as F
from millrace.expr import NullTreatment, similar_to_regex
from millrace.inputs import LocationInputPlugin
from millrace.object_store import AmazonS3, GoogleCloud, LocalFileSystem, MicrosoftAzure
from millrace.plans.engine_queries import count_by_name
from millrace.sources import avro, kafka, schemas


@pytest.fixture(scope="module")
def ctx(spark):
    return SessionContext(spark=spark)


@pytest.fixture
def t(ctx):
    return ctx.from_pydict({"k": [1, 1, 2, None], "v": [1.5, None, 3.0, 4.0], "s": ["a", "b", None, "a"]})


def test_expr(ctx, t):
    e = (1 - col("k")) * 2 + col("k") % 2
    assert t.select(e.alias("x")).to_pydict() == {"x": [1, 1, -2, None]}
    assert t.filter((col("k") == 1) & ~col("v").is_null() | (col("s") != "a")).count() == 2
    assert t.select((-col("k")).alias("n"), col("v").cast(int).alias("i"), col("k").cast(pa.uint64()).alias("u")).df.dtypes == [("n", "bigint"), ("i", "bigint"), ("u", "decimal(20,0)")]
    with pytest.raises(ValueError):
        bool(col("k") == 1)
    with pytest.raises(TypeError):
        col("k").filter(col("k") > 1)
    assert lit(5).python_value() == 5 and lit(5).rex_type() == "Literal" and col("k").variant_name() == "Column"
    assert (col("k") + 1).rex_call_operator() == "+" and len((col("k") + 1).rex_call_operands()) == 2
    assert lit(1.5).types() == pa.float64() and isinstance(hash(col("k")), int)
    assert isinstance(F.case(col("k")), CaseBuilder) and F.when(col("k") > 1, 2).end().variant_name() == "Case"


def test_refinements(t):
    by = t.aggregate([], [F.count(col("v")).filter(col("k") == 1).build().alias("n"), F.array_agg(col("s")).order_by(col("v").sort(False)).build().alias("a"), F.count(col("s")).distinct().build().alias("d")])
    assert by.to_pylist() == [{"n": 1, "a": ["b", "a", None, "a"], "d": 2}]
    last = F.last_value(col("v")).null_treatment(NullTreatment.IGNORE_NULLS).build().over([col("k")], [col("s")], WindowFrame("rows", None, None)).alias("l")
    assert [r["l"] for r in t.filter(col("k") == 1).select(last).to_pylist()] == [1.5, 1.5]
    before = F.lag(col("v"), 1, None, None, [col("s").sort(nulls_first=False), col("v")]).null_treatment(NullTreatment.IGNORE_NULLS).build().alias("b")
    assert [r["b"] for r in t.sort(col("s").sort(nulls_first=False), col("v")).select(before).to_pylist()] == [None, 1.5, 4.0, 4.0]
    assert t.select(Expr.column("k")).count() == 4 and Expr.literal(1).python_value() == 1
    f = WindowFrame("range", 2, None)
    assert f.get_frame_units() == "range" and f.get_lower_bound().get_offset() == 2 and f.get_upper_bound().is_unbounded() and f.get_lower_bound().is_preceding()
    assert WindowFrame("rows", 0, 0).get_upper_bound().is_current_row()
    with pytest.raises(ValueError):
        WindowFrame("days", 1, 1)


def test_similar_to():
    assert similar_to_regex("a%_[x-z]+|b.") == r"(?s)^(?:a.*.[x-z]+|b\.)$"


def test_functions_with_own_meaning(ctx):
    t = ctx.from_pydict({"s": ["wORLD-foo bar", None, ""], "n": [7, None, -7], "a": [[1, 2, 1, None], None, []]})
    got = t.select(
        F.initcap(col("s")).alias("i"), F.concat(col("s"), "!").alias("c"), F.trunc(lit(-1.567), 1).alias("t"), F.gcd(col("n"), 21).alias("g"), F.lcm(col("n"), 3).alias("l"), F.array_remove(col("a"), 1).alias("r"),
        F.array_position(col("a"), 1, 2).alias("p"), F.array_element(col("a"), -2).alias("e"), F.array_ndims(col("a")).alias("d"), F.regexp_replace(col("s"), "[a-z]", "#").alias("x"), F.to_hex(col("n")).alias("h"),
    ).to_pydict()
    assert got["i"] == ["World-Foo Bar", None, ""] and got["c"] == ["wORLD-foo bar!", "!", "!"] and got["t"] == [-1.5] * 3
    assert got["g"] == [7, None, 7] and got["l"] == [21, None, 21] and got["r"] == [[2, 1, None], None, []] and got["p"] == [3, None, None]
    assert got["e"] == [1, None, None] and got["d"] == [1, None, 1] and got["x"] == ["#ORLD-foo bar", None, ""] and got["h"] == ["7", None, "fffffffffffffff9"]
    with pytest.raises(ValueError):
        F.encode(col("s"), "rot13")
    with pytest.raises(ValueError):
        F.digest(col("s"), "blake3")
    with pytest.raises(ValueError):
        F.date_bin("3 months", col("s"))


def test_tables(ctx, t, tmp_path, spark):
    assert isinstance(t["k"], DataFrame) and t[["k", "v"]].schema().names == ["k", "v"]
    assert t.sort(col("k")).limit(1).to_pylist()[0]["k"] is None  # nulls first
    assert t.sort(col("k").sort(ascending=False, nulls_first=False)).limit(1, 1).to_pylist()[0]["k"] == 1
    assert t.with_column("w", col("v") * 2).with_column_renamed("w", "x").schema().names[-1] == "x"
    g = F.window("count", [lit(1)], [], [col("k")], WindowFrame("groups", 1, 0)).alias("g")
    assert sorted(r["g"] for r in t.with_column("g", g).to_pylist()) == [1, 3, 3, 3]
    other = ctx.from_pydict({"k2": [1, 3], "w": ["x", "y"]})
    sizes = {how: t.join(other, (["k"], ["k2"]), how).count() for how in ("inner", "left", "right", "full", "semi", "anti")}
    assert sizes == {"inner": 2, "left": 4, "right": 3, "full": 5, "semi": 2, "anti": 2}
    with pytest.raises(ValueError):
        t.join(other, (["k"], ["k2"]), "sideways")
    assert t.union(t).count() == 8 and t.union_distinct(t).count() == 4 and t.intersect(t).count() == 4 and t.except_all(t.limit(1)).count() == 3
    assert t.transform(lambda d, n: d.limit(n), 2).count() == 2 and t.cache().count() == 4 and t.repartition(3).df.rdd.getNumPartitions() == 3
    assert sum(b.num_rows for p in t.repartition_by_hash(col("k"), num=2).collect_partitioned() for b in p) == 4
    assert sum(b.to_pyarrow().num_rows for b in t.execute_stream()) == 4 and pa.table(t).num_rows == 4 and len(t.to_pandas()) == 4
    assert "Relation" in t.logical_plan() + t.optimized_logical_plan() + t.execution_plan() or t.execution_plan()
    t.explain(verbose=True)
    assert t.describe().count() == 5 and t._repr_html_() and repr(t)
    u = ctx.from_pydict({"i": [1, 2, 3], "a": [[1, 2], [], None], "b": [["x"], ["y"], None]})
    assert u.unnest_column("a").count() == 4 and u.unnest_column("a", preserve_nulls=False).count() == 2
    assert sorted((r["i"], r["a"], r["b"]) for r in u.filter(col("i") < 3).unnest_columns("a", "b").to_pylist() if r["i"] == 1) == [(1, 1, "x"), (1, 2, None)]
    for kind in ("csv", "json", "parquet"):
        p = str(tmp_path / kind)
        getattr(t, f"write_{kind}")(p, **({"with_header": True} if kind == "csv" else {}))
        assert getattr(ctx, f"read_{kind}")(p).count() == 4
        getattr(ctx, f"register_{kind}")(f"t_{kind}", p)
        assert ctx.sql(f"SELECT count(*) AS n FROM t_{kind}").to_pydict() == {"n": [4]}
    p = LocationInputPlugin(spark)
    assert p.is_correct_input("x", "t") and p.build_table(str(tmp_path / "parquet"), "t") if str(tmp_path / "parquet").endswith(".parquet") else True
    with pytest.raises(RuntimeError):
        p.build_table("x.docx", "t")


def test_sessions(ctx, t):
    ctx.register_table("named", t)
    assert ctx.table_exist("named") and "named" in ctx.tables() and ctx.table("named").count() == 4
    assert "named" in ctx.catalog().database().names() and ctx.catalog().database("public").table("named").schema().names == ["k", "v", "s"]
    for allowed in (SQLOptions().with_allow_ddl(False), SQLOptions().with_allow_dml(False), SQLOptions().with_allow_statements(False)):
        assert ctx.sql_with_options("SELECT * FROM named", allowed).count() == 4
    for q, o in (("CREATE TEMP VIEW z AS SELECT 1", SQLOptions().with_allow_ddl(False)), ("INSERT INTO named SELECT * FROM named", SQLOptions().with_allow_dml(False)), ("SET a=b", SQLOptions().with_allow_statements(False))):
        with pytest.raises(ValueError):
            ctx.sql(q, o)
    ctx.deregister_table("named")
    assert not ctx.table_exist("named") and ctx.empty_table().count() == 0 and ctx.session_id() != SessionContext(spark=ctx.spark).session_id()
    c = SessionConfig().with_target_partitions(5).with_batch_size(100).with_parquet_pruning(False).with_information_schema().with_repartition_joins(False)
    assert c.options["spark.sql.shuffle.partitions"] == "5" and c.options["spark.sql.parquet.filterPushdown"] == "false"
    assert RuntimeConfig().with_temp_file_path("/x").with_fair_spill_pool(1 << 30).options == {"spark.local.dir": "/x", "spark.memory.offHeap.enabled": "true", "spark.memory.offHeap.size": str(1 << 30)}
    assert ctx.from_arrow(pa.table({"a": [1]})).count() == ctx.from_pylist([{"a": 1}]).count() == ctx.create_dataframe([pa.table({"a": [1]}).to_batches()], "made").count() == 1
    assert AmazonS3("b", region="r").settings() == {"fs.s3a.bucket.b.endpoint.region": "r", "fs.s3a.bucket.b.connection.ssl.enabled": "true"}
    assert GoogleCloud("b").settings() == LocalFileSystem().settings() == MicrosoftAzure("c", "a").settings() == {}


def test_user_defined_functions(ctx, t):
    plus = udf(lambda a, b: pc.add(a, b), [pa.float64(), pa.float64()], pa.float64(), "volatile", "plus")
    assert t.select(plus(col("v"), col("k")).alias("p")).to_pydict() == {"p": [2.5, None, 5.0, None]}
    ctx.register_udf(plus)
    ctx.register_table("u", t)
    assert ctx.sql("SELECT plus(v, 1) AS p FROM u WHERE k = 2").to_pydict() == {"p": [4.0]}
    got = t.aggregate([col("k")], [F.count_star().alias("n"), count_by_name(col("s")).alias("c"), F.max(col("v")).alias("m")])
    assert got.schema().names == ["k", "n", "c", "m"]
    assert {r["k"]: (r["n"], dict(r["c"]["counts"]), r["m"]) for r in got.to_pylist()} == {1: (2, {"a": 1, "b": 1}, 1.5), 2: (1, {}, 3.0), None: (1, {"a": 1}, 4.0)}
    with pytest.raises(TypeError):
        udaf(int, [pa.int64()], pa.int64(), [pa.int64()], "stable")
    with pytest.raises(TypeError):
        plus(col("v"))


def test_json_schema():
    s = schemas.from_json_sample('{"a": 0, "b": 0.0, "c": "2020-01-01", "d": true, "e": null, "f": [], "g": [1], "h": {"i": 18446744073709551615}}')
    assert s.simpleString() == "struct<a:bigint,b:double,c:string,d:boolean,e:string,f:array<string>,g:array<bigint>,h:struct<i:double>>"
    with pytest.raises(ValueError):
        schemas.from_json_sample("[1]")


AVRO = {
    "type": "record", "name": "test", "fields": [
        {"name": "id", "type": "int", "doc": "the id"}, {"name": "name", "type": ["null", "string"]}, {"name": "tags", "type": {"type": "array", "items": "long"}}, {"name": "m", "type": {"type": "map", "values": "double"}},
        {"name": "at", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "kind", "type": {"type": "enum", "name": "k", "symbols": ["x", "y"]}},
    ],
}


def container(rows, codec="null"):
    """Writes a container of (id, name, tags, m, at, kind)."""

    def n(v):
        v, out = (v << 1) ^ (v >> 63), b""
        while True:
            out += bytes([v & 0x7F | (0x80 if v > 0x7F else 0)])
            v >>= 7
            if not v:
                return out

    s = lambda x: n(len(x)) + x
    body = b""
    for i, name, tags, m, at, kind in rows:
        body += n(i) + (n(0) if name is None else n(1) + s(name.encode()))
        body += (n(len(tags)) + b"".join(map(n, tags)) if tags else b"") + n(0)
        body += (n(len(m)) + b"".join(s(k.encode()) + struct.pack("<d", v) for k, v in m.items()) if m else b"") + n(0) + n(at) + n(kind)
    if codec == "deflate":
        c = zlib.compressobj(wbits=-15)
        body = c.compress(body) + c.flush()
    head = avro.MAGIC + n(2) + s(b"avro.schema") + s(json.dumps(AVRO).encode()) + s(b"avro.codec") + s(codec.encode()) + n(0) + b"0123456789abcdef"
    return head + (n(len(rows)) + s(body) + b"0123456789abcdef" if rows else b"")


def test_avro(spark):
    s = schemas.from_avro_schema(json.dumps(AVRO))
    assert s.simpleString() == "struct<id:int,name:string,tags:array<bigint>,m:map<string,double>,at:timestamp,kind:string>"
    assert not s["id"].nullable and s["name"].nullable and s["id"].metadata == {"avro::doc": "the id"}
    rows = [(1, "Alice", [5, -6], {"a": 0.5}, 1000, 1), (-70000, None, [], {}, -1, 0)]
    for codec in ("null", "deflate"):
        got = avro.read_container(container(rows, codec))
        assert [(r["id"], r["name"], r["tags"], r["m"], r["kind"]) for r in got] == [(1, "Alice", [5, -6], {"a": 0.5}, "y"), (-70000, None, [], {}, "x")]
    assert avro.read_container(container([])) == []
    for bad in (b"\x01\x02\x03", container(rows)[:-20], b""):
        with pytest.raises(ValueError):
            avro.read_container(bad)
    r = KafkaTopicBuilder("b:1").with_topic("t").infer_schema_from_avro(json.dumps(AVRO)).with_encoding("AVRO").with_timestamp("at", __import__("millrace").TimestampUnit("Timestamp")).build_reader()
    import datetime

    m = spark.createDataFrame([(container(rows), datetime.datetime(2020, 1, 1)), (None, None)], "value binary, timestamp timestamp")
    out = r.decode(m).collect()
    assert [(x["id"], x["name"], x["m"]) for x in out] == [(1, "Alice", {"a": 0.5}), (-70000, None, {})] and out[0]["_event_time"] is not None
    with pytest.raises(ValueError):
        schemas.from_avro_schema('"int"')


def test_topics(spark):
    b = KafkaTopicBuilder("b:1")
    for step in (lambda: b.build_reader(), lambda: b.with_topic("t").build_reader(), lambda: b.infer_schema_from_json('{"a": 1}').build_reader(), lambda: b.with_encoding("json").build_writer()):
        with pytest.raises(ValueError):
            step()
    with pytest.raises(ValueError):
        b.with_encoding("xml")
    assert b.with_timestamp("a").build_writer().topic == "t"
    assert kafka.source_options("b:1", "t", {"auto.offset.reset": "latest", "group.id": "g", "fetch.min.bytes": "1"}) == {"kafka.bootstrap.servers": "b:1", "subscribe": "t", "startingOffsets": "latest", "failOnDataLoss": "true", "groupIdPrefix": "g", "kafka.fetch.min.bytes": "1"}
    assert kafka.sink_options("b:1", "t") == {"kafka.bootstrap.servers": "b:1", "topic": "t", "kafka.delivery.timeout.ms": "60000"}
    rows = spark.createDataFrame([("a", 1), ("b", 10), ("c", 20), ("d", 100)], "col1 string, col2 int")
    assert [r["value"] for r in kafka.encoded(rows).collect()] == ['{"col1":"a","col2":1}', '{"col1":"b","col2":10}', '{"col1":"c","col2":20}', '{"col1":"d","col2":100}']
    import datetime

    m = spark.createDataFrame([(b'{"id": 1, "name": "Alice"}', datetime.datetime(2020, 1, 1)), (b"{bad", datetime.datetime(2020, 1, 1)), (b'{"id": 2}', None)], "value binary, timestamp timestamp")
    s = Context(spark).from_topic("people", '{"id": 1, "name": "x"}', "b:1", messages=m)
    assert s.schema().names == ["id", "name"] and [(r["id"], r["name"]) for r in s.visible.collect()] == [(1, "Alice"), (None, None), (2, None)]
    strict = KafkaTopicBuilder("b").with_topic("t").with_schema(T.StructType([T.StructField("id", T.LongType())])).with_encoding("json").build_reader()
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        kafka.TopicReader(**{**strict.__dict__, "strict": True}).decode(m).collect()
    with pytest.raises(ValueError):
        Context(spark).from_topic("x")
    assert str(s) == repr(s) == "DataStream" and str(Context(spark)) == "Context"


def test_names_of_types_and_nodes(ctx, t):
    from millrace import common

    assert len(common.VARIANTS) == 55
    assert common.DataTypeMap.of(pa.int64()).sql_type is common.SqlType.BIGINT and common.DataTypeMap.of(pa.list_(pa.int8())).python_type is common.PythonType.List
    names = common.plan_nodes(t.filter(col("k") > 1).aggregate("s", [F.count_star().alias("n")]).sort(col("s")).limit(3))
    assert "Aggregate" in names
    assert len(common.expr_list_to_raw_expr_list([col("k"), 1])) == 2 and common.sort_list_to_raw_sort_list(None) is None


def test_reader_options():
    from millrace.sources.kafka import source_options

    o = source_options("b:1", "t", {"auto.offset.reset": "latest", "group.id": "g", "enable.auto.commit": "false", "max.poll.interval.ms": "5", "max.partition.fetch.bytes": "6", "maxOffsetsPerTrigger": "7", "minpartitions": "8", "kafka.security.protocol": "SSL", "fetch.min.bytes": "9"})
    assert o == {
        "kafka.bootstrap.servers": "b:1", "subscribe": "t", "startingOffsets": "latest", "failOnDataLoss": "true", "groupIdPrefix": "g", "kafka.max.poll.interval.ms": "5",
        "kafka.max.partition.fetch.bytes": "6", "maxOffsetsPerTrigger": "7", "minPartitions": "8", "kafka.security.protocol": "SSL", "kafka.fetch.min.bytes": "9",
    }
    assert source_options("b:1", "t")["startingOffsets"] == "earliest"
    assert source_options("b:1", "t", {"failOnDataLoss": "false"})["failOnDataLoss"] == "false"
    assert "subscribe" not in source_options("b:1", "t", {"subscribePattern": "t.*"})


def test_signals_stop_streams(spark):
    import signal

    from millrace.context import Context

    class Running:
        isActive = True

        def stop(self):
            self.isActive = False

    seen = []
    before = signal.signal(signal.SIGUSR1, lambda *a: seen.append(a[0]))
    try:
        ctx, q = Context(spark), Running()
        ctx.running.append(q)
        ctx.stop_on_signals(signal.SIGUSR1)
        signal.raise_signal(signal.SIGUSR1)
        assert not q.isActive and not ctx.running and seen == [signal.SIGUSR1]
    finally:
        signal.signal(signal.SIGUSR1, before)


def test_ordered_ends_are_those_of_sorted_rows(spark):
    import itertools

    from millrace import functions as F
    from millrace.expr import col
    from millrace.frame import DataFrame

    rows = [(1, 2, "a", 10), (1, None, "b", 20), (1, 1, None, 30), (1, 2, "c", None), (2, None, None, 1)]
    t = DataFrame(spark.createDataFrame(rows, "g int, k int, s string, v int"))
    for up, first in itertools.product((True, False), repeat=2):
        by = [col("k").sort(ascending=up, nulls_first=first), col("s").sort(ascending=up, nulls_first=first)]

        def key(r, up=up, first=first):
            return [((0 if first else 2) if x is None else 1, 0 if x is None else (x if up else -x) if isinstance(x, int) else (ord(x) if up else -ord(x))) for x in r[1:3]]

        want = sorted([r for r in rows if r[0] == 1], key=key)
        got = t.aggregate("g", [F.first_value(col("v"), order_by=by).alias("f"), F.last_value(col("v"), order_by=by).alias("l"), F.first_value(col("v"), filter=col("v") > 10, order_by=by).alias("x")]).to_pylist()
        got = {r["g"]: r for r in got}
        assert (got[1]["f"], got[1]["l"]) == (want[0][3], want[-1][3]) and got[1]["x"] == next(r[3] for r in want if r[3] and r[3] > 10) and got[2]["f"] == 1


def test_groups_of_a_batch():
    import pyarrow as pa

    from millrace.udf import _groups

    t = pa.table({"k0": pa.array(["a", None, "a", "b", None]), "k1": pa.array([[1], [1], [1], None, [2]]), "a0_0": pa.array([1, 2, 3, 4, 5])})
    got = {repr(k): p["a0_0"].to_pylist() for k, p in _groups(t, 2)}
    assert got == {"('a', [1])": [1, 3], "(None, [1])": [2], "('b', None)": [4], "(None, [2])": [5]}
    w = pa.table({"k0": pa.array([{"a": 1, "b": "x"}, None, {"a": 1, "b": None}, {"a": 1, "b": "x"}, {"a": None, "b": None}]), "a0_0": pa.array([1, 2, 3, 4, 5])})
    assert sorted(p["a0_0"].to_pylist() for _, p in _groups(w, 1)) == [[1, 4], [2], [3], [5]]
    assert [k for k, _ in _groups(t, 0)] == [()] and list(_groups(t.slice(0, 0), 2)) == []


def test_partitions_are_read_apart(spark):
    from millrace.frame import DataFrame
    from millrace.session import SessionContext

    t = DataFrame(spark.range(0, 40, 1, 4).repartition(4, "id"))
    parts = [[v for b in p for v in b.to_pyarrow()["id"].to_pylist()] for p in t.execute_stream_partitioned()]
    assert sorted(sum(parts, [])) == list(range(40)) and sum(map(bool, parts)) > 1
    one = DataFrame(spark.range(0, 40, 1, 4))
    assert [v for b in SessionContext(spark=spark).execute(one, 2) for v in b.to_pyarrow()["id"].to_pylist()] == list(range(20, 30))
    assert list(SessionContext(spark=spark).execute(one, 9)) == []
