"""Implausible spikes, stuck stretches and impossible values, judged series by series.

The series are cut into time shards of about ``shard_rows`` readings, each with ``halo_rows``
readings of its neighbours on either side, so that a series with a third of all rows is spread over
many tasks, and each shard is judged by :func:`millrace.operators.robust_ar.find_faults`: a robust
autoregression with iterative additive-outlier and level-shift tests.  Stuck stretches are judged by
the whole series: two passes before give its median step, and its still steps with the stretches that shard
borders cut.  The shard bounds come from hourly counts, pre-aggregated at the scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import robust_ar
from millrace.operators.series import LEAST_EVENT_MS, SERIES, hour_of, number, sensor

#: The values a quantity can take: temperature (degrees Fahrenheit) from absolute zero to what an
#: ambient sensor can report, humidity as a fraction.
LIMITS = {"temperature": (-459.67, 500.0), "humidity": (0.0, 1.0)}
KINDS = {robust_ar.SPIKE: "spike", robust_ar.STUCK: "stuck", robust_ar.LIMIT: "impossible"}


def _placed(measurements: DataFrame) -> DataFrame:
    """Readings with a place in their series: the event time; where that is unusable the event time
    read as seconds, else the arrival."""
    v = F.col("occurred_at_ms")
    at = F.coalesce(
        F.when(v >= LEAST_EVENT_MS, v),
        F.when((v >= LEAST_EVENT_MS // 1000) & (v < 10 * LEAST_EVENT_MS // 1000), v * 1000),
        F.unix_millis(F.col("kafka_timestamp").cast("timestamp")),
    )
    return measurements.select("msg_id", "topic", sensor().alias("sensor_name"), at.alias("at"), number().alias("reading")).filter(F.col("reading").isNotNull())


def _shards(placed: DataFrame, shard_rows: int, halo_rows: int) -> DataFrame:
    """For each series and hour the shards it belongs to: (topic, sensor_name, hour, shard, own)."""
    hours = placed.groupBy(*SERIES, "hour").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*SERIES).orderBy("hour")
    upto = F.sum("n").over(by)
    hours = hours.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    hours = hours.withColumn("part", F.dense_rank().over(Window.partitionBy(*SERIES).orderBy(F.floor(F.col("before") / shard_rows))))
    # a short last part belongs to the one before
    last_rows = F.max("upto").over(Window.partitionBy(*SERIES)) - F.min("before").over(Window.partitionBy(*SERIES, "part"))
    short = (F.col("part") > 1) & (F.col("part") == F.max("part").over(Window.partitionBy(*SERIES))) & (2 * last_rows < shard_rows)
    hours = hours.withColumn("part", F.when(short, F.col("part") - 1).otherwise(F.col("part")))
    one = Window.partitionBy(*SERIES, "part")
    hours = hours.withColumn("first", F.min("before").over(one)).withColumn("last", F.max("upto").over(one))
    last_part = F.max("part").over(Window.partitionBy(*SERIES))
    places = F.array(
        F.struct(F.col("part").alias("shard"), F.lit(True).alias("own")),
        F.when((F.col("part") > 1) & (F.col("before") - F.col("first") < halo_rows), F.struct((F.col("part") - 1).alias("shard"), F.lit(False).alias("own"))),
        F.when((F.col("part") < last_part) & (F.col("last") - F.col("upto") < halo_rows), F.struct((F.col("part") + 1).alias("shard"), F.lit(False).alias("own"))),
    )
    return hours.select(*SERIES, "hour", F.filter(places, lambda p: p.isNotNull()).alias("places"))


class _Shard:
    """The readings of a shard in time order, copies (equal readings at one time) once."""

    def __init__(self, shard: pa.Table) -> None:
        x, at = shard["reading"].to_numpy(), shard["at"].to_numpy()
        ids, own = shard["msg_id"].to_numpy(), shard["own"].to_numpy()
        by = np.lexsort((ids, x, at))
        x, at, self.ids, self.own = x[by], at[by], ids[by], own[by]
        self.first = np.r_[True, (np.diff(at) != 0) | (np.diff(x) != 0)]
        lead = np.flatnonzero(self.first)
        self.order = np.lexsort((self.ids[lead], at[lead]))  # within one time as they arrived
        lead = lead[self.order]
        self.x, self.at, self.mine = x[lead], at[lead].astype(float), self.own[lead]
        self.limits = LIMITS.get(shard["topic"][0].as_py(), (-np.inf, np.inf))
        self.possible = (self.x >= self.limits[0]) & (self.x <= self.limits[1])
        self.keys = [shard[k][0].as_py() for k in (*SERIES, "shard")]


def _ends(own: np.ndarray) -> tuple[int, int]:
    """The first and last own reading; none is an empty range at the start."""
    at = np.flatnonzero(own)
    return (int(at[0]), int(at[-1])) if len(at) else (0, -1)


_KEYS = "topic string, sensor_name string, shard int"
#: Steps of a series are counted in classes of this relative width for their median.
_WIDTH = 0.005


def _row(keys: list, **more: np.ndarray) -> pa.Table:
    kinds = [pa.string(), pa.string(), pa.int32()]
    cols = {k: pa.array([v], t) for k, v, t in zip((*SERIES, "shard"), keys, kinds)}
    return pa.table(cols | {k: pa.array([np.asarray(v, float).tolist()], pa.list_(pa.float64())) for k, v in more.items()})


def _steps(shard: pa.Table) -> pa.Table:
    """The steps that lead to own readings, by classes of their size: class, count and sum."""
    s = _Shard(shard)
    x, mine = s.x[s.possible], s.mine[s.possible]
    d = np.abs(np.diff(x))[mine[1:]]
    with np.errstate(divide="ignore"):
        kind = np.where(d > 1e-9, np.round(np.log(np.maximum(d, 1e-9)) / _WIDTH), -1e9)
    key, at = np.unique(kind, return_inverse=True)
    return _row(s.keys, kind=key, n=np.bincount(at, minlength=len(key)), total=np.bincount(at, d, len(key)))


def _median_step(t: pa.Table) -> pa.Table:
    """The median step of a series, for each of its shards."""
    flat = [np.concatenate([np.asarray(v, float) for v in t[c].to_pylist()]) for c in ("kind", "n", "total")]
    key, at = np.unique(flat[0], return_inverse=True)
    n, total = np.bincount(at, flat[1], len(key)), np.bincount(at, flat[2], len(key))
    step = 0.0
    if n.sum():
        k = int(np.searchsorted(np.cumsum(n), n.sum() / 2))
        step = float(total[k] / n[k]) if key[k] > -1e9 else 0.0
    return pa.table({"topic": t["topic"], "sensor_name": t["sensor_name"], "shard": t["shard"], "step": pa.array([step] * len(t), pa.float64())})


def _held(shard: pa.Table, known: pa.Table) -> pa.Table:
    """The held stretches of a shard by size, and those that its borders cut."""
    s, step = _Shard(shard), known["step"][0].as_py()
    x, mine = s.x[s.possible], s.mine[s.possible]
    if not mine.any():
        return _row(s.keys, head=[0, 0, step], cut=[0] * 10, size=[], steps=[])
    sizes, steps, still, cut = robust_ar.edges(x, step, *_ends(mine))
    size, at = np.unique(sizes, return_inverse=True)
    return _row(s.keys, head=[mine.sum(), still, step], cut=cut, size=size, steps=np.bincount(at, steps, len(size)))


def _known(t: pa.Table) -> pa.Table:
    """What each shard of a series is told: step, length that is too long, and what lies beyond its borders."""
    rows = sorted(t.to_pylist(), key=lambda r: r["shard"])
    n, still = (int(sum(r["head"][i] for r in rows)) for i in (0, 1))
    size, steps = (np.concatenate([np.asarray(r[c], float) for r in rows]) for c in ("size", "steps"))
    need = robust_ar.longest_still(n, still, size, steps)
    beyond = robust_ar.carried([[int(v) for v in r["cut"]] for r in rows])
    out = [_row([r["topic"], r["sensor_name"], r["shard"]], known=[r["head"][2], need, n, *a, *b]) for r, (a, b) in zip(rows, beyond)]
    return pa.concat_tables(out)


def _judge(limit: float):
    def judge(shard: pa.Table, known: pa.Table) -> pa.Table:
        s = _Shard(shard)
        step, need, n, *beyond = known["known"][0].as_py()
        left, right = (tuple(int(v) for v in beyond[i : i + 3]) for i in (0, 3))

        def still(y: np.ndarray, keep: np.ndarray) -> np.ndarray:
            return robust_ar.mark_still(y, step, need, *_ends(s.mine[keep]), left, right) if n > 10 else np.zeros(len(y), bool)

        fault = np.zeros(len(s.x), np.int8)
        fault[s.order] = robust_ar.find_faults(s.x, s.at, *s.limits, limit, still)
        kind = fault[np.cumsum(s.first) - 1]
        hit = (kind != robust_ar.NONE) & s.own
        return pa.table({"msg_id": pa.array(s.ids[hit], pa.int64()), "kind": pa.array([KINDS[k] for k in kind[hit].tolist()], pa.string())})

    return judge


def find_faults(measurements: DataFrame, limit: float = 6.0, shard_rows: int = 20_000, halo_rows: int = 64) -> DataFrame:
    """Faulty readings: (msg_id, kind), kind being ``spike``, ``stuck`` or ``impossible``.

    * A reading its quantity cannot take is impossible, whether or not its sensor and times are known.
    * A series is judged by its own course and scatter; readings with an unusable event time are placed
      by their arrival.  Null and not-a-number are no readings; rows without a sensor are only held
      against the limits; a topic without limits has none.
    * Copies of a faulty row are faulty.  Series with fewer than five readings show no spikes.
    * An empty table gives no rows; columns not named here are ignored.
    """
    placed = _placed(measurements).withColumn("hour", hour_of(F.col("at")))
    known = placed.filter(F.col("topic").isNotNull() & F.col("sensor_name").isNotNull() & F.col("at").isNotNull())
    shards = _shards(known, shard_rows, halo_rows)
    spread = (
        known.join(shards, [*SERIES, "hour"])
        .select("msg_id", *SERIES, "at", "reading", F.explode("places").alias("p"))
        .select("msg_id", *SERIES, "at", "reading", "p.shard", "p.own")
    )
    # held stretches are judged by the whole series: its median step, its share of still steps, and what goes on beyond a shard
    cut, lists = spread.groupBy(*SERIES, "shard"), "array<double>"
    steps = cut.applyInArrow(_steps, f"{_KEYS}, kind {lists}, n {lists}, total {lists}")
    step = steps.groupBy(*SERIES).applyInArrow(_median_step, f"{_KEYS}, step double")
    held = cut.cogroup(step.groupBy(*SERIES, "shard")).applyInArrow(_held, f"{_KEYS}, head {lists}, cut {lists}, size {lists}, steps {lists}")
    told = held.groupBy(*SERIES).applyInArrow(_known, f"{_KEYS}, known {lists}")
    judged = cut.cogroup(told.groupBy(*SERIES, "shard")).applyInArrow(_judge(limit), "msg_id long, kind string")
    out_of = F.lit(False)
    for topic, (lo, hi) in LIMITS.items():
        out_of = out_of | ((F.col("topic") == topic) & ~F.col("reading").between(lo, hi))
    nowhere = placed.filter(F.col("sensor_name").isNull() | F.col("at").isNull()).filter(out_of)
    return judged.unionByName(nowhere.select("msg_id", F.lit("impossible").alias("kind")))
