"""The operators on measurements: against brute force, and on awkward rows."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as S

from millrace.operators import faults, grid, incremental, lateness, robust_ar, trailing
from millrace.operators.series import bounded, steps, without_copies

T0 = 1_230_768_000_000
H, D = 3_600_000, 86_400_000
NAN = float("nan")

AWKWARD = [
    ("temperature", 0, 1, T0, "a", 50.0), ("temperature", 0, 2, T0, " A ", 50.0), ("temperature", 0, 3, T0, "a", 51.0), ("temperature", 1, 1, T0, "a", 50.0),
    ("temperature", 0, 4, None, "a", 50.0), ("temperature", 0, 5, 0, "a", 50.0), ("temperature", 0, 6, T0 + H, None, 50.0), ("temperature", 0, 7, T0 + H, "a", None), ("temperature", 0, 8, T0 + H, "a", NAN),
    (None, 0, 9, T0, "a", 50.0), ("temperature", None, 10, T0 + 3 * H, "a", 52.0), ("temperature", 0, None, T0 + 3 * H, "a", 52.0), ("humidity", 0, 1, T0, "", 0.5), ("humidity", 0, 2, T0 + 40 * D, "", 0.0), ("humidity", 0, 3, T0 + 40 * D, "", -0.0),
]


def test_copies(measurements):
    got = [tuple(r.values()) for r in without_copies(measurements(AWKWARD)).toArrow().to_pylist()]
    n = collections.Counter((r[0], r[1], r[2], r[3]) for r in got)
    assert n[("temperature", "a", T0, 50.0)] == 2  # one a partition
    assert n[("temperature", "a", T0, 51.0)] == 1
    assert n[("temperature", "a", T0 + 3 * H, 52.0)] == 2  # a row without a partition is no copy
    assert n[("humidity", "", T0 + 40 * D, 0.0)] == 1 and sum(n.values()) == 7


def test_bounded(spark):
    df = spark.range(5)
    assert bounded(spark, df, 5).count() == 5 and bounded(spark, df, 4) is df


# grid


def pchip(x, y, at, segments):
    """Plain monotone cubic through the knots of the segment around ``at``."""
    for k in segments:
        xs, ys = x[k], y[k]
        if xs[0] <= at <= xs[-1]:
            h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
            if len(xs) == 2:
                return ys[0] + d[0] * (at - xs[0])
            m = np.zeros(len(xs))
            for i in range(1, len(xs) - 1):
                if d[i - 1] * d[i] > 0:
                    a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
                    m[i] = (a + b) / (a / d[i - 1] + b / d[i])

            def end(h0, h1, d0, d1):
                s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
                return 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

            m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
            i = min(np.searchsorted(xs, at, side="right") - 1, len(h) - 1)
            s = at - xs[i]
            return ys[i] + s * (m[i] + s * ((3 * d[i] - 2 * m[i] - m[i + 1]) / h[i] + s * (m[i] + m[i + 1] - 2 * d[i]) / h[i] ** 2))
    return None


@pytest.mark.parametrize("shard", [1, 3, 720])
def test_grid_is_brute_force(measurements, shard):
    rng = random.Random(shard)
    rows, o = [], 0
    for s in ("a", "b"):
        t = T0
        for _ in range(120):
            t += rng.choice([20, 40, 90, 150, 300, 1200]) * 60_000
            o += 1
            rows.append(("temperature", 0, o, t, s, round(rng.uniform(40, 60), 1)))
    got = collections.defaultdict(dict)
    for r in grid.hourly_grid(measurements(rows), longest_gap_hours=6, shard_hours=shard).toArrow().to_pylist():
        assert r["hour_start_ms"] not in got[r["sensor_name"]]
        got[r["sensor_name"]][r["hour_start_ms"]] = r
    for s in ("a", "b"):
        by = collections.defaultdict(list)
        for r in rows:
            if r[4] == s:
                by[r[3] // H * H].append(r)
        hours = sorted(by)
        x = np.array([h + np.mean([r[3] - h for r in by[h]]) for h in hours])
        y = np.array([np.mean([r[5] for r in by[h]]) for h in hours])
        cuts = [0, *[i for i in range(1, len(hours)) if hours[i] - hours[i - 1] > 7 * H], len(hours)]
        segments = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
        assert sorted(got[s]) == list(range(hours[0], hours[-1] + 1, H))
        for h, r in got[s].items():
            if h in by:
                assert (r["status"], r["n_readings"]) == ("observed", len(by[h])) and r["value"] == pytest.approx(np.mean([q[5] for q in by[h]]))
                continue
            a = max(k for k in hours if k < h)
            b = min(k for k in hours if k > h)
            assert r["n_readings"] == 0
            if b - a > 7 * H:
                assert (r["status"], r["value"]) == ("gap", None)
            else:
                assert r["status"] == "filled" and r["value"] == pytest.approx(pchip(x, y, h + H / 2, segments), abs=1e-6)
                lo, hi = sorted((y[hours.index(a)], y[hours.index(b)]))
                assert lo - 1e-9 <= r["value"] <= hi + 1e-9  # the shape is kept


def test_grid_awkward(measurements):
    got = grid.hourly_grid(measurements(AWKWARD)).toArrow().to_pylist()
    t = {r["hour_start_ms"]: r["status"] for r in got if r["topic"] == "temperature"}
    assert t == {T0: "observed", T0 + H: "filled", T0 + 2 * H: "filled", T0 + 3 * H: "observed"}
    assert sum(r["topic"] == "humidity" for r in got) == 40 * 24 + 1
    assert grid.hourly_grid(measurements([])).count() == 0


def test_steps(spark):
    df = spark.createDataFrame([(0, 10), (5, 5), (7, 6), (3, 3 + 20_000 * 5)], "a long, b long").withColumn("note", S.lit("x"))
    got = collections.defaultdict(list)
    for r in steps(df, S.col("a"), S.col("b"), 5, "c", block=7).collect():
        got[(r["a"], r["b"])].append(r["c"])
    assert {k: sorted(v) for k, v in got.items()} == {(0, 10): [0, 5, 10], (5, 5): [5], (7, 6): [7], (3, 100_003): list(range(3, 100_004, 5))}


def test_a_far_off_time_makes_rows_but_no_huge_array(measurements):
    far = T0 + 2_000_000 * H  # 228 years on
    rows = [("temperature", 0, 1, T0, "a", 1.0), ("temperature", 0, 2, far, "a", 2.0), ("temperature", 0, 3, far, "a", 2.0)]
    t = grid.hourly_grid(measurements(rows))
    assert t.count() == 2_000_001 and t.filter("hour_start_ms = %d" % far).first()["n_readings"] == 1  # a copy does not count
    assert trailing.activity(measurements(rows)).count() == 2_000_000 // 24 + 1


# trailing


@pytest.mark.parametrize("w", [1, 2, 7, 30])
def test_trailing_is_brute_force(spark, w):
    rng = random.Random(w)
    days = {k: sorted(rng.sample(range(100), n)) for k, n in (("a", 40), ("b", 1), ("c", 90))}
    rows = [("t", k, d, float(rng.randint(1, 9)), rng.randint(1, 5)) for k, ds in days.items() for d in ds]
    df = spark.createDataFrame(rows, "topic string, sensor_name string, day long, day_sum double, day_count long")
    have = {(r[1], r[2]): r for r in rows}
    got = trailing.trailing_totals(df, (w,)).toArrow().to_pylist()
    assert len(got) == sum(ds[-1] - ds[0] + 1 for ds in days.values())
    for r in got:
        part = [have[k] for d in range(r["day"] - w + 1, r["day"] + 1) if (k := (r["sensor_name"], d)) in have]
        total, n = sum(p[3] for p in part), sum(p[4] for p in part)
        assert (r[f"sum_{w}"], r[f"count_{w}"]) == (total, n)
        assert r[f"avg_{w}"] == (pytest.approx(total / n) if n else None)


def test_trailing_awkward(measurements):
    got = {(r["sensor_name"], r["activity_day"]): r for r in trailing.activity(measurements(AWKWARD)).toArrow().to_pylist()}
    assert len(got) == 1 + 41 and got[("a", "2009-01-01")]["day_count"] == 5
    assert got[("", "2009-01-20")]["count_30"] == 1 and got[("", "2009-01-20")]["count_7"] == 0
    assert trailing.activity(measurements([])).count() == 0


# new records


def bookkeeping(spark, runs, reads, points):
    import datetime

    t = lambda s: datetime.datetime(2009, 1, 1, 0, 0, s, tzinfo=datetime.UTC)
    return (
        spark.createDataFrame([(r, s, t(0), t(u)) for r, s, u in runs], "run_id long, run_status string, started_at timestamp, updated_at timestamp"),
        spark.createDataFrame(reads, "run_id long, topic string, channel_tag string, assigned_partitions array<int>"),
        spark.createDataFrame(points, "run_id long, channel_tag string, epoch long, offsets_read map<int,long>"),
    )


def test_committed(spark):
    runs = [(1, "running", 0), (1, " Succeeded ", 5), (2, "succeeded", 1), (2, "failed", 2), (3, "SUCCEEDED", 1), (3, None, 0), (4, None, 3), (5, "succeeded", 1), (5, "running", 1)]
    reads = [(1, "x", "c", [0, 1]), (1, "x", "c", [0, 1]), (2, "x", "c", [0]), (3, "x", "c", [0]), (3, "y", "d", [7]), (4, "x", "c", [0]), (5, "x", "c", [0]), (3, "x", "e", None)]
    points = [
        (1, "c", 9, {0: 50, 1: 60}), (2, "c", 99, {0: 99}), (3, "c", 1, {0: 30, 1: 80}), (3, "c", 2, {}), (3, "c", 2, None), (3, "c", 0, {0: 40}), (3, "d", 0, {7: 5, 0: 1}), (4, "c", 1, {0: 98}), (5, "c", 1, {0: 97}), (3, "c", 1, {0: 30, 1: 80}),
    ]
    got = {(r["topic"], r["kafka_partition"]): r["committed"] for r in incremental.committed_offsets(*bookkeeping(spark, runs, reads, points)).collect()}
    # of run 3 partition 1 was not the reader's; run 5 says two things at once and stays open
    assert got == {("x", 0): 30, ("x", 1): 60, ("y", 7): 5}


def brute_unprocessed(rows, committed):
    seen, out = set(), set()
    for t, p, o, ms, s, r in sorted(rows, key=lambda q: (str(q[0]), str(q[1]), q[2] if q[2] is not None else -1)):
        key = (t, p, s.strip(" ").lower() if s is not None else None, ms, r + 0.0 if r is not None else None)
        whole = None not in key and not math.isnan(r)
        copy = whole and key in seen
        if whole:
            seen.add(key)
        at = committed.get((t, p))
        if not copy and (at is None or o is not None and o > at):
            out.add((t, p, o))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unprocessed_is_brute_force(spark, measurements, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["x", "y"]), rng.choice([0, 1]), o, rng.choice([T0, T0 + 1, None]), rng.choice(["a", " A", None]), rng.choice([1.0, 2.0, NAN, None])) for o in range(200)]
    marks = {("x", 0): 150, ("x", 1): 20}
    df = spark.createDataFrame([(*k, v) for k, v in marks.items()], "topic string, kafka_partition int, committed long")
    got = incremental.unprocessed(spark, measurements(rows), df).select("topic", "kafka_partition", "kafka_offset").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_unprocessed(rows, marks)


def test_unprocessed_awkward(spark, measurements):
    none = spark.createDataFrame([], "topic string, kafka_partition int, committed long")
    rows = [r for r in AWKWARD if r[2] is not None]
    assert {tuple(r) for r in incremental.unprocessed(spark, measurements(rows), none).select("topic", "kafka_partition", "kafka_offset").collect()} == brute_unprocessed(rows, {})
    assert incremental.unprocessed(spark, measurements([]), none).count() == 0


def test_ledger_over_failing_runs(spark, measurements, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y"]), rng.choice([0, 1]), o, rng.choice([T0, T0 + 1, T0 + 3 * D, None]), rng.choice(["a", " A", None]), rng.choice([1.0, -0.0, NAN, None])) for o in range(300)]
    df = measurements(rows)
    at = lambda o, n: spark.createDataFrame([(t, p, o) for t in "xy" for p in (0, 1)], f"topic string, kafka_partition int, {n} long")
    ledger, got = incremental.Ledger(spark, str(tmp_path / "ledger")), []

    def run(i, upto, opened=None, fails=False):
        new = ledger.fresh(df.filter(S.col("kafka_offset") <= upto))
        rows = [tuple(r) for r in new.select("topic", "kafka_partition", "kafka_offset").collect()]
        if fails:  # the pairs are written, the offsets never are
            new.select(*incremental.PAIR, "kafka_offset", S.lit(14245).cast("long").alias("day")).write.partitionBy("day").parquet(str(tmp_path / "ledger" / "pairs" / f"run={i}"))
            return
        got.extend(rows)
        ledger.commit(i, new, at(upto, "upto"), None if opened is None else at(opened, "open_from"))

    run(1, 100)
    run(2, 180, fails=True)
    run(2, 180, opened=120)  # the next run rereads from 120
    assert {tuple(r) for r in ledger.offsets().collect()} == {(t, p, 119, 180) for t in "xy" for p in (0, 1)}
    run(3, 250)
    run(4, 250)
    run(5, 299)
    assert len(got) == len(set(got)) and set(got) == brute_unprocessed(rows, {})


# lateness


def brute_late(rows, marks):
    once = {}
    for r in rows:
        t, p, o, ms, s, v = r
        if None in (t, ms, s, v) or math.isnan(v) or ms < 10**12:
            continue
        key = (t, p, s.strip(" ").lower(), ms, v) if p is not None else (t, o)
        if key not in once or o < once[key][2]:
            once[key] = r
    out = collections.defaultdict(lambda: [0, 0, 0])
    for t, p, o, ms, s, _ in once.values():
        known = [w for mt, mp, mo, w in marks if w is not None and (mt, mp) == (t, p) and mo < o]
        w = max(known) if known else None
        hour = ms // H * H
        state = 0 if w is None or w < hour + H else 1 if ms >= w - 6 * H else 2
        out[(t, s.strip(" ").lower(), hour)][state] += 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("bucket, span", [(1, 2), (7, 3), (4096, 4096)])
def test_lateness_is_brute_force(spark, measurements, bucket, span):
    import datetime

    rng = random.Random(bucket)
    rows = [(rng.choice(["x", "y"]), rng.choice([0, 1]), o, T0 + rng.randint(0, 120) * H // 12, rng.choice(["a", "B "]), rng.choice([1.0, 2.0])) for o in rng.sample(range(1000), 150)]
    marks = [(rng.choice(["x", "y"]), rng.choice([0, 1]), rng.randint(0, 1000), rng.choice([None, T0 + rng.randint(0, 24) * H])) for _ in range(40)]
    cp = spark.createDataFrame([(t, p, 0, o, None if w is None else datetime.datetime.fromtimestamp(w / 1000, datetime.UTC), 1) for t, p, o, w in marks], "topic string, kafka_partition int, epoch long, as_of_offset long, watermark timestamp, open_frames int")
    out = lateness.hourly_with_late(measurements(rows), cp, bucket=bucket, span=span).collect()
    got = {(r["topic"], r["sensor_name"], r["window_start_ms"]): (r["provisional_count"], r["n_late_accepted"], r["n_late_dropped"]) for r in out}
    want = brute_late(rows, marks)
    assert {tuple(r) for r in lateness.hourly_with_late(measurements(rows), cp, bucket=bucket, span=span, slice_ms=H).collect()} == {tuple(r) for r in out}  # slices fit together
    assert got == want and any(v[1] for v in want.values()) and any(v[2] for v in want.values())


def test_lateness_awkward(spark, measurements):
    cp = spark.createDataFrame([], "topic string, kafka_partition int, epoch long, as_of_offset long, watermark timestamp, open_frames int")
    got = lateness.hourly_with_late(measurements(AWKWARD), cp).collect()
    assert sum(r["final_count"] for r in got) == 7 and all(r["n_late_accepted"] == 0 for r in got)
    assert lateness.hourly_with_late(measurements([]), cp).count() == 0


# faults


def course(n, seed, noise=0.3, step=600_000):
    rng = np.random.default_rng(seed)
    t = T0 + np.cumsum(rng.integers(step // 2, step * 3 // 2, n))
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = 0.6 * e[i - 1] + rng.normal(0, noise)
    return t.astype(float), np.round(60 + 5 * np.sin(2 * np.pi * t / D) + e, 2)


def test_spikes_stuck_and_limits():
    t, x = course(2000, 1)
    planted = {100: 15.0, 400: -12.0, 900: 9.0, 901: 9.5, 902: 8.7, 1500: 400.0}
    for i, a in planted.items():
        x[i] += a
    x[1200:1240] = x[1200]
    x[1205] += 0.01
    x[1700] = -500.0
    x[1800:] += 6.0  # a lasting change is none
    f = robust_ar.find_faults(x, t, -459.67, 500.0)
    assert set(np.flatnonzero(f == robust_ar.SPIKE)) == set(planted)
    assert set(np.flatnonzero(f == robust_ar.STUCK)) == set(range(1200, 1240))
    assert set(np.flatnonzero(f == robust_ar.LIMIT)) == {1700}


@pytest.mark.parametrize("length", [1, 2, 4, 5, 6, 8])
def test_excursions_of_any_brief_length(length):
    t, x = course(2000, length)
    own = np.zeros(len(x), bool)
    for i in range(100, 1900, 150):
        x[i : i + length] += 12.0 if i % 300 else -12.0
        own[i : i + length] = True
    assert (robust_ar.find_faults(x, t, -459.67, 500.0) == np.where(own, robust_ar.SPIKE, robust_ar.NONE)).all()


def test_neighbouring_excursions_and_corrections():
    t, x = course(1500, 9)
    x[[300, 301, 302, 304, 305, 306]] += 15.0  # two excursions with one reading between
    x[700:703] += 15.0
    t[703], x[703] = t[702], x[702] + 0.5  # a correction at the time of the last one
    f = robust_ar.find_faults(x, t, -459.67, 500.0)
    assert set(np.flatnonzero(f == robust_ar.SPIKE)) == {300, 301, 302, 304, 305, 306, 700, 701, 702, 703}


@pytest.mark.parametrize("seed", range(5))
def test_clean_series_have_none(seed):
    t, x = course(3000, seed)
    assert not robust_ar.find_faults(x, t, -459.67, 500.0).any()
    assert not robust_ar.find_faults(np.round(x), t, -459.67, 500.0).any()  # a coarse series holds by itself


def test_short_and_constant_series():
    for x in ([], [1.0], [50.0] * 4, [50.0] * 300, [50.0, 50.1, 50.2, 49.9, 50.0, 50.3, 90.0, 50.1, 50.0, 49.8]):
        f = robust_ar.find_faults(np.array(x), T0 + H * np.arange(len(x), dtype=float), -459.67, 500.0)
        assert len(f) == len(x)
    assert list(np.flatnonzero(f)) == [6]


def test_faults_over_shards(spark, measurements):
    t, x = course(1500, 3)
    x[[300, 777, 778, 1400]] += 20
    x[1000:1040] = x[1000]
    rows = [("temperature", i % 3, i, int(t[i]), " S" if i % 5 else "s", float(x[i])) for i in range(len(x))]
    rows += [rows[777], ("temperature", 0, 9000, T0, None, 9999.0), ("temperature", 0, 9001, None, "s", -999.0), ("humidity", 0, 1, T0, "h", 1.5), ("humidity", 0, 2, T0, "h", 0.5), ("other", 0, 1, T0, "o", -1e9), (None, 0, 1, T0, "o", 5.0), ("temperature", 0, 5, T0, "s", None), ("temperature", 0, 5, T0, "s", NAN)]
    whole = {(r["msg_id"], r["kind"]) for r in faults.find_faults(measurements(rows)).collect()}
    kinds = dict(whole)
    assert {i for i, k in whole if k == "spike"} == {300, 777, 778, 1400, 1500}
    assert {i for i, k in whole if k == "stuck"} == set(range(1000, 1040))
    assert {i for i, k in whole if k == "impossible"} == {1501, 1502, 1503} and len(kinds) == len(whole)
    # cut into shards of some hundred rows it finds the same
    cut = [(r["msg_id"], r["kind"]) for r in faults.find_faults(measurements(rows), shard_rows=400, halo_rows=64).collect()]
    assert len(cut) == len(set(cut)) and set(cut) == whole
    assert faults.find_faults(measurements([])).count() == 0


def test_stuck_over_shard_borders(spark, measurements):
    rng = np.random.default_rng(4)
    n = 1290
    t = T0 + 600_000 * np.arange(n)
    x = np.round(60 + rng.normal(0, 1, n), 2)
    coarse = np.repeat(rng.integers(50, 60, n), rng.integers(3, 9, n))[:n].astype(float)  # holds by itself, so only long stretches count
    x[385:420] = 61.5  # across a border
    x[1230:] = 58.25 + rng.normal(0, 0.01, n - 1230)  # all of a short tail, with slight jitter
    coarse[300:900] = 55.0  # longer than a shard and its halo
    rows = [("temperature", 0, i, int(t[i]), s, float(v[i])) for s, v in (("fine", x), ("coarse", coarse)) for i in range(n)]

    def stuck(**how):
        return {r["msg_id"] for r in faults.find_faults(measurements(rows), **how).collect() if r["kind"] == "stuck"}

    want = {*range(385, 420), *range(1230, n), *range(n + 300, n + 900)}
    whole, cut = stuck(), stuck(shard_rows=400, halo_rows=12)
    assert want <= whole and cut == whole and len(whole - want) < 20
