"""The queries on measurements and the reader's bookkeeping, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import faults, grid, incremental, lateness, trailing
from millrace.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every faulty reading with the kind of its fault."""
    return faults.find_faults(table(spark, d, "measurements"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_faults(spark, d).select("msg_id")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every hour of every series with its value and how it came about; rounded for comparison, a little off the middle between two values."""
    return grid.hourly_grid(table(spark, d, "measurements")).withColumn("value", F.round(F.col("value") + 1.2345e-8, 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.hourly_grid(table(spark, d, "measurements")).filter(F.col("n_readings") == 0).select("topic", "sensor_name", "hour_start_ms")


def p4_committed(spark: SparkSession, d: str) -> DataFrame:
    """The committed offset of each topic and partition."""
    return incremental.committed_offsets(*(table(spark, d, t) for t in ("pipeline_runs", "stream_reads", "batch_reads")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.unprocessed(spark, table(spark, d, "measurements"), p4_committed(spark, d)).select("topic", "kafka_partition", "kafka_offset")


def p5_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the last 7 and 30 days; sums are rounded, and averages taken of these, for comparison."""
    t = trailing.activity(table(spark, d, "measurements"))
    t = t.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])
    return t.withColumns({f"avg_{w}": F.when(F.col(f"count_{w}") > 0, F.col(f"sum_{w}") / F.col(f"count_{w}")) for w in (7, 30)})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = trailing.activity(table(spark, d, "measurements"))
    return t.filter((F.col("day_count") == 0) & (F.col("count_7") > 0)).select("topic", "sensor_name", "activity_day")


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    """Provisional and corrected aggregates for each series and hour; doubles rounded for comparison."""
    t = lateness.hourly_with_late(table(spark, d, "measurements"), table(spark, d, "window_checkpoints"))
    return t.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    t = lateness.hourly_with_late(table(spark, d, "measurements"), table(spark, d, "window_checkpoints"))
    return t.filter(F.col("n_late_accepted") > 0).select("topic", "sensor_name", "window_start_ms")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_faults, p3_found, p3_grid, p4_found, p4_committed, p5_found, p5_trailing, p6_found, p6_windows)}

_USABLE = """
u AS (SELECT topic, lower(trim(sensor_name, ' ')) AS sensor_name, occurred_at_ms AS ms, reading, kafka_partition, kafka_offset
      FROM measurements
      WHERE topic IS NOT NULL AND sensor_name IS NOT NULL AND occurred_at_ms >= 1000000000000 AND reading IS NOT NULL AND NOT isnan(reading))"""
_ONCE = _USABLE + """,
c AS (SELECT topic, sensor_name, ms, reading, kafka_partition, min(kafka_offset) AS kafka_offset FROM u GROUP BY ALL)"""
_DAYS = _ONCE + """,
g AS (SELECT topic, sensor_name, ms // 86400000 AS day, sum(reading) AS day_sum, count(*) AS day_count FROM c GROUP BY ALL),
b AS (SELECT topic, sensor_name, unnest(range(min(day), max(day) + 1)) AS day FROM g GROUP BY topic, sensor_name),
d AS (SELECT b.*, coalesce(day_sum, 0) AS day_sum, coalesce(day_count, 0) AS day_count FROM b LEFT JOIN g USING (topic, sensor_name, day)),
t AS (SELECT *, strftime(make_date(CAST(day AS INTEGER)), '%Y-%m-%d') AS activity_day,
        sum(day_sum) OVER w7 AS sum_7, CAST(sum(day_count) OVER w7 AS BIGINT) AS count_7, sum(day_sum) OVER w30 AS sum_30, CAST(sum(day_count) OVER w30 AS BIGINT) AS count_30
      FROM d WINDOW w7 AS (PARTITION BY topic, sensor_name ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY topic, sensor_name ORDER BY day ROWS 29 PRECEDING))"""
_OFFSETS = """
r AS (SELECT run_id FROM pipeline_runs GROUP BY run_id HAVING bool_and(updated_at < (SELECT max(updated_at) FROM pipeline_runs q WHERE q.run_id = pipeline_runs.run_id) OR coalesce(lower(trim(run_status, ' ')) = 'succeeded', false))),
a AS (SELECT DISTINCT run_id, channel_tag, topic, unnest(assigned_partitions) AS kafka_partition FROM stream_reads),
o AS (SELECT run_id, channel_tag, epoch, e.key AS kafka_partition, e.value AS off FROM (SELECT run_id, channel_tag, epoch, unnest(map_entries(offsets_read)) AS e FROM batch_reads)),
k AS (SELECT topic, kafka_partition, off, row_number() OVER (PARTITION BY topic, kafka_partition ORDER BY run_id DESC, epoch DESC, off) AS n
      FROM o JOIN r USING (run_id) JOIN a USING (run_id, channel_tag, kafka_partition) WHERE off IS NOT NULL),
m AS (SELECT topic, kafka_partition, off AS committed FROM k WHERE n = 1)"""
_LATE = _ONCE + """,
w AS (SELECT topic, kafka_partition, as_of_offset, max(epoch_ms(watermark)) OVER (PARTITION BY topic, kafka_partition ORDER BY as_of_offset) AS wm FROM window_checkpoints WHERE watermark IS NOT NULL),
v AS (SELECT c.*, w.wm, c.ms - c.ms % 3600000 AS window_start_ms FROM c ASOF LEFT JOIN w ON c.topic = w.topic AND c.kafka_partition = w.kafka_partition AND c.kafka_offset > w.as_of_offset),
s AS (SELECT *, CASE WHEN NOT coalesce(wm >= window_start_ms + 3600000, false) THEN 0 WHEN ms >= wm - 21600000 THEN 1 ELSE 2 END AS state FROM v)"""
_RISE = """,
p AS (SELECT *, lag(reading) OVER w AS provisional_before FROM s WHERE state = 0 WINDOW w AS (PARTITION BY topic, sensor_name, window_start_ms ORDER BY ms, kafka_partition, kafka_offset)),
f AS (SELECT *, lag(reading) OVER w AS final_before FROM s WHERE state <= 1 WINDOW w AS (PARTITION BY topic, sensor_name, window_start_ms ORDER BY ms, kafka_partition, kafka_offset)),
pr AS (SELECT topic, sensor_name, window_start_ms, round(coalesce(max(greatest(reading - provisional_before, 0)), 0), 4) AS provisional_rise FROM p GROUP BY ALL),
fr AS (SELECT topic, sensor_name, window_start_ms, round(coalesce(max(greatest(reading - final_before, 0)), 0), 4) AS final_rise FROM f GROUP BY ALL)"""


def _aggs(prefix: str, on: str) -> str:
    f = f"FILTER ({on})"
    return f"""count(*) {f} AS {prefix}_count, round(sum(reading) {f}, 4) AS {prefix}_sum, round(min(reading) {f}, 4) AS {prefix}_min, round(max(reading) {f}, 4) AS {prefix}_max,
        round(arg_min(reading, (ms, kafka_partition, kafka_offset)) {f}, 4) AS {prefix}_first, round(arg_max(reading, (ms, kafka_partition, kafka_offset)) {f}, 4) AS {prefix}_last"""


_END = "CASE WHEN s * {d0} <= 0 THEN 0 WHEN {d0} * {d1} <= 0 AND abs(s) > 3 * abs({d0}) THEN 3 * {d0} ELSE s END"
_GRID = _ONCE + f""",
h AS (SELECT topic, sensor_name, ms - ms % 3600000 AS hour, count(*) AS n, avg(reading) AS y, hour + avg(CAST(ms % 3600000 AS DOUBLE)) AS x FROM c GROUP BY topic, sensor_name, hour),
k AS (SELECT *, lag(hour) OVER w AS ph, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(hour) OVER w AS bh, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(hour, 2) OVER w AS qh, lead(x, 2) OVER w AS qx, lead(y, 2) OVER w AS qy
      FROM h WINDOW w AS (PARTITION BY topic, sensor_name ORDER BY hour)),
i AS (SELECT *, coalesce(bh - hour <= 25200000, false) AS short, coalesce(hour - ph <= 25200000, false) AS l, coalesce(qh - bh <= 25200000, false) AS r,
        bx - x AS d_x, (by_ - y) / (bx - x) AS d, x - px AS hp, (y - py) / (x - px) AS dp, qx - bx AS hq, (qy - by_) / (qx - bx) AS dq FROM k),
e AS (SELECT *, ((2 * d_x + hq) * d - d_x * dq) / (d_x + hq) AS ea, ((2 * d_x + hp) * d - d_x * dp) / (d_x + hp) AS eb FROM i),
t AS (SELECT *, CASE WHEN l THEN CASE WHEN dp * d > 0 THEN (3 * d_x + 3 * hp) / ((2 * d_x + hp) / dp + (d_x + 2 * hp) / d) ELSE 0 END
          WHEN r THEN {_END.replace("s ", "ea ").replace("(s)", "(ea)").format(d0="d", d1="dq")} ELSE d END AS sa,
        CASE WHEN r THEN CASE WHEN d * dq > 0 THEN (3 * hq + 3 * d_x) / ((2 * hq + d_x) / d + (hq + 2 * d_x) / dq) ELSE 0 END
          WHEN l THEN {_END.replace("s ", "eb ").replace("(s)", "(eb)").format(d0="d", d1="dp")} ELSE d END AS sb FROM e),
g AS (SELECT *, unnest(range(hour, coalesce(bh, hour + 1), 3600000)) AS hour_start_ms FROM t),
o AS (SELECT *, hour_start_ms + 1800000 - x AS z FROM g)"""

SQL: dict[str, str] = {
    "p3_grid": f"""WITH {_GRID} SELECT topic, sensor_name, hour_start_ms, CASE WHEN hour_start_ms = hour THEN n ELSE 0 END AS n_readings,
        round(CASE WHEN hour_start_ms = hour THEN y WHEN short THEN y + z * (sa + z * ((3 * d - 2 * sa - sb) / d_x + z * (sa + sb - 2 * d) / (d_x * d_x))) END + 1.2345e-8, 6) AS value,
        CASE WHEN hour_start_ms = hour THEN 'observed' WHEN short THEN 'filled' ELSE 'gap' END AS status FROM o""",
    "p3_found": f"""WITH {_USABLE},
h AS (SELECT topic, sensor_name, ms - ms % 3600000 AS hour_start_ms FROM u GROUP BY ALL),
a AS (SELECT topic, sensor_name, unnest(range(min(hour_start_ms), max(hour_start_ms), 3600000)) AS hour_start_ms FROM h GROUP BY topic, sensor_name)
SELECT * FROM a ANTI JOIN h USING (topic, sensor_name, hour_start_ms)""",
    "p4_committed": f"WITH {_OFFSETS} SELECT * FROM m",
    "p4_found": f"""WITH {_OFFSETS},
l AS (SELECT topic, kafka_partition, kafka_offset,
        reading IS NOT NULL AND NOT isnan(reading) AND sensor_name IS NOT NULL AND occurred_at_ms IS NOT NULL AND topic IS NOT NULL AND kafka_partition IS NOT NULL
        AND row_number() OVER (PARTITION BY topic, kafka_partition, lower(trim(sensor_name, ' ')), occurred_at_ms, reading ORDER BY kafka_offset) > 1 AS copy FROM measurements)
SELECT l.topic, l.kafka_partition, l.kafka_offset FROM l LEFT JOIN m USING (topic, kafka_partition) WHERE NOT copy AND (committed IS NULL OR kafka_offset > committed)""",
    "p5_found": f"WITH {_DAYS} SELECT topic, sensor_name, activity_day FROM t WHERE day_count = 0 AND count_7 > 0",
    "p5_trailing": f"""WITH {_DAYS} SELECT topic, sensor_name, activity_day, round(day_sum, 4) AS day_sum, CAST(day_count AS BIGINT) AS day_count,
        round(sum_7, 4) AS sum_7, count_7, CASE WHEN count_7 > 0 THEN round(sum_7, 4) / count_7 END AS avg_7,
        round(sum_30, 4) AS sum_30, count_30, CASE WHEN count_30 > 0 THEN round(sum_30, 4) / count_30 END AS avg_30 FROM t""",
    "p6_found": f"WITH {_LATE} SELECT DISTINCT topic, sensor_name, window_start_ms FROM s WHERE state = 1",
    "p6_windows": f"""WITH {_LATE}{_RISE}, a AS (SELECT topic, sensor_name, window_start_ms, {_aggs("provisional", "WHERE state = 0")}, {_aggs("final", "WHERE state <= 1")},
        count(*) FILTER (WHERE state = 1) AS n_late_accepted, count(*) FILTER (WHERE state = 2) AS n_late_dropped FROM s GROUP BY topic, sensor_name, window_start_ms)
        SELECT a.*, provisional_rise, final_rise FROM a LEFT JOIN pr USING (topic, sensor_name, window_start_ms) LEFT JOIN fr USING (topic, sensor_name, window_start_ms)""",
}
