"""The queries of this subpackage, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import packing, quantiles, subjects, tokenize
from millrace.operators.series import DAY_MS, without_copies
from millrace.operators.spread import spread
from millrace.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
SERIES_DAY = ["topic", "sensor_name", "day"]
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _daily_sketch(spark: SparkSession, d: str) -> DataFrame:
    u = without_copies(table(spark, d, "measurements")).withColumn("day", F.floor(F.col("ms") / DAY_MS).cast("long"))
    return quantiles.sketch(u, SERIES_DAY, "reading")


def _named(days: DataFrame) -> DataFrame:
    day = F.date_format(F.timestamp_millis(F.col("day") * DAY_MS), "yyyy-MM-dd").alias("activity_day")
    return days.select("topic", "sensor_name", day, *[c for c in days.columns if c not in SERIES_DAY])


def _rounded(t: DataFrame) -> DataFrame:
    return t.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])


def p1_daily(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each series and day, within 1 % of the value of that rank; rounded for comparison."""
    return _rounded(_named(quantiles.percentiles(_daily_sketch(spark, d), SERIES_DAY, QUANTILES)))


def p1_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The buckets that :func:`p1_daily` takes its percentiles from."""
    return _named(quantiles.percentile_buckets(_daily_sketch(spark, d), SERIES_DAY, QUANTILES))


def p1_period(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each series over all days, combined from the daily sketches; rounded for comparison."""
    keys = ["topic", "sensor_name"]
    return _rounded(quantiles.percentiles(quantiles.combine(_daily_sketch(spark, d), keys), keys, QUANTILES))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, table(spark, d, "documents").select("doc_id", "text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(_documents(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each text, or of each piece of one over 2,048 tokens."""
    return packing.pack(spark, tokenize.count_tokens(_documents(spark, d)), 2048)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    t = [table(spark, d, x) for x in ("subjects", "subject_labels")]
    return subjects.assign(spark, _documents(spark, d), *t).select("doc_id", "subject")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_daily, p1_buckets, p1_period, p7_ids, p8_containers, p9_found)}

_LG = quantiles._shape(quantiles.ALPHA)
_BUCKET = f"""CASE WHEN reading = 0 THEN 0 WHEN isinf(reading) THEN sign(reading) * {_LG[2]}
    ELSE sign(reading) * (ceil(ln(abs(reading)) / {_LG[0]!r}) + {_LG[1]}) END"""
_AT = ", ".join(f"CAST(min(CASE WHEN upto >= greatest(ceil(total * CAST({q} AS DOUBLE)), 1) THEN bucket END) AS INTEGER) AS b{quantiles.percentile_name(q)[1:]}" for q in QUANTILES)

_MIDDLE = f"CASE WHEN b = 0 THEN 0 WHEN abs(b) = {_LG[2]} THEN sign(b) * CAST('inf' AS DOUBLE) ELSE sign(b) * exp((abs(b) - {_LG[1]}) * {_LG[0]!r} + {math.log(2 / (math.exp(_LG[0]) + 1))!r}) END"
_NAMES = [quantiles.percentile_name(q) for q in QUANTILES]


def _buckets(day: str) -> str:
    """Ranks of buckets by series, and by ``day`` if it is given."""
    return f"""WITH c AS (SELECT DISTINCT topic, lower(trim(sensor_name, ' ')) AS sensor_name, occurred_at_ms AS ms, reading, kafka_partition FROM measurements
  WHERE topic IS NOT NULL AND sensor_name IS NOT NULL AND occurred_at_ms >= 1000000000000 AND reading IS NOT NULL AND NOT isnan(reading)),
k AS (SELECT topic, sensor_name, {day or "0"} AS day, {_BUCKET} AS bucket, count(*) AS n FROM c GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY topic, sensor_name, day ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY topic, sensor_name, day) AS total FROM k),
q AS (SELECT topic, sensor_name, day, CAST(max(total) AS BIGINT) AS n_values, {_AT} FROM r GROUP BY topic, sensor_name, day)"""


_DAY = "strftime(make_date(CAST(day AS INTEGER)), '%Y-%m-%d') AS activity_day"
_VALUES = ", ".join(f"round({_MIDDLE.replace('(b)', f'(b{n[1:]})').replace('WHEN b =', f'WHEN b{n[1:]} =')}, 6) AS {n}" for n in _NAMES)

SQL: dict[str, str] = {
    "p1_buckets": f"{_buckets('ms // 86400000')} SELECT topic, sensor_name, {_DAY}, n_values, {', '.join('b' + n[1:] for n in _NAMES)} FROM q",
    "p1_daily": f"{_buckets('ms // 86400000')} SELECT topic, sensor_name, {_DAY}, n_values, {_VALUES} FROM q",
    "p1_period": f"{_buckets('')} SELECT topic, sensor_name, n_values, {_VALUES} FROM q",
}
