"""Coverage of recorded captures: periods and gaps per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.intervals import interval_gaps, interval_periods
from foliospark.plans.registry import Registry
from foliospark.sources.tables import micros, table

KEYS = ["capture_id", "series"]

INTERVALS_SQL = """
WITH bounds AS (
  SELECT * FROM (SELECT capture_id, epoch_us(capture_started_at) AS lo, epoch_us(capture_ended_at) AS hi, process_tracks, interruptions,
    row_number() OVER (PARTITION BY capture_id ORDER BY saved_at DESC NULLS LAST) AS rn FROM capture_requests WHERE capture_id IS NOT NULL)
  WHERE rn = 1 AND lo IS NOT NULL AND hi IS NOT NULL),
raw AS (
  SELECT b.capture_id, 'microphone' AS series, epoch_us(m.started_at) AS s, epoch_us(m.ended_at) AS e, lo, hi
  FROM microphone_segments m JOIN bounds b ON m.capture_id = b.capture_id
  UNION ALL
  SELECT capture_id, 'process', epoch_us(t.started_at), hi, lo, hi FROM (SELECT *, unnest(process_tracks) AS t FROM bounds)
  UNION ALL
  SELECT capture_id, 'interruption', epoch_us(t.started_at), epoch_us(t.ended_at), lo, hi FROM (SELECT *, unnest(interruptions) AS t FROM bounds)),
iv AS (
  SELECT DISTINCT capture_id, series, greatest(s, lo) AS s, least(e, hi) AS e, lo, hi FROM raw
  WHERE s IS NOT NULL AND e IS NOT NULL AND e > s AND least(e, hi) > greatest(s, lo)),
runs AS (
  SELECT *, max(e) OVER (PARTITION BY capture_id, series ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv)
"""

GAPS_SQL = INTERVALS_SQL + """
SELECT capture_id, series, coalesce(before, lo) AS gap_start_us, s AS gap_end_us FROM runs WHERE coalesce(before, lo) < s
UNION ALL
SELECT capture_id, series, max(e), max(hi) FROM iv GROUP BY capture_id, series HAVING max(e) < max(hi)
"""

PERIODS_SQL = INTERVALS_SQL + """,
marked AS (
  SELECT *, sum(CASE WHEN before IS NULL OR before < s THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, series ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM runs)
SELECT capture_id, series, min(s) AS period_start_us, max(e) AS period_end_us FROM marked GROUP BY capture_id, series, island
"""


def capture_intervals(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """All intervals of all series with their capture's bounds: (capture_id, series, s, e, lo, hi) in microseconds.

    The latest save of a capture counts. Null ids, times and arrays give no rows.
    """
    latest = (
        requests.filter(F.col("capture_id").isNotNull())
        .groupBy("capture_id")
        .agg(F.max_by(F.struct("capture_started_at", "capture_ended_at", "process_tracks", "interruptions"), F.coalesce(micros("saved_at"), F.lit(-(2**62)))).alias("r"))
        .select("capture_id", micros("r.capture_started_at").alias("lo"), micros("r.capture_ended_at").alias("hi"), "r.process_tracks", "r.interruptions")
        .filter("lo is not null and hi is not null")
    )
    mic = segments.select("capture_id", micros("started_at").alias("s"), micros("ended_at").alias("e")).join(latest.select("capture_id", "lo", "hi"), "capture_id").withColumn("series", F.lit("microphone"))
    process = latest.select("capture_id", "lo", "hi", F.explode("process_tracks").alias("t")).select("capture_id", "lo", "hi", micros("t.started_at").alias("s"), F.col("hi").alias("e"), F.lit("process").alias("series"))
    stops = latest.select("capture_id", "lo", "hi", F.explode("interruptions").alias("t")).select("capture_id", "lo", "hi", micros("t.started_at").alias("s"), micros("t.ended_at").alias("e"), F.lit("interruption").alias("series"))
    return mic.unionByName(process).unionByName(stops)


def _intervals(spark: SparkSession, folder: str) -> DataFrame:
    return capture_intervals(table(spark, folder, "capture_requests"), table(spark, folder, "microphone_segments", "capture_id", "started_at", "ended_at"))


def register(to: Registry) -> None:
    """Add the queries on captures."""

    @to.query("p4_found", GAPS_SQL)
    def p4_found(spark: SparkSession, folder: str) -> DataFrame:
        gaps = interval_gaps(_intervals(spark, folder), KEYS, "s", "e", "lo", "hi")
        return gaps.withColumnsRenamed({"gap_start": "gap_start_us", "gap_end": "gap_end_us"})

    @to.query("p4_periods", PERIODS_SQL)
    def p4_periods(spark: SparkSession, folder: str) -> DataFrame:
        periods = interval_periods(_intervals(spark, folder), KEYS, "s", "e", "lo", "hi")
        return periods.withColumnsRenamed({"period_start": "period_start_us", "period_end": "period_end_us"})
