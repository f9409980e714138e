"""Queries over event and segment time lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators import timeline as L
from foliospark.plans.registry import Registry
from foliospark.sources.tables import micros, table

_SEG = "seg AS (SELECT DISTINCT segment_id, capture_id, segment_no, device, epoch_us(started_at) / 1e6 AS s, epoch_us(ended_at) / 1e6 AS e FROM microphone_segments WHERE started_at IS NOT NULL AND ended_at > started_at)"
_RUNS = f"""WITH {_SEG},
a AS (SELECT *, CASE WHEN device IS NOT DISTINCT FROM lag(device) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM seg WINDOW w AS (PARTITION BY capture_id ORDER BY s, e, segment_id)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY capture_id ORDER BY s, e, segment_id ROWS UNBOUNDED PRECEDING) AS island FROM a),
c AS (SELECT *, max(e) OVER (PARTITION BY capture_id, island ORDER BY s, e, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b),
d AS (SELECT *, sum(CASE WHEN top IS NULL OR s - top > 1.25 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY s, e, segment_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
"""


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "microphone_segments", "segment_id", "capture_id", "segment_no", "device", "started_at", "ended_at").distinct()
    return rows.select("segment_id", "capture_id", "segment_no", "device", (micros("started_at") / 1e6).alias("s"), (micros("ended_at") / 1e6).alias("e")).filter("e > s")


def register(to: Registry) -> None:
    """Add the time line queries."""

    @to.query("device_runs", _RUNS + "SELECT capture_id, run, device, round(min(s), 3) AS s, round(max(e), 3) AS e, count(*) AS n_rows FROM d GROUP BY 1, 2, 3")
    def device_runs(spark: SparkSession, folder: str) -> DataFrame:
        rows = L.runs(_segments(spark, folder), ["capture_id"], ["device"], "s", "e", L.GAP, ["segment_id"])
        out = L.coalesce_runs(rows, ["capture_id", "device"], "s", "e")
        return out.select("capture_id", "run", "device", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"), "n_rows")

    @to.query("transcript_runs", _RUNS + "SELECT capture_id, run, string_agg(segment_no::VARCHAR, ' ' ORDER BY s, e, segment_id) AS numbers FROM d GROUP BY 1, 2")
    def transcript_runs(spark: SparkSession, folder: str) -> DataFrame:
        rows = L.runs(_segments(spark, folder), ["capture_id"], ["device"], "s", "e", L.GAP, ["segment_id"]).withColumn("numbers", F.col("segment_no").cast("string"))
        return L.coalesce_runs(rows, ["capture_id"], "s", "e", "numbers", ["segment_id"]).select("capture_id", "run", "numbers")

    @to.query(
        "event_sessions",
        """WITH a AS (SELECT *, epoch_us(ts) / 1e6 AS s FROM events), b AS (SELECT user_id, s, event_id, CASE WHEN s - lag(s) OVER w <= 21600 THEN 0 ELSE 1 END AS n FROM a WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
        c AS (SELECT user_id, s, sum(n) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT user_id, run, count(*) AS n_rows, round(max(s) - min(s), 3) AS seconds FROM c GROUP BY 1, 2""",
    )
    def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "events", "event_id", "user_id", "ts").select("event_id", "user_id", (micros("ts") / 1e6).alias("s")).withColumn("e", F.col("s"))
        out = L.coalesce_runs(L.runs(rows, ["user_id"], [], "s", "e", 21600, ["event_id"]), ["user_id"], "s", "e")
        return out.select("user_id", "run", "n_rows", F.round(F.col("e") - F.col("s"), 3).alias("seconds"))

    @to.query(
        "device_overlaps",
        f"WITH {_SEG} SELECT a.capture_id, a.segment_id, b.segment_id AS other_id, round(least(a.e, b.e) - greatest(a.s, b.s), 3) AS overlap FROM seg a JOIN seg b ON a.capture_id = b.capture_id AND a.segment_id < b.segment_id AND least(a.e, b.e) > greatest(a.s, b.s)",
    )
    def device_overlaps(spark: SparkSession, folder: str) -> DataFrame:
        seg = _segments(spark, folder).select("segment_id", "capture_id", "s", "e")
        pairs = L.overlap_join(seg, seg, ["capture_id"], 120.0).filter("segment_id < segment_id_r")
        return pairs.select("capture_id", "segment_id", F.col("segment_id_r").alias("other_id"), F.round("overlap", 3).alias("overlap"))

    @to.query("clean_segments", f"WITH {_SEG} SELECT segment_id FROM seg a WHERE e - s >= 30 AND NOT EXISTS (SELECT 1 FROM seg b WHERE b.capture_id = a.capture_id AND b.device IS DISTINCT FROM a.device AND least(a.e, b.e) > greatest(a.s, b.s))")
    def clean_segments(spark: SparkSession, folder: str) -> DataFrame:
        seg = _segments(spark, folder).select("segment_id", "capture_id", "device", "s", "e")
        hit = L.overlap_join(seg, seg, ["capture_id"], 120.0).filter(~F.col("device").eqNullSafe(F.col("device_r"))).select("segment_id").distinct()
        return seg.filter("e - s >= 30").join(hit, "segment_id", "left_anti").select("segment_id")

    ints = "ints AS (SELECT DISTINCT capture_id, epoch_us(t.started_at) / 1e6 AS s, epoch_us(t.ended_at) / 1e6 AS e, coalesce(t.reason, '') AS reason FROM (SELECT capture_id, unnest(interruptions) AS t FROM capture_requests) WHERE t.ended_at > t.started_at)"

    def interruptions(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "capture_requests", "capture_id", "interruptions").select("capture_id", F.explode("interruptions").alias("t"))
        return rows.select("capture_id", (micros("t.started_at") / 1e6).alias("s"), (micros("t.ended_at") / 1e6).alias("e"), F.coalesce("t.reason", F.lit("")).alias("reason")).filter("e > s").distinct()

    @to.query(
        "reason_by_overlap",
        f"WITH {_SEG}, {ints}, p AS (SELECT segment_id, reason, round(sum(least(a.e, b.e) - greatest(a.s, b.s)), 6) AS overlap FROM seg a JOIN ints b ON a.capture_id = b.capture_id AND least(a.e, b.e) > greatest(a.s, b.s) GROUP BY 1, 2), "
        "r AS (SELECT *, row_number() OVER w AS n, lead(overlap) OVER w AS second FROM p WINDOW w AS (PARTITION BY segment_id ORDER BY overlap DESC, reason)) SELECT segment_id, reason, round(overlap, 3) AS overlap, coalesce(overlap - second <= 1e-6, false) AS ambiguous FROM r WHERE n = 1",
    )
    def reason_by_overlap(spark: SparkSession, folder: str) -> DataFrame:
        pairs = L.overlap_join(_segments(spark, folder).select("segment_id", "capture_id", "s", "e"), interruptions(spark, folder), ["capture_id"], 120.0)
        total = pairs.groupBy("segment_id", "reason_r").agg(F.round(F.sum("overlap"), 6).alias("overlap"))
        return L.best_overlap(total, ["segment_id"], "reason_r").select("segment_id", F.col("reason_r").alias("reason"), F.round("overlap", 3).alias("overlap"), "ambiguous")

    @to.query(
        "segment_hints",
        f"WITH {_SEG}, {ints}, h AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY s, e, reason) AS hint_no FROM ints) SELECT segment_id, min(hint_no) AS hint_no FROM seg a LEFT JOIN h ON a.capture_id = h.capture_id AND (a.s + a.e) / 2 >= h.s AND (a.s + a.e) / 2 < h.e GROUP BY segment_id",
    )
    def segment_hints(spark: SparkSession, folder: str) -> DataFrame:
        hints = interruptions(spark, folder).withColumn("hint_no", F.row_number().over(W.partitionBy("capture_id").orderBy("s", "e", "reason")))
        return L.hint_of_midpoint(_segments(spark, folder).select("segment_id", "capture_id", "s", "e"), hints, ["capture_id"], 120.0).select("segment_id", F.col("hint_no").cast("bigint").alias("hint_no"))

    @to.query(
        "lanes_needed",
        f"WITH {_SEG}, st AS (SELECT capture_id, s AS t, 1 AS d FROM seg UNION ALL SELECT capture_id, e, -1 FROM seg), g AS (SELECT capture_id, t, sum(d) AS d FROM st GROUP BY 1, 2), o AS (SELECT capture_id, sum(d) OVER (PARTITION BY capture_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT capture_id, max(n) AS lanes FROM o GROUP BY 1",
    )
    def lanes_needed(spark: SparkSession, folder: str) -> DataFrame:
        return L.lanes_needed(_segments(spark, folder), ["capture_id"], "s", "e")

    # One segment of every capture a step; the state is the list of the lanes' ends.
    @to.query(
        "assigned_lanes",
        f"WITH RECURSIVE {_SEG}, r AS (SELECT capture_id, segment_id, s, e, row_number() OVER (PARTITION BY capture_id ORDER BY s, e, segment_id) AS n FROM seg), "
        "st AS (SELECT capture_id, segment_id, n, [e] AS ends, 0 AS lane FROM r WHERE n = 1 UNION ALL SELECT capture_id, segment_id, n, CASE WHEN p IS NULL THEN list_append(ends, e) ELSE list_concat(list_concat(ends[1:p - 1], [e]), ends[p + 1:]) END, coalesce(p - 1, len(ends)) "
        "FROM (SELECT r.*, st.ends, nullif(list_position(list_transform(st.ends, lambda x: x <= r.s), true), 0) AS p FROM st JOIN r ON r.capture_id = st.capture_id AND r.n = st.n + 1)) SELECT capture_id, segment_id, lane FROM st",
    )
    def assigned_lanes(spark: SparkSession, folder: str) -> DataFrame:
        return L.assign_lanes(_segments(spark, folder), ["capture_id"], "segment_id", "s", "e")

    plan_sql = "len AS (SELECT DISTINCT capture_id, (epoch_us(capture_ended_at) - epoch_us(capture_started_at)) / 1e6 AS d FROM capture_requests WHERE capture_ended_at > capture_started_at), pl AS (SELECT capture_id, d, greatest(1, ceil(d / 600))::BIGINT AS n, unnest(range(0, greatest(1, ceil(d / 600))::BIGINT)) AS w FROM len)"

    @to.query("window_plan", f"WITH {plan_sql} SELECT capture_id, w AS window_no, round(greatest(0, w * d / n - 2) * 1e6)::BIGINT AS s_us, round(least(d, (w + 1) * d / n + 2) * 1e6)::BIGINT AS e_us FROM pl")
    def window_plan(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "capture_requests").select("capture_id", ((micros("capture_ended_at") - micros("capture_started_at")) / 1e6).alias("d")).distinct()
        return L.equal_windows(rows, "capture_id", "d", 600.0).select("capture_id", F.col("window").alias("window_no"), F.round(F.col("s") * 1e6).cast("bigint").alias("s_us"), F.round(F.col("e") * 1e6).cast("bigint").alias("e_us"))

    @to.query(
        "evenly_spaced_segments",
        f"WITH {_SEG}, r AS (SELECT *, count(*) OVER (PARTITION BY capture_id) AS n, row_number() OVER (PARTITION BY capture_id ORDER BY s, e, segment_id) - 1 AS i FROM seg) SELECT capture_id, segment_id FROM r WHERE n <= 5 OR i IN (SELECT round_even(k * (n - 1) / 4.0, 0) FROM (SELECT unnest(range(0, 5)) AS k))",
    )
    def evenly_spaced_segments(spark: SparkSession, folder: str) -> DataFrame:
        return L.evenly_spaced(_segments(spark, folder), ["capture_id"], [F.col("s"), F.col("e"), F.col("segment_id")], 5).select("capture_id", "segment_id")

    @to.query(
        "out_of_order",
        "WITH s AS (SELECT DISTINCT segment_id, capture_id, segment_no, started_at FROM microphone_segments), g AS (SELECT *, last_value(started_at IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY segment_no, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s) SELECT segment_id FROM g WHERE started_at < p",
    )
    def out_of_order(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "microphone_segments", "segment_id", "capture_id", "segment_no", "started_at").distinct()
        before = F.last("started_at", ignorenulls=True).over(W.partitionBy("capture_id").orderBy("segment_no", "segment_id").rowsBetween(W.unboundedPreceding, -1))
        return rows.withColumn("_p", before).filter("started_at < _p").select("segment_id")

    @to.query("signal_levels", "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS peak, round(least(20 * log10(0.1 / greatest(sqrt(avg(value * value)) / 1000, 1e-9)), 12), 6) AS gain_db FROM events GROUP BY 1")
    def signal_levels(spark: SparkSession, folder: str) -> DataFrame:
        rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
        return table(spark, folder, "events", "event_type", "value").groupBy("event_type").agg(F.round(rms, 6).alias("rms"), F.round(F.max(F.abs("value")), 6).alias("peak"), F.round(F.least(20 * F.log10(0.1 / F.greatest(rms / 1000, F.lit(1e-9))), F.lit(12.0)), 6).alias("gain_db"))
