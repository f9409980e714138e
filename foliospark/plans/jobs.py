"""Queries of the queue, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.text import clock, natural_key, short_id
from foliospark.operators import timeline as L
from foliospark.operators import views as V
from foliospark.plans.registry import Registry
from foliospark.sources import corpus, sinks
from foliospark.sources.tables import micros, table
from foliospark.streaming import queue as J

_KINDS = {"view": "submit", "click": "claim", "signup": "heartbeat", "purchase": "complete", "error": "fail"}


def queue_events(events: DataFrame) -> DataFrame:
    """The event table read as a queue: users are recipes, event kinds queue calls, every third number one job."""
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    kind = F.try_element_at(kinds, F.col("event_type"))
    job = F.concat(F.lit("job-"), (F.col("event_id") % 3).cast("string"))
    rows = events.select(F.col("user_id").cast("string").alias("recipe"), F.floor(micros("ts") / 1_000_000).alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind != "claim", job).alias("job"), F.col("props").alias("body"))
    # Calls name the attempt of the last claim before them, but every fifth, which names an older one.
    last = F.last(F.when(F.col("kind") == "claim", F.col("seq")), ignorenulls=True).over(W.partitionBy("recipe").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, 0))
    token = F.when((F.col("kind") != "submit") & F.col("job").isNotNull(), F.concat(F.when(F.col("seq") % 5 == 0, F.lit("0")).otherwise(last.cast("string")), F.lit("-"), "job"))
    return rows.select("recipe", "at", "seq", "kind", "job", token.alias("attempt"), "body", F.lit(True).alias("document"), F.lit(2).alias("capacity"))


def register(to: Registry) -> None:
    """Add the queue, source and sink queries."""

    @to.query("queue_decisions")
    def queue_decisions(spark: SparkSession, folder: str) -> DataFrame:
        return J.decide_batch(queue_events(table(spark, folder, "events")))

    @to.query(
        "job_reconciliation",
        "WITH j AS (SELECT o_orderkey AS job, o_orderstatus AS f, CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'current' END AS s, o_orderkey % 10 < 4 AS x FROM orders WHERE o_orderkey % 5 <> 0), w AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus END AS f FROM orders WHERE o_orderkey % 11 <> 0) "
        "SELECT coalesce(j.job, w.job) AS job, CASE WHEN w.job IS NULL THEN 'removed' WHEN j.job IS NULL OR j.f <> w.f THEN 'queued' WHEN s = 'running' AND x THEN 'queued' ELSE s END AS status FROM j FULL JOIN w ON j.job = w.job",
    )
    def job_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
        jobs = rows.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("fingerprint"), F.when(F.col("o_orderkey") % 2 == 0, "running").otherwise("current").alias("status"), (F.col("o_orderkey") % 10 < 4).alias("expired"))
        wanted = rows.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderkey") % 7 == 0, "changed").otherwise(F.col("o_orderstatus")).alias("fingerprint"))
        return J.reconcile(jobs, wanted)

    @to.query("worker_liveness", "SELECT user_id, max(epoch_us(ts)) AS last_seen_us, (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) < 3600000000 AS alive FROM events GROUP BY 1")
    def worker_liveness(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "events", "user_id", "ts").select("user_id", micros("ts").alias("t"))
        last = rows.groupBy("user_id").agg(F.max("t").alias("last_seen_us"))
        now = rows.agg(F.max("t")).scalar()
        return last.select("user_id", "last_seen_us", (now - F.col("last_seen_us") < 3_600_000_000).alias("alive"))

    @to.query(
        "document_order",
        "SELECT path, row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(x, 12, '0') ELSE x END), '') NULLS LAST, path NULLS LAST) AS position FROM documents",
    )
    def document_order(spark: SparkSession, folder: str) -> DataFrame:
        return V.numbered(table(spark, folder, "documents", "path"), [natural_key("path"), F.col("path")], "position")

    @to.query("short_ids", "SELECT meeting_id, right(regexp_replace(meeting_id, '[^A-Za-z0-9]', '', 'g'), 12) AS short_id FROM (SELECT DISTINCT meeting_id FROM capture_requests)")
    def short_ids(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "capture_requests", "meeting_id").distinct().select("meeting_id", short_id("meeting_id").alias("short_id"))

    @to.query(
        "document_lines",
        "WITH a AS (SELECT path || ':2-4' AS asked, path FROM documents), l AS (SELECT d.path, asked, unnest(string_split_regex(text, '\\r?\\n')) AS line, unnest(range(1, len(string_split_regex(text, '\\r?\\n')) + 1)) AS line_no FROM documents d JOIN a USING (path)) SELECT asked, line_no, line FROM l WHERE line_no BETWEEN 2 AND 4",
    )
    def document_lines(spark: SparkSession, folder: str) -> DataFrame:
        pages = table(spark, folder, "documents", "path", "text")
        asked = pages.select(F.concat("path", F.lit(":2-4")).alias("asked"))
        return corpus.read_windows(pages, asked).select("asked", F.col("line_no").cast("bigint").alias("line_no"), "line")

    @to.query("object_index", "SELECT sha256(markdown) AS sha256, min(strlen(markdown)) AS size FROM blocks WHERE markdown IS NOT NULL GROUP BY 1")
    def object_index(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "blocks", "markdown").filter("markdown is not null").select(F.sha2("markdown", 256).alias("sha256"), F.octet_length("markdown").alias("size"))
        return rows.groupBy("sha256").agg(F.min("size").alias("size"))

    @to.query(
        "book_chapters",
        "WITH p AS (SELECT book_id, page_no, max(CASE WHEN kind = 'title' THEN markdown END) AS t FROM blocks GROUP BY 1, 2), c AS (SELECT *, sum(CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS chapter_no FROM p) SELECT book_id, chapter_no, max(t) AS title, min(page_no) AS first_page, max(page_no) AS last_page FROM c GROUP BY 1, 2",
    )
    def book_chapters(spark: SparkSession, folder: str) -> DataFrame:
        pages = table(spark, folder, "blocks", "book_id", "page_no", "kind", "markdown").groupBy("book_id", "page_no").agg(F.max(F.when(F.col("kind") == "title", F.col("markdown"))).alias("t"))
        return sinks.chapters_of(pages, "book_id", "page_no", "t")

    @to.query(
        "book_files",
        "WITH r AS (SELECT book_id, page_no, arg_min(raw, observation_id) AS raw FROM ocr_observations GROUP BY 1, 2), c AS (SELECT book_id, (page_no - 1) // 10 AS ch, strlen(string_agg(raw, chr(10) || chr(10) ORDER BY page_no)) AS b FROM r WHERE raw IS NOT NULL GROUP BY 1, 2), "
        "s AS (SELECT *, sum(b) OVER (PARTITION BY book_id) > 262144 AND count(*) OVER (PARTITION BY book_id) >= 2 AS split FROM c) SELECT book_id, printf('chapter-%03d.md', ch::INT) AS file, b AS bytes FROM s WHERE split UNION ALL SELECT book_id, 'index.md', sum(6 + 2 * strlen(printf('chapter-%03d.md', ch::INT))) + count(*) - 1 FROM s WHERE split GROUP BY 1 UNION ALL SELECT book_id, 'book.md', sum(b) + 2 * (count(*) - 1) FROM s WHERE NOT split GROUP BY 1",
    )
    def book_files(spark: SparkSession, folder: str) -> DataFrame:
        reads = table(spark, folder, "ocr_observations", "observation_id", "book_id", "page_no", "raw").groupBy("book_id", "page_no").agg(F.min_by("raw", "observation_id").alias("raw"))
        pages = reads.withColumn("chapter", F.floor((F.col("page_no") - 1) / 10))
        return sinks.book_files(pages, "book_id", "page_no", "raw", "chapter").select("book_id", "file", "bytes")

    @to.query("capture_transcripts")
    def capture_transcripts(spark: SparkSession, folder: str) -> DataFrame:
        seg = table(spark, folder, "microphone_segments", "segment_id", "capture_id", "segment_no", "device", "started_at", "ended_at").distinct()
        bounds = table(spark, folder, "capture_requests", "capture_id", "capture_started_at").groupBy("capture_id").agg(F.min("capture_started_at").alias("c"))
        rows = seg.join(bounds, "capture_id").select("segment_id", "capture_id", "device", ((micros("started_at") - micros("c")) / 1e6).alias("s"), ((micros("ended_at") - micros("c")) / 1e6).alias("e"), F.concat(F.lit("segment "), "segment_no").alias("text")).filter("e > s and s >= 0")
        runs = L.coalesce_runs(L.runs(rows, ["capture_id"], ["device"], "s", "e", L.GAP, ["segment_id"]), ["capture_id", "device"], "s", "e", "text", ["segment_id"])
        return sinks.transcript_lines(runs, ["capture_id"], "device", "s", "text")

    @to.query("clock_texts", "SELECT event_id, lpad((c // 360000)::VARCHAR, 2, '0') || ':' || lpad((c // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((c // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS clock FROM (SELECT event_id, round_even(abs(value) * 3700, 0)::BIGINT AS c FROM events)")
    def clock_texts(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "events", "event_id", "value").select("event_id", clock(F.abs("value") * 37).alias("clock"))
