"""Queries that assemble page reads into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import documents as D
from foliospark.operators import repairs as R
from foliospark.plans.registry import Registry
from foliospark.sources.tables import table

_FIRST = "r AS (SELECT book_id, page_no, arg_min(raw, observation_id) AS raw FROM ocr_observations GROUP BY 1, 2)"


def _reads(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_observations", "observation_id", "book_id", "page_no", "raw").groupBy("book_id", "page_no").agg(F.min_by("raw", "observation_id").alias("raw"))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks", "block_id", "observation_id", "book_id", "page_no", "ordinal", "kind", "markdown", "bbox").distinct()


def register(to: Registry) -> None:
    """Add the assembly queries."""

    @to.query("pipe_tables")
    def pipe_tables(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).filter(F.col("markdown").rlike("(?i)<table"))
        return rows.select("block_id", D.pipe_table("markdown").alias("pipe"))

    @to.query("formula_spans", "SELECT page_id, CASE WHEN m.display THEN 'display' ELSE 'inline' END AS kind, substring(text, m.content_start + 1, m.content_end - m.content_start) AS content FROM (SELECT page_id, any_value(text) AS text, unnest(any_value(math_spans)) AS m FROM parsed_pages GROUP BY page_id)")
    def formula_spans(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "parsed_pages", "page_id", "text", "math_spans").filter("math_spans is not null").dropDuplicates(["page_id"])
        return rows.select("page_id", F.explode(D.math_spans("text")).alias("m")).select("page_id", "m.kind", "m.content")

    @to.query("title_cased")
    def title_cased(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).filter("kind in ('title', 'header')")
        return rows.select("block_id", D.title_case("markdown").alias("title"))

    @to.query(
        "title_anchors",
        r"WITH b AS (SELECT DISTINCT block_id, book_id, markdown FROM blocks WHERE kind = 'title'), s AS (SELECT *, regexp_replace(regexp_replace(lower(trim(markdown)), '[^\p{L}\p{N}_\s-]', '', 'g'), '\s', '-', 'g') AS s FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY book_id, s ORDER BY block_id) - 1 AS n FROM s) SELECT block_id, CASE WHEN n > 0 THEN s || '-' || n ELSE s END AS anchor FROM n",
    )
    def title_anchors(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).filter("kind = 'title'")
        return D.anchors(rows, ["book_id"], "block_id", "markdown").select("block_id", "anchor")

    @to.query(
        "paragraph_joins",
        rf"WITH {_FIRST}, l AS (SELECT book_id, page_no, trim(regexp_replace(raw, '<\|ref\|>.*?<\|/ref\|><\|det\|>.*?<\|/det\|>', '', 'gs')) AS t FROM r), n AS (SELECT *, lead(page_no) OVER w AS nx, lead(t) OVER w AS f FROM l WINDOW w AS (PARTITION BY book_id ORDER BY page_no)) "
        r"SELECT book_id, page_no, coalesce(nx = page_no + 1 AND (regexp_matches(t, '\p{L}-\s*$') OR (NOT regexp_matches(t, '[.!?:…»\x22”)]\s*$') AND regexp_matches(f, '^\s*\p{Ll}'))), false) AS joined FROM n",
    )
    def paragraph_joins(spark: SparkSession, folder: str) -> DataFrame:
        text = F.trim(F.regexp_replace("raw", r"(?s)<\|ref\|>.*?<\|/ref\|><\|det\|>.*?<\|/det\|>", ""))
        rows = _reads(spark, folder).select("book_id", "page_no", text.alias("a"), text.alias("b"))
        return D.next_page_paragraphs(rows, "book_id", "page_no", "a", "b")

    @to.query("continued_tables")
    def continued_tables(spark: SparkSession, folder: str) -> DataFrame:
        return D.continued_tables(_reads(spark, folder), "book_id", "page_no", "raw")

    @to.query("consensus_reads")
    def consensus_reads(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "ocr_observations", "observation_id", "book_id", "page_no", "obs_mode", "raw").dropDuplicates(["observation_id"])
        many = rows.groupBy("book_id", "page_no").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        return D.consensus(rows.join(many, ["book_id", "page_no"]), ["book_id", "page_no"], "observation_id", "raw", primary=F.col("obs_mode") == "grounded")

    @to.query(
        "all_chapter_starts",
        "WITH h AS (SELECT book_id, page_no AS page, min(markdown) AS title FROM blocks WHERE kind = 'title' GROUP BY 1, 2), c AS (SELECT book_id, page_no AS page, min(markdown) AS title FROM blocks WHERE kind = 'header' GROUP BY 1, 2), "
        "u AS (SELECT *, 'headings' AS source, 0.8 AS confidence FROM h UNION ALL SELECT *, 'contents', 0.85 FROM c), b AS (SELECT book_id, max(confidence) AS confidence FROM u GROUP BY 1) SELECT book_id, page, title, source, CAST(confidence AS DOUBLE) AS confidence, lead(page) OVER (PARTITION BY book_id ORDER BY page) - 1 AS last_page FROM u JOIN b USING (book_id, confidence)",
    )
    def all_chapter_starts(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "blocks", "book_id", "page_no", "kind", "markdown")
        pick = lambda kind: rows.filter(F.col("kind") == kind).groupBy("book_id", F.col("page_no").alias("page")).agg(F.min("markdown").alias("title"))
        # The tables hold no outlines.
        outline = spark.createDataFrame([], pick("title").schema)
        return D.chapter_starts(outline, pick("header"), pick("title"), "book_id")

    @to.query(
        "outlined_chapters",
        "WITH p AS (SELECT DISTINCT book_id, page_no AS page FROM blocks), o AS (SELECT book_id, page, 'part ' || page AS title FROM p WHERE book_id % 2 = 0 AND page % 5 = 1), h AS (SELECT book_id, page_no AS page, min(markdown) AS title FROM blocks WHERE kind = 'title' GROUP BY 1, 2), "
        "u AS (SELECT *, 'headings' AS source, 0.8 AS confidence FROM h UNION ALL SELECT *, 'outline', 1.0 FROM o), b AS (SELECT book_id, max(confidence) AS confidence FROM u GROUP BY 1) SELECT book_id, page, title, source, CAST(confidence AS DOUBLE) AS confidence, lead(page) OVER (PARTITION BY book_id ORDER BY page) - 1 AS last_page FROM u JOIN b USING (book_id, confidence)",
    )
    def outlined_chapters(spark: SparkSession, folder: str) -> DataFrame:
        # Every second book is given an outline that names each fifth page.
        rows = table(spark, folder, "blocks", "book_id", "page_no", "kind", "markdown")
        heads = rows.filter("kind = 'title'").groupBy("book_id", F.col("page_no").alias("page")).agg(F.min("markdown").alias("title"))
        outline = rows.filter("book_id % 2 = 0 and page_no % 5 = 1").select("book_id", F.col("page_no").alias("page")).distinct().withColumn("title", F.concat(F.lit("part "), "page"))
        return D.chapter_starts(outline, heads.limit(0), heads, "book_id")

    @to.query(
        "quietest_cuts",
        "WITH s AS (SELECT user_id, event_id AS ev, value, row_number() OVER w AS i, avg(value * value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, arg_min(ev, {'e': round(e, 9), 'd': abs(ev - 5000), 'a': ev}) AS cut FROM s WHERE i >= 5 GROUP BY 1",
    )
    def quietest_cuts(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "events", "user_id", "event_id", "value")
        return D.quietest_cut(rows, ["user_id"], "event_id", "value", F.lit(5000), 5)

    @to.query("read_warnings")
    def read_warnings(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "ocr_observations", "observation_id", "raw").dropDuplicates(["observation_id"])
        return rows.select("observation_id", D.quality_warnings(F.coalesce("raw", F.lit(""))).alias("found")).filter("size(found) > 0")

    @to.query("footnotes", r"WITH b AS (SELECT DISTINCT block_id, markdown FROM blocks), m AS (SELECT block_id, unnest(regexp_extract_all(markdown, '\[\^(\d+)\](?:[^:]|$)', 1)) AS label FROM b), n AS (SELECT block_id, unnest(regexp_extract_all(markdown, '\[\^(\d+)\]:', 1)) AS label FROM b), mo AS (SELECT block_id, label FROM m GROUP BY 1, 2 HAVING count(*) = 1), nn AS (SELECT block_id, label FROM n GROUP BY 1, 2 HAVING count(*) = 1) SELECT mo.block_id, mo.label FROM mo JOIN nn USING (block_id, label)")
    def footnotes(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "blocks", "block_id", "markdown").distinct()
        find = lambda p: rows.select("block_id", F.explode(F.regexp_extract_all("markdown", F.lit(p), F.lit(1))).alias("label"))
        return D.footnote_pairs(find(r"\[\^(\d+)\](?:[^:]|$)"), find(r"\[\^(\d+)\]:"), ["block_id"]).select("block_id", "label")

    @to.query("looping_reads")
    def looping_reads(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "ocr_observations", "observation_id", "raw").dropDuplicates(["observation_id"])
        return rows.filter(R.looping("raw")).select("observation_id")

    @to.query("read_differences")
    def read_differences(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "ocr_observations", "observation_id", "book_id", "page_no", "raw").groupBy("book_id", "page_no").agg(F.min_by("raw", "observation_id").alias("a"), F.max_by("raw", "observation_id").alias("b"), F.count_distinct("observation_id").alias("n")).filter("n > 1")
        return rows.select("book_id", "page_no", F.posexplode(R.word_differences("a", "b")).alias("no", "d")).select("book_id", "page_no", "no", "d.op", "d.a", "d.b")

    @to.query(
        "indent_bands",
        "WITH RECURSIVE b AS (SELECT DISTINCT observation_id, ordinal, bbox.x0 AS x FROM blocks WHERE bbox IS NOT NULL AND bbox.x0 IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY ordinal) AS n FROM b), "
        "st AS (SELECT observation_id, ordinal, n, [x] AS seen, 0 AS band FROM r WHERE n = 1 UNION ALL SELECT observation_id, ordinal, n, CASE WHEN p IS NULL THEN list_append(seen, x) ELSE seen END, coalesce(p - 1, len(seen)) "
        "FROM (SELECT r.*, st.seen, nullif(list_position(list_transform(st.seen, lambda v: abs(v - r.x) <= 12), true), 0) AS p FROM st JOIN r ON r.observation_id = st.observation_id AND r.n = st.n + 1)) SELECT observation_id, ordinal, band FROM st",
    )
    def indent_bands(spark: SparkSession, folder: str) -> DataFrame:
        return R.indent_bands(_blocks(spark, folder).withColumn("x", F.col("bbox.x0")), ["observation_id"], "ordinal", "x")
