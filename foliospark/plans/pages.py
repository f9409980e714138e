"""Queries over Markdown pages: structure, excerpts, anchors, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import chunks as C
from foliospark.operators import edits as E
from foliospark.operators import validate as V
from foliospark.plans.registry import Registry
from foliospark.sources.tables import table

PAGE = V.Schema(
    fields={"title": V.string(required=True, min_length=12, max_length=60), "tags": V.list_of(required=True, min_items=1, unique=True), "effort": V.integer(minimum=1, maximum=5), "state": V.enum(["open", "done"])},
    sections=("Decisions",),
    extra_sections=True,
)


def _pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "parsed_pages", "page_id", "path", *columns).dropDuplicates(["page_id"])


_P = "p AS (SELECT page_id, any_value(path) AS path, any_value(text) AS text, any_value(frontmatter) AS fm, any_value(headings) AS headings, any_value(code_blocks) AS code FROM parsed_pages GROUP BY 1)"


def register(to: Registry) -> None:
    """Add the page queries."""

    def parsed(spark: SparkSession, folder: str) -> DataFrame:
        known = _pages(spark, folder, "headings", "code_blocks", "frontmatter", "body_start_line").select(F.col("path").alias("_p"), F.col("headings").alias("_h"), F.col("code_blocks").alias("_c"), F.col("body_start_line").alias("_b"))
        return C.parse_pages(_pages(spark, folder, "text")).join(known, F.col("path") == F.col("_p"))

    # The stored facts are the oracle wherever they aren't null.
    @to.query("page_headings", f"WITH {_P} SELECT path, h.level AS level, h.text AS title, h.line AS line FROM (SELECT path, unnest(headings) AS h FROM p)")
    def page_headings(spark: SparkSession, folder: str) -> DataFrame:
        return parsed(spark, folder).filter("_h is not null").select("path", F.explode("headings").alias("h")).select("path", "h.level", F.col("h.text").alias("title"), "h.line")

    @to.query("page_code_blocks", f"WITH {_P} SELECT path, c.start_line AS start_line, c.end_line AS end_line FROM (SELECT path, unnest(code) AS c FROM p)")
    def page_code_blocks(spark: SparkSession, folder: str) -> DataFrame:
        return parsed(spark, folder).filter("_c is not null").select("path", F.explode("code_blocks").alias("c")).select("path", "c.start_line", "c.end_line")

    @to.query(
        "section_ends",
        f"WITH {_P}, h AS (SELECT path, text, h.line AS line, h.level AS level FROM (SELECT path, text, unnest(headings) AS h FROM p)) SELECT path, line, coalesce((SELECT min(b.line) - 1 FROM h b WHERE b.path = a.path AND b.line > a.line AND b.level <= a.level), len(string_split(text, chr(10)))) AS last_line FROM h a",
    )
    def section_ends(spark: SparkSession, folder: str) -> DataFrame:
        return parsed(spark, folder).filter("_h is not null").select("path", F.explode("headings").alias("h")).select("path", "h.line", "h.last_line")

    @to.query("breadcrumbs")
    def breadcrumbs(spark: SparkSession, folder: str) -> DataFrame:
        return parsed(spark, folder).select("path", F.explode("headings").alias("h")).select("path", "h.line", F.array_join("h.crumbs", " > ").alias("breadcrumb"))

    @to.query("page_chunks")
    def page_chunks(spark: SparkSession, folder: str) -> DataFrame:
        return C.chunk_pages(_pages(spark, folder, "text")).select("path", "chunk_no", "start_line", "end_line", F.array_join("heading", " > ").alias("breadcrumb"), "text", "embedding_text")

    @to.query("page_titles", f"WITH {_P} SELECT path, coalesce(json_extract_string(fm, '$.title'), list_filter(headings, lambda h: h.level = 1)[1].text, path) AS title FROM p WHERE headings IS NOT NULL")
    def page_titles(spark: SparkSession, folder: str) -> DataFrame:
        known = _pages(spark, folder, "headings", "frontmatter").filter("headings is not null")
        first = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"]
        return known.select("path", F.coalesce(F.get_json_object("frontmatter", "$.title"), first, "path").alias("title"))

    @to.query(
        "field_findings",
        f"""WITH {_P}, f AS (SELECT page_id, coalesce(fm, '{{}}') AS j FROM p), k AS (SELECT page_id, j, json_keys(j) AS ks FROM f)
        SELECT page_id, 'title' AS field, 'missing' AS finding FROM k WHERE NOT list_contains(ks, 'title') UNION ALL SELECT page_id, 'tags', 'missing' FROM k WHERE NOT list_contains(ks, 'tags')
        UNION ALL SELECT page_id, 'title', 'too short' FROM k WHERE json_type(j, '$.title') = 'VARCHAR' AND length(json_extract_string(j, '$.title')) < 12 UNION ALL SELECT page_id, 'title', 'too long' FROM k WHERE json_type(j, '$.title') = 'VARCHAR' AND length(json_extract_string(j, '$.title')) > 60
        UNION ALL SELECT page_id, x, 'null' FROM (SELECT page_id, j, unnest(list_filter(ks, lambda q: q IN ('title', 'tags', 'effort', 'state'))) AS x FROM k) WHERE json_type(j, '$.' || x) = 'NULL'
        UNION ALL SELECT page_id, 'effort', 'too large' FROM k WHERE json_type(j, '$.effort') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(j, '$.effort') AS BIGINT) > 5 UNION ALL SELECT page_id, 'effort', 'too small' FROM k WHERE json_type(j, '$.effort') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(j, '$.effort') AS BIGINT) < 1
        UNION ALL SELECT page_id, 'state', 'value' FROM k WHERE json_type(j, '$.state') = 'VARCHAR' AND json_extract_string(j, '$.state') NOT IN ('open', 'done')
        UNION ALL SELECT page_id, 'tags', 'too few' FROM k WHERE json_type(j, '$.tags') = 'ARRAY' AND json_array_length(j, '$.tags') < 1 UNION ALL SELECT page_id, unnest(list_filter(ks, lambda x: x NOT IN ('title', 'tags', 'effort', 'state'))), 'unknown' FROM k""",
    )
    def field_findings(spark: SparkSession, folder: str) -> DataFrame:
        return V.field_findings(_pages(spark, folder, "frontmatter"), "page_id", "frontmatter", PAGE)

    @to.query("section_findings", f"WITH {_P}, n AS (SELECT page_id, list_transform(list_filter(headings, lambda h: h.level = 2), lambda h: h.text) AS n FROM p WHERE headings IS NOT NULL) SELECT page_id, 'Decisions' AS field, 'missing' AS finding FROM n WHERE NOT list_contains(n, 'Decisions') UNION ALL SELECT page_id, x, 'repeated' FROM (SELECT page_id, unnest(n) AS x FROM n) GROUP BY 1, 2 HAVING count(*) > 1")
    def section_findings(spark: SparkSession, folder: str) -> DataFrame:
        return V.section_findings(_pages(spark, folder, "headings").filter("headings is not null"), "page_id", "headings", PAGE)

    @to.query("next_serials", r"SELECT regexp_extract(path, '^([^/]+)/.*?(\d+)\.md$', 1) AS scope, max(CAST(regexp_extract(path, '^([^/]+)/.*?(\d+)\.md$', 2) AS BIGINT)) + 1 AS next_serial FROM documents WHERE regexp_matches(path, '^([^/]+)/.*?(\d+)\.md$') GROUP BY 1")
    def next_serials(spark: SparkSession, folder: str) -> DataFrame:
        return V.next_serials(table(spark, folder, "documents", "path"), "path", r"^([^/]+)/.*?(\d+)\.md$")

    @to.query("status_changes", "WITH a AS (SELECT o_orderkey, o_orderstatus AS s FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 3 = 1 THEN 'O' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 23 <> 0) SELECT a.o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'vanished' ELSE 'transition' END AS finding FROM a LEFT JOIN b ON a.o_orderkey = b.o_orderkey WHERE (b.o_orderkey IS NULL AND a.s IN ('O', 'P')) OR (a.s <> b.s AND a.s || b.s NOT IN ('OP', 'OF', 'PF'))")
    def status_changes(spark: SparkSession, folder: str) -> DataFrame:
        before = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
        after = before.filter("o_orderkey % 23 <> 0").withColumn("s", F.when(F.col("o_orderkey") % 3 == 0, "F").when(F.col("o_orderkey") % 3 == 1, "O").otherwise(F.col("s")))
        return V.change_findings(before, after, "o_orderkey", "s", {"O": ["P", "F"], "P": ["F"], "F": []})

    @to.query(
        "anchored_lines",
        r"WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\n$', '') AS t FROM documents WHERE text <> ''), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM b), "
        "n AS (SELECT *, coalesce(lag(line) OVER w, '') AS p, coalesce(lead(line) OVER w, '') AS q FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) "
        "SELECT doc_id, line_no, line_no || ':' || left(sha256(unhex(lpad(hex(strlen(p)), 16, '0')) || encode(p) || unhex(lpad(hex(strlen(line)), 16, '0')) || encode(line) || unhex(lpad(hex(strlen(q)), 16, '0')) || encode(q)), 2) AS anchor FROM n",
    )
    def anchored_lines(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "documents", "doc_id", "text")
        return E.anchored_lines(rows, "doc_id").select(F.col("path").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), "anchor")
