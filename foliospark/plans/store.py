"""Queries over stored pages: links, folders, snapshots, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import links as L
from foliospark.operators import sync as S
from foliospark.operators import views as V
from foliospark.plans.registry import Registry
from foliospark.sources.tables import table

_LINKS = r"""
b AS (SELECT DISTINCT block_id, regexp_replace(coalesce(markdown, ''), '```.*?```|~~~.*?~~~|`[^`\n]*`|<!--.*?-->', ' ', 'gs') AS t FROM blocks),
links AS (
  SELECT block_id, CASE WHEN l LIKE '!%' THEN 'image' ELSE 'markdown' END AS syntax, regexp_extract(l, '\]\(([^()\s]+)\)$', 1) AS target FROM (SELECT block_id, unnest(regexp_extract_all(t, '!?\[[^\[\]\n]*\]\([^()\s]+\)')) AS l FROM b)
  UNION ALL SELECT block_id, 'wiki', trim(unnest(regexp_extract_all(t, '\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]', 1))) FROM b
  UNION ALL SELECT block_id, 'html', trim(unnest(regexp_extract_all(t, '\bhref=["'']([^"'']+)["'']', 1))) FROM b)
"""
_OLD = "old AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 3), new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 2)"
_DIFF = f"WITH {_OLD}, ch AS (SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'created' WHEN n.o_orderkey IS NULL THEN 'deleted' WHEN o.o_orderstatus = n.o_orderstatus THEN 'unchanged' ELSE 'updated' END AS change FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey)"


def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of one table: rows leave, come and change by their keys (this is the case shown, not a sample)."""
    rows = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = rows.filter("o_orderkey % 5 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return rows.filter("o_orderkey % 7 <> 3"), new


def register(to: Registry) -> None:
    """Add the store queries."""

    def block_links(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "blocks", "block_id", "markdown").distinct()
        return L.links_of(rows, ["block_id"], "markdown")

    @to.query("block_links", f"WITH {_LINKS} SELECT block_id, syntax, target FROM links")
    def q_block_links(spark: SparkSession, folder: str) -> DataFrame:
        return block_links(spark, folder).select("block_id", "syntax", "target")

    @to.query(
        "link_targets",
        f"WITH {_LINKS}, p AS (SELECT syntax, CASE WHEN syntax = 'wiki' THEN target || '.md' WHEN syntax = 'image' THEN NULL WHEN target LIKE '/%' THEN ltrim(target, '/') ELSE 'scans/' || target END AS path FROM links WHERE NOT regexp_matches(target, '^([A-Za-z][A-Za-z0-9+.-]*:|//)')), "
        "k AS (SELECT DISTINCT path FROM documents) SELECT syntax, count(*) AS n, count(*) FILTER (WHERE p.path IS NOT NULL AND k.path IS NULL) AS dangling FROM p LEFT JOIN k ON p.path = k.path GROUP BY 1",
    )
    def link_targets(spark: SparkSession, folder: str) -> DataFrame:
        links = block_links(spark, folder).withColumn("source", F.concat(F.lit("scans/block-"), "block_id", F.lit(".md")))
        found = L.resolve(links, table(spark, folder, "documents", "path"))
        return found.filter(~T.is_external("target")).groupBy("syntax").agg(F.count("*").alias("n"), F.count_if("dangling").alias("dangling"))

    edges_sql = "e AS (SELECT 'c' || o_custkey AS source, 'ordered' AS relation, 'o' || o_orderkey AS target FROM orders UNION ALL SELECT 'o' || o_orderkey, 'ordered_by', 'c' || o_custkey FROM orders WHERE o_orderkey % 13 <> 0)"

    @to.query("link_reciprocal_missing", f"WITH {edges_sql} SELECT * FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.source = a.target AND b.target = a.source AND b.relation = CASE a.relation WHEN 'ordered' THEN 'ordered_by' ELSE 'ordered' END)")
    def link_reciprocal_missing(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("c"), F.concat(F.lit("o"), "o_orderkey").alias("o"))
        one = rows.select(F.col("c").alias("source"), F.lit("ordered").alias("relation"), F.col("o").alias("target"))
        back = rows.filter("o_orderkey % 13 <> 0").select(F.col("o").alias("source"), F.lit("ordered_by").alias("relation"), F.col("c").alias("target"))
        return L.missing_reciprocals(one.unionByName(back), {"ordered": "ordered_by", "ordered_by": "ordered"})

    @to.query("folder_children", "SELECT split_part(path, '/', 1) AS name, path LIKE '%/%' AS is_folder, count(*) AS n_pages FROM documents GROUP BY 1, 2")
    def folder_children(spark: SparkSession, folder: str) -> DataFrame:
        return L.list_folder(table(spark, folder, "documents", "path"))

    @to.query("folder_rollup", "SELECT folder, count(*) AS n_pages, sum(n_chars) AS chars, count(*) FILTER (WHERE title IS NULL) AS untitled FROM (SELECT *, unnest(['', split_part(path, '/', 1)]) AS folder FROM documents) GROUP BY 1")
    def folder_rollup(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "documents", "path", "n_chars", "title")
        return L.folder_rollup(rows, F.count("*").alias("n_pages"), F.sum("n_chars").alias("chars"), F.count_if(F.col("title").isNull()).alias("untitled"))

    @to.query("nearest_policy", "SELECT path, CASE split_part(path, '/', 1) WHEN 'tasks' THEN 'task' WHEN 'meetings' THEN 'recording' ELSE 'any' END AS policy FROM documents")
    def nearest_policy(spark: SparkSession, folder: str) -> DataFrame:
        rules = spark.createDataFrame([("", "any"), ("tasks", "task"), ("meetings", "recording")], "folder string, policy string")
        return L.nearest_policy(table(spark, folder, "documents", "path"), rules)

    @to.query("selected_paths", r"SELECT path, media FROM (SELECT path, 'text/markdown' AS media FROM documents WHERE regexp_matches(path, '^(notes|tasks)/[^/]*\.md$') AND NOT regexp_matches(path, '^(.*/)?agenda-[^/]*$'))")
    def selected_paths(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "documents", "path")
        return rows.filter(T.path_selected("path", ["{notes,tasks}/*.md"], ["**/agenda-*"])).select("path", T.media_type("path").alias("media"))

    @to.query("region_paths", "SELECT n_nationkey, r_name || '/' || n_name AS path, 2 AS depth FROM nation JOIN region ON n_regionkey = r_regionkey")
    def region_paths(spark: SparkSession, folder: str) -> DataFrame:
        top = table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("k"), F.lit(None).cast("string").alias("p"), F.col("r_name").alias("name"))
        low = table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("k"), F.concat(F.lit("r"), "n_regionkey").alias("p"), F.col("n_name").alias("name"))
        paths = L.ancestor_paths(top.unionByName(low), "k", "p", "name", 8)
        return paths.filter("k like 'n%'").select(F.expr("cast(substring(k, 2) as int)").alias("n_nationkey"), "path", "depth")

    @to.query("snapshot_diff", _DIFF + " SELECT * FROM ch")
    def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
        old, new = _snapshots(spark, folder)
        return S.diff(old, new, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])

    @to.query(
        "sync_counts",
        _DIFF + ", g AS (SELECT o_orderkey % 400 AS part, count(*) FILTER (WHERE change = 'created') AS created, count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change = 'deleted') AS deleted FROM ch GROUP BY 1) "
        "SELECT *, deleted > 0 AND (deleted = updated + unchanged + deleted OR deleted > 10 OR (updated + unchanged + deleted >= 4 AND deleted > ceil((updated + unchanged + deleted) * 0.25))) AS refused FROM g",
    )
    def sync_counts(spark: SparkSession, folder: str) -> DataFrame:
        old, new = _snapshots(spark, folder)
        changes = S.diff(old, new, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])
        return S.change_counts(changes.withColumn("part", F.col("o_orderkey") % 400), "part")

    @to.query(
        "three_way_merge",
        "WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), l AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'L' ELSE v END AS v FROM b WHERE k % 17 <> 0), s AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'S' ELSE v END AS v FROM b WHERE k % 19 <> 0) "
        "SELECT b.k AS o_orderkey, CASE WHEN l.v IS NOT DISTINCT FROM s.v THEN l.v WHEN l.v IS NOT DISTINCT FROM b.v THEN s.v ELSE l.v END AS v, "
        "CASE WHEN l.v IS NOT DISTINCT FROM s.v THEN CASE WHEN l.v IS NULL THEN 'deleted' ELSE 'same' END WHEN l.v IS NOT DISTINCT FROM b.v THEN CASE WHEN s.v IS NULL THEN 'deleted' ELSE 'server' END WHEN s.v IS NOT DISTINCT FROM b.v THEN CASE WHEN l.v IS NULL THEN 'deleted' ELSE 'local' END ELSE 'conflict' END AS outcome FROM b LEFT JOIN l ON b.k = l.k LEFT JOIN s ON b.k = s.k",
    )
    def three_way_merge(spark: SparkSession, folder: str) -> DataFrame:
        base = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
        local = base.filter("o_orderkey % 17 <> 0").withColumn("v", F.when(F.col("o_orderkey") % 3 == 0, "L").otherwise(F.col("v")))
        server = base.filter("o_orderkey % 19 <> 0").withColumn("v", F.when(F.col("o_orderkey") % 4 == 0, "S").otherwise(F.col("v")))
        return S.merge_three(base, local, server, "o_orderkey", "v")

    @to.query("carried_import_times", "SELECT doc_id, CASE WHEN title IS NULL THEN ingested_at ELSE updated_at END AS ingested_at FROM documents")
    def carried_import_times(spark: SparkSession, folder: str) -> DataFrame:
        new = table(spark, folder, "documents", "doc_id", "title", "updated_at", "ingested_at").withColumn("revision", F.coalesce("title", F.lit("new")))
        old = new.withColumn("revision", F.col("title")).withColumn("ingested_at", F.col("updated_at"))
        return S.carry_on(old, new, "doc_id", "revision", "ingested_at").select("doc_id", "ingested_at")

    @to.query("latest_events", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
    def latest_events(spark: SparkSession, folder: str) -> DataFrame:
        return S.latest_by_job(table(spark, folder, "events", "user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")

    @to.query(
        "order_schedule",
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start_day, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 9 AS INT) + 1 END AS end_day, o_orderkey % 6 <> 0 AS scheduled FROM orders",
    )
    def order_schedule(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.when(F.col("o_orderkey") % 6 == 0, "soon").otherwise(F.date_format(F.date_add("o_orderdate", (F.col("o_custkey") % 9).cast("int")), "yyyy-MM-dd")).alias("b"))
        return V.schedule(rows, "a", "b").select("o_orderkey", "start_day", "end_day", "scheduled")

    @to.query(
        "order_board",
        "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '4%' THEN 'Unassigned' ELSE o_orderpriority END AS lane FROM orders), l AS (SELECT lane, row_number() OVER (ORDER BY lane = 'Unassigned', lane) AS lane_no FROM (SELECT DISTINCT lane FROM r)) SELECT o_orderkey, lane, lane_no, row_number() OVER (PARTITION BY lane ORDER BY o_orderkey) AS position FROM r JOIN l USING (lane)",
    )
    def order_board(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "orders").select("o_orderkey", F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority")).alias("lane"))
        return V.board(rows, "lane", [F.col("o_orderkey")])

    @to.query(
        "order_dependencies",
        "WITH r AS (SELECT o_orderkey AS k, unnest(list_distinct([o_orderkey, o_orderkey + 10, o_custkey, o_custkey])) AS need FROM orders) SELECT k AS o_orderkey, need, CASE WHEN need = k THEN 'self' WHEN need IN (SELECT o_orderkey FROM orders) THEN 'ok' ELSE 'missing' END AS state FROM r",
    )
    def order_dependencies(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "orders").select("o_orderkey", F.array("o_orderkey", F.col("o_orderkey") + 10, "o_custkey", "o_custkey").alias("needs"))
        return V.dependencies(rows, "o_orderkey", "needs")

    @to.query("slugs", r"SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '') AS s FROM documents)")
    def slugs(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "documents", "doc_id", "title").select("doc_id", T.slug(F.coalesce("title", F.lit(""))).alias("slug"))

    @to.query("content_addresses", "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS doc_id, min(strlen(text)) AS size FROM documents GROUP BY 1")
    def content_addresses(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
        return rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("size").alias("size"))
