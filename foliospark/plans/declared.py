"""Queries of hybrid search, checked answers, declared relations, identities and page layout.

Where no table holds a case (answers of a model, broken formulas), the query plants it in
every row by a rule of the keys, and the SQL plants the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import chunks as C
from foliospark.operators import documents as D
from foliospark.operators import evidence as V
from foliospark.operators import identity as I
from foliospark.operators import links as L
from foliospark.operators import quality as Q
from foliospark.operators import relations as E
from foliospark.operators import repairs as P
from foliospark.operators import rerank as K
from foliospark.operators import search as R
from foliospark.operators import trust as U
from foliospark.plans.registry import Registry
from foliospark.plans.retrieval import _BM25, QUERY, VARIANT
from foliospark.plans.store import _LINKS
from foliospark.sources.tables import micros, table

_B = "b AS (SELECT DISTINCT block_id, observation_id, book_id, page_no, ordinal, kind, markdown, bbox, confidence FROM blocks)"
_KEY = r"regexp_replace(regexp_replace(regexp_replace(markdown, '\\(begin|end)\{(array|aligned|align\*?|gathered)\}(\{[lcr ]+\})?', '', 'g'), '\\(math(rm|bf|bb|cal|sf)|text|operatorname|left|right|[bB]igg?)\b\*?', '', 'g'), '[\s{}\\&]', '', 'g')"
_READS = "r AS (SELECT book_id, page_no, arg_min(raw, observation_id) AS raw FROM ocr_observations GROUP BY 1, 2)"


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks", "block_id", "observation_id", "book_id", "page_no", "ordinal", "kind", "markdown", "bbox", "confidence").distinct()


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return L.links_of(table(spark, folder, "blocks", "block_id", "markdown").distinct(), ["block_id"], "markdown")


def _pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "parsed_pages", "page_id", "path", *columns).dropDuplicates(["page_id"])


def _search(to: Registry) -> None:
    @to.query(
        "reranked_orders",
        "WITH c AS (SELECT o_custkey AS q, o_orderkey AS k, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5), m AS (SELECT *, count(*) OVER (PARTITION BY q) AS n FROM c), "
        "d AS (SELECT *, CASE WHEN q % 4 = 0 THEN 'rerank: unexpected number of results' WHEN q % 4 = 2 THEN 'rerank: non-finite score' WHEN q % 4 = 3 AND n > 1 THEN 'rerank: duplicate index' END AS degraded FROM m), e AS (SELECT *, CASE WHEN degraded IS NULL THEN k % 97 END AS r FROM d) "
        "SELECT q AS o_custkey, k AS o_orderkey, row_number() OVER (PARTITION BY q ORDER BY coalesce(r, -1) DESC, s DESC, rank) AS rank, CAST(r AS DOUBLE) AS rerank_score, degraded FROM e",
    )
    def reranked_orders(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_totalprice")
        fused = R.ranked(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).withColumn("score", F.col("o_totalprice").cast("double"))
        kind = F.col("o_custkey") % 4
        score = F.when((kind == 2) & (F.col("rank") == 1), F.lit(float("nan"))).otherwise((F.col("o_orderkey") % 97).cast("double"))
        answers = fused.filter(kind != 0).select("o_custkey", F.when(kind == 3, 0).otherwise(F.col("rank") - 1).alias("index"), score.alias("score"))
        return K.reranked(fused, answers, "o_custkey", "o_orderkey", 5).select("o_custkey", "o_orderkey", "rank", "rerank_score", "degraded")

    @to.query(
        "bad_vector_answers",
        "WITH v AS (SELECT DISTINCT vec_id, dimensions AS d, vector AS x FROM vector_records WHERE vec_id IS NOT NULL) SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'unexpected count' ELSE 'unexpected dimensions or non-finite values' END AS reason FROM v WHERE vec_id % 10 = 0 OR x IS NULL OR len(x) <> d OR len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) > 0",
    )
    def bad_vector_answers(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "vector_records", "vec_id", "dimensions", "vector").filter("vec_id is not null").dropDuplicates(["vec_id"])
        asked = rows.select("vec_id", F.when(F.col("vec_id") % 10 == 0, 2).otherwise(1).alias("n_texts"), "dimensions")
        return K.bad_vector_sets(rows.select("vec_id", "vector"), asked, "vec_id")

    value = "CASE event_id % 7 WHEN 0 THEN -0.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN -value ELSE value END"

    @to.query("float_order", f"WITH v AS (SELECT user_id, event_id, {value} AS v FROM events) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY isnan(v), v, CASE WHEN v = 0 AND event_id % 7 = 0 THEN 0 ELSE 1 END, event_id) AS place FROM v")
    def float_order(spark: SparkSession, folder: str) -> DataFrame:
        kind = F.col("event_id") % 7
        v = F.when(kind == 0, F.lit(-0.0)).when(kind == 1, F.lit(0.0)).when(kind == 2, F.lit(float("nan"))).when(kind == 3, -F.col("value")).otherwise(F.col("value"))
        rows = table(spark, folder, "events", "user_id", "event_id", "value").withColumn("v", v)
        return rows.select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy(K.total_order(F.col("v")), "event_id")).alias("place"))

    unit = "CAST(embedding AS DOUBLE[])"

    @to.query(
        "hybrid_hits",
        f"WITH qs AS (SELECT 0 AS qid, '{QUERY}' AS q UNION ALL SELECT 1, '{VARIANT}'), {_BM25}, pages AS (SELECT doc_id, path FROM documents), "
        f"w AS (SELECT doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, path) AS rn FROM scores JOIN pages USING (doc_id)), v AS (SELECT vec_id, {unit} AS x FROM embeddings), f AS (SELECT x AS y, vec_id AS qv FROM v WHERE vec_id IN (SELECT min(vec_id) FROM v UNION SELECT max(vec_id) FROM v)), "
        "n AS (SELECT vec_id AS doc_id, row_number() OVER (PARTITION BY qv ORDER BY round(list_cosine_similarity(x, y), 9) DESC, path) AS rn FROM v JOIN pages ON doc_id = vec_id, f WHERE qv <> -1), "
        "l AS (SELECT doc_id, rn FROM w WHERE rn <= 30 UNION ALL SELECT doc_id, rn FROM n WHERE rn <= 30), fu AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rn)) AS s FROM l GROUP BY 1), "
        "g AS (SELECT doc_id, s FROM fu UNION ALL SELECT p.doc_id, s * 0.15 FROM fu JOIN pages p ON p.doc_id = CASE WHEN fu.doc_id % 2 = 0 THEN fu.doc_id + 1 ELSE fu.doc_id - 1 END), "
        "t AS (SELECT doc_id, sum(s) AS s FROM g GROUP BY 1) SELECT t.doc_id AS chunk, row_number() OVER (ORDER BY round(s, 9) DESC, path) AS rank, round(s, 9) AS score FROM t JOIN pages USING (doc_id) QUALIFY rank <= 30",
    )
    def hybrid_hits(spark: SparkSession, folder: str) -> DataFrame:
        # Every document is a page of one excerpt; its link goes to its neighbour in pairs of ids.
        documents = table(spark, folder, "documents", "doc_id", "path", "title", "text")
        held = table(spark, folder, "embeddings", "vec_id", "embedding")
        chunks = documents.select(F.col("doc_id").alias("chunk"), F.col("path").alias("page"), F.lit(0).alias("chunk_no"), T.search_text("path", "title", "text").alias("text")).join(held.select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector")), "chunk", "left")
        names = documents.select("doc_id", "path")
        edges = names.filter("doc_id % 2 = 0").select(F.col("path").alias("source"), (F.col("doc_id") + 1).alias("doc_id")).join(names, "doc_id").select("source", F.col("path").alias("target"))
        queries = spark.createDataFrame([("q", 0, QUERY), ("q", 1, VARIANT), ("q", 2, " ")], "by string, formulation int, text string")
        ends = held.agg(F.min_by("embedding", "vec_id").alias("a"), F.max_by("embedding", "vec_id").alias("b"))
        vectors = ends.select(F.lit("q").alias("by"), F.posexplode(F.array("a", "b")).alias("formulation", "vector"))
        return K.hybrid(chunks, queries, vectors, edges, "by").select("chunk", "rank", F.round("score", 9).alias("score"))

    @to.query("best_of_pages", "SELECT path AS page, max(score) AS score FROM (SELECT 'users/' || user_id AS path, value AS score FROM events) GROUP BY 1")
    def best_of_pages(spark: SparkSession, folder: str) -> DataFrame:
        return R.page_scores(table(spark, folder, "events", "user_id", "value").select(F.concat(F.lit("users/"), "user_id").alias("page"), F.col("value").alias("score")))


def _relations(to: Registry) -> None:
    tags = "t AS (SELECT path, from_json(json_extract(fm, '$.tags'), '[\"VARCHAR\"]') AS a FROM (SELECT page_id, any_value(path) AS path, any_value(frontmatter) AS fm FROM parsed_pages GROUP BY 1))"

    @to.query("tag_edges", f"WITH {tags} SELECT path AS source, 'tagged' AS relation, a[i] AS target, '/tags/' || (i - 1) AS pointer FROM (SELECT path, a, unnest(range(1, len(a) + 1)) AS i FROM t)")
    def tag_edges(spark: SparkSession, folder: str) -> DataFrame:
        return E.field_edges(_pages(spark, folder, "frontmatter"), "tagged", "/tags")

    @to.query("typed_edges", "SELECT 'orders/' || o_orderkey AS source, 'needs' AS relation, 'parts/' || l_partkey AS target, '/items/' || (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1) || '/to' AS pointer FROM orders JOIN lineitem ON l_orderkey = o_orderkey QUALIFY l_returnflag = 'R'")
    def typed_edges(spark: SparkSession, folder: str) -> DataFrame:
        items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: F.struct(F.concat(F.lit("parts/"), x["l_partkey"]).alias("to"), x["l_returnflag"].alias("kind")))
        pages = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").groupBy("l_orderkey").agg(F.to_json(F.struct(items.alias("items"))).alias("frontmatter"))
        return E.field_edges(pages.select(F.concat(F.lit("orders/"), "l_orderkey").alias("path"), "frontmatter"), "needs", "/items", "/to", "/kind", "R")

    @to.query("open_pages", "SELECT path FROM (SELECT page_id, any_value(path) AS path, any_value(frontmatter) AS fm FROM parsed_pages GROUP BY 1) WHERE json_extract_string(fm, '$.effort') = '4'")
    def open_pages(spark: SparkSession, folder: str) -> DataFrame:
        return E.of_type(_pages(spark, folder, "frontmatter"), "/effort", "4").select("path")

    @to.query("wiki_edges", f"WITH {_LINKS} SELECT 'scans/' || block_id || '.md' AS source, 'mentions' AS relation, target FROM links WHERE syntax = 'wiki' AND block_id::VARCHAR LIKE '%1%'")
    def wiki_edges(spark: SparkSession, folder: str) -> DataFrame:
        links = _links(spark, folder).select(F.concat(F.lit("scans/"), "block_id", F.lit(".md")).alias("source"), "target", "syntax", F.array().cast("array<string>").alias("sections"))
        return E.link_edges(links, "mentions", include="scans/*1*.md", syntax="wiki")

    @to.query("wiki_places", f"WITH {_LINKS} SELECT block_id, target AS raw, true AS exact FROM links WHERE syntax = 'wiki'")
    def wiki_places(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "blocks", "block_id", "markdown").distinct()
        found = E.wiki_references(rows, "block_id", "markdown").join(rows.withColumnRenamed("block_id", "path"), "path")
        there = F.decode(F.substring(F.encode("markdown", "UTF-8"), F.col("first_byte").cast("int") + 1, (F.col("end_byte") - F.col("first_byte")).cast("int")), "UTF-8")
        return found.select(F.col("path").alias("block_id"), "raw", (there == F.col("raw")).alias("exact"))

    seg = "s AS (SELECT DISTINCT segment_id, capture_id, segment_no, device, started_at AS s, ended_at AS e FROM microphone_segments WHERE ended_at > started_at)"

    @to.query(
        "corrected_segments",
        f"WITH {seg}, h AS (SELECT *, segment_no = 2 AS hit, count(*) FILTER (WHERE segment_no = 2) OVER (PARTITION BY capture_id) AS n FROM s) SELECT segment_id, CASE WHEN hit AND n = 1 THEN 'part two of ' ELSE 'part <' || segment_no || '> of ' END || coalesce(device, '-') AS text FROM h",
    )
    def corrected_segments(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "microphone_segments", "segment_id", "capture_id", "segment_no", "device", "started_at", "ended_at").distinct().filter("ended_at > started_at")
        rows = rows.select("segment_id", "capture_id", micros("started_at").alias("s"), micros("ended_at").alias("e"), F.lit("microphone").alias("role"), F.concat(F.lit("part <"), "segment_no", F.lit("> of "), F.coalesce("device", F.lit("-"))).alias("text"))
        edits = rows.groupBy("capture_id").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("capture_id", F.col("capture_id").alias("edit"), "s", "e", F.lit(None).cast("string").alias("role"), F.lit("<2>").alias("before"), F.lit("two").alias("after"))
        return E.corrected(rows, edits, "capture_id", "segment_id")[0].select("segment_id", "text")

    @to.query("page_links_rewritten", "SELECT path, 'See [x](' || regexp_extract(path, '([^/]*)$', 1) || ') and `[y](https://n.so/' || md5(path) || ')` and [z](https://n.so/about).' AS text FROM documents")
    def page_links_rewritten(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "documents", "path").withColumn("id", F.md5("path"))
        text = F.concat(F.lit("See [x](https://n.so/T-"), "id", F.lit("?v=1) and `[y](https://n.so/"), "id", F.lit(")` and [z](https://n.so/about)."))
        return E.with_page_links(rows.withColumn("text", text), rows.select(F.col("id").alias("page_id"), F.col("path").alias("target")), "path", "text")

    @to.query("referenced_assets", f"WITH {_LINKS}, a AS (SELECT DISTINCT target FROM links WHERE syntax <> 'wiki'), x AS (SELECT target FROM a UNION SELECT 'unused/' || target FROM a) SELECT target AS path FROM x WHERE target IN (SELECT target FROM a)")
    def referenced_assets(spark: SparkSession, folder: str) -> DataFrame:
        known = _links(spark, folder).filter("syntax != 'wiki'").select(F.col("target").alias("path")).distinct()
        assets = known.unionByName(known.select(F.concat(F.lit("unused/"), "path").alias("path")))
        # Code and comments name nothing.
        bare = F.regexp_replace(F.coalesce("markdown", F.lit("")), r"(?s)```.*?```|~~~.*?~~~|`[^`\n]*`|<!--.*?-->", " ")
        return E.referenced(assets, table(spark, folder, "blocks", "markdown").select(bare.alias("text")), "text")

    @to.query("all_paths", "SELECT path FROM documents WHERE path IS NOT NULL UNION SELECT path FROM parsed_pages WHERE path IS NOT NULL")
    def all_paths(spark: SparkSession, folder: str) -> DataFrame:
        return E.united(table(spark, folder, "documents", "path"), table(spark, folder, "parsed_pages", "path"))

    @to.query(
        "contained_numbers",
        "WITH a AS (SELECT DISTINCT l_suppkey, l_linenumber AS m FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey, l_linenumber AS m FROM lineitem WHERE l_returnflag = 'A') SELECT a.l_suppkey, count(*) FILTER (WHERE b.m IS NULL) AS n_missing, count(*) FILTER (WHERE b.m IS NULL) = 0 AS contained FROM a LEFT JOIN b ON a.l_suppkey = b.l_suppkey AND a.m = b.m GROUP BY 1",
    )
    def contained_numbers(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "lineitem", "l_suppkey", "l_linenumber", "l_returnflag")
        return E.within(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"), ["l_suppkey"], "l_linenumber")

    @to.query("identity_differences", "SELECT c_custkey AS k, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION SELECT -o_custkey, 'unexpected' FROM orders WHERE o_orderstatus = 'P' AND o_custkey > 0")
    def identity_differences(spark: SparkSession, folder: str) -> DataFrame:
        orders = table(spark, folder, "orders", "o_custkey", "o_orderstatus")
        actual = orders.select(F.col("o_custkey").cast("bigint").alias("k")).unionByName(orders.filter("o_orderstatus = 'P' and o_custkey > 0").select((-F.col("o_custkey")).cast("bigint").alias("k")))
        return E.identity_differences(table(spark, folder, "customer", "c_custkey").select(F.col("c_custkey").cast("bigint").alias("k")), actual, ["k"])

    @to.query(
        "moved_page_links",
        "WITH d AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS f FROM documents) SELECT 'moved/' || f AS new_source, f AS new_target FROM d",
    )
    def moved_page_links(spark: SparkSession, folder: str) -> DataFrame:
        # Every page links to itself, and every page moves: with it goes its target.
        rows = table(spark, folder, "documents", "path").withColumn("f", F.regexp_extract("path", r"([^/]*)$", 1))
        links = rows.select(F.col("path").alias("source"), F.lit("markdown").alias("syntax"), F.col("f").alias("target"), "path")
        moves = rows.select(F.col("path").alias("old"), F.concat(F.lit("moved/"), "f").alias("new"))
        return L.moved_links(links, moves).select("new_source", F.try_url_decode("new_target").alias("new_target"))


def _layout(to: Registry) -> None:
    @to.query("rejected_texts", "SELECT doc_id, 'visual_implausible_output_length' AS reason FROM documents WHERE length(text) > 20000 UNION ALL SELECT -doc_id, 'visual_math_repetition' FROM documents WHERE length(text) <= 20000 AND doc_id > 0")
    def rejected_texts(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "documents", "doc_id", "text")
        # The short ones once more with a runaway formula after them.
        planted = rows.filter("doc_id > 0 and length(text) <= 20000").select((-F.col("doc_id")).alias("doc_id"), F.concat(F.left("text", F.lit(2000)), F.lit("\n\n"), F.repeat(F.lit("$x_{1}=2$, "), F.lit(32))).alias("text"))
        found = rows.unionByName(planted).withColumn("reason", U.rejection(F.col("text"), F.lit(1)))
        return found.filter("reason is not null").select("doc_id", "reason")

    @to.query("trusted_layers", "SELECT doc_id, CASE WHEN text = '' OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN doc_id % 3 = 0 THEN 'no geometry' WHEN doc_id % 3 = 1 THEN 'broken' ELSE 'sound' END AS layer, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'untrusted' WHEN doc_id % 3 = 1 THEN 'untrusted' ELSE 'trusted' END AS state FROM documents")
    def trusted_layers(spark: SparkSession, folder: str) -> DataFrame:
        # A layer is the start of its text; a broken one has characters that were not decoded and boxes that are wrong.
        kind = F.col("doc_id") % 3
        blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
        layer = F.when(kind == 1, F.concat(F.left("text", F.lit(300)), F.repeat(F.lit("\ufffd"), F.lit(9)))).otherwise(F.left("text", F.lit(300)))
        valid = F.when(kind == 0, F.lit(None).cast("double")).when(kind == 1, F.lit(0.5)).otherwise(F.lit(1.0))
        rows = table(spark, folder, "documents", "doc_id", "text").withColumn("text", F.replace("text", F.lit("\r"), F.lit(""))).withColumn("t", U.embedded_trust(F.when(blank, F.lit("")).otherwise(layer), valid, F.lit("")))
        return rows.select("doc_id", F.when(blank, "empty").when(kind == 0, "no geometry").when(kind == 1, "broken").otherwise("sound").alias("layer"), "t.state")

    @to.query("protected_formulas", "SELECT page_id, len(any_value(math_spans)) AS n_math FROM parsed_pages WHERE math_spans IS NOT NULL GROUP BY 1")
    def protected_formulas(spark: SparkSession, folder: str) -> DataFrame:
        rows = _pages(spark, folder, "text", "math_spans").filter("math_spans is not null")
        return rows.select("page_id", F.size(F.filter(U.protected("text"), lambda s: s["kind"] == "math")).cast("bigint").alias("n_math"))

    @to.query("formatted_pages", "SELECT page_id, true AS stable, true AS kept FROM parsed_pages WHERE text IS NOT NULL GROUP BY 1")
    def formatted_pages(spark: SparkSession, folder: str) -> DataFrame:
        rows = _pages(spark, folder, "text").filter("text is not null").withColumn("once", U.formatted("text"))
        same = lambda c: F.transform(U.protected(c), lambda s: F.substring(c, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))
        return rows.select("page_id", (U.formatted("once") == F.col("once")).alias("stable"), (same(F.col("once")) == same(F.col("text"))).alias("kept"))

    @to.query("region_keys", f"WITH {_B} SELECT block_id, {_KEY} AS key FROM b WHERE kind = 'formula'")
    def region_keys(spark: SparkSession, folder: str) -> DataFrame:
        return _blocks(spark, folder).filter("kind = 'formula'").select("block_id", U.region_key("markdown").alias("key"))

    @to.query("math_keys", rf"WITH {_B} SELECT block_id, trim(regexp_replace(regexp_replace(regexp_replace(markdown, '\\(mathrm|text|left|right|[bB]igg?)\b', '', 'g'), '\\([lg]e)q\b', '\\\1', 'g'), '\\[()\[\]]|\$\$|\s', '', 'g'), '.,; ') AS key FROM b WHERE kind = 'formula'")
    def math_keys(spark: SparkSession, folder: str) -> DataFrame:
        return _blocks(spark, folder).filter("kind = 'formula'").select("block_id", U.math_key("markdown").alias("key"))

    area = "greatest(0, bbox.x1 - bbox.x0) * greatest(0, bbox.y1 - bbox.y0) > 0"

    @to.query("copied_blocks", f"WITH {_B} SELECT block_id, 'same_region' AS reason FROM b WHERE kind = 'text' AND bbox IS NOT NULL AND {area} AND NOT contains(lower(markdown), '<table') AND length({_KEY}) >= 96")
    def copied_blocks(spark: SparkSession, folder: str) -> DataFrame:
        # Every block is on a page of its own, with itself again after it.
        rows = _blocks(spark, folder).select("block_id", "kind", "markdown", "bbox", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
        return U.duplicate_blocks(rows, ["block_id"], "n").select("block_id", "reason")

    @to.query("copied_regions", f"WITH {_B} SELECT block_id, 0 AS earlier FROM b WHERE bbox IS NOT NULL AND {area} AND length(markdown) >= 64")
    def copied_regions(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).select("block_id", "kind", "markdown", "bbox", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
        return D.repeated_regions(rows, ["block_id"], "n").select("block_id", "earlier")

    @to.query(
        "planted_overlaps",
        rf"WITH {_READS}, t AS (SELECT book_id, page_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM r), x AS (SELECT book_id, page_no * 2 AS p, t FROM t UNION ALL SELECT book_id, page_no * 2 + 1, CASE page_no % 3 WHEN 0 THEN t WHEN 1 THEN left(t, length(t) - length(t) // 3) ELSE 'other ' || page_no END FROM t), "
        "y AS (SELECT book_id, p, t AS a, lead(p) OVER w AS n, lead(t) OVER w AS b FROM x WINDOW w AS (PARTITION BY book_id ORDER BY p)) SELECT book_id, p AS page_no, CASE WHEN a = b THEN 'equal' WHEN (contains(a, trim(b)) OR contains(b, a)) THEN 'contained' END AS kind FROM y WHERE n = p + 1 AND p % 2 = 0 AND a <> '' AND b <> '' AND (p // 2) % 3 < 2",
    )
    def planted_overlaps(spark: SparkSession, folder: str) -> DataFrame:
        reads = table(spark, folder, "ocr_observations", "observation_id", "book_id", "page_no", "raw").groupBy("book_id", "page_no").agg(F.min_by("raw", "observation_id").alias("raw"))
        t = F.trim(F.regexp_replace("raw", r"\s+", " "))
        copy = F.when(F.col("page_no") % 3 == 0, t).when(F.col("page_no") % 3 == 1, F.left(t, F.length(t) - F.floor(F.length(t) / 3).cast("int"))).otherwise(F.concat(F.lit("other "), "page_no"))
        rows = reads.select("book_id", (F.col("page_no") * 2).alias("page_no"), t.alias("t")).unionByName(reads.select("book_id", (F.col("page_no") * 2 + 1).alias("page_no"), copy.alias("t")))
        return Q.adjacent_overlap(rows, ["book_id"], "page_no", "t").filter("page_no % 2 = 0").select("book_id", "page_no", "kind")

    @to.query("broken_formulas", rf"WITH {_B} SELECT block_id FROM b WHERE kind = 'formula' AND len(regexp_extract_all(left(markdown, length(markdown) - 3), '\{{')) <> len(regexp_extract_all(left(markdown, length(markdown) - 3), '\}}'))")
    def broken_formulas(spark: SparkSession, folder: str) -> DataFrame:
        # Every formula without its last three characters.
        rows = _blocks(spark, folder).filter("kind = 'formula'").select("block_id", F.left("markdown", F.length("markdown") - 3).alias("m"))
        return rows.filter(~Q.balanced_math("m")).select("block_id")

    @to.query(
        "joined_link_boxes",
        f"WITH {_B}, o AS (SELECT *, kind = lag(kind) OVER w AND bbox.y0 - lag(bbox.y1) OVER w BETWEEN -greatest(bbox.y1 - bbox.y0, lag(bbox.y1) OVER w - lag(bbox.y0) OVER w) - 3 AND 35 AS j FROM b WHERE markdown <> '' AND bbox IS NOT NULL WINDOW w AS (PARTITION BY observation_id ORDER BY ordinal)), "
        "q AS (SELECT *, sum(CASE WHEN coalesce(j, false) THEN 0 ELSE 1 END) OVER (PARTITION BY observation_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT observation_id, min(ordinal) AS first, any_value(kind) AS target, string_agg(markdown, '' ORDER BY ordinal) AS text, min(bbox.x0) AS x0, max(bbox.y1) AS y1 FROM q GROUP BY observation_id, run",
    )
    def joined_link_boxes(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).filter("bbox is not null").withColumn("target", F.col("kind")).withColumn("text", F.col("markdown"))
        return U.joined_links(rows, ["observation_id"], "ordinal").select("observation_id", "first", "target", "text", "bbox.x0", "bbox.y1")

    @to.query(
        "native_lines",
        rf"WITH {_B}, g AS (SELECT * FROM b WHERE bbox.x0 >= 0 AND bbox.x0 < bbox.x1 AND bbox.x1 <= 1000 AND bbox.y0 >= 0 AND bbox.y0 < bbox.y1 AND bbox.y1 <= 1000 AND trim(markdown) <> '' AND NOT regexp_matches(markdown, '[\x{{FFFD}}\p{{Cc}}]')), l AS (SELECT observation_id, floor(bbox.y0 / 50) AS line, min(bbox.x0) AS x0, max(bbox.y1) AS y1, min(bbox.y0) AS y0, string_agg(markdown, '' ORDER BY ordinal) AS text FROM g GROUP BY 1, 2) "
        r"SELECT observation_id, CAST(line AS BIGINT) AS line, x0, y1, text, CASE WHEN regexp_matches(lower(text), '^(\d+|[ivxlcdm]+)$') AND (y0 > 890 OR y1 < 65) THEN 'page_number' END AS excluded FROM l",
    )
    def native_lines(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).filter("bbox is not null").withColumn("line", F.floor(F.col("bbox.y0") / 50)).withColumn("text", F.col("markdown"))
        return U.native_regions(rows, ["observation_id"], "line", "ordinal").select("observation_id", "line", "bbox.x0", "bbox.y1", "text", "excluded")


def _evidence(to: Registry) -> None:
    @to.query("aligned_titles", f"WITH {_B} SELECT block_id, length(markdown) - 1 AS n FROM b WHERE kind = 'title' AND markdown <> ''")
    def aligned_titles(spark: SparkSession, folder: str) -> DataFrame:
        # A title against itself with its last character lost; what is left is found at its places.
        rows = _blocks(spark, folder).filter("kind = 'title' and markdown <> ''")
        pairs = V.alignment("markdown", F.left("markdown", F.length("markdown") - 1))
        return rows.select("block_id", F.size(F.filter(pairs, lambda p: p["a"] == p["b"])).cast("bigint").alias("n"))

    @to.query("merged_details", f"WITH {_B} SELECT block_id, 'The quick fox of ' || block_id || ' sees an old dog' AS text FROM b")
    def merged_details(spark: SparkSession, folder: str) -> DataFrame:
        own = lambda a, b, c: F.concat(F.lit(a), "block_id", F.lit(f" {b} an old {c}"))
        return _blocks(spark, folder).select("block_id", V.with_detail(own("The qnick fox of ", "sees", "dog"), own("The quick fox of ", "secs", "dog"), own("the quick fox of ", "sees", "dog")).alias("text"))

    corner = "(greatest(0, least(bbox.x1, 1000) - greatest(bbox.x0, 900)) * greatest(0, least(bbox.y1, 1000) - greatest(bbox.y0, 980)))"

    @to.query("adopted_regions", f"WITH {_B} SELECT block_id, CAST(coalesce(bbox.y0 <= 980, false) AS INT) AS place FROM b WHERE block_id % 2 = 0 AND (bbox IS NULL OR {corner} / 2000 < 0.35)")
    def adopted_regions(spark: SparkSession, folder: str) -> DataFrame:
        # Every block is a page; at its foot another read has words that the text layer has too for every second page.
        rows = _blocks(spark, folder)
        foot = F.struct(F.lit(900.0).alias("x0"), F.lit(980.0).alias("y0"), F.lit(1000.0).alias("x1"), F.lit(1000.0).alias("y1"))
        found = rows.select("block_id", F.lit(1).alias("id"), F.lit("note").alias("kind"), F.concat(F.lit("foot of "), "block_id").alias("text"), foot.alias("bbox"))
        native = found.select("block_id", F.when(F.col("block_id") % 2 == 0, F.col("text")).otherwise("nothing").alias("text"), "bbox")
        held = rows.select("block_id", F.lit(1).alias("id"), "kind", F.col("markdown").alias("text"), "bbox")
        return V.adopted_regions(found, held, native, ["block_id"]).select("block_id", "place")


def _planted(to: Registry) -> None:
    @to.query("planted_loops", "SELECT DISTINCT observation_id FROM ocr_observations WHERE observation_id % 2 = 0")
    def planted_loops(spark: SparkSession, folder: str) -> DataFrame:
        # Every second read has a loop in its middle, each with a counter of its own; the others hold it too few times.
        rows = table(spark, folder, "ocr_observations", "observation_id").distinct()
        head = F.concat(F.lit("A page numbered "), "observation_id", F.lit(" begins here. "))
        text = F.concat(head, F.repeat(F.lit("one and two; "), F.when(F.col("observation_id") % 2 == 0, 30).otherwise(3)), F.lit("Then it ends with other words."))
        return rows.withColumn("t", text).filter(P.looping("t")).select("observation_id")

    @to.query("planted_phrases", f"WITH {_B} SELECT block_id FROM b WHERE block_id % 3 = 0")
    def planted_phrases(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).select("block_id", F.concat(F.lit("block "), "block_id", F.lit(": "), F.repeat(F.lit("Ends here. "), F.when(F.col("block_id") % 3 == 0, 3).otherwise(2)), F.lit("so")).alias("t"))
        return rows.filter(Q.triple_phrase("t")).select("block_id")

    @to.query("planted_runaways", f"WITH {_B} SELECT block_id, length('so it goes ') * (block_id % 12) + 4 AS before, length('so it goes ') + 5 AS after FROM b WHERE block_id % 12 >= 8")
    def planted_runaways(spark: SparkSession, folder: str) -> DataFrame:
        # A phrase of three words stands up to eleven times; from eight on it is cut to one.
        rows = _blocks(spark, folder).select("block_id", F.concat(F.repeat(F.lit("so it goes "), (F.col("block_id") % 12).cast("int")), F.lit("done")).alias("t")).withColumn("cut", Q.truncated_runaway("t"))
        return rows.filter("cut <> t").select("block_id", F.length("t").alias("before"), F.length("cut").alias("after"))

    @to.query(
        "planted_tables",
        "WITH p AS (SELECT DISTINCT book_id, page_no FROM ocr_observations), g AS (SELECT *, page_no - row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS g FROM p) SELECT book_id, min(page_no) AS first_page, count(*) AS n_pages, 1 + 2 * count(*) AS n_rows FROM g GROUP BY book_id, g",
    )
    def planted_tables(spark: SparkSession, folder: str) -> DataFrame:
        # Every page has a table with the same header, and the last row of the page before again.
        row = lambda n: F.concat(F.lit("| r"), n.cast("string"), F.lit(" | x |\n"))
        n = F.col("page_no") * 2
        text = F.concat(F.lit("| name | value |\n| --- | --- |\n"), row(n), row(n + 1))
        rows = table(spark, folder, "ocr_observations", "book_id", "page_no").distinct().withColumn("t", text)
        return D.continued_tables(rows, "book_id", "page_no", "t")

    @to.query("event_gaps", "WITH g AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, p AS after_no, event_id AS before_no FROM g WHERE event_id - p <> 1")
    def event_gaps(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "events", "user_id", "event_id").distinct()
        before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
        return rows.withColumn("after_no", before).filter("event_id - after_no <> 1").select("user_id", "after_no", F.col("event_id").alias("before_no"))

    @to.query(
        "breadcrumb_trails",
        "WITH p AS (SELECT page_id, any_value(path) AS path, any_value(headings) AS h FROM parsed_pages WHERE headings IS NOT NULL GROUP BY 1), i AS (SELECT path, h, unnest(range(1, len(h) + 1)) AS i FROM p) "
        "SELECT path, h[i].line AS line, array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(h[1:i], lambda x: [CAST(x.level AS VARCHAR), x.text])), lambda a, x: list_concat(a[1:CAST(x[1] AS INT) - 1], [x[2]])), ' > ') AS breadcrumb FROM i",
    )
    def breadcrumb_trails(spark: SparkSession, folder: str) -> DataFrame:
        pages = _pages(spark, folder, "text", "headings").filter("headings is not null")
        return C.parse_pages(pages.select("path", "text")).select("path", F.explode("headings").alias("h")).select("path", "h.line", F.array_join("h.crumbs", " > ").alias("breadcrumb"))


def _identities(to: Registry) -> None:
    unit = "v AS (SELECT label, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings)"
    scores = f"{unit}, s AS (SELECT a.vec_id % 20 AS grp, a.vec_id, b.label, max(list_dot_product(a.v, b.v)) AS m FROM v a, v b GROUP BY 1, 2, 3), p AS (SELECT grp, label, avg(m) AS score FROM s GROUP BY 1, 2)"

    def scored(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "embeddings").withColumn("grp", F.col("vec_id") % 20)
        return I.sample_similarity(rows, rows, "grp", "label", "embedding")

    @to.query("profile_similarity", f"WITH {scores} SELECT grp, label, round(score, 4) AS score FROM p")
    def profile_similarity(spark: SparkSession, folder: str) -> DataFrame:
        return scored(spark, folder).select("grp", "label", F.round("score", 4).alias("score"))

    @to.query(
        "one_to_one_identities",
        f"WITH {scores}, n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, label DESC) AS r FROM p), t AS (SELECT grp, max(CASE WHEN r = 1 THEN label END) AS best, max(CASE WHEN r = 1 THEN round(score, 9) END) AS a, max(CASE WHEN r = 2 THEN round(score, 9) END) AS b FROM n GROUP BY 1), "
        "g AS (SELECT grp, grp % 4 AS win, best, a, a - b AS lead, a >= 0.2 AND coalesce(a - b >= 0.005, true) AS e FROM t), q AS (SELECT *, row_number() OVER (PARTITION BY win, best, e ORDER BY a DESC, grp DESC) AS k FROM g) "
        "SELECT win, grp, CASE WHEN e AND k = 1 THEN best END AS label, CASE WHEN e AND k = 1 THEN 'threshold_and_margin_met' WHEN a < 0.2 THEN 'below_similarity_threshold' WHEN lead < 0.005 THEN 'ambiguous_margin' ELSE 'one_to_one_conflict' END AS reason FROM q",
    )
    def one_to_one_identities(spark: SparkSession, folder: str) -> DataFrame:
        rows = scored(spark, folder).withColumn("win", F.col("grp") % 4)
        groups = rows.select("win", "grp").distinct().withColumn("n_samples", F.lit(1))
        return I.assign_one_to_one(rows, groups, "win", "grp", "label", 0.2, 0.005).select("win", "grp", "label", "reason")


def register(to: Registry) -> None:
    """Add the queries."""
    _search(to)
    _relations(to)
    _layout(to)
    _evidence(to)
    _planted(to)
    _identities(to)
