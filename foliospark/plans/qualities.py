"""Queries on text quality, page geometry and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import geometry as G
from foliospark.operators import identity as I
from foliospark.operators import quality as Q
from foliospark.plans.registry import Registry
from foliospark.sources.tables import table

_W = r"regexp_extract_all(lower(coalesce({0}, '')), '(\p{{L}}+|\p{{N}}+)')"
_BLOCKS = "b AS (SELECT DISTINCT block_id, observation_id, book_id, page_no, ordinal, kind, markdown, bbox, confidence FROM blocks)"
_AREA = "(greatest(0, {0}.x1 - {0}.x0) * greatest(0, {0}.y1 - {0}.y0))"
_SHARED = "(greatest(0, least(p.bbox.x1, q.bbox.x1) - greatest(p.bbox.x0, q.bbox.x0)) * greatest(0, least(p.bbox.y1, q.bbox.y1) - greatest(p.bbox.y0, q.bbox.y0)))"


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks", "block_id", "observation_id", "book_id", "page_no", "ordinal", "kind", "markdown", "bbox", "confidence").distinct()


def register(to: Registry) -> None:
    """Add the quality queries."""

    @to.query("token_coverage", f"SELECT item_id, round(CASE WHEN len(list_distinct(a)) = 0 THEN 1 ELSE len(list_intersect(list_distinct(a), b)) / len(list_distinct(a)) END, 6) AS coverage FROM (SELECT item_id, {_W.format('answer')} AS a, {_W.format('prompt')} AS b FROM eval_items)")
    def token_coverage(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "eval_items")
        return rows.select("item_id", F.round(Q.token_coverage(Q.words(F.coalesce("answer", F.lit(""))), Q.words(F.coalesce("prompt", F.lit("")))), 6).alias("coverage"))

    @to.query(
        "multiset_precision_recall",
        f"WITH x AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_W.format('title')}) AS w FROM documents) GROUP BY 1, 2), y AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_W.format('path')}) AS w FROM documents) GROUP BY 1, 2), "
        "j AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, x.n AS a, y.n AS b FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.w = y.w) SELECT doc_id, round(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) ELSE 0 END) / sum(b), 6) AS precision, round(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) ELSE 0 END) / sum(a), 6) AS recall FROM j GROUP BY 1",
    )
    def multiset_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
        out = Q.multiset_overlap(table(spark, folder, "documents", "doc_id", "title", "path"), ["doc_id"], "title", "path")
        return out.select("doc_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))

    @to.query(
        "repeated_line_share",
        r"WITH l AS (SELECT doc_id, trim(unnest(string_split_regex(text, '\r?\n'))) AS l FROM documents), p AS (SELECT doc_id, l, count(*) AS n FROM l WHERE l <> '' GROUP BY 1, 2) SELECT doc_id, sum(n) AS n_lines, count(*) AS n_distinct, round((sum(n) - count(*)) / sum(n), 6) AS repeated_share, round(max(n) / sum(n), 6) AS top_share FROM p GROUP BY 1",
    )
    def repeated_line_share(spark: SparkSession, folder: str) -> DataFrame:
        out = Q.repeated_lines(table(spark, folder, "documents", "doc_id", "text"), ["doc_id"], "text")
        return out.select("doc_id", "n_lines", "n_distinct", F.round("repeated_share", 6).alias("repeated_share"), F.round("top_share", 6).alias("top_share"))

    @to.query("boilerplate_blocks", rf"WITH {_BLOCKS} SELECT book_id, form, count(*) AS n_pages FROM (SELECT DISTINCT book_id, page_no, regexp_replace(regexp_replace(lower(trim(markdown)), '\d+', '#', 'g'), '\s+', ' ', 'g') AS form FROM b WHERE bbox.y0 <= 80 OR bbox.y1 >= 940) WHERE form <> '' GROUP BY 1, 2 HAVING count(*) >= 2")
    def boilerplate_blocks(spark: SparkSession, folder: str) -> DataFrame:
        return Q.boilerplate(_blocks(spark, folder), "book_id", "page_no")

    @to.query(
        "triple_phrases",
        f"WITH b AS (SELECT DISTINCT block_id, {_W.format('markdown')} AS w FROM blocks), k AS (SELECT block_id, w, unnest(range(1, least(35, len(w) // 3) + 1)) AS k FROM b), i AS (SELECT block_id, w, k, unnest(range(1, len(w) - 3 * k + 2)) AS i FROM k) SELECT DISTINCT block_id FROM i WHERE w[i:i + k - 1] = w[i + k:i + 2 * k - 1] AND w[i:i + k - 1] = w[i + 2 * k:i + 3 * k - 1]",
    )
    def triple_phrases(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "blocks", "block_id", "markdown").filter(Q.triple_phrase(F.coalesce("markdown", F.lit("")))).select("block_id").distinct()

    @to.query("runaway_blocks")
    def runaway_blocks(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "blocks", "block_id", "markdown").distinct().withColumn("cut", Q.truncated_runaway("markdown"))
        return rows.filter("cut <> markdown").select("block_id", F.length("markdown").alias("before"), F.length("cut").alias("after"))

    @to.query(
        "table_quality",
        rf"WITH {_BLOCKS}, l AS (SELECT block_id, unnest(string_split_regex(markdown, '\r?\n')) AS l FROM b), r AS (SELECT block_id, list_transform(string_split_regex(regexp_replace(trim(l), '^\||\|$', '', 'g'), '\|'), lambda x: trim(x)) AS c FROM l WHERE regexp_matches(l, '^\s*\|.*\|\s*$') AND NOT regexp_matches(l, '^[\s|:-]+$')) "
        "SELECT block_id, count(*) AS n_rows, max(len(c)) AS n_columns, count(*) - count(DISTINCT list_aggregate(c, 'string_agg', '|')) AS repeated_rows FROM r GROUP BY 1",
    )
    def table_quality(spark: SparkSession, folder: str) -> DataFrame:
        return Q.table_quality(_blocks(spark, folder), ["block_id"], "markdown").select("block_id", "n_rows", "n_columns", "repeated_rows")

    @to.query(
        "confidence_summary",
        f"WITH {_BLOCKS}, x AS (SELECT book_id, ln(confidence) AS lp, confidence AS p FROM b WHERE confidence > 0), r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY exp(lp)) AS i, count(*) OVER (PARTITION BY book_id) AS n FROM x) "
        "SELECT book_id, count(*) AS n_tokens, round(exp(avg(lp)), 6) AS mean, round(min(CASE WHEN i >= greatest(1, ceil(n * 0.05)) THEN exp(lp) END), 6) AS low, round(min(exp(lp)), 6) AS least, round(avg(CASE WHEN p < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS below_half FROM r GROUP BY 1",
    )
    def confidence_summary(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).filter("confidence > 0").withColumn("lp", F.log("confidence"))
        return Q.confidence_summary(rows, ["book_id"], "lp")

    @to.query("compared_reads")
    def compared_reads(spark: SparkSession, folder: str) -> DataFrame:
        # Pages read twice: the second read against the first.
        rows = table(spark, folder, "ocr_observations", "observation_id", "book_id", "page_no", "raw").groupBy("book_id", "page_no").agg(F.min_by("raw", "observation_id").alias("a"), F.max_by("raw", "observation_id").alias("b"), F.count_distinct("observation_id").alias("n")).filter("n > 1")
        out = Q.compare(rows, "a", "b")
        return out.select("book_id", "page_no", F.round("similarity", 6).alias("similarity"), F.round("coverage", 6).alias("coverage"), F.round("length_ratio", 6).alias("length_ratio"), "warnings")

    @to.query(
        "box_overlaps",
        f"WITH {_BLOCKS.replace('b AS', 'u AS')}, b AS (SELECT observation_id, block_id, {{'x0': bbox.x0 - 10, 'y0': bbox.y0 - 10, 'x1': bbox.x1 + 10, 'y1': bbox.y1 + 10}} AS bbox FROM u WHERE bbox IS NOT NULL) SELECT p.observation_id, p.block_id, q.block_id AS other, round({_SHARED} / ({_AREA.format('p.bbox')} + {_AREA.format('q.bbox')} - {_SHARED}), 6) AS iou, round({_SHARED} / {_AREA.format('p.bbox')}, 6) AS coverage FROM b p JOIN b q ON p.observation_id = q.observation_id AND p.block_id < q.block_id WHERE {_SHARED} > 0",
    )
    def box_overlaps(spark: SparkSession, folder: str) -> DataFrame:
        padded = _blocks(spark, folder).withColumn("bbox", G.padded(F.col("bbox"), 10.0))
        out = G.overlapping_pairs(padded, ["observation_id"], "block_id")
        return out.select("observation_id", "block_id", "other", F.round("iou", 6).alias("iou"), F.round("coverage", 6).alias("coverage"))

    @to.query("page_envelopes", f"WITH {_BLOCKS} SELECT observation_id, min(bbox.x0) AS x0, min(bbox.y0) AS y0, max(bbox.x1) AS x1, max(bbox.y1) AS y1, median(bbox.y1 - bbox.y0) AS median_height FROM b WHERE bbox IS NOT NULL GROUP BY 1")
    def page_envelopes(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).filter("bbox is not null")
        return rows.groupBy("observation_id").agg(G.envelope(F.col("bbox")).alias("e"), F.median(F.col("bbox.y1") - F.col("bbox.y0")).alias("median_height")).select("observation_id", "e.*", "median_height")

    @to.query(
        "column_bands",
        f"WITH {_BLOCKS}, s AS (SELECT observation_id, block_id, CASE WHEN bbox.x0 - lag(bbox.x0) OVER w > 45 THEN 1 ELSE 0 END AS st, bbox.x0 AS x FROM b WHERE bbox IS NOT NULL WINDOW w AS (PARTITION BY observation_id ORDER BY bbox.x0, block_id)) SELECT observation_id, block_id, 1 + sum(st) OVER (PARTITION BY observation_id ORDER BY x, block_id ROWS UNBOUNDED PRECEDING) AS band FROM s",
    )
    def column_bands(spark: SparkSession, folder: str) -> DataFrame:
        return G.column_bands(_blocks(spark, folder), ["observation_id"], "block_id")

    @to.query(
        "page_groups",
        "WITH p AS (SELECT book_id, page_no, max(CASE WHEN kind = 'title' THEN 1 ELSE 0 END) AS st FROM blocks GROUP BY 1, 2), n AS (SELECT *, CASE WHEN st = 1 OR page_no - lag(page_no) OVER w <> 1 OR lag(page_no) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM p WINDOW w AS (PARTITION BY book_id ORDER BY page_no)), "
        "r AS (SELECT *, sum(nw) OVER (PARTITION BY book_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS run FROM n), q AS (SELECT *, (row_number() OVER (PARTITION BY book_id, run ORDER BY page_no) - 1) // 8 AS part FROM r), "
        "f AS (SELECT *, CASE WHEN run <> lag(run) OVER w OR part <> lag(part) OVER w OR lag(run) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM q WINDOW w AS (PARTITION BY book_id ORDER BY page_no)) SELECT book_id, page_no, sum(f) OVER (PARTITION BY book_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS group_no FROM f",
    )
    def page_groups(spark: SparkSession, folder: str) -> DataFrame:
        pages = table(spark, folder, "blocks", "book_id", "page_no", "kind").groupBy("book_id", "page_no").agg(F.max((F.col("kind") == "title").cast("int")).alias("st"))
        return G.page_groups(pages, "book_id", "page_no", F.col("st") == 1)

    # An order has one customer, so a component is a customer with its orders.
    @to.query(
        "order_components",
        "WITH m AS (SELECT o_custkey AS c, least(min(-1 - o_orderkey), min(o_custkey)) AS m FROM orders GROUP BY 1) SELECT -1 - o_orderkey AS node, m AS component FROM orders JOIN m ON c = o_custkey UNION SELECT c_custkey, coalesce(m, c_custkey) FROM customer LEFT JOIN m ON c = c_custkey UNION SELECT c, m FROM m",
    )
    def order_components(spark: SparkSession, folder: str) -> DataFrame:
        # Customers and their orders, which have the negative numbers.
        e = table(spark, folder, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").cast("bigint").alias("a"), (-1 - F.col("o_orderkey")).cast("bigint").alias("b")).distinct()
        customers = table(spark, folder, "customer", "c_custkey").select(F.col("c_custkey").cast("bigint").alias("node"))
        return G.components(e, customers.unionByName(e.select(F.col("a").alias("node"))).unionByName(e.select(F.col("b").alias("node"))))

    @to.query("box_components")
    def box_components(spark: SparkSession, folder: str) -> DataFrame:
        # Blocks whose boxes, ten points larger on every side, touch one another in chains.
        rows = _blocks(spark, folder).filter("block_id is not null").withColumn("bbox", G.padded(F.col("bbox"), 10.0))
        pairs = G.overlapping_pairs(rows, ["observation_id"], "block_id")
        return G.components(pairs.select(F.col("block_id").alias("a"), F.col("other").alias("b")), rows.select(F.col("block_id").alias("node")))

    unit = "v AS (SELECT label, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings)"

    @to.query(
        "robust_centroids",
        f"WITH {unit}, sc AS (SELECT a.label, a.vec_id, any_value(a.v) AS v, round(sum(list_dot_product(a.v, b.v)), 9) AS s, count(*) AS n FROM v a JOIN v b ON a.label = b.label GROUP BY 1, 2), m AS (SELECT label, v AS mv, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM sc) WHERE r = 1) "
        "SELECT v.label, count(*) AS n_used, any_value(n) AS n_all FROM v JOIN m ON v.label = m.label WHERE n <= 2 OR list_dot_product(v, mv) >= 0.65 GROUP BY 1",
    )
    def robust_centroids(spark: SparkSession, folder: str) -> DataFrame:
        return I.profiles(table(spark, folder, "embeddings"), "label", "vec_id", "embedding").select("label", "n_used", "n_all")

    @to.query(
        "profile_best_two",
        f"WITH {unit}, sc AS (SELECT a.label, a.vec_id, any_value(a.v) AS v, round(sum(list_dot_product(a.v, b.v)), 9) AS s, count(*) AS n FROM v a JOIN v b ON a.label = b.label GROUP BY 1, 2), m AS (SELECT label, v AS mv, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM sc) WHERE r = 1), "
        "k AS (SELECT v.label, v.v FROM v JOIN m ON v.label = m.label WHERE n <= 2 OR list_dot_product(v, mv) >= 0.65), d AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM k) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM d GROUP BY 1), "
        "s AS (SELECT vec_id, c.label AS l, round(list_cosine_similarity(v, c), 9) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, c.label) AS r FROM v, c), t AS (SELECT vec_id, max(CASE WHEN r = 1 THEN l END) AS best, max(CASE WHEN r = 1 THEN s END) AS a, max(CASE WHEN r = 2 THEN l END) AS second, max(CASE WHEN r = 2 THEN s END) AS b FROM s WHERE r <= 2 GROUP BY 1) "
        "SELECT vec_id, best, round(a, 4) AS score, second, a >= 0.3 AND a - b >= 0.02 AS matched FROM t",
    )
    def profile_best_two(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "embeddings")
        return I.best_two(rows, "vec_id", "embedding", I.profiles(rows, "label", "vec_id", "embedding"), "label", 0.3, 0.02).select("vec_id", "best", F.round("score", 4).alias("score"), "second", "matched")

    @to.query("assigned_identities")
    def assigned_identities(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "embeddings").withColumn("track", F.col("vec_id") % 10).withColumn("who", (F.col("vec_id") % 3).cast("string"))
        return I.assign_runs(rows, "track", "vec_id", "who", "embedding")
