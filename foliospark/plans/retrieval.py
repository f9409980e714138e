"""Search queries over documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import search as R
from foliospark.plans.registry import Registry
from foliospark.sources.tables import table

QUERY, VARIANT = "castle treaty empire", "crew of the orbit"

_TOKENS = r"list_transform(list_filter(string_split_regex({0}, '[^\p{{L}}\p{{N}}]+'), lambda x: strlen(x) > 1), lambda x: lower(x))"
_BM25 = (
    r"""
docs AS (SELECT doc_id, concat_ws(' ', path, title, text) AS s, """ + _TOKENS.format("concat_ws(' ', path, title, text)") + r""" AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM docs),
terms AS (SELECT qid, unnest(list_distinct(""" + _TOKENS.format("q") + r""")) AS term FROM qs),
ex AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM docs),
hits AS (SELECT doc_id, term, any_value(l) AS l, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
sc AS (
  SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / greatest(a, 1)))) AS s
  FROM terms JOIN hits USING (term) JOIN df USING (term), st GROUP BY 1, 2
  UNION ALL SELECT qid, doc_id, 2.0 FROM qs, docs WHERE contains(lower(s), lower(trim(q)))),
scores AS (SELECT qid, doc_id, sum(s) AS score FROM sc GROUP BY 1, 2 HAVING sum(s) > 0)
"""
)


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "path", "title", "text").select("doc_id", T.search_text("path", "title", "text").alias("s"))


def _asked(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "qid int, q string")


def register(to: Registry) -> None:
    """Add the retrieval queries."""

    @to.query("bm25_topk", f"WITH qs AS (SELECT 0 AS qid, '{QUERY}' AS q), {_BM25} SELECT doc_id, round(score, 9) AS score FROM scores ORDER BY score DESC, doc_id LIMIT 10")
    def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
        scores = R.bm25(_docs(spark, folder), "doc_id", "s", _asked(spark, QUERY), "qid", "q")
        return scores.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 9).alias("score"))

    @to.query("phrase_bonus", f"WITH qs AS (SELECT 0 AS qid, 'the castle' AS q), {_BM25} SELECT doc_id, round(score, 9) AS score FROM scores ORDER BY score DESC, doc_id LIMIT 20")
    def phrase_bonus(spark: SparkSession, folder: str) -> DataFrame:
        scores = R.bm25(_docs(spark, folder), "doc_id", "s", _asked(spark, "the castle"), "qid", "q")
        return scores.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 9).alias("score"))

    @to.query(
        "bm25_multi_query",
        f"WITH qs AS (SELECT item_id AS qid, answer || ' ' || suite AS q FROM eval_items WHERE answer IS NOT NULL), {_BM25} SELECT qid AS item_id, doc_id, round(score, 9) AS score, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rn FROM scores) WHERE rn <= 3",
    )
    def bm25_multi_query(spark: SparkSession, folder: str) -> DataFrame:
        asked = table(spark, folder, "eval_items").filter("answer is not null").select("item_id", F.concat_ws(" ", "answer", "suite").alias("q"))
        scores = R.bm25(_docs(spark, folder), "doc_id", "s", asked, "item_id", "q").withColumn("score", F.round("score", 9))
        return R.ranked(scores, ["item_id"], [F.desc("score"), F.col("doc_id")], 3)

    @to.query(
        "rrf_two_formulations",
        f"WITH qs AS (SELECT 0 AS qid, '{QUERY}' AS q UNION ALL SELECT 1, '{VARIANT}'), {_BM25}, lists AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rn FROM scores), "
        "fused AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rn)) AS score FROM lists WHERE rn <= 30 GROUP BY 1) SELECT doc_id, round(score, 9) AS score FROM fused ORDER BY round(score, 9) DESC, doc_id LIMIT 10",
    )
    def rrf_two_formulations(spark: SparkSession, folder: str) -> DataFrame:
        scores = R.bm25(_docs(spark, folder), "doc_id", "s", _asked(spark, QUERY, VARIANT), "qid", "q").withColumn("score", F.round("score", 9))
        lists = R.ranked(scores, ["qid"], [F.desc("score"), F.col("doc_id")], R.CANDIDATES)
        return R.fuse(lists, [], "doc_id").withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(10)

    @to.query("term_df_stats", f"WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1")
    def term_df_stats(spark: SparkSession, folder: str) -> DataFrame:
        # Counted per document first: the second grouping is over distinct pairs.
        per = R.postings(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
        return per.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))

    @to.query("corpus_stats", f"WITH d AS (SELECT len({_TOKENS.format('text')}) AS l, updated_at FROM documents) SELECT count(*) AS pages, round(coalesce(avg(l), 0), 6) AS mean_length, count(*) FILTER (WHERE l = 0) AS empty, count(updated_at) AS dated FROM d")
    def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "documents", "text", "updated_at").select(F.size(T.tokens("text")).alias("l"), "updated_at")
        return rows.agg(F.count("*").alias("pages"), F.round(F.coalesce(F.avg("l"), F.lit(0.0)), 6).alias("mean_length"), F.count_if(F.col("l") == 0).alias("empty"), F.count("updated_at").alias("dated"))

    edges_sql = "edges AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem), pairs AS (SELECT DISTINCT * FROM (SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges)), deg AS (SELECT source, count(*) AS d FROM pairs GROUP BY 1)"

    @to.query(
        "graph_expand",
        f"WITH {edges_sql}, scores AS (SELECT 'p' || p_partkey AS page, p_retailprice / 1000 AS score FROM part WHERE p_size = 11) "
        "SELECT page, round(sum(score), 6) AS score FROM (SELECT page, score FROM scores UNION ALL SELECT b.target, s.score * 0.15 / sqrt(d) FROM scores s JOIN deg ON deg.source = s.page JOIN pairs b ON b.source = s.page) GROUP BY 1",
    )
    def graph_expand(spark: SparkSession, folder: str) -> DataFrame:
        edges = table(spark, folder, "lineitem", "l_partkey", "l_suppkey").distinct().select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
        scores = table(spark, folder, "part").filter("p_size = 11").select(F.concat(F.lit("p"), "p_partkey").alias("page"), (F.col("p_retailprice") / 1000).alias("score"))
        return R.expand_by_links(scores, edges).select("page", F.round("score", 6).alias("score"))

    def first_vector(spark: SparkSession, folder: str) -> list[float]:
        # One row by key.
        return list(table(spark, folder, "embeddings").filter("vec_id = 0").select("embedding").first()[0])

    cos = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

    @to.query("cosine_topk", f"SELECT a.vec_id, round({cos}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {cos} DESC, a.vec_id LIMIT 10")
    def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
        return R.exact_top(table(spark, folder, "embeddings"), "vec_id", "embedding", first_vector(spark, folder), 10).select("vec_id", F.round("score", 6).alias("score"))

    @to.query("cosine_filtered_topk", f"SELECT a.vec_id, round({cos}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.label = 3 ORDER BY {cos} DESC, a.vec_id LIMIT 10")
    def cosine_filtered_topk(spark: SparkSession, folder: str) -> DataFrame:
        return R.exact_top(table(spark, folder, "embeddings"), "vec_id", "embedding", first_vector(spark, folder), 10, F.col("label") == 3).select("vec_id", F.round("score", 6).alias("score"))

    bad = "CASE WHEN vector IS NULL THEN 'missing' WHEN len(vector) <> dimensions THEN 'dimensions' WHEN len(list_filter(vector, lambda c: c IS NULL OR NOT isfinite(c))) > 0 THEN 'not finite' WHEN len(list_filter(vector, lambda c: c <> 0)) = 0 THEN 'zero' ELSE 'ok' END"

    @to.query("vector_space_validate", f"SELECT space_namespace, recipe, dimensions, {bad} AS state, count(*) AS n, count(DISTINCT vec_id) AS ids FROM vector_records GROUP BY 1, 2, 3, 4")
    def vector_space_validate(spark: SparkSession, folder: str) -> DataFrame:
        v = F.col("vector")
        state = (
            F.when(v.isNull(), "missing").when(F.size(v) != F.col("dimensions"), "dimensions")
            .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("ok")
        )
        rows = table(spark, folder, "vector_records").select("space_namespace", "recipe", "dimensions", "vec_id", state.alias("state"))
        return rows.groupBy("space_namespace", "recipe", "dimensions", "state").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"))
