"""Hybrid search over excerpts, and answers of outside models checked before they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators import search as R


def finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def total_order(value: Column) -> Column:
    """A sort key under which -0.0 comes before 0.0 and NaN after all; null stays null."""
    negative = (value == 0) & F.startswith(value.cast("string"), F.lit("-"))
    return F.when(value.isNotNull(), F.struct(value.alias("v"), F.when(negative, 0).otherwise(1).alias("s")))


def bad_vector_sets(responses: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """(by, reason) of vector responses that may not be used.

    ``responses``: by, position, vector; ``asked``: by, n_texts, dimensions. A set is bad if it
    has not one vector for each text, a vector of another length, or a component that is
    null or not finite. Sets in order have no row.
    """
    whole = F.forall("vector", finite)
    rows = responses.join(asked.select(by, "n_texts", "dimensions"), by)
    fit = F.coalesce((F.size("vector") == F.col("dimensions")) & whole, F.lit(False))
    got = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~fit).alias("bad"))
    joined = asked.select(by, "n_texts").join(got, by, "left").fillna(0, ["n", "bad"])
    reason = F.when(F.col("n") != F.col("n_texts"), F.lit("unexpected count")).when(F.col("bad") > 0, F.lit("unexpected dimensions or non-finite values"))
    return joined.select(by, reason.alias("reason")).filter("reason is not null")


def bad_rankings(responses: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """(by, reason) of rerank responses that may not be used.

    ``responses``: by, index, score; ``asked``: by, n_documents, top_n. Checked in this order:
    the number of results, indices outside the documents, scores that aren't finite,
    indices given twice.
    """
    rows = responses.join(asked.select(by, "n_documents"), by)
    got = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.col("index").isNull() | (F.col("index") < 0) | (F.col("index") >= F.col("n_documents"))).alias("outside"),
        F.count_if(~finite(F.col("score"))).alias("odd"), F.count_distinct("index").alias("several"),
    )
    joined = asked.select(by, F.least("n_documents", "top_n").alias("expected")).join(got, by, "left").fillna(0, ["n", "outside", "odd", "several"])
    reason = (
        F.when(F.col("n") != F.col("expected"), F.lit("unexpected number of results")).when(F.col("outside") > 0, F.lit("index outside the documents"))
        .when(F.col("odd") > 0, F.lit("non-finite score")).when(F.col("several") != F.col("n"), F.lit("duplicate index"))
    )
    return joined.select(by, reason.alias("reason")).filter("reason is not null")


def reranked(candidates: DataFrame, responses: DataFrame, by: str, key: str, limit: int, top_n: int | None = None) -> DataFrame:
    """(by, key, rank, score, rerank_score, degraded): candidates in the order of the reranker, where its answer holds.

    ``candidates``: by, key, rank (1-based, fused), score; ``responses``: by, index (0-based
    place among the candidates), score. A query without an answer, or with a bad one, keeps
    its fused order and says why in ``degraded``: nothing fails. Candidates the reranker
    left out come last; ties go by fused score, then rank.
    """
    asked = candidates.groupBy(by).agg(F.count("*").alias("n_documents")).withColumn("top_n", F.lit(top_n or limit))
    bad = bad_rankings(responses, asked, by).select(by, F.concat(F.lit("rerank: "), "reason").alias("degraded"))
    given = responses.select(by, (F.col("index") + 1).cast("int").alias("rank"), F.col("score").alias("rerank_score")).filter(finite(F.col("rerank_score"))).dropDuplicates([by, "rank"])
    rows = candidates.withColumn("rank", F.col("rank").cast("int")).join(bad, by, "left").join(given, [by, "rank"], "left")
    rows = rows.withColumn("rerank_score", F.when(F.col("degraded").isNull(), F.col("rerank_score")))
    order = W.partitionBy(by).orderBy(F.coalesce("rerank_score", F.lit(float("-inf"))).desc(), F.desc("score"), F.col("rank"))
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).select(by, key, F.col("_n").alias("rank"), "score", "rerank_score", "degraded")


def add_page_signals(scores: DataFrame, chunks: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(by, chunk, score): what linked pages give is added to a page's first chunk.

    ``scores``: by, chunk, score; ``chunks``: chunk, page, chunk_no; ``edges``: source, target of
    pages, taken without direction and once. A page counts with its best chunk and gives
    each neighbour ``GRAPH / sqrt(its degree)`` of it.
    """
    both = edges.filter("source is not null and target is not null and source != target").select("source", "target")
    both = both.unionByName(both.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    degree = both.groupBy("source").agg(F.count("*").alias("_d"))
    best = scores.join(chunks.select("chunk", "page"), "chunk").groupBy(by, F.col("page").alias("source")).agg(F.max("score").alias("_s"))
    first = chunks.groupBy(F.col("page").alias("target")).agg(F.min_by("chunk", "chunk_no").alias("chunk"))
    given = best.join(degree, "source").join(both, "source").join(first, "target").select(by, "chunk", (F.col("_s") * R.GRAPH / F.sqrt("_d")).alias("score"))
    return scores.select(by, "chunk", "score").unionByName(given).groupBy(by, "chunk").agg(F.sum("score").alias("score"))


def hybrid(chunks: DataFrame, queries: DataFrame, vectors: DataFrame, edges: DataFrame, by: str, candidates: int = R.CANDIDATES) -> DataFrame:
    """(by, chunk, rank, score): exact and vector retrieval of all formulations, fused, with the signals of linked pages.

    ``chunks``: chunk, page, chunk_no, text, vector (null: not embedded); ``queries``: by,
    formulation, text (blank ones are left out); ``vectors``: by, formulation, vector. Every
    formulation gives one list of words and one of vectors, each of ``candidates`` rows;
    they are fused by reciprocal rank. Ties go by page, then place on the page.
    """
    name = F.concat_ws("\x01", F.col(by).cast("string"), F.col("formulation").cast("string"))
    asked = queries.filter(F.trim("text") != "").select(name.alias("_q"), "text", by)
    place = chunks.select("chunk", "page", "chunk_no")
    scored = R.bm25(chunks, "chunk", "text", asked.select("_q", "text"), "_q", "text").join(place, "chunk")
    order = [F.desc(F.round("score", 9)), F.col("page"), F.col("chunk_no")]
    words = R.ranked(scored, ["_q"], order, candidates).join(asked.select("_q", by), "_q").select(by, "chunk", "rank")
    # The formulations are the stated query set: their vectors go to the chunks, not the chunks to them.
    near = chunks.filter("vector is not null").select("chunk", "page", "chunk_no", F.col("vector").alias("_v")).join(F.broadcast(vectors.select(name.alias("_q"), by, F.col("vector").alias("_w"))), F.size("_v") == F.size("_w"))
    near = near.select("_q", by, "chunk", "page", "chunk_no", R.cosine(F.col("_v"), F.col("_w")).alias("score"))
    like = R.ranked(near, ["_q"], order, candidates).select(by, "chunk", "rank")
    fused = R.fuse(words.unionByName(like), [by], "chunk")
    out = add_page_signals(fused, place, edges, by).join(place, "chunk")
    return R.ranked(out, [by], order, candidates).select(by, "chunk", "rank", "score")
