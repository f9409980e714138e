"""Ranked retrieval: term statistics, BM25, fusion, link-graph expansion, exact vectors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.text import lowered_tokens, raw_tokens, tokens
from foliospark.session import cut_lineage

#: BM25 parameters, the bonus for the whole phrase, the rank constant of fusion, the graph's weight.
K1, B, PHRASE, RRF_K, GRAPH = 1.2, 0.75, 2.0, 60, 0.15
#: Ranked rows kept of each list before fusion.
CANDIDATES = 30
#: Queries served by one scan of the corpus.
QUERY_BLOCK = 1_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): term counts of each row; a null text has no terms."""
    toks = docs.select(key, raw_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    # Lower-casing after the explode stays in generated code.
    return toks.select(key, F.size("_t").alias("length"), F.explode("_t").alias("_r")).select(key, "length", F.lower("_r").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def _asked_in_blocks(queries: DataFrame, query_key: str, query: str) -> Iterator[list[tuple]]:
    """(key, phrase, distinct terms) of the queries that aren't blank, ``QUERY_BLOCK`` at a time."""
    rows = queries.select(F.col(query_key).alias("_q"), F.lower(F.trim(query)).alias("_phrase"), F.array_distinct(tokens(query)).alias("_terms")).filter("_phrase != ''")
    held: list[tuple] = []
    for row in rows.toLocalIterator():
        held.append((row["_q"], row["_phrase"], list(row["_terms"])))
        if len(held) == QUERY_BLOCK:
            yield held
            held = []
    if held:
        yield held


def term_hits(docs: DataFrame, key: str, text: str, asked: list[tuple]) -> DataFrame:
    """(_d, term, tf, _len, _phrases) of the asked terms, and one row per document with the term ``''`` (its tf counts for nothing).

    One scan: texts are cut into words in place, only those that hold an asked term are
    exploded, and words meet the bounded, broadcast terms before anything is shuffled.
    ``_phrases`` are the places in ``asked`` of the phrases the text holds.
    """
    terms = sorted({t for _, _, own in asked for t in own})
    spark = docs.sparkSession
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    phrases = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(own[0] if own else None).cast("string").alias("first")) for i, (_, p, own) in enumerate(asked)])
    # A generator hands its columns on as they are; expressions of a projection would be computed again inside each lambda.
    read = docs.select(F.col(key).alias("_d"), F.inline(F.array(F.struct(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low")))))
    cut = read.select("_d", "_low", F.inline(F.array(F.struct(lowered_tokens("_text", "_low").alias("_t")))))
    found = cut.select("_d", "_low", "_t", F.inline(F.array(F.struct(F.array_intersect("_t", wanted).alias("_in")))))
    held = F.filter(phrases, lambda p: (p["first"].isNull() | F.array_contains("_in", p["first"])) & F.contains(F.col("_low"), p["p"]))
    some = F.when(F.size("_in") > 0, F.concat("_t", F.array(F.lit("")))).otherwise(F.array(F.lit("")))
    counted = found.select("_d", F.inline(F.array(F.struct(F.size("_t").alias("_len"), F.transform(held, lambda p: p["i"]).alias("_phrases"), some.alias("_some")))))
    words = counted.select("_d", "_len", "_phrases", F.explode("_some").alias("term"))
    known = F.broadcast(spark.createDataFrame([(t,) for t in ["", *terms]], "term string"))
    return words.join(known, "term").groupBy("_d", "term").agg(F.count("*").alias("tf"), F.first("_len").alias("_len"), F.first("_phrases").alias("_phrases"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str) -> DataFrame:
    """(query_key, key, score): BM25 with the phrase bonus for all rows of positive score.

    The corpus is scanned once for each ``QUERY_BLOCK`` queries; only hits on their terms
    are shuffled, and all statistics come from these and one row per document. Query
    words count once. Statistics run over all rows; an empty corpus or a blank query
    gives no rows; a query without words is matched by its phrase alone. Rows that
    repeat a document's key count as one text of both.
    """
    out = None
    for asked in _asked_in_blocks(queries, query_key, query):
        scores = _bm25_block(docs, key, text, queries, query_key, asked)
        out = scores if out is None else out.unionByName(scores)
    if out is None:
        return queries.select(query_key).join(docs.select(key), F.lit(False)).withColumn("score", F.lit(0.0))
    return out


def _bm25_block(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, asked: list[tuple]) -> DataFrame:
    spark = docs.sparkSession
    hits = cut_lineage(term_hits(docs, key, text, asked))
    marks, hits = hits.filter("term = ''"), hits.filter("term != ''")
    stats = marks.agg(F.count("*").alias("_n"), F.coalesce(F.avg("_len"), F.lit(0.0)).alias("_avg"))
    # One row per asked term or query: as many as the block holds.
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))
    kind = queries.schema[query_key].dataType.simpleString()
    terms = F.broadcast(spark.createDataFrame([(q, t) for q, _, own in asked for t in own], f"_q {kind}, term string"))
    places = F.broadcast(spark.createDataFrame([(q, i) for i, (q, _, _) in enumerate(asked)], f"_q {kind}, _i int"))
    n, mean = stats.select("_n").scalar(), stats.select("_avg").scalar()
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("_len") / F.greatest(mean, F.lit(1.0)))
    by_terms = hits.join(df, "term").withColumn("_s", weight * F.col("tf") * (K1 + 1) / norm).join(terms, "term").select("_q", "_d", "_s")
    phrase = marks.select("_d", F.explode("_phrases").alias("_i")).join(places, "_i").select("_q", "_d", F.lit(PHRASE).alias("_s"))
    out = by_terms.unionByName(phrase).groupBy("_q", "_d").agg(F.sum("_s").alias("score")).filter("score > 0")
    return out.select(F.col("_q").alias(query_key), F.col("_d").alias(key), "score")


def ranked(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows per group with their 1-based ``rank``."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)


def fuse(lists: DataFrame, by: list[str], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (by, key, 1-based rank): (by, key, score)."""
    return lists.groupBy(*by, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def expand_by_links(scores: DataFrame, edges: DataFrame, weight: float = GRAPH) -> DataFrame:
    """(page, score): each page's score plus what linked pages give it, one hop, from the scores before.

    ``scores``: page, score; ``edges``: source, target, taken without direction and once. A
    page gives ``score * weight / sqrt(its degree)`` to each neighbour.
    """
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).filter("source is not null and target is not null").distinct()
    degree = both.groupBy("source").agg(F.count("*").alias("_degree"))
    given = scores.join(degree, scores["page"] == degree["source"]).join(both, "source").select(F.col("target").alias("page"), (F.col("score") * weight / F.sqrt("_degree")).alias("score"))
    return scores.select("page", "score").unionByName(given).groupBy("page").agg(F.sum("score").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double: -inf where lengths differ, 0 where one is all zero, clamped to [-1, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(float("-inf"))).when(norm == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def exact_top(records: DataFrame, key: str, vector: str, asked: list[float], most: int, where: Column | None = None) -> DataFrame:
    """(key, score) of the ``most`` most similar rows; ``where`` is applied before the cut, ties go to the smaller key."""
    rows = records if where is None else records.filter(where)
    query = F.array(*[F.lit(float(v)) for v in asked])
    return rows.select(key, cosine(F.col(vector), query).alias("score")).orderBy(F.desc("score"), key).limit(max(0, most))


def page_scores(scores: DataFrame) -> DataFrame:
    """Best score of each page from its chunks' scores (page, score)."""
    return scores.groupBy("page").agg(F.max("score").alias("score"))
