"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm import leakage, markup, neighbors, packing, repetition, scans, splitting, subjects
from foliospark.llm import sql as S
from foliospark.plans.registry import Registry
from foliospark.sources.tables import table


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_observations", "observation_id", "book_id", "raw").dropDuplicates(["observation_id"])


def _tokenizer(spark: SparkSession) -> str:
    """The vocabulary file, which every node must hold: the setting ``foliospark.tokenizer`` of the session, else the usual place."""
    return spark.conf.get("foliospark.tokenizer", packing.TOKENIZER)


def register(to: Registry) -> None:
    """Add the pN_ queries."""

    @to.query("p2_found", S.P2_FOUND)
    def p2_found(spark: SparkSession, folder: str) -> DataFrame:
        share = repetition.repeated_share(table(spark, folder, "ocr_observations", "observation_id", "raw"), "observation_id", "raw")
        return share.filter("repeated_share >= 0.3").select("observation_id")

    @to.query("p2_shares", S.P2_SHARES)
    def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
        return repetition.repeated_share(table(spark, folder, "ocr_observations", "observation_id", "raw"), "observation_id", "raw")

    @to.query("p2_line_frequency", S.P2_LINES)
    def p2_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
        lines = repetition.line_frequency(_observations(spark, folder), "observation_id", "book_id", "raw")
        return lines.groupBy("book_id", "n_docs").agg(F.count("*").alias("n_lines"))

    @to.query("p2_without_frequent_lines", S.P2_CLEAN)
    def p2_without_frequent_lines(spark: SparkSession, folder: str) -> DataFrame:
        return repetition.without_frequent_lines(_observations(spark, folder), "observation_id", "book_id", "raw", limit=2)

    @to.query("p5_found", S.P5_FOUND)
    def p5_found(spark: SparkSession, folder: str) -> DataFrame:
        out = splitting.pieces(table(spark, folder, "parsed_pages"), table(spark, folder, "embedding_plans"), texts=False)
        return out.select("page_id", F.inline("sections")).filter("section_over").select("page_id", "section_line").distinct()

    @to.query("p5_pieces")
    def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
        pages = table(spark, folder, "parsed_pages").dropDuplicates(["page_id"])
        return splitting.pieces(pages, table(spark, folder, "embedding_plans")).select("page_id", "piece_no", "piece", "overlap_used", "cut", "char_start", "char_end")

    @to.query("p7_found", S.P7_FOUND)
    def p7_found(spark: SparkSession, folder: str) -> DataFrame:
        packs = packing.packs_of(table(spark, folder, "pack_specs").filter("pack_id = 1"))
        out = packing.pack_texts(table(spark, folder, "documents", "doc_id", "text"), packs, _tokenizer(spark))
        return out.filter("n_parts > 1").select("doc_id").distinct()

    @to.query("p7_packed")
    def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
        return packing.pack_texts(table(spark, folder, "documents", "doc_id", "text"), packing.packs_of(table(spark, folder, "pack_specs")), _tokenizer(spark))

    @to.query("p8_found", S.P8_FOUND)
    def p8_found(spark: SparkSession, folder: str) -> DataFrame:
        leaks = leakage.find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items"))
        return leaks.select("doc_id", "item_id")

    @to.query("p8_item_counts", S.P8_COUNTS)
    def p8_item_counts(spark: SparkSession, folder: str) -> DataFrame:
        leaks = leakage.find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items"))
        return leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"))

    @to.query("p8_item_report")
    def p8_item_report(spark: SparkSession, folder: str) -> DataFrame:
        leaks = leakage.find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items"))
        return leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("longest"))

    @to.query("p8_longest")
    def p8_longest(spark: SparkSession, folder: str) -> DataFrame:
        return leakage.longest_verbatim(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items")).select("item_id", "n_words")

    @to.query("p8_clean", S.P8_CLEAN)
    def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
        documents = table(spark, folder, "documents", "doc_id", "text")
        return leakage.without_leaks(documents, leakage.find_leaks(documents, table(spark, folder, "eval_items"))).select("doc_id").distinct()

    @to.query("p9_found")
    def p9_found(spark: SparkSession, folder: str) -> DataFrame:
        return subjects.document_subjects(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "subject_labels")).select("doc_id", "subject")

    @to.query("p9_composition")
    def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
        documents = table(spark, folder, "documents", "doc_id", "text")
        shares = subjects.subject_shares(documents, subjects.mine_rules(documents, table(spark, folder, "subject_labels")))
        per = shares.groupBy("subject").agg(F.sum("n_sentences").alias("n_sentences"), F.count_if(F.col("share") >= subjects.SHARE).alias("n_documents"))
        # One row per subject by now.
        whole = F.sum("n_sentences").over(W.partitionBy())
        return per.select("subject", "n_documents", "n_sentences", (F.col("n_sentences") / whole).alias("share"))

    @to.query("p3_found", S.P3_FOUND)
    def p3_found(spark: SparkSession, folder: str) -> DataFrame:
        return neighbors.similar_pairs(table(spark, folder, "vector_records"), 0.9)

    @to.query("p3_nearest")
    def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
        return neighbors.nearest(table(spark, folder, "vector_records"), 10)

    @to.query("p3_answers", S.P3_ANSWERS)
    def p3_answers(spark: SparkSession, folder: str) -> DataFrame:
        return neighbors.answer_queries(table(spark, folder, "vector_records"), table(spark, folder, "vector_queries")).select("query_id", "rank", "vec_id")

    @to.query("p1_found", S.P1_FOUND)
    def p1_found(spark: SparkSession, folder: str) -> DataFrame:
        out = markup.clean_markup(table(spark, folder, "blocks", "block_id", "observation_id", "ordinal", "markdown"), "block_id", "markdown", texts=False, page="observation_id", order="ordinal")
        return out.select("block_id", F.explode("families").alias("family"))

    @to.query("p1_clean_blocks")
    def p1_clean_blocks(spark: SparkSession, folder: str) -> DataFrame:
        return markup.clean_markup(table(spark, folder, "blocks", "block_id", "observation_id", "ordinal", "markdown"), "block_id", "markdown", page="observation_id", order="ordinal")

    @to.query("p1_clean_pages")
    def p1_clean_pages(spark: SparkSession, folder: str) -> DataFrame:
        return markup.clean_markup(table(spark, folder, "parsed_pages", "page_id", "text"), "page_id", "text", frontmatter=True)

    @to.query("p6_found")
    def p6_found(spark: SparkSession, folder: str) -> DataFrame:
        return scans.noise(table(spark, folder, "ocr_observations", "observation_id", "book_id", "page_no", "raw"))

    @to.query("p6_repaired")
    def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
        return scans.repaired(table(spark, folder, "ocr_observations", "observation_id", "book_id", "page_no", "raw"))

    @to.query("p6_repaired_blocks")
    def p6_repaired_blocks(spark: SparkSession, folder: str) -> DataFrame:
        blocks = table(spark, folder, "blocks", "block_id", "observation_id", "book_id", "page_no", "ordinal", "markdown", "confidence")
        return scans.repaired_blocks(blocks, table(spark, folder, "ocr_observations", "observation_id", "book_id", "page_no", "raw")).select("block_id", "text")
