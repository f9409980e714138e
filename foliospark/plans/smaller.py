"""Queries of the small operators: path, line and date functions, batches, choices, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import actions as A
from foliospark.operators import chunks as C
from foliospark.operators import documents as D
from foliospark.operators import edits as E
from foliospark.operators import lists as I
from foliospark.operators import relations as N
from foliospark.operators import repairs as R
from foliospark.operators import search as R_
from foliospark.operators import sync as S
from foliospark.operators import timeline as L
from foliospark.operators import validate as V
from foliospark.operators import views as X
from foliospark.plans.registry import Registry
from foliospark.sources import corpus
from foliospark.sources.drive import walk, whole_listings
from foliospark.sources.tables import micros, table

_B = "b AS (SELECT DISTINCT block_id, observation_id, book_id, page_no, ordinal, kind, markdown, bbox, confidence FROM blocks)"
_INSIDE = "(greatest(0, least(p.bbox.x1, q.bbox.x1) - greatest(p.bbox.x0, q.bbox.x0)) * greatest(0, least(p.bbox.y1, q.bbox.y1) - greatest(p.bbox.y0, q.bbox.y0)))"


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks", "block_id", "observation_id", "book_id", "page_no", "ordinal", "kind", "markdown", "bbox", "confidence").distinct()


def _functions(to: Registry) -> None:
    @to.query(
        "path_forms",
        "SELECT path, path AS normal, CAST(NULL AS VARCHAR) AS outside, path AS decoded, true AS safe, false AS git, '../../' || path AS relative, CAST(NULL AS VARCHAR) AS encoded_slash FROM documents",
    )
    def path_forms(spark: SparkSession, folder: str) -> DataFrame:
        p = F.col("path")
        return table(spark, folder, "documents", "path").select(
            p, T.normal_path(F.concat(F.lit("zz/./../"), p)).alias("normal"), T.normal_path(F.concat(F.lit("a/../../"), p)).alias("outside"), T.decoded_path(T.encoded_path(p)).alias("decoded"), T.safe_path(p).alias("safe"),
            T.safe_path(F.concat(F.lit("a/.git/"), p)).alias("git"), T.relative_path(F.lit("zz/yy/here.md"), p).alias("relative"), T.decoded_path(F.concat(F.lit("a%2F"), p)).alias("encoded_slash"),
        )

    lines = r"l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line FROM documents)"

    @to.query("heading_levels", rf"WITH {lines} SELECT doc_id, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})([ \t]|$)', 1)) AS level, count(*) AS n FROM l GROUP BY 1, 2")
    def heading_levels(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("line"))
        return rows.groupBy("doc_id", T.heading_level("line").cast("bigint").alias("level")).agg(F.count("*").alias("n"))

    @to.query("search_texts", "SELECT doc_id, concat_ws(' ', path, title, left(text, 40)) AS s, CASE WHEN title IS NULL THEN '—' ELSE title END AS shown FROM documents")
    def search_texts(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "documents", "doc_id", "path", "title", "text").select("doc_id", T.search_text("path", "title", F.left("text", F.lit(40))).alias("s"), T.display("title").alias("shown"))

    @to.query("linked_addresses", "SELECT path, 'See <https://e.org/' || md5(path) || '>, `https://x.org` and [y](https://y.org).' AS text FROM documents")
    def linked_addresses(spark: SparkSession, folder: str) -> DataFrame:
        text = F.concat(F.lit("See https://e.org/"), F.md5("path"), F.lit(", `https://x.org` and [y](https://y.org)."))
        return table(spark, folder, "documents", "path").select("path", R.autolinked(text).alias("text"))

    @to.query("tidy_formulas", r"SELECT event_id, 'x_{' || event_id || '} \le ' || user_id AS tex FROM events")
    def tidy_formulas(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "events", "event_id", "user_id").select("event_id", R.tidy_latex(F.concat(F.lit(" x  _ { "), "event_id", F.lit(" }  ≤ "), "user_id", F.lit(" "))).alias("tex"))

    @to.query("hotword_list", "SELECT min(i) AS no, arg_min(s, i) AS term FROM (SELECT subject AS s, row_number() OVER (ORDER BY subject) AS i FROM subjects) GROUP BY lower(s)")
    def hotword_list(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "subjects", "subject")
        named = X.numbered(rows, [F.col("subject")], "no").select("no", F.concat(F.lit(" "), "subject", F.lit("  ")).alias("term"))
        again = named.select((F.col("no") + 1000).alias("no"), F.upper("term").alias("term"))
        return D.hotwords(named.unionByName(again), "term", "no")

    @to.query("frontmatter_titles", "SELECT path, json_extract_string(any_value(frontmatter), '$.title') AS title FROM parsed_pages WHERE frontmatter IS NOT NULL GROUP BY path")
    def frontmatter_titles(spark: SparkSession, folder: str) -> DataFrame:
        pages = table(spark, folder, "parsed_pages", "path", "text", "frontmatter").filter("frontmatter is not null").dropDuplicates(["path"])
        return C.parse_pages(pages.select("path", "text")).select("path", F.get_json_object("frontmatter", "$.title").alias("title"))

    @to.query("parsed_turns", "SELECT segment_id, 1 AS ordinal, 'S01' AS speaker, 'no ' || segment_no AS text FROM (SELECT DISTINCT segment_id, segment_no FROM microphone_segments) WHERE segment_no > 0")
    def parsed_turns(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "microphone_segments", "segment_id", "segment_no").distinct()
        text = F.concat(F.lit("["), F.lit("1.50"), F.lit("][S01]no "), "segment_no", F.lit("["), F.when(F.col("segment_no") > 0, "2.25").otherwise("1.00"), F.lit("]"))
        return corpus.transcript_turns(rows.withColumn("t", text), "segment_id", "t").select("segment_id", F.lit(1).alias("ordinal"), "speaker", "text")


def _rows(to: Registry) -> None:
    @to.query("carried_times", "SELECT n.o_orderkey, CASE WHEN o.o_orderstatus = n.o_orderstatus THEN o.o_totalprice ELSE n.o_totalprice END AS kept FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, -o_totalprice AS o_totalprice FROM orders) n JOIN orders o USING (o_orderkey)")
    def carried_times(spark: SparkSession, folder: str) -> DataFrame:
        old = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
        new = old.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (-F.col("o_totalprice")).alias("o_totalprice"))
        return S.carry_on(old, new, "o_orderkey", "o_orderstatus", "o_totalprice").select("o_orderkey", F.col("o_totalprice").alias("kept"))

    @to.query("work_left", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0")
    def work_left(spark: SparkSession, folder: str) -> DataFrame:
        wanted = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
        done = wanted.filter("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "old").otherwise(F.col("o_orderstatus")))
        return S.work_list(wanted, done, ["o_orderkey", "o_orderstatus"])

    @to.query(
        "supported_reads",
        "WITH c AS (SELECT l_orderkey AS page, l_linenumber * 1000 + l_partkey % 1000 AS k, l_discount * 10 AS p, l_tax * 12.5 AS r, 0.3 AS b, l_quantity AS s FROM lineitem), g AS (SELECT * FROM c WHERE p >= 0.65 - 1e-9 AND r >= 0.7 - 1e-9 AND r - b >= 0.18 AND s >= 2) SELECT page, -max(-k) AS k FROM g JOIN (SELECT page, max(r) AS r FROM g GROUP BY 1) USING (page, r) JOIN (SELECT page, r, max(p) AS p FROM g GROUP BY 1, 2) USING (page, r, p) GROUP BY 1",
    )
    def supported_reads(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax", "l_quantity")
        some = rows.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("k"), (F.col("l_discount") * 10 + 1e-9).alias("precision"), (F.col("l_tax") * 12.5 + 1e-9).alias("recall"), F.lit(0.3).alias("base_recall"), F.col("l_quantity").alias("supported"))
        return D.supported_choice(some, ["page"], "k")

    @to.query("reads_again", "SELECT DISTINCT observation_id FROM ocr_observations WHERE list_has_any(coalesce(warnings, []), ['empty', 'repeated_lines', 'very_long']) OR observation_id % 5 = 0 OR observation_id % 7 = 1")
    def reads_again(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "ocr_observations", "observation_id", "warnings")
        key = F.col("observation_id")
        unlike, gap = F.when(key % 5 == 0, 0.5).otherwise(0.9), F.when(key % 7 == 1, 30)
        return rows.filter(R.needs_recovery(F.col("warnings"), unlike, F.lit(True), F.lit(20), gap)).select("observation_id").distinct()

    @to.query(
        "own_shares",
        "WITH c AS (SELECT capture_id, min(capture_started_at) AS a, max(capture_ended_at) AS z FROM capture_requests GROUP BY 1), w AS (SELECT capture_id, a, epoch_us(z) - epoch_us(a) AS d, CAST(greatest(1, ceil((epoch_us(z) - epoch_us(a)) / 600e6)) AS BIGINT) AS n FROM c WHERE z > a), s AS (SELECT DISTINCT segment_id, capture_id, epoch_us(started_at) AS s, epoch_us(ended_at) AS e FROM microphone_segments WHERE ended_at > started_at), "
        "m AS (SELECT segment_id, n, d, (s + e) / 2 - epoch_us(a) AS m FROM s JOIN w USING (capture_id)) SELECT segment_id, least(n - 1, CAST(floor(m / (d / n)) AS BIGINT)) AS win FROM m WHERE m >= 0 AND m < d AND abs(m / (d / n) - round(m / (d / n))) > 1e-6",
    )
    def own_shares(spark: SparkSession, folder: str) -> DataFrame:
        # Segments go to the equal shares of at most ten minutes of their capture.
        c = table(spark, folder, "capture_requests", "capture_id", "capture_started_at", "capture_ended_at").groupBy("capture_id").agg(micros(F.min("capture_started_at")).alias("a"), micros(F.max("capture_ended_at")).alias("z")).filter("z > a").withColumn("d", F.col("z") - F.col("a"))
        n = F.greatest(F.lit(1), F.ceil(F.col("d") / 600e6)).cast("bigint")
        shares = c.withColumn("n", n).select("capture_id", "a", "d", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("win"))
        shares = shares.withColumn("core_s", F.col("win") * F.col("d") / F.col("n")).withColumn("core_e", (F.col("win") + 1) * F.col("d") / F.col("n"))
        seg = table(spark, folder, "microphone_segments", "segment_id", "capture_id", "started_at", "ended_at").distinct().filter("ended_at > started_at").select("segment_id", "capture_id", micros("started_at").alias("p"), micros("ended_at").alias("q"))
        both = seg.join(shares, "capture_id").withColumn("s", F.col("p") - F.col("a")).withColumn("e", F.col("q") - F.col("a"))
        place = (F.col("s") + F.col("e")) / 2 / (F.col("d") / F.col("n"))
        return L.in_own_share(both).filter(F.abs(place - F.round(place)) > 1e-6).select("segment_id", "win")

    @to.query("file_name_findings", r"SELECT path, 'filename' AS field FROM documents WHERE NOT regexp_full_match(regexp_extract(path, '([^/]*)$', 1), '[a-z0-9-]+-[0-9]+\.md')")
    def file_name_findings(spark: SparkSession, folder: str) -> DataFrame:
        return V.filename_findings(table(spark, folder, "documents", "path"), "path", r"[a-z0-9-]+-[0-9]+\.md").select("path", F.lit("filename").alias("field"))

    @to.query("chosen_documents", "SELECT doc_id, title FROM documents WHERE lang = 'en'")
    def chosen_documents(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "documents", "doc_id", "title", "lang")
        return X.collection(rows, "doc_id", lambda d: d.filter("lang = 'en'")).select("doc_id", "title")

    @to.query("edited_pages", "SELECT path, 'first' || chr(10) || 'new ' || md5(path) || chr(10) || 'third' AS text, 'updated' AS outcome FROM documents")
    def edited_pages(spark: SparkSession, folder: str) -> DataFrame:
        # Every page has three lines here; its second is replaced by the anchor the page gives.
        pages = table(spark, folder, "documents", "path").withColumn("text", F.concat(F.lit("first\n"), F.md5("path"), F.lit("\nthird")))
        anchors = E.anchored_lines(pages).filter("line_no = 2")
        edits = anchors.select("path", F.lit(0).alias("seq"), F.lit("replace").alias("op"), "anchor", F.concat(F.lit("new "), F.md5("path")).alias("content"))
        return E.edit_pages(pages, edits).select("path", "text", "outcome")


def _listings(to: Registry) -> None:
    @to.query(
        "walked_folders",
        "SELECT 'r' || r_regionkey AS id, 1 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'c' || c_custkey, 3 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'root', 0",
    )
    def walked_folders(spark: SparkSession, folder: str) -> DataFrame:
        # Customers are reached by shortcuts, and every nation has one back to the root.
        none = F.lit(None).cast("string")
        regions = table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent"), F.lit("folder").alias("kind"), none.alias("target"))
        nations = table(spark, folder, "nation")
        nation = F.concat(F.lit("n"), "n_nationkey")
        folders = nations.select(nation.alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("folder").alias("kind"), none.alias("target"))
        back = nations.select(F.concat(F.lit("b"), "n_nationkey").alias("id"), nation.alias("parent"), F.lit("shortcut").alias("kind"), F.lit("root").alias("target"))
        customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
        name = F.concat(F.lit("c"), "c_custkey")
        files = customers.select(name.alias("id"), F.lit("elsewhere").alias("parent"), F.lit("file").alias("kind"), none.alias("target"))
        links = customers.select(F.concat(F.lit("s"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.lit("shortcut").alias("kind"), name.alias("target"))
        root = spark.createDataFrame([("root", None, "folder", None)], "id string, parent string, kind string, target string")
        return walk(root.unionByName(regions).unionByName(folders).unionByName(back).unionByName(files).unionByName(links), root.select("id"))

    @to.query(
        "whole_listings",
        "SELECT o_custkey, o_orderkey AS item FROM orders WHERE o_custkey % 3 <> 0 OR o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1)",
    )
    def q_whole_listings(spark: SparkSession, folder: str) -> DataFrame:
        # Every customer's orders came one a page; of every third customer the second page is missing in the newest and only revision.
        w = W.partitionBy("o_custkey")
        rows = table(spark, folder, "orders", "o_custkey", "o_orderkey").withColumn("page_no", F.row_number().over(w.orderBy("o_orderkey"))).withColumn("last", F.col("page_no") == F.count("*").over(w))
        pages = rows.filter("o_custkey % 3 <> 0 or page_no <> 2").select("o_custkey", F.lit(7).alias("revision"), "page_no", "last", F.array("o_orderkey").alias("items"))
        return whole_listings(pages, ["o_custkey"])


def _documents(to: Registry) -> None:
    pages = "p AS (SELECT DISTINCT book_id, page_no FROM ocr_observations), g AS (SELECT *, page_no - row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS g FROM p)"

    @to.query("stitched_lists", f"WITH {pages} SELECT book_id, min(page_no) AS first_page, 4 * count(*) AS n_items, min(page_no) * 2 AS first_ordinal, max(page_no) * 2 + 1 AS last_ordinal FROM g GROUP BY book_id, g")
    def stitched_lists(spark: SparkSession, folder: str) -> DataFrame:
        # Every page is a piece of one numbered list, with two bullets under its first item.
        n = F.col("page_no") * 2
        text = F.concat(n.cast("string"), F.lit(". one\n   - under\n   - and di-\n     vided\n"), (n + 1).cast("string"), F.lit(". two\n   goes on\n"))
        rows = table(spark, folder, "ocr_observations", "book_id", "page_no").distinct().withColumn("t", text)
        items = I.stitched_lists(I.page_lists(rows, "book_id", "page_no", "t"), "book_id", "page_no")
        outer = F.when(F.col("level") == 0, F.col("ordinal"))
        return items.groupBy("book_id", "first_page", "first_list").agg(F.count("*").alias("n_items"), F.min(outer).cast("bigint").alias("first_ordinal"), F.max(outer).cast("bigint").alias("last_ordinal")).drop("first_list")

    @to.query("list_items", r"WITH d AS (SELECT page_id, any_value(text) AS t FROM parsed_pages GROUP BY 1) SELECT page_id, 2 AS n_items, 'x' || page_id AS first_text FROM d WHERE t IS NOT NULL")
    def list_items(spark: SparkSession, folder: str) -> DataFrame:
        # Behind every page's text a list in Roman numerals of two items.
        rows = table(spark, folder, "parsed_pages", "page_id", "text").dropDuplicates(["page_id"]).filter("text is not null")
        whole = rows.select("page_id", F.lit(1).alias("n"), F.concat("text", F.lit("\n```\n\nText.\n\ni) x"), "page_id", F.lit("\nii) y\n")).alias("t"))
        items = I.page_lists(whole, "page_id", "n", "t").filter("style = 'roman' and at_end")
        return items.groupBy("page_id").agg(F.count("*").alias("n_items"), F.min_by("text", "ordinal").alias("first_text"))

    @to.query("acted_pages", "SELECT path, CASE WHEN page_id % 3 = 0 THEN 'rejected' WHEN page_id % 3 = 1 THEN 'unchanged' ELSE 'updated' END AS outcome, page_id % 3 = 2 AS grown FROM (SELECT page_id, any_value(path) AS path, any_value(text) AS text FROM parsed_pages GROUP BY 1) WHERE text IS NOT NULL")
    def acted_pages(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "parsed_pages", "page_id", "path", "text").dropDuplicates(["page_id"]).filter("text is not null")
        named = rows.select(F.concat("page_id", F.lit("|"), "path").alias("path"), "text")

        def action(document: dict) -> str | None:
            kind = int(document["path"].split("|")[0]) % 3
            if kind == 0:
                raise ValueError("not this one")
            return None if kind == 1 else A.updated(document, {"state": "done"}, "2024-01-02 closed")

        out = A.acted(named, action)
        grown = F.contains("text", F.lit("state: done")) & F.contains("text", F.lit("- 2024-01-02 closed"))
        return out.select(F.substring_index("path", "|", -1).alias("path"), "outcome", grown.alias("grown"))

    @to.query("section_entries", "SELECT path, len(list_distinct(list_transform(headings, lambda h: h.text))) AS n_sections FROM (SELECT page_id, any_value(path) AS path, any_value(headings) AS headings FROM parsed_pages GROUP BY 1) WHERE headings IS NOT NULL")
    def section_entries(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "parsed_pages", "page_id", "path", "text", "headings").dropDuplicates(["page_id"]).filter("headings is not null")
        out = A.acted(rows, lambda d: str(len(d["sections"])))
        return out.select("path", F.col("text").cast("bigint").alias("n_sections"))

    @to.query("stale_results", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'outdated' END AS reason FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 UNION ALL SELECT -1 - o_orderkey, 'orphan' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 5 <> 0")
    def stale_results(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))
        made = A.stale_results(rows, rows.select("o_orderkey", F.lit("").alias("fingerprint")).filter("false"), "o_orderkey", ["o_orderstatus"], "sum-v1").select("o_orderkey", "fingerprint").filter("o_orderkey % 5 <> 0")
        gone = made.filter("o_orderkey % 11 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), "fingerprint")
        # A price that changes is no declared field; a status that changes is.
        now = rows.withColumn("o_totalprice", -F.col("o_totalprice")).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "new").otherwise(F.col("o_orderstatus")))
        return A.stale_results(now, made.unionByName(gone), "o_orderkey", ["o_orderstatus"], "sum-v1").select("o_orderkey", "reason")

    @to.query("sync_states", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nothing' WHEN 1 THEN 'push' WHEN 2 THEN 'fast-forward' WHEN 3 THEN 'blocked' ELSE 'blocked' END AS state FROM events")
    def sync_states(spark: SparkSession, folder: str) -> DataFrame:
        kind = F.col("event_id") % 5
        here, there = F.when(kind.isin(1, 3), "l").otherwise("b"), F.when(kind.isin(2, 3, 4), "s").otherwise("b")
        return table(spark, folder, "events", "event_id").select("event_id", A.sync_state(here, F.lit("b"), there, kind != 4).alias("state"))

    @to.query("reading_order", f"WITH {_B} SELECT block_id, row_number() OVER (PARTITION BY observation_id ORDER BY bbox.y0, bbox.x0, block_id) AS place FROM b WHERE bbox IS NOT NULL")
    def reading_order(spark: SparkSession, folder: str) -> DataFrame:
        w = W.partitionBy("observation_id").orderBy("bbox.y0", "bbox.x0", "block_id")
        return _blocks(spark, folder).filter("bbox is not null").select("block_id", F.row_number().over(w).alias("place"))

    @to.query("shortest_blocks", f"WITH {_B} SELECT observation_id, block_id FROM b WHERE markdown IS NOT NULL QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY length(markdown), block_id) <= 2")
    def shortest_blocks(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).filter("markdown is not null").withColumn("n", F.length("markdown"))
        return R_.ranked(rows.select("observation_id", "block_id", "n"), ["observation_id"], [F.col("n"), F.col("block_id")], 2).select("observation_id", "block_id")

    @to.query("projected_fields", "SELECT path, json_extract_string(fm, '$.title') AS title, json_extract_string(fm, '$.tags[0]') AS tag, json_extract_string(fm, '$.effort') AS effort FROM (SELECT page_id, any_value(path) AS path, any_value(frontmatter) AS fm FROM parsed_pages GROUP BY 1)")
    def projected_fields(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "parsed_pages", "page_id", "path", "frontmatter").dropDuplicates(["page_id"])
        return rows.select("path", *[N.field_at("frontmatter", pointer).alias(name) for name, pointer in {"title": "/title", "tag": "/tags/0", "effort": "/effort"}.items()])

    @to.query("voiceprints", "SELECT label, count(*) AS n, 64 AS dimensions FROM embeddings GROUP BY 1")
    def voiceprints(spark: SparkSession, folder: str) -> DataFrame:
        from foliospark.operators.identity import profiles
        from foliospark.sources.sinks import voiceprint_lines

        rows = voiceprint_lines(profiles(table(spark, folder, "embeddings"), "label", "vec_id", "embedding"), "label")
        held = F.from_json("line", "label bigint, samples bigint, vector array<double>")
        return rows.select(held.alias("h")).select("h.label", F.col("h.samples").alias("n"), F.size("h.vector").alias("dimensions"))


def _boxes(to: Registry) -> None:
    @to.query("block_links_covered", f"WITH {_B}, q AS (SELECT observation_id, block_id AS other, {{'x0': bbox.x0 + 5, 'y0': bbox.y0 + 2, 'x1': bbox.x1 + 5, 'y1': bbox.y1 + 2}} AS bbox FROM b WHERE bbox IS NOT NULL) SELECT p.block_id, 'u' || q.other AS url FROM b p JOIN q USING (observation_id) WHERE p.bbox IS NOT NULL AND {_INSIDE} >= 0.5 * (q.bbox.x1 - q.bbox.x0) * (q.bbox.y1 - q.bbox.y0) AND q.bbox.x1 > q.bbox.x0 AND q.bbox.y1 > q.bbox.y0")
    def block_links_covered(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).filter("bbox is not null")
        b = F.col("bbox")
        moved = F.struct((b["x0"] + 5).alias("x0"), (b["y0"] + 2).alias("y0"), (b["x1"] + 5).alias("x1"), (b["y1"] + 2).alias("y1"))
        found = rows.select("observation_id", F.concat(F.lit("u"), "block_id").alias("url"), moved.alias("bbox"))
        return D.covered_links(rows, found, ["observation_id"], "block_id").select("block_id", "url")

    @to.query("uncovered_text", rf"WITH {_B}, t AS (SELECT * FROM b WHERE kind = 'text' AND bbox IS NOT NULL), c AS (SELECT * FROM b WHERE kind <> 'text' AND bbox IS NOT NULL), h AS (SELECT * FROM t q WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.observation_id = q.observation_id AND (q.bbox.x1 - q.bbox.x0) * (q.bbox.y1 - q.bbox.y0) > 0 AND {_INSIDE} >= 0.5 * (q.bbox.x1 - q.bbox.x0) * (q.bbox.y1 - q.bbox.y0))) SELECT observation_id, sum(length(regexp_replace(markdown, '\s', '', 'g'))) AS characters FROM h GROUP BY 1 HAVING sum(length(regexp_replace(markdown, '\s', '', 'g'))) >= 18")
    def uncovered_text(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder).filter("bbox is not null")
        native = rows.filter("kind = 'text'").select("observation_id", F.col("block_id").alias("id"), F.col("markdown").alias("text"), "bbox")
        return R.coverage_gaps(native, rows.filter("kind <> 'text'"), ["observation_id"])

    words = r"list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '(\p{{L}}+|\p{{N}}+)'))"

    @to.query("unsupported_texts", rf"WITH {_B}, e AS (SELECT observation_id, list_distinct(flatten(list({words.format('markdown')}))) AS e FROM b WHERE bbox IS NOT NULL GROUP BY 1), u AS (SELECT block_id, observation_id, {words.format('markdown')} AS w FROM b WHERE bbox IS NULL) SELECT block_id FROM u LEFT JOIN e USING (observation_id) WHERE len(w) > 0 AND len(list_intersect(w, coalesce(e, []))) / len(w) < 0.8")
    def unsupported_texts(spark: SparkSession, folder: str) -> DataFrame:
        rows = _blocks(spark, folder)
        evidence = rows.filter("bbox is not null").select("observation_id", F.col("markdown").alias("text"))
        return D.unsupported_blocks(rows, evidence, ["observation_id"]).select("block_id")

    @to.query("trimmed_pages", "WITH p AS (SELECT DISTINCT book_id, page_no FROM ocr_observations), q AS (SELECT book_id, page_no, lag(page_no) OVER (PARTITION BY book_id ORDER BY page_no) = page_no - 1 AS f FROM p) SELECT book_id, page_no, CASE WHEN f THEN '' ELSE repeat('=', 50) || (page_no - 1) || '.' END || repeat('=', 50) || page_no || '.' AS text FROM q")
    def trimmed_pages(spark: SparkSession, folder: str) -> DataFrame:
        # Every page begins with what the page before ends with.
        own = lambda n: F.concat(F.repeat(F.lit("="), F.lit(50)), n.cast("string"), F.lit("."))
        rows = table(spark, folder, "ocr_observations", "book_id", "page_no").distinct().withColumn("text", F.concat(own(F.col("page_no") - 1), own(F.col("page_no"))))
        return R.trimmed_repeats(rows, "book_id", "page_no", "text")


def register(to: Registry) -> None:
    """Add the queries."""
    _functions(to)
    _rows(to)
    _listings(to)
    _documents(to)
    _boxes(to)

