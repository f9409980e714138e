"""Document assembly on literal cases."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import documents as D

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_tables():
    assert D.table_of("x <table><tr><th>a</th><th colspan='2'>b|c</th></tr><tr><td rowspan=2>1</td><td>2</td><td>3 &amp; 4</td></tr><tr><td>5</td></tr></table>") == "| a | b\\|c |  |\n| --- | --- | --- |\n| 1 | 2 | 3 & 4 |\n| 1 | 5 |  |"
    assert D.table_of("none") is None
    a = [["h", "i"], ["1", "2"], ["3", "4"]]
    assert D.merged_table(a, [["h", "i"], ["3", "4"], ["5", "6"]]) == [*a, ["5", "6"]]
    assert D.merged_table(a, [["x"]]) is None


def test_text_functions(spark):
    df = spark.createDataFrame([("THE WAR OF THE NHS ROSES",), ("Mixed Case",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(D.title_case("t")).collect()] == ["The War of the Nhs Roses", "Mixed Case", None, ""]
    df = spark.createDataFrame([("a $x=1$ `$no$` $$y$$ \\(z\\) costs $5 and $6",), (None,)], "t string")
    got = [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.select(D.math_spans("t")).collect()]
    assert got == [[("inline", "x=1"), ("display", "y"), ("inline", "z")], None]
    words = spark.createDataFrame([(1, " Alpha "), (2, "alpha"), (3, "Beta")], "n int, w string")
    assert sorted(tuple(r) for r in D.hotwords(words, "w", "n").collect()) == [(1, "Alpha"), (3, "Beta")]
    with pytest.raises(Exception, match="too many"):
        D.hotwords(words, "w", "n", 1).collect()
    with pytest.raises(Exception, match="non-empty"):
        D.hotwords(words.union(spark.createDataFrame([(4, " ")], "n int, w string")), "w", "n").collect()
    heads = spark.createDataFrame([("b", 1, "A b!"), ("b", 2, "a B"), ("c", 3, "A b")], "k string, o int, t string")
    assert [r["anchor"] for r in D.anchors(heads, ["k"], "o", "t").orderBy("o").collect()] == ["a-b", "a-b-1", "a-b"]


def test_titles():
    assert D.title_cased("THE API INTO THE WAR-OF-ROSES: a NASA tale XIV") == "The API into the War-of-Roses: A Nasa Tale XIV"
    assert D.title_cased("2.1 the end of [the book](http://X/the.md) by") == "2.1 The End of [the Book](http://X/the.md) By"
    assert D.title_cased("CEO's guide[^1] to FAQs iPhone") == "CEO's Guide[^1] to FAQs iPhone" and D.title_cased("12 – 3") == "12 – 3"


def test_pairs_on_pages(spark):
    text = "the same words again and again in a block that is long enough to count here"
    rows = [(1, 0, "text", text, (0.0, 0.0, 100.0, 100.0)), (1, 1, "text", "other " * 20, (0.0, 0.0, 100.0, 100.0)), (1, 2, "text", text + "!", (1.0, 0.0, 100.0, 100.0)), (1, 3, "title", text, (0.0, 0.0, 100.0, 100.0)), (1, 4, "text", None, None)]
    df = spark.createDataFrame(rows, f"p int, o int, kind string, markdown string, bbox {BOX}")
    assert [tuple(r) for r in D.repeated_regions(df, ["p"], "o").collect()] == [(1, 2, 0)]
    assert D.repeated_regions(df, ["p"], "o", back=1).count() == 0
    a = spark.createDataFrame([(1, 1, "alpha beta", (0.0, 0.0, 10.0, 10.0)), (1, 2, "alpha bet", None)], f"p int, id bigint, text string, bbox {BOX}")
    b = spark.createDataFrame([(1, 7, "alpha beta", (0.0, 0.0, 10.0, 10.0)), (1, 8, "alpha betb", None), (1, 9, None, None)], f"p int, id bigint, text string, bbox {BOX}")
    assert sorted((r["l"], r["r"]) for r in D.match_blocks(a, b, "p").collect()) == [(1, 7), (2, 8)]
    ev = spark.createDataFrame([(1, "alpha beta gamma")], "p int, text string")
    loose = spark.createDataFrame([(1, 1, "alpha beta", None), (1, 2, "delta alpha", None), (1, 3, "delta", (0.0, 0.0, 1.0, 1.0)), (2, 4, "x", None)], f"p int, o int, markdown string, bbox {BOX}")
    assert sorted(r["o"] for r in D.unsupported_blocks(loose, ev, ["p"]).collect()) == [2, 4]
    urls = spark.createDataFrame([(1, "u", (0.0, 0.0, 1.0, 2.0)), (1, "v", (5.0, 5.0, 6.0, 6.0))], f"p int, url string, bbox {BOX}")
    assert [(r["o"], r["url"]) for r in D.covered_links(loose, urls, ["p"], "o").collect()] == [(3, "u")]


def test_across_pages(spark):
    pages = spark.createDataFrame([("b", 1, "runs on", "x"), ("b", 2, "ends.", "and here"), ("b", 3, "divi-", "Y"), ("b", 4, "z", "ded"), ("b", 6, "end", "small")], "b string, p int, last string, first string")
    joined = D.next_page_paragraphs(pages, "b", "p", "last", "first")
    assert [r["joined"] for r in joined.orderBy("p").collect()] == [True, False, True, False, False]
    assert [r["chain"] for r in D.paragraph_chains(joined, "b", "p").orderBy("p").collect()] == [1, 1, 2, 2, 3]
    entries = spark.createDataFrame([("b", 1, "Alpha"), ("b", 2, "Beta"), ("b", 3, "Alpha"), ("b", 4, "None")], "b string, entry_no bigint, title string")
    heads = spark.createDataFrame([("b", 3, "ALPHA"), ("b", 5, "Betas"), ("b", 9, "Alpha")], "b string, page bigint, title string")
    found = D.match_contents(entries, heads, "b")
    assert sorted((r["entry_no"], r["page"]) for r in found.collect()) in ([(1, 3), (2, 5), (3, 9)], [(1, 9)])
    got = D.chapter_starts(heads.limit(0), found.drop("entry_no"), heads, "b").collect()
    assert {r["source"] for r in got} == {"contents"}
    assert D.align_pages(["aaa", "bbb", "ccc"], ["aaa\nbbb", "ccc"]) == [(0, 0, 2), (1, 2, 3)]


def test_choices(spark):
    reads = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, "alpha beta gamna"), (1, 3, "zzz"), (2, 4, None)], "p int, k int, t string")
    assert sorted((r["p"], r["k"]) for r in D.consensus(reads, ["p"], "k", "t").collect()) == [(1, 1), (2, 4)]
    assert sorted(r["k"] for r in D.consensus(reads, ["p"], "k", "t", primary=F.col("k") == 2).collect()) == [2, 4]
    cand = spark.createDataFrame([(1, 1, 0.7, 0.9, 0.5, 3), (1, 2, 0.7, 0.95, 0.5, 1), (1, 3, 0.7, 0.9, 0.8, 3)], "p int, k int, precision double, recall double, base_recall double, supported int")
    assert [r["k"] for r in D.supported_choice(cand, ["p"], "k").collect()] == [1]
    seg = spark.createDataFrame([("t", 1, 0.0, 5.0, "A", "hello there friend"), ("t", 2, 4.0, 9.0, "A", "hello there friends"), ("t", 3, 4.2, 9.0, "B", "hello there friends"), ("t", 4, 20.0, 21.0, "A", None)], "t string, id bigint, s double, e double, speaker string, text string")
    assert [r["id"] for r in D.boundary_repeats(seg, "t").collect()] == [1]
    warn = spark.createDataFrame([("",), ("```\nx",), ("| a |\n| a | b |",), ("fine",)], "t string").select(D.quality_warnings(F.col("t"))).collect()
    assert [r[0] for r in warn] == [["empty"], ["open_fence"], ["ragged_table"], []]
