"""Text functions and quirks."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.pages import scan_page, sections


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def test_tokens_count_bytes(spark):
    assert one(spark, T.tokens("t"), t="Café é x 7 中 ab-C1") == ["café", "é", "中", "ab", "c1"]
    assert one(spark, T.tokens("t"), t=None) is None
    assert one(spark, T.tokens("t"), t="") == []


@pytest.mark.parametrize("glob,path,hit", [("**/*.md", "a.md", True), ("**/*.md", "x/y/a.md", True), ("*.md", "x/a.md", False), ("a/{b,c}/?.md", "a/c/z.md", True), ("a/[!b].md", "a/b.md", False), ("a/**", "a/b/c.txt", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, F.col("p").rlike(T.glob_regex(glob)), p=path) is hit


def test_paths(spark):
    assert one(spark, T.normal_path("p"), p="a/./b/../c.md") == "a/c.md"
    assert one(spark, T.normal_path("p"), p="a/../../c.md") is None
    assert one(spark, T.relative_path("a", "b"), a="x/y/p.md", b="x/z/q.md") == "../z/q.md"
    assert one(spark, T.relative_path("a", "b"), a="p.md", b="z/q.md") == "z/q.md"
    assert one(spark, T.relative_path("a", "b"), a="x/p.md", b="x/q.md") == "q.md"
    assert one(spark, T.decoded_path("p"), p="a%20b+c.md") == "a b+c.md"
    assert one(spark, T.decoded_path("p"), p="a%2Fb.md") is None
    assert one(spark, T.encoded_path("p"), p="a b/c+d.md") == "a%20b/c%2Bd.md"
    for path, good in [("a/b.md", True), ("/a", False), ("a/../b", False), (".git/x", False), ("", False), (None, False)]:
        assert one(spark, T.safe_path("p"), p=path) is good


def test_small_functions(spark):
    assert one(spark, T.slug("t"), t="  Héllo, World -- two_words! ") == "héllo-world-two-words"
    assert one(spark, T.slug("t"), t="?!") == "untitled"
    assert one(spark, T.short_id("t"), t="ab-12-cdef-3456-7890") == "cdef34567890"
    assert one(spark, T.clock(F.col("t").cast("double")), t="3725.125") == "01:02:05.12"
    assert one(spark, T.heading_level("t"), t="### x") == 3
    assert one(spark, T.table_cells("t"), t=r"| a \| b | c |") == ["a | b", "c"]
    assert one(spark, T.nfkc(F.col("t")), t="ﬁ①") == "fi1"
    assert one(spark, T.media_type("t"), t="x/y.PNG") == "image/png"
    rows = spark.createDataFrame([("p10.md",), ("p9.md",), ("p9a.md",)], "p string").orderBy(T.natural_key("p")).collect()
    assert [r[0] for r in rows] == ["p9.md", "p9a.md", "p10.md"]


def test_scan_page():
    text = "---\na: 1\n---\nintro\n\nTitle\n=====\n\n```\n# no\n```\n<!-- c\n# no\n-->\n## Two ##\ntext\n"
    page = scan_page(text)
    assert page.body == 4
    assert page.headings == [(1, "Title", 6), (2, "Two", 15)]
    assert page.code == [(9, 11)]
    assert sections(page) == [(4, 5), (6, 14), (15, 17)]
    assert scan_page("").headings == [] and sections(scan_page("")) == [(1, 1)]
