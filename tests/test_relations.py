"""Checked answers, declared relations, trust and protected stretches on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import identity, relations, rerank, search, trust
from foliospark.sources import drive


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rankings_are_checked(spark):
    asked = spark.createDataFrame([(q, 3, 2) for q in "abcdef"], "q string, n_documents int, top_n int")
    answers = [("a", 2, 0.5), ("a", 0, 0.1), ("b", 0, 0.5), ("c", 3, 0.5), ("c", 0, 0.5), ("d", 0, math.nan), ("d", 1, 0.5), ("e", 1, 0.5), ("e", 1, 0.4)]
    bad = rerank.bad_rankings(spark.createDataFrame(answers, "q string, index int, score double"), asked, "q")
    assert rows_of(bad) == [("b", "unexpected number of results"), ("c", "index outside the documents"), ("d", "non-finite score"), ("e", "duplicate index"), ("f", "unexpected number of results")]


def test_reranking_degrades(spark):
    fused = spark.createDataFrame([(q, k, n, 1.0 / n, "x") for q in "abc" for n, k in enumerate("uvw", 1)], "q string, k string, rank int, score double, extra string")
    answers = spark.createDataFrame([("a", 2, 0.9), ("a", 0, 0.3), ("b", 0, math.inf), ("b", 1, 0.1)], "q string, index int, score double")
    got = {}
    for r in rerank.reranked(fused, answers, "q", "k", 2).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["k"], r["degraded"]))
    assert got == {"a": [("w", None), ("u", None)], "b": [("u", "rerank: non-finite score"), ("v", "rerank: non-finite score")], "c": [("u", "rerank: unexpected number of results"), ("v", "rerank: unexpected number of results")]}
    assert rerank.reranked(fused.limit(0), answers, "q", "k", 2).count() == 0


def test_vector_sets_and_order(spark):
    asked = spark.createDataFrame([("a", 2, 2), ("b", 1, 2), ("c", 1, 2), ("d", 1, 2)], "q string, n_texts int, dimensions int")
    answers = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [0.0, 1.0]), ("b", 0, [1.0]), ("c", 0, [1.0, math.nan])], "q string, position int, vector array<double>")
    assert [r[0] for r in rows_of(rerank.bad_vector_sets(answers, asked, "q"))] == ["b", "c", "d"]
    values = spark.createDataFrame([(1, math.nan), (2, 0.0), (3, -0.0), (4, math.inf), (5, -1.0), (6, None)], "i int, v double")
    assert [r[0] for r in values.orderBy(rerank.total_order(F.col("v")).asc_nulls_first()).collect()] == [6, 5, 3, 2, 4, 1]


def test_page_signals_go_to_first_chunks(spark):
    scores = spark.createDataFrame([("q", "a2", 1.0), ("q", "b1", 0.5)], "q string, chunk string, score double")
    chunks = spark.createDataFrame([(c, c[0], int(c[1])) for c in ("a1", "a2", "b1", "b2", "c1")], "chunk string, page string, chunk_no int")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "a"), (None, "a")], "source string, target string")
    got = {r["chunk"]: r["score"] for r in rerank.add_page_signals(scores, chunks, edges, "q").collect()}
    given = search.GRAPH / math.sqrt(2)
    assert got == pytest.approx({"a2": 1.0, "b1": 0.5 + given, "c1": given, "a1": 0.5 * search.GRAPH})


def test_field_edges(spark):
    pages = spark.createDataFrame([("p", '{"a/b": [{"to": "x", "kind": "k"}, {"to": "y"}, null, {"kind": "k"}]}', 1), ("q", None, 1), ("r", '{"a/b": "no list"}', 1), ("s", "{}", 1)], "path string, frontmatter string, index int")
    assert rows_of(relations.field_edges(pages, "needs", "/a~1b", "/to")) == [("p", "needs", "x", "/a~1b/0/to"), ("p", "needs", "y", "/a~1b/1/to")]
    assert rows_of(relations.field_edges(pages, "needs", "/a~1b", "/to", "/kind", "k")) == [("p", "needs", "x", "/a~1b/0/to")]
    assert relations.of_type(pages, "/a~1b/0/kind", "k").count() == 1


def test_link_edges(spark):
    links = spark.createDataFrame([("n/a.md", "t", "wiki", ["See"]), ("n/b.md", "t", "markdown", []), ("o/a.md", "t", "wiki", None), (None, "t", "wiki", [])], "source string, target string, syntax string, sections array<string>")
    assert rows_of(relations.link_edges(links, "r", include="n/*")) == [("n/a.md", "r", "t"), ("n/b.md", "r", "t")]
    assert rows_of(relations.link_edges(links, "r", section="See")) == [("n/a.md", "r", "t")]
    assert relations.link_edges(links, "r", syntax="wiki").count() == 2


def test_references_stand_at_bytes(spark):
    text = "é [[ zä |shown]] `[[no]]` <!-- [[no]] --> [[b]]"
    got = rows_of(relations.wiki_references(spark.createDataFrame([("p", text), ("q", None), ("r", "")], "path string, text string"), "path", "text"))
    assert [(r[1], text.encode()[r[2] : r[3]].decode()) for r in got] == [("b", "b"), ("zä", "zä")]


def test_corrections(spark):
    segments = spark.createDataFrame([("c", 1, 0.0, 2.0, "mic", "a cat and a dog"), ("c", 2, 2.0, 4.0, "mic", "a cat"), ("d", 3, 0.0, 2.0, "mic", "cat cat"), ("d", 4, 5.0, 6.0, "sys", None)], "c string, k int, s double, e double, role string, text string")
    edits = spark.createDataFrame([("c", "one", 0.0, 2.0, None, "cat", "cow"), ("c", "role", 0.0, 2.0, "sys", "dog", "fox"), ("c", "both", 0.0, 4.0, None, "a cat", "x"), ("d", "twice", 0.0, 2.0, "mic", "cat", "x"), ("d", "void", 0.0, 9.0, None, "", "x")], "c string, edit string, s double, e double, role string, before string, after string")
    mended, refused = relations.corrected(segments, edits, "c", "k")
    assert {r["k"]: r["text"] for r in mended.collect()} == {1: "a cow and a dog", 2: "a cat", 3: "cat cat", 4: None}
    assert rows_of(refused) == [("both", 2), ("role", 0), ("twice", 2), ("void", 0)]


def test_page_links(spark):
    i = "0123456789abcdef0123456789ABCDEF"
    hyphened = f"{i[:8]}-{i[8:12]}-{i[12:16]}-{i[16:20]}-{i[20:]}"
    pages = spark.createDataFrame([("n/a.md", f'[t](https://n.so/T-{i}?p=1) <page url="https://n.so/{hyphened}">u</page> ![i](https://n.so/{i}) $[m](https://n.so/{i})$ [o](https://n.so/{"f" * 32})'), ("n/b.md", None)], "path string, text string")
    paths = spark.createDataFrame([(i.lower(), "m/c.md")], "page_id string, target string")
    got = dict(rows_of(relations.with_page_links(pages, paths, "path", "text")))
    assert got["n/a.md"] == f'[t](../m/c.md) [u](../m/c.md) ![i](https://n.so/{i}) $[m](https://n.so/{i})$ [o](https://n.so/{"f" * 32})' and got["n/b.md"] is None


def test_sets(spark):
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "path string"), spark.createDataFrame([("y",), ("y",)], "path string")
    assert rows_of(relations.united(a, b)) == [("x",), ("y",)]
    assert rows_of(relations.identity_differences(a, b, ["path"])) == [("x", "missing"), (None, "missing")]
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "g int, v string")
    assert rows_of(relations.within(small, small.filter("v = 'a'"), ["g"], "v")) == [(1, 1, False), (2, 0, True)]


def test_trust():
    word = "the quick brown fox jumps over the lazy dog and runs away"
    assert trust.trust_of(None, 1.0) == ("untrusted", 0.0, ["empty"]) and trust.trust_of("x", 1.0)[0] == "trusted"
    assert trust.trust_of(word, None) == ("trusted", 0.75, ["no_character_geometry"])
    assert trust.trust_of(word, 0.9, word) == ("partial", 0.5, ["invalid_geometry"])
    assert trust.trust_of("so it goes " * 20, 1.0)[2] == ["repetition"]
    assert trust.trust_of(word, 1.0, "0123456789 " * 9)[2] == ["visual_disagreement"]
    assert trust.trust_of(word * 4, 1.0, word)[2] == ["length_mismatch"]


def test_keys():
    assert trust.math_words.plain(r"\alpha \frac ﬁne X2") == ["α", "fine", "x", "2"]
    assert trust.region_key.plain(r"\begin{array}{lc} \mathbf{x}_{1} & = 2 \\ \end{array}") == "x_1=2"
    assert trust.math_key.plain(r"\(\left x \leq \text y\right\)., ") == r"x\ley"
    assert trust.evidence_key.plain(r"**Let** \(\mathbb{R}_{n}\) , \alpha^2") == "let r_n, alpha2"


def test_protected_stretches():
    text = "a `x*y` $b_1$ [c](d *e*) <i>f</i> \\alpha [^1]\n```\n* g\n```\n*  h   i\n\n\n\nj"
    kinds = [(s["kind"], text[s["first"] : s["last"]]) for s in trust.protected.plain(text)]
    assert kinds == [("code", "`x*y`"), ("math", "$b_1$"), ("link", "[c](d *e*)"), ("html", "<i>"), ("html", "</i>"), ("command", "\\alpha"), ("link", "[^1]"), ("code", "```\n* g\n```")]
    once = trust.formatted.plain(text)
    assert "```\n* g\n```" in once and "- h i\n\nj\n" in once and trust.formatted.plain(once) == once and trust.formatted.plain("") == ""
    assert trust.edited(text, lambda t: t.replace("⟦0⟧", "")) == text


def test_joined_links_and_regions(spark):
    box = lambda y: (0.0, y, 10.0, y + 10)
    links = spark.createDataFrame([(1, 0, "u", "ab", box(0.0)), (1, 1, "u", "cd", box(40.0)), (1, 2, "u", "e", box(90.0)), (1, 3, "v", "f", box(91.0)), (1, 4, "v", "", box(91.0))], "p int, o int, target string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [(r["first"], r["text"], r["bbox"]["y1"]) for r in trust.joined_links(links, ["p"], "o").orderBy("first").collect()] == [(0, "abcd", 50.0), (2, "e", 100.0), (3, "f", 101.0)]
    glyphs = spark.createDataFrame([(1, 0, 0, "x", (1.0, 900.0, 2.0, 910.0)), (1, 0, 1, "I", (2.0, 900.0, 3.0, 911.0)), (1, 1, 0, "a", (5.0, 5.0, 4.0, 9.0)), (1, 1, 1, "�", box(5.0)), (1, 2, 0, "b", box(500.0))], "p int, l int, o int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [(r["l"], r["text"], r["excluded"]) for r in trust.native_regions(glyphs, ["p"], "l", "o").orderBy("l").collect()] == [(0, "xI", "page_number"), (2, "b", None)]


def test_duplicate_blocks(spark):
    text = "A paragraph of words that says something at some length, so that its key is long enough to be compared with another one."
    big, inside, below, far = (0.0, 0.0, 100.0, 100.0), (0.0, 5.0, 100.0, 100.0), (0.0, 110.0, 100.0, 140.0), (0.0, 500.0, 100.0, 600.0)
    rows = [(1, 0, "text", text, big), (1, 1, "text", text.upper().lower(), inside), (1, 2, "text", text, below), (1, 3, "text", text, far), (1, 4, "table", text, big), (1, 5, "text", "short", big), (1, 6, "text", None, None)]
    df = spark.createDataFrame(rows, "p int, o int, kind string, markdown string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert rows_of(trust.duplicate_blocks(df, ["p"], "o")) == [(1, 1, 0, "same_region"), (1, 2, 0, "compressed_near_copy")]


def test_one_to_one(spark):
    new = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.1]), ("c", None)], "g string, v array<double>")
    known = spark.createDataFrame([("p", [1.0, 0.0]), ("p", [0.0, 2.0]), ("q", [-1.0, 0.0])], "who string, v array<double>")
    scores = identity.sample_similarity(new, known, "g", "who", "v")
    got = {(r["g"], r["who"]): r["score"] for r in scores.collect()}
    # Both kinds of samples of p match, which its centroid would not.
    assert got["a", "p"] == 1.0 and got["b", "p"] == pytest.approx(1 / math.sqrt(1.01)) and ("c", "p") not in got
    groups = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "c", 0)], "w int, g string, n_samples int")
    out = {r["g"]: (r["who"], r["reason"]) for r in identity.assign_one_to_one(scores.withColumn("w", F.lit(1)), groups, "w", "g", "who").collect()}
    assert out == {"a": ("p", "threshold_and_margin_met"), "b": (None, "one_to_one_conflict"), "c": (None, "no_clean_embedding")}


def test_runs_take_the_nearest_profile(spark):
    rng = np.random.default_rng(3)
    base = np.eye(3)
    rows = [(1, i, f"L{i % 2}", (base[i % 3] + 0.05 * rng.standard_normal(3)).tolist()) for i in range(30)] + [(1, 30, "L0", None)]
    got = identity.assign_runs(spark.createDataFrame(rows, "t int, o int, l string, v array<double>"), "t", "o", "l", "v").orderBy("o").collect()
    assert [r["identity"] for r in got[:3]] == ["S01", "S02", "S01"] or len({r["identity"] for r in got}) == 3


def test_walk(spark):
    items = [("a", "root", "folder", None), ("b", "a", "folder", None), ("s", "b", "shortcut", "a"), ("t", "b", "shortcut", "z"), ("z", "other", "file", None), ("u", "b", "shortcut", "gone"), ("b", "a", "folder", None), (None, "a", "file", None)]
    df = spark.createDataFrame(items, "id string, parent string, kind string, target string")
    roots = spark.createDataFrame([("root",), ("root",)], "id string")
    assert rows_of(drive.walk(df, roots)) == [("a", 1), ("b", 2), ("root", 0), ("z", 3)]
    assert drive.walk(df.limit(0), roots).count() == 1
    with pytest.raises(ValueError):
        drive.walk(df, roots, rounds=2)


def test_whole_listings(spark):
    pages = [("x", 1, 1, False, [1, 2]), ("x", 1, 2, True, [3]), ("x", 2, 1, False, [9]), ("x", 1, 2, True, [3]), ("y", 1, 2, True, [4]), ("z", 5, 1, True, []), ("z", 4, 1, True, [7])]
    df = spark.createDataFrame(pages, "d string, revision int, page_no int, last boolean, items array<int>")
    assert rows_of(drive.whole_listings(df, ["d"])) == [("x", 1), ("x", 2), ("x", 3)]
