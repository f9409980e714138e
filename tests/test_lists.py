"""Lists over pages, document objects and actions on small cases."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import actions, lists
from foliospark.sources import sinks


def short(text):
    return [(r[2], r[3], r[4], r[5]) for r in lists.lists_of(text)]


def test_markers():
    assert lists.parse_marker("  12) x").values == {"decimal": 12} and lists.parse_marker("(iv) x").values == {"roman": 4}
    assert lists.parse_marker("c. x").values == {"alpha": 3, "roman": 100} and lists.parse_marker("• x").values == {"bullet": 0}
    assert lists.parse_marker("mild. x") is None and lists.parse_marker("1.5 x") is None and lists.parse_marker("-x") is None and lists.parse_marker("") is None


def test_letters_or_numerals():
    assert [s for _, s, _, _ in short("h) a\ni) b\nj) c")] == ["alpha"] * 3
    assert [s for _, s, _, _ in short("i) a\nii) b\niii) c")] == ["roman"] * 3
    assert [(s, n) for _, s, n, _ in short("v. a\nvi. b")] == [("roman", 5), ("roman", 6)]
    assert [(s, n) for _, s, n, _ in short("a. x\nb. y")] == [("alpha", 1), ("alpha", 2)]


def test_nesting_and_continuations():
    text = "Intro\n\n1. one\n   - a\n     - deep\n   - b goes\n     on and is di-\n     vided\n2. two\n\n   more of two\n\nText.\n\n# Head\n- x"
    assert short(text) == [(0, "decimal", 1, "one"), (1, "bullet", 0, "a"), (2, "bullet", 0, "deep"), (1, "bullet", 0, "b goes on and is divided"), (0, "decimal", 2, "two more of two"), (0, "bullet", 0, "x")]
    assert [r[0] for r in lists.lists_of(text)] == [0] * 5 + [1] and lists.lists_of(None) == [] and lists.lists_of("no list") == []
    assert lists.rendered([(0, "decimal", 3, "a"), (1, "roman", 4, "b"), (1, "bullet", 0, "c")]) == "3. a\n    - **iv.** b\n    - c"


def test_lists_go_on_over_pages(spark):
    pages = [("b", 1, "Text\n\n1. a\n2. b"), ("b", 2, "3. c\n\nText"), ("b", 3, "4. d"), ("b", 4, "6. f"), ("b", 6, "7. g"), ("c", 2, "3. c"), (None, 1, "- x"), (None, 2, "- y"), ("d", 1, None), ("d", 2, "")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "book string, page int, text string, level int")
    got = {(r["book"], r["page"], r["item_no"]): r["first_page"] for r in lists.stitched_lists(lists.page_lists(df, "book", "page", "text"), "book", "page").collect() if r["book"]}
    assert got == {("b", 1, 0): 1, ("b", 1, 1): 1, ("b", 2, 0): 1, ("b", 3, 0): 3, ("b", 4, 0): 4, ("b", 6, 0): 6, ("c", 2, 0): 2}
    assert lists.page_lists(df.limit(0), "book", "page", "text").count() == 0


def test_document_object():
    d = actions.document_of("p.md", "---\na: 1\n---\n# T\n\n## Log\n- 2024-01-02: did [x](y.md)\n  and [[z]]\n- plain\n\n## Log\n- other\n")
    assert d["frontmatter"] == {"a": 1} and list(d["sections"]) == ["T", "Log"] and d["links"] == ["y.md", "z"]
    log = d["sections"]["Log"]
    assert (log["level"], log["line"]) == (2, 6) and [e["timestamp"] for e in log["entries"]] == ["2024-01-02", None] and log["entries"][0]["links"] == ["y.md", "z"]


def test_updates():
    d = actions.document_of("p", "---\na: 1\nb: x\n---\nText\n\n## Timeline\n\n- one\n\n## After\n")
    new = actions.updated(d, {"a": 2, "b": None, "c": "yes: no"}, "two")
    assert new == '---\na: 2\nc: "yes: no"\n---\nText\n\n## Timeline\n\n- one\n- two\n\n## After\n'
    assert actions.document_of("p", new)["frontmatter"] == {"a": 2, "c": "yes: no"}
    assert actions.updated(actions.document_of("p", "Text\n"), {}, "x") == "Text\n\n## Timeline\n\n- x\n" and actions.updated(actions.document_of("p", "T"), {"k": 1}) == "---\nk: 1\n---\nT"


def test_actions_fail_alone(spark):
    pages = spark.createDataFrame([("a", "x", 1), ("b", "bad", 1), ("c", None, 1), ("d", "same", 1)], "path string, text string, outcome int")

    def action(document):
        if document["text"] == "bad":
            raise KeyError("no")
        return {"x": "y", "same": "same"}.get(document["text"])

    got = {r["path"]: (r["text"], r["outcome"], r["error"]) for r in actions.acted(pages, action).collect()}
    assert got == {"a": ("y", "updated", None), "b": ("bad", "rejected", "KeyError: 'no'"), "c": (None, "unchanged", None), "d": ("same", "unchanged", None)}
    assert {r["outcome"] for r in actions.acted(pages, lambda d: 3, F.col("path") == "a").collect()} == {"rejected"}


def test_publication(spark):
    pages = spark.createDataFrame([("a.md", "![x](f/1.png) <img src='f/2.png'>"), ("b.md", None)], "path string, text string")
    assets = spark.createDataFrame([("f/1.png",), ("f/2.png",), ("f/3.png",)], "path string")
    assert sorted((r["path"], r["kind"]) for r in sinks.published(pages, assets, "path", "text").collect()) == [("a.md", "page"), ("b.md", "page"), ("f/1.png", "asset"), ("f/2.png", "asset")]


@pytest.mark.parametrize("here,base,there,valid,want", [("a", "a", "a", True, "nothing"), ("b", "a", "a", True, "push"), ("a", "a", "b", True, "fast-forward"), ("a", "a", "b", False, "blocked"), ("b", "a", "c", True, "blocked"), (None, None, "a", None, "blocked")])
def test_sync_state(spark, here, base, there, valid, want):
    df = spark.createDataFrame([(here, base, there, valid)], "l string, b string, s string, v boolean")
    assert df.select(actions.sync_state(F.col("l"), F.col("b"), F.col("s"), F.col("v"))).first()[0] == want
