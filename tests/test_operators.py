"""Operators against small plain models and literal cases."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions.text import compare_form, natural_key
from foliospark.operators import chunks, edits, geometry, identity, links, quality, search, sync, timeline, validate, views
from foliospark.plans.catalog import catalog
from foliospark.sources import corpus, sinks
from foliospark.streaming import queue
from tests.compare import DATA


def test_numbered_over_ranges(spark):
    names = [f"notes/a{random.Random(i).randint(0, 400)}.md" for i in range(1500)] + [None, None]
    df = spark.createDataFrame([(x,) for x in names], "path string").repartition(7)
    got = views.numbered(df, [natural_key("path"), F.col("path")], "position").collect()
    want = sorted(names, key=lambda x: (x is None, int(x[7:-3]) if x else 0))
    assert [r["path"] for r in sorted(got, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in got) == list(range(1, len(names) + 1))
    assert views.numbered(df.limit(0), [F.col("path")], "position").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_document_order_is_whole(spark):
    got = catalog().queries["document_order"](spark, DATA).collect()
    total = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert sorted(r["position"] for r in got) == list(range(1, total + 1))


def test_bm25_quirks(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma of delta"), (3, None), (4, "")], "d int, t string")
    ask = spark.createDataFrame([(0, "alpha alpha"), (1, "of delta"), (2, "zz"), (3, "  ")], "q int, t string")
    got = {(r["q"], r["d"]): r["score"] for r in search.bm25(docs, "d", "t", ask, "q", "t").collect()}
    # Repeated query words count once; the phrase adds two; nulls match nothing.
    idf = np.log(1 + (4 - 1 + 0.5) / 1.5)
    avg = 5 / 4
    assert got[0, 1] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg)))
    assert got[1, 2] == pytest.approx(2 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / avg)) + 2)
    assert set(got) == {(0, 1), (1, 2)}


def test_expand_by_links(spark):
    scores = spark.createDataFrame([("a", 1.0)], "page string, score double")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("a", "a"), (None, "a")], "source string, target string")
    got = {r[0]: r[1] for r in search.expand_by_links(scores, edges).collect()}
    step = 0.15 / 3**0.5
    assert got == {"a": pytest.approx(1 + step), "b": pytest.approx(step), "c": pytest.approx(step)}


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, float("-inf")]


def model_runs(rows, gap):
    out, island, top = [], None, None
    for label, s, e in sorted(rows, key=lambda r: (r[1], r[2])):
        if not out or label != island or s - top > gap:
            out.append(0)
            top = e
        out[-1] += 1
        island, top = label, max(top, e)
    return out


def test_runs_against_model(spark):
    r = random.Random(5)
    for _ in range(4):
        rows = [(r.choice("xy"), float(s := r.randint(0, 60)), float(s + r.randint(0, 9)), i) for i in range(40)]
        df = spark.createDataFrame([("g", *x) for x in rows], "g string, l string, s double, e double, i int")
        got = [x[0] for x in timeline.runs(df, ["g"], ["l"], "s", "e", 1.25, ["l", "i"]).groupBy("run").count().orderBy("run").select("count").collect()]
        ordered = sorted(rows, key=lambda x: (x[1], x[2], x[0], x[3]))
        want, top, label = [], 0.0, None
        for name, s, e, _ in ordered:
            if label != name or s - top > 1.25:
                want.append(0)
                top = e
            want[-1] += 1
            top, label = max(top, e), name
        assert got == want


def test_overlap_join(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), i, float(s := r.randint(0, 100)), float(s + r.randint(-1, 40))) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, s double, e double")
    got = sorted((x["i"], x["i_r"]) for x in timeline.overlap_join(df, df, ["g"], 7.0).collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[3] > a[2] and b[3] > b[2] and min(a[3], b[3]) > max(a[2], b[2]))
    assert got == want


def test_lanes(spark):
    df = spark.createDataFrame([("g", 1, 0, 5), ("g", 2, 3, 8), ("g", 3, 5, 6), ("g", 4, 9, 10)], "g string, k int, s int, e int")
    assert {r["k"]: r["lane"] for r in timeline.assign_lanes(df, ["g"], "k", "s", "e").collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert timeline.lanes_needed(df, ["g"], "s", "e").first()["lanes"] == 2
    assert list(timeline.batches(iter([("a", 900), ("b", 900), ("c", 3000), ("d", 10), ("e", 10), ("f", 10), ("g", 10), ("h", 10)]))) == [[("a", 900), ("b", 900)], [("c", 3000)], [("d", 10), ("e", 10), ("f", 10), ("g", 10)], [("h", 10)]]


def test_links_and_moves(spark):
    pages = spark.createDataFrame([("a/p.md", "[x](../b/q.md) [[b/q]] ![i](i.png) [w](https://w.org) `[n](n.md)` [gone](no)"), ("b/q.md", None)], "path string, text string")
    found = links.resolve(links.links_of(pages.withColumnRenamed("path", "source"), ["source"], "text"), pages)
    got = {(r["syntax"], r["target"]): (r["path"], r["dangling"]) for r in found.collect()}
    assert got == {("markdown", "../b/q.md"): ("b/q.md", False), ("wiki", "b/q"): ("b/q.md", False), ("image", "i.png"): (None, None), ("markdown", "https://w.org"): (None, None), ("markdown", "no"): ("a/no.md", True)}
    moves = spark.createDataFrame([("b/q.md", "a/p.md"), ("a/p.md", "b/q.md")], "old string, new string")
    swapped = {(r["syntax"], r["target"]): (r["new_source"], r["new_target"]) for r in links.moved_links(found.filter("path is not null"), moves).collect()}
    assert swapped["markdown", "../b/q.md"] == ("b/q.md", "../a/p.md")
    assert swapped["wiki", "b/q"] == ("b/q.md", "a/p")


def test_ancestors_are_cycle_safe(spark):
    df = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y"), ("o", "gone", "O")], "k string, p string, n string")
    got = {r["k"]: (r["path"], r["depth"]) for r in links.ancestor_paths(df, "k", "p", "n", 8).collect()}
    assert got == {"a": ("A", 1), "b": ("A/B", 2), "c": ("A/B/C", 3), "x": (None, None), "y": (None, None), "o": ("O", 1)}


def test_sync_guard(spark):
    def refused(existing, gone):
        rows = [(i, "deleted" if i < gone else "unchanged") for i in range(existing)]
        return sync.change_counts(spark.createDataFrame(rows, "k int, change string")).first()["refused"]

    assert [refused(1, 1), refused(4, 1), refused(4, 2), refused(3, 2), refused(100, 10), refused(100, 11), refused(5, 0)] == [True, False, True, False, False, True, False]
    same = spark.createDataFrame([(1, "a", None)], "k int, v string, w string")
    assert [r["change"] for r in sync.diff(same, same, "k", ["v", "w"]).collect()] == ["unchanged"]


def test_edits():
    text = "one\ntwo\nthree\n"
    anchors = {i: f"{i + 1}:{edits.anchor_hash(*p)}" for i, p in enumerate([("", "one", "two"), ("one", "two", "three"), ("two", "three", "")])}
    E = edits.Edit
    assert edits.apply_edits(text, [E("replace", anchors[1], "2a\n2b"), E("append", None, "four"), E("append", "0:", "zero")]) == "zero\none\n2a\n2b\nthree\nfour\n"
    assert edits.apply_edits(text, [E("replace", f"{anchors[0]}..{anchors[2]}", "")]) is None
    assert edits.apply_edits(None, [E("replace", None, "new")]) == "new"
    assert edits.apply_edits("a\r\nb\r\n", [E("append", None, "c")]) == "a\r\nb\r\nc\r\n"
    for bad in ([E("replace", "2:zz", "x")], [E("replace", "2:00" if anchors[1] != "2:00" else "2:01", "x")], [E("append", None, "")], [E("replace", None, "x")], [E("replace", f"{anchors[0]}..{anchors[1]}", "x"), E("replace", anchors[1], "y")]):
        with pytest.raises(edits.EditError):
            edits.apply_edits(text, bad)


def test_edit_pages_and_anchors(spark):
    pages = spark.createDataFrame([("p", "a\nb"), ("e", ""), ("n", None)], "path string, text string")
    shown = edits.anchored_lines(pages).orderBy("line_no").collect()
    assert [(r["path"], r["line"]) for r in shown] == [("p", "a"), ("p", "b")]
    change = spark.createDataFrame([("p", 1, "replace", shown[0]["anchor"], "A"), ("new", 1, "replace", None, "x"), ("gone", 1, "append", None, "x")], "path string, seq int, op string, anchor string, content string")
    got = {r["path"]: (r["text"], r["outcome"]) for r in edits.edit_pages(pages, change).collect()}
    assert got == {"p": ("A\nb", "updated"), "new": ("x", "created"), "gone": (None, "rejected")}


def test_chunks():
    text = "---\ntitle: t\n---\npre\n\n# H1\n\n### H3\n\n" + "word " * 500 + "\n\n## Skip\nhidden\n\n## Two\na\n\nb\n"
    config = chunks.ChunkConfig(tokens=50, most=400, skipped_sections=("Skip",))
    out = chunks.chunk_page(text, config)
    assert all(len(c[3]) <= 200 and len(c[4]) <= 400 for c in out)
    # A skipped level is not padded; merged blocks share a breadcrumb; skipped sections are gone.
    assert out[1][2] == ["H1", "H3"] and out[-1][2:4] == (["H1", "Two"], "a\n\nb")
    assert "hidden" not in "".join(c[3] for c in out) and out[2][4].startswith("H1 > H3\n\n")
    assert "".join(c[3] for c in out if c[2] == ["H1", "H3"]) == ("word " * 500)
    assert chunks.chunk_page("", config) == []
    # A long breadcrumb is cut to what the body leaves, so the overlap keeps its room.
    long = chunks.chunk_page("# " + "h" * 500 + "\n\n" + "word " * 100, chunks.ChunkConfig(tokens=50, most=200))
    assert {c[4].split("\n\n")[0] for c in long} == {"h" * 48} and all(len(c[4]) <= 200 for c in long)


def test_frontmatter():
    assert chunks.frontmatter_of("x") == (None, None)
    assert chunks.frontmatter_of("---\na: 1\n---\n")[0] == {"a": 1}
    assert chunks.frontmatter_of("---\na: 1\n")[1] == "frontmatter is not closed"
    assert chunks.frontmatter_of("---\n- a\n---\n")[1]
    assert chunks._plain_fields(["a: 1", "b: [x, y]"]) == {"a": 1, "b": ["x", "y"]}


def test_validation(spark):
    schema = validate.Schema({"state": validate.enum(["open"], required=True), "n": validate.integer(nullable=True, minimum=1, maximum=3), "tags": validate.list_of(unique=True)}, sections=("A", "B"), ordered_sections=True, extra_sections=False)
    rows = [(1, '{"state": "open", "n": null}'), (2, '{"state": "x", "n": 9, "tags": ["a", "a"], "more": 1}'), (3, None), (4, "{broken"), (5, '{"state": null, "n": "1"}')]
    got = sorted(tuple(r) for r in validate.field_findings(spark.createDataFrame(rows, "k int, f string"), "k", "f", schema).collect())
    assert got == [(2, "more", "unknown"), (2, "n", "too large"), (2, "state", "value"), (2, "tags", "repeated"), (3, "state", "missing"), (4, "", "unreadable"), (5, "n", "type"), (5, "state", "null")]
    heads = spark.createDataFrame([(1, [(2, "B", 3), (2, "A", 5), (2, "C", 7), (2, "C", 9)]), (2, None)], "k int, h array<struct<level:int,text:string,line:int>>")
    got = sorted(tuple(r) for r in validate.section_findings(heads, "k", "h", schema).collect())
    assert got == [(1, "B", "out of order"), (1, "C", "repeated"), (1, "C", "unknown"), (2, "A", "missing"), (2, "B", "missing")]
    items = spark.createDataFrame([("p", 1, "2024-01-02T00:00:00Z"), ("p", 2, "?"), ("p", 3, "2024-01-01T00:00:00Z"), ("p", 4, "2024-01-01T00:00:00Z")], "p string, i int, t string")
    assert sorted(tuple(r)[1:] for r in validate.dated_findings(items, ["p"], "i", "t").collect()) == [(2, "unreadable"), (3, "out of order")]
    assert validate.rule_problems(validate.Schema({"a": validate.integer(minimum=5, maximum=1), "b": validate.enum([])}, sections=("X", "X"))) == ["section X is declared twice", "a: minimum exceeds maximum", "b: no values"]


def test_views(spark):
    df = spark.createDataFrame([(1, "2024-02-29", "2024-02-29"), (2, "2024-02-30", "2024-03-01"), (3, "2024-03-02", "2024-03-01"), (4, "2024-3-1", None)], "k int, a string, b string")
    got = {r["k"]: (r["scheduled"], str(r["end_day"])) for r in views.schedule(df, "a", "b").collect()}
    assert got == {1: (True, "2024-03-01"), 2: (False, "None"), 3: (False, "None"), 4: (False, "None")}
    assert [r["k"] for r in views.collection(df, "k", lambda d: d.filter("k < 3")).orderBy("k").collect()] == [1, 2]
    with pytest.raises(Exception, match="collection must return"):
        views.collection(df, "k", lambda d: d.unionByName(d)).collect()


def test_quality(spark):
    assert quality.runaway_span("x " + "go " * 12) == (5, 37)
    assert quality.runaway_span("x " + "go " * 11) is None
    # Phrases of twelve words need five times, of thirteen three.
    twelve, more = " ".join(f"w{i}" for i in range(12)) + " ", " ".join(f"w{i}" for i in range(13)) + " "
    assert quality.runaway_span(twelve * 4) is None and quality.runaway_span(twelve * 5) and quality.runaway_span(more * 3) and quality.runaway_span(more * 2) is None
    # Rows, tables, images and formulas aren't looked at.
    assert quality.runaway_span("| a | b |\n" * 30) is None and quality.runaway_span("<table>" + "<tr> x </tr> " * 30 + "</table>") is None and quality.runaway_span("![a b](c) " * 30) is None
    # Far into a long text.
    assert quality.runaway_span(" ".join(str(i) for i in range(5000)) + " so it goes" * 9 + " end") is not None
    assert quality.runaway_span("a b c d e f g") is None
    df = spark.createDataFrame([("a b c " * 9 + "end",), ("plain",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(quality.truncated_runaway("t")).collect()] == ["a b c  end", "plain", None, ""]
    assert [r[0] for r in df.select(quality.triple_phrase("t")).collect()] == [True, False, None, False]
    ok = spark.createDataFrame([(r"\begin{a}{x}\end{a}",), (r"\begin{a}\end{b}",), ("}{",), (r"\{",)], "t string")
    assert [r[0] for r in ok.select(quality.balanced_math("t")).collect()] == [True, False, False, True]
    both = quality.compare(spark.createDataFrame([("The quick brown fox", "The quick brown fax"), ("abc", "x" * 99), (None, None)], "a string, b string"), "a", "b").collect()
    assert both[0]["similarity"] > 0.9 and both[1]["warnings"] == ["low_similarity", "low_coverage", "length_mismatch"] and both[2]["similarity"] == 1.0
    assert spark.createDataFrame([("# T\n[a](b) <i>c-\nd</i>",)], "t string").select(compare_form("t")).first()[0] == "T a cd"


def test_geometry(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    r = random.Random(3)
    rows = [(1, i, (float(x := r.randint(0, 900)), float(y := r.randint(0, 900)), float(x + r.randint(0, 300)), float(y + r.randint(0, 300)))) for i in range(30)] + [(1, 99, None)]
    got = sorted((a["k"], a["other"], round(a["iou"], 9)) for a in geometry.overlapping_pairs(spark.createDataFrame(rows, f"p int, k int, bbox {box}"), ["p"], "k").collect())
    want = []
    for _, i, a in rows:
        for _, j, b in rows:
            if a and b and i < j:
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                if w > 0 and h > 0:
                    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
                    want.append((i, j, round(w * h / (area(a) + area(b) - w * h), 9)))
    assert got == sorted(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_order_components_of_all_rows(spark):
    edges = spark.read.parquet(f"{DATA}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    root = {r[0]: r[0] for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect()}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for customer, order in edges:
        a, b = find(customer), find(-1 - order)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in catalog().queries["order_components"](spark, DATA).collect()}
    assert got == {x: find(x) for x in root}


def test_box_components(spark, tmp_path):
    r = random.Random(3)
    boxes = {i: (i % 3, r.uniform(0, 1500), r.uniform(0, 1500)) for i in range(240)}
    # A chain of a hundred boxes in no order of their ids.
    boxes |= {i: (9, 45.0 * k, 0.0) for k, i in enumerate(r.sample(range(1000, 1100), 100))}
    rows = [(i, p, 1, 1, i, "text", "x", (x, y, x + 40, y + 40), 0.9) for i, (p, x, y) in boxes.items()] + [(2000, 0, 1, 1, 0, "text", "x", None, 0.9)]
    spark.createDataFrame(rows, "block_id bigint, observation_id bigint, book_id bigint, page_no bigint, ordinal int, kind string, markdown string, bbox struct<x0: double, y0: double, x1: double, y1: double>, confidence double").write.parquet(f"{tmp_path}/blocks.parquet")
    root = {i: i for i in [*boxes, 2000]}
    for _ in range(len(boxes)):
        before = dict(root)
        for i, (p, x, y) in boxes.items():
            root[i] = min(root[j] for j, (q, u, v) in boxes.items() if p == q and abs(x - u) < 60 and abs(y - v) < 60)
        if root == before:
            break
    got = {r["node"]: r["component"] for r in catalog().queries["box_components"](spark, str(tmp_path)).collect()}
    assert got == root and len(set(got.values())) > 20
    with pytest.raises(ValueError, match="not settled"):
        geometry.components(spark.createDataFrame([(k, k + 1) for k in range(50)], "a bigint, b bigint"), spark.createDataFrame([(0,)], "node bigint"), rounds=1)


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randint(0, 30), 100 + r.randint(0, 30)) for _ in range(20)]
    nodes = sorted({x for e in edges for x in e} | {500})
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in geometry.components(spark.createDataFrame(edges, "a bigint, b bigint"), spark.createDataFrame([(n,) for n in nodes], "node bigint")).collect()}
    assert got == {n: root(n) for n in nodes}


def test_profiles(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3, 8))
    rows = [(int(p), int(p * 100 + i), (base[p] + 0.2 * rng.standard_normal(8)).tolist()) for p in range(3) for i in range(6)] + [(0, 7, (-base[0]).tolist()), (0, 8, [0.0] * 8)]
    df = spark.createDataFrame(rows, "p int, k int, v array<double>")
    got = {r["p"]: r for r in identity.profiles(df, "p", "k", "v").collect()}
    for p in range(3):
        want, used = identity.robust_centroid(np.array([v for q, _, v in rows if q == p and any(v)]))
        assert got[p]["n_used"] == used and np.allclose(got[p]["centroid"], want)
    best = identity.best_two(df, "k", "v", identity.profiles(df, "p", "k", "v"), "p").collect()
    assert all(r["best"] == r["k"] // 100 for r in best if r["k"] >= 100) and 8 not in {r["k"] for r in best}


def test_snapshots(spark, tmp_path):
    store = sinks.Snapshots(spark, str(tmp_path / "s"))
    assert store.ids() == []
    assert store.commit(spark.range(3)) == 1
    assert store.commit(spark.range(5), expected=1) == 2
    with pytest.raises(RuntimeError):
        store.commit(spark.range(9), expected=1)
    assert (store.read(1).count(), store.read().count()) == (3, 5)
    objects = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    first = sinks.store_objects(objects, "c", str(tmp_path / "o"))
    assert first.count() == 2
    assert sinks.store_objects(objects, "c", str(tmp_path / "o2"), first).count() == 0


def test_sources(spark, tmp_path):
    for name, text in (("a.md", "x\ny\nz"), ("d/b.md", "q"), ("d/c.txt", "t"), (".git/h.md", "no")):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    pages = corpus.read_pages(spark, str(tmp_path / "root"), ["**/*.md"], ["d/**"])
    assert [tuple(r) for r in pages.collect()] == [("a.md", "x\ny\nz")]
    asked = spark.createDataFrame([("a.md:2-3",), ("a.md:1",), ("none.md",)], "asked string")
    assert sorted((r["asked"], r["line"]) for r in corpus.read_windows(pages, asked).collect()) == [("a.md:1", "x"), ("a.md:2-3", "y"), ("a.md:2-3", "z")]
    manifests = spark.createDataFrame([(1, '{"schemaVersion": 1, "audio": [{"role": "mic", "file": "m.caf"}]}'), (2, '{"schemaVersion": 3, "audio": [{"role": "mic", "file": "a", "streamIndex": 4}]}'), (3, "no"), (4, '{"schemaVersion": 9}')], "k int, j string")
    got = {r["k"]: (r["role"], r["stream"], r["error"]) for r in corpus.read_manifests(manifests, "k", "j").collect()}
    assert got == {1: ("mic", 0, None), 2: ("mic", 4, None), 3: (None, None, "unknown manifest"), 4: (None, None, "unknown manifest")}
    turns = corpus.transcript_turns(spark.createDataFrame([(1, "[0.0][S01] hi [1.5][2.0][S02]x[1.0]"), (2, None)], "k int, t string"), "k", "t").collect()
    assert [(r["speaker"], r["text"], r["e"]) for r in turns] == [("S01", "hi", 1.5)]


EVENTS = [
    ("r", 0, 1, "submit", "d1", None, None, True, None), ("r", 1, 2, "submit", "i1", None, None, False, None), ("r", 2, 3, "claim", None, None, None, None, 1),
    ("r", 3, 4, "submit", "i1", None, None, False, None), ("r", 4, 5, "claim", None, None, None, None, 5), ("r", 5, 6, "complete", "d1", "3-d1", "B", None, None),
    ("r", 6, 7, "complete", "d1", "3-d1", "B", None, None), ("r", 7, 8, "complete", "d1", "3-d1", "C", None, None), ("r", 8, 9, "complete", "i1", "bad", "B", None, None),
    ("r", 9, 10, "fail", "i1", "5-i1", "e", None, None), ("r", 20, 11, "claim", None, None, None, None, 5), ("r", 50, 12, "claim", None, None, None, None, 5),
    ("q", 0, 1, "submit", "d", None, None, True, None), ("q", 1, 2, "claim", None, None, None, None, 1), ("q", 400, 3, "complete", "d", "2-d", "B", None, None),
]
WANTED = ["queued", "unavailable", "claimed", "queued", "claimed", "completed", "replayed", "conflict", "superseded", "retry", "empty", "empty"]


def test_queue_batch_equals_stream(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, queue.EVENT)
    batch = queue.decide_batch(events).collect()
    assert [r["outcome"] for r in sorted((r for r in batch if r["recipe"] == "r"), key=lambda r: r["seq"])] == WANTED
    # Late completion: the lease is over.
    assert [r["outcome"] for r in sorted((r for r in batch if r["recipe"] == "q"), key=lambda r: r["seq"])][-1] == "expired"
    for part in (EVENTS[:5], EVENTS[5:]):
        spark.createDataFrame(part, queue.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queue.EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        run = queue.decide_stream(stream).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        got = sorted(tuple(r) for r in spark.sql("select recipe, seq, outcome from decided").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == sorted((r["recipe"], r["seq"], r["outcome"]) for r in batch)


def test_streamed_index(spark, tmp_path):
    from foliospark.streaming import changes

    store = sinks.Snapshots(spark, str(tmp_path / "idx"))
    fold = changes.keep_index(store, "k", lambda d: d, "v")
    fold(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int"), 0)
    fold(spark.createDataFrame([("b", 5)], "k string, v int"), 1)
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 2), ("b", 5)]
