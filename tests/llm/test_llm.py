"""The training-text operators against brute force, round trips and held-out accuracy."""

import os
import random
import re

import numpy as np
import pytest

from foliospark.functions.pages import scan_page, sections
from foliospark.llm import leakage, markup, neighbors, packing, partitions, repetition, scans, splitting, subjects
from foliospark.llm.labeller import Labeller
from foliospark.llm.leaves import FAMILIES, leaves_of
from foliospark.llm.markup_train import _batch, examples

DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
CLASH = ", _key int, _text string, _n int, rank int, id string, space int"
EXTRA = (1, "z", 2, 3, "i", 4)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def query_names():
    from foliospark.llm.queries import register
    from foliospark.plans.registry import Registry

    registry = Registry()
    register(registry)
    return registry


@has_data
@pytest.mark.parametrize("name", sorted(query_names().queries))
def test_query(spark, name):
    from tests.compare import rows_of as both
    from tests.compare import sql_rows

    registry = query_names()
    names, rows = both(registry.queries[name](spark, DATA))
    if name in registry.sql:
        assert rows == sql_rows(registry.sql[name], names)


# --- markup


def families(text):
    ((leaves, found),), = Labeller.load().label([[text]])
    assert "".join(text[x.start : x.end] for x in leaves) == text
    return {FAMILIES[f] for f in found if f}


@pytest.mark.parametrize(
    "text,want",
    [
        ("It cost $64, then $88 more.", set()), ("So 5 * 3 = 15 and x == y {maybe}.", set()), ("The file C:\\new\\alpha was lost.", set()), ("R&D kept row_a_id & more.", set()), ("Here 7 < 9 and 7 > 3.", set()), ("Seat #9 [sic] was free.", set()),
        ("# T", {"markdown"}), ("T\n---", {"markdown"}), ("- a\n- b", {"markdown"}), ("1) a", {"markdown"}), ("a **b** c", {"markdown"}), ("~~x~~", {"markdown"}), ("[a](b.md)", {"markdown"}), ("> q", {"markdown"}), ("| a | b |\n| --- | --- |\n| c | d |", {"markdown"}), ("`<b>`", {"markdown"}), ("```\n$x$ [[a]] <b>\n```", {"markdown"}), ("a[^1]", {"markdown"}),
        ("<b>x</b>", {"html"}), ("a&nbsp;b", {"html"}), ("<!-- c -->", {"html"}), ("<table><tr><td>1</td></tr></table>", {"html"}),
        ("[[A|b]]", {"wiki"}), ("'''b'''", {"wiki"}), ("{{t|a=1}}", {"wiki"}), ("{|\n| a || b\n|}", {"wiki"}), ("== H ==", {"wiki"}),
        ("$x=1$", {"latex"}), ("$$\\frac{a}{b}$$", {"latex"}), ("\\(x\\)", {"latex"}), ("\\emph{a}", {"latex"}), ("\\begin{equation}\nx\n\\end{equation}", {"latex"}),
        ("# H\n\n<b>x</b> and [[l]] with $a=b$", set(FAMILIES[1:])), ("", set()), ("   \n", set()),
    ],
)
def test_families(text, want):
    assert families(text) == want


def test_labeller_held_out():
    rows = examples(400, 987)
    model = Labeller.load()
    x, mask, y = _batch(rows)
    good = (model.scores(x, mask).argmax(2) == y) & (mask[:, :, 0] > 0)
    assert good.sum() / mask.sum() > 0.995


def test_network_decides():
    """Shapes leave families open; without its weights, or without its two passes, the labeller loses or mistakes leaves."""
    rows = examples(300, 4321)
    x, mask, y = _batch(rows)
    some = (y > 0) & (mask[:, :, 0] > 0)
    model = Labeller.load()

    def lost(weights):
        return int((Labeller(weights).scores(x, mask).argmax(2) != y)[some].sum())

    whole = lost(model.w)
    blind = lost({k: v * 0 if k in ("wf", "uf", "wb", "ub") else v for k, v in model.w.items()})
    none = lost({k: v * 0 for k, v in model.w.items()})
    assert none == some.sum() and whole < 0.002 * some.sum() and blind > 10 * whole + 20


def test_rows_by_context():
    """The same row is of either family, by what stands before it on the page."""
    row = "| a | b |"
    label = Labeller.load().label([["{|\n|-\n" + row + "\n|}"], ["| c | d |\n| --- | --- |\n" + row]])
    wiki, pipes = ({FAMILIES[f] for f in page[0][1] if f} for page in label)
    assert wiki == {"wiki"} and pipes == {"markdown"}


def test_pages_in_order(spark):
    rows = [(i, i // 3, i % 3, f"*a{i}* text") for i in range(30)] + [(4, 1, 1, "*a4* text"), (40, None, None, "<b>x</b>"), (41, None, None, "[[x]]")]
    df = spark.createDataFrame(rows, "k bigint, p bigint, o int, t string")
    got = {r["k"]: (r["families"], r["clean_text"]) for r in markup.clean_markup(df, "k", "t", page="p", order="o").collect()}
    assert got == {i: (["markdown"], f"a{i} text") for i in range(30)} | {40: (["html"], "x"), 41: (["wiki"], "x")}


def test_long_text_is_read_to_the_end():
    text = "word *em* and plain text. " * 400 + "<i>end</i>"
    ((leaves, found),), = Labeller.load().label([[text]])
    assert FAMILIES[found[-1]] == "html" and sum(FAMILIES[f] == "markdown" for f in found) == 400


def test_render():
    def clean(text):
        ((leaves, found),), = Labeller.load().label([[text]])
        return markup.render(text, leaves, found)

    assert clean("<h2>T</h2><p>a &amp; <b>b</b></p><ul><li>x</li><li>y</li></ul>") == "## T\n\na & b\n\n- x\n- y"
    assert clean("T\n===\n\n* a\n* b\n\n| c | d |\n| --- | --- |\n| 1 | 2 |") == "# T\n\n- a\n- b\n\nc | d\n\n1 | 2"
    assert clean("== T ==\n'''b''' [[x|y]] {{q|text = z}}") == "## T\nb y z"
    assert clean("\\section{T} \\emph{a} \\(x\\) \\cite{k}") == "## T\n a $x$"
    assert clean("```py\nx = '$a$'\n```") == "```\nx = '$a$'\n```"
    assert clean("plain $5 text") == "plain $5 text"


def test_clean_markup_edges(spark):
    df = spark.createDataFrame([(1, None, *EXTRA), (2, "", *EXTRA), (3, "*a*", *EXTRA), (3, "*a*", *EXTRA), (None, "<b>", *EXTRA)], "k bigint, t string" + CLASH)
    got = {r["k"]: (r["families"], r["clean_text"]) for r in markup.clean_markup(df, "k", "t").collect()}
    assert got == {1: ([], ""), 2: ([], ""), 3: (["markdown"], "a")}
    assert markup.clean_markup(df.limit(0), "k", "t").count() == 0


# --- repetition


def plain_repeated(words, n=5):
    seen, covered = set(), set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            covered |= set(range(i, i + n))
        seen.add(g)
    return len(covered)


def test_repeated_words():
    r = random.Random(2)
    for _ in range(200):
        words = [r.choice("abc") for _ in range(r.randint(0, 60))]
        assert repetition.repeated_words(words) == plain_repeated(words)
    assert repetition.words_of("<|ref|>text<|/ref|><|det|>[[1,2]]<|/det|>One TWO-2 <b>x</b> three<3") == ["one", "two", "x", "three"]


def test_repetition_edges(spark):
    df = spark.createDataFrame([(1, None, *EXTRA), (2, "", *EXTRA), (3, "a b c d e a b c d e", *EXTRA), (3, "a b c d e a b c d e", *EXTRA), (4, "go " * 100_000, *EXTRA)], "k bigint, t string" + CLASH)
    got = {r["k"]: (r["n_words"], r["n_repeated"]) for r in repetition.repeated_share(df, "k", "t").collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (10, 5), 4: (100_000, 99_999)}
    assert repetition.repeated_share(df.limit(0), "k", "t").count() == 0


def test_frequent_lines(spark):
    df = spark.createDataFrame([(i, "h", f"Header\nown {chr(97 + i)}\n\nMENU") for i in range(4)] + [(9, None, "Header"), (10, "h", None)], "k bigint, h string, t string")
    got = {r["k"]: (r["clean_text"], r["n_removed"], r["rejected"]) for r in repetition.without_frequent_lines(df, "k", "h", "t", limit=3).collect()}
    assert got[0] == ("own a\n", 2, True) and got[9] == ("Header", 0, False) and got[10] == ("", 0, False)


# --- vectors

VECTORS = "vec_id bigint, space_namespace string, recipe string, dimensions int, vector array<float>, metadata string, rank int, rep string"


def vector_rows(n=5000, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim))
    x = centres[(rng.random(n) ** 3 * 40).astype(int)] + rng.standard_normal((n, dim))
    x[n - 150 : n - 100] = x[:50] * rng.uniform(0.5, 3, (50, 1)) + 0.01 * rng.standard_normal((50, dim))
    x[n - 100 : n - 95] = x[60]
    return x.astype(np.float32)


def test_pairs_and_neighbours(spark):
    x = vector_rows()
    rows = [(i, "ns", "r", 16, v.tolist(), '{"g": %d}' % (i % 7) if i % 5 else None, 0, "") for i, v in enumerate(x)]
    rows += rows[:40] + [(9001, "ns", "r", 16, None, None, 0, ""), (9002, "ns", "r", 16, [0.0] * 16, None, 0, ""), (9003, "ns", "r", 16, [float("nan")] * 16, None, 0, ""), (9004, "ns", "r", 16, [1.0], None, 0, ""), (9005, None, "r", 16, x[3].tolist(), None, 0, ""), (None, "ns", "r", 16, x[3].tolist(), None, 0, "")]
    df = spark.createDataFrame(rows, VECTORS)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = unit @ unit.T
    np.fill_diagonal(like, -2)
    want = {(i, j) for i, j in np.argwhere(np.triu(like, 1) >= 0.99).tolist()}
    found = [tuple(r) for r in neighbors.similar_pairs(df, 0.99).collect()]
    assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.97 * len(want)
    near = neighbors.nearest(df, 5).collect()
    assert {r["vec_id"] for r in near} == set(range(0, 5000, 20))
    hit = total = 0
    for i in range(0, 5000, 20):
        best = np.sort(like[i])[-5]
        mine = [r["neighbor_id"] for r in near if r["vec_id"] == i]
        assert len(mine) == 5 and i not in mine
        hit += sum(like[i, j] >= best - 1e-5 for j in mine)
        total += 5
    assert hit / total >= 0.9
    asked = spark.createDataFrame([(1, "ns", "r", 16, x[5].tolist(), 4, None), (2, "ns", "r", 16, x[5].tolist(), 3, '{"g": 2}'), (3, "ns", "r", 16, None, 3, None), (4, "ns", "r", 16, x[5].tolist(), 0, None), (5, "no", "r", 16, x[5].tolist(), 3, None)], "query_id bigint, space_namespace string, recipe string, dimensions int, vector array<float>, limit_k int, filter_json string")
    got = {}
    for r in neighbors.answer_queries(df, asked).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {1, 2} and len(got[1]) == 4 and sorted(got[1])[0][1] == 5
    allowed = [i for i in range(5000) if i % 5 and i % 7 == 2]
    own = like[5].copy()
    own[5] = 1
    assert [v for _, v in sorted(got[2])] == sorted(allowed, key=lambda i: (-round(float(own[i]), 6), i))[:3]
    assert neighbors.similar_pairs(df.limit(0), 0.9).count() == 0


def test_blocks_lose_nothing(spark, monkeypatch):
    x = vector_rows(600)
    df = spark.createDataFrame([(i, "ns", "r", 16, v.tolist(), None, 0, "") for i, v in enumerate(x)], VECTORS)
    whole = rows_of(neighbors.similar_pairs(df, 0.9))
    monkeypatch.setattr(neighbors, "DATA_BLOCK", 64)
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 50)
    index = neighbors.build_index(df)
    space = index.spaces[0]
    index.spaces[0] = space._replace(data_blocks=np.array([7]), query_blocks=np.array([5]))
    assert rows_of(neighbors.search(index, index.representatives, 40, 0.9, same_ids=True).select("id", "rep")) == rows_of(neighbors.search(neighbors.build_index(df), index.representatives, 40, 0.9, same_ids=True).select("id", "rep"))
    assert len(whole) > 10


def test_parts_grow_and_few_are_probed(spark, monkeypatch):
    """A second level of routers: over a hundred parts, of which a query sees some, and pairs and neighbours are found."""
    monkeypatch.setattr(neighbors, "FIT", 1500)
    monkeypatch.setattr(neighbors, "PART", 50)
    monkeypatch.setattr(neighbors, "MOST_PARTS", 12)
    x = vector_rows(7000, 12)
    df = spark.createDataFrame([(i, "ns", "r", 12, v.tolist(), None, 0, "") for i, v in enumerate(x)], VECTORS)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = unit @ unit.T
    np.fill_diagonal(like, -2)
    pairs = neighbors.build_index(df, least=0.98).spaces[0]
    index = neighbors.build_index(df, query_share=1 / 20).spaces[0]
    assert pairs.router.children and pairs.router.parts > 100 and pairs.probes < 30 and index.probes < index.router.parts
    want = {(i, j) for i, j in np.argwhere(np.triu(like, 1) >= 0.98).tolist()}
    found = {tuple(r) for r in neighbors.similar_pairs(df, 0.98).collect()}
    assert found <= want and len(found) >= 0.99 * len(want)
    near = neighbors.nearest(df, 10).toPandas()
    hit = sum(like[i, j] >= np.sort(like[i])[-10] - 1e-5 for i, j in zip(near["vec_id"], near["neighbor_id"]))
    assert hit >= 0.9 * 10 * 350


def test_router_children_are_ranked_together():
    x = vector_rows(3000, 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = partitions.fit_router(x, 4)
    home = top.rank(x, 1)[:, 0]
    both = top._replace(children=tuple(partitions.fit_router(x[home == p], 1 + p) for p in range(4)))
    assert both.parts == 10
    ranked = both.rank(x, 10)
    assert (np.sort(ranked, 1) == np.arange(10)).all()
    assert (both.rank(x, 3) == ranked[:, :3]).mean() > 0.99


def test_balanced_parts():
    x = vector_rows(2000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = partitions.neighbour_graph(x)
    label = partitions.balanced_parts(x, graph, 8)
    size = np.bincount(label, minlength=8)
    cut = (label[graph] != label[:, None]).mean()
    assert size.max() <= np.ceil(2000 / 8 * partitions.SLACK) and size.sum() == 2000
    assert cut < 0.6 < (np.random.default_rng(0).permutation(label)[graph] != label[:, None]).mean()


# --- splitting


def test_split_pages():
    r = random.Random(4)
    for _ in range(60):
        lines = []
        for _ in range(r.randint(0, 40)):
            lines.append(r.choice(["", "# H", "## I", "- item one", "Sentence one is here. Another follows it! And a third?" * r.randint(1, 6), "x" * r.randint(1, 400), "```\n# no\n```", "<!-- a\n# no\n-->", "Title\n-----"]))
        text = "\n".join(lines)
        limit, overlap = r.randint(20, 300), r.choice([0, 10, 60, 500])
        out = splitting.split_page(text, None, None, limit, overlap)
        assert all(len(o[7]) <= limit for o in out)
        assert "".join(text[o[2] : o[3]] for o in out) == text
        assert all(o[4] <= overlap and o[7] == text[o[2] - o[4] : o[3]] for o in out)
        page = scan_page(text)
        over = {a for a, b in sections(page) if len("\n".join(page.lines[a - 1 : b]).rstrip()) > limit}
        assert {line for o in out for line, _, big in o[6] if big} == over


def test_cuts_prefer_topic_valleys():
    one = " ".join(f"The cat sat near cat number {i} and a dog." for i in range(12))
    two = " ".join(f"Stock prices rose while bond yields fell {i} points." for i in range(12))
    text = one + " " + two
    units = splitting.units_of(text, set(), [], 1)
    cuts = splitting.cut_points(text, units, 0, int(len(text) * 0.62), 0)
    assert abs(cuts[0][1] - len(one)) <= 1


def test_a_deep_valley_beats_a_heading():
    """A heading inside one topic is passed over for the change of topic beside it; of like places the heading is taken."""
    cats = [f"The cat sat near cat number {i} and a dog." for i in range(16)]
    bonds = [f"Stock prices rose while bond yields fell {i} points." for i in range(8)]
    text = "\n".join(cats[:12] + ["# The cat and a dog"] + cats[12:] + bonds)
    page = scan_page(text)
    units = splitting.units_of(text, {a for a, _ in sections(page)}, [], 1)
    assert text[splitting.cut_points(text, units, 0, int(len(text) * 0.8), 0)[0][1] :].startswith("Stock")
    alike = "\n".join(cats[:12] + ["# The cat and a dog"] + cats[12:])
    units = splitting.units_of(alike, {a for a, _ in sections(scan_page(alike))}, [], 1)
    assert alike[splitting.cut_points(alike, units, 0, int(len(alike) * 0.85), 0)[0][1] :].startswith("# The")


def test_overlap_as_planned():
    text = "word " * 200
    out = splitting.split_page(text, None, None, 50, 40)
    assert all(len(o[7]) <= 50 for o in out) and min(o[4] for o in out[1:]) >= 35


def test_pieces_edges(spark):
    pages = spark.createDataFrame([(1, "", None, None, 1), (2, None, None, None, 1), (3, "# a\n" + "word " * 50, None, None, 1), (3, "# a\n" + "word " * 50, None, None, 1), (4, "no plan", None, None, 1)], "page_id bigint, text string, headings array<struct<level:int,text:string,line:int>>, body_start_line int, overlap int")
    plans = spark.createDataFrame([(1, 10, 2), (2, 10, 2), (3, 60, None), (3, 60, None), (None, 5, 1)], "page_id bigint, body_limit int, overlap_chars int")
    got = splitting.pieces(pages, plans).collect()
    assert {r["page_id"] for r in got} == {3} and all([tuple(s) for s in r["sections"]] == [(1, 253, True)] and len(r["piece"]) <= 60 for r in got)


# --- packing


def test_bins():
    r = random.Random(1)
    pack = packing.Pack(1, 100, 1)
    bins = packing.Bins(pack, 8, "t")
    placed = {}
    for _ in range(3000):
        size = r.choice([0, 1, 5, 20, 35, 50, 99, 100])
        name, slot = bins.add(size)
        placed.setdefault(name, []).append((slot, size))
        assert len(bins.slots) <= 8
    used = 0
    for items in placed.values():
        assert [s for s, _ in items] == list(range(len(items)))
        total = sum(n for _, n in items) + len(items) - 1
        assert total <= 100
        used += sum(n for _, n in items)
    assert used / (100 * len(placed)) > 0.93
    assert packing.parts_of(100, 100) == [100] and packing.parts_of(250, 100) == [100, 100, 50] and packing.parts_of(0, 5) == [0]


def test_pack_texts(spark):
    docs = spark.createDataFrame([(1, None, *EXTRA), (2, "", *EXTRA), (3, "word " * 50, *EXTRA), (4, "x", *EXTRA)], "doc_id bigint, text string" + CLASH)
    out = packing.pack_texts(docs, [packing.Pack(1, 20, 1), packing.Pack(2, 1000, 0)]).collect()
    parts = {(r["doc_id"], r["pack_id"]): r["n_parts"] for r in out}
    assert parts[3, 1] == 3 and parts[3, 2] == 1 and parts[1, 1] == 1 and len(out) == 4 + 2 + 4
    assert packing.pack_texts(docs.limit(0), [packing.Pack(1, 20, 1)]).count() == 0


@has_data
def test_packing_wastes_little(spark):
    out = packing.pack_texts(spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet").coalesce(1), [packing.Pack(2, 2048, 1)]).groupBy("container").sum("n_tokens").collect()
    assert sum(r[1] for r in out) / (2048 * len(out)) > 0.9


# --- leakage


def test_passages():
    found = leakage.passages([(1, "Do it now. Alpha beta gamma. Delta? Which one?", True), (2, "Do it now. Own words here.", True), (3, None, False), (4, "Only one?", False)])
    assert leakage.opening("Do it, NOW. Alpha") == "do it now" and leakage.opening(None) is None
    assert found == {1: "alpha beta gamma delta".split(), 2: "own words here".split(), 4: ["only", "one"]}


def brute_leak(passage, words, least=20):
    need, best = min(least, len(passage)), 0
    for i in range(len(passage)):
        for j in range(len(words)):
            if passage[i] != words[j]:
                continue
            n = k = 0
            miss = same = 0
            while i + n < len(passage) and j + n < len(words):
                if passage[i + n] == words[j + n]:
                    same, miss = same + 1, 0
                    k = n + 1
                else:
                    miss += 1
                    if miss > 1:
                        break
                n += 1
                if k >= need and sum(a == b for a, b in zip(passage[i : i + k], words[j : j + k])) >= leakage.MATCHED * k:
                    best = max(best, k)
    return best >= need


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(r.choice([12, 30, 50])))) for i in range(12)]
    docs, want = [], set()
    for d in range(120):
        words = [word() for _ in range(r.randint(0, 80))]
        if r.random() < 0.7:
            own = r.choice(items)[1].split()
            a = r.randint(0, max(0, len(own) - 20))
            part = own[a : a + r.choice([10, 18, 19, 20, 21, 28, 60])]
            for k in range(3, len(part) - 3, 9):
                if r.random() < 0.5:
                    part[k] = "altered"
            words[len(words) // 2 : len(words) // 2] = part
        text = ""
        for w in words:
            text += (w.upper() if r.random() < 0.2 else w) + r.choice([" ", "  ", "\n", ", ", ". ", " ** "])
        docs.append((d, text, "x"))
        want |= {(d, i) for i, p in items if brute_leak(p.split(), words)}
    docs += [(500, None, "x"), (501, "", "x"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").repartition(3)
    frame = spark.createDataFrame(items + [(99, None), items[0]], "item_id bigint, prompt string")
    leaks = leakage.find_leaks(df, frame)
    got = rows_of(leaks.select("doc_id", "item_id"))
    assert set(got) == want and len(got) == len(set(got)) and len(want) > 20
    assert leakage.without_leaks(df, leaks).select("doc_id").distinct().count() == 122 - len({d for d, _ in want})
    assert leakage.find_leaks(df.limit(0), frame).count() == 0 and leakage.find_leaks(df, frame.limit(0)).count() == 0


def test_suffix_array_is_whole_and_in_order():
    r = np.random.default_rng(4)
    for _ in range(60):
        words = r.integers(0, 5, r.integers(0, 90))
        array = leakage.suffix_array(words)

        def suffix(i, words=words):
            end = np.flatnonzero(words[i:] == 0)
            return words[i : i + end[0] if len(end) else None].tolist()

        own = [i for i in range(len(words)) if len(suffix(i)) >= leakage.SEED]
        assert sorted(array.tolist()) == own and [suffix(i) for i in array] == sorted(map(suffix, own))


def test_longest_verbatim(spark):
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(r.choice([6, 20, 40])))) for i in range(15)]
    docs = []
    for d in range(40):
        own = r.choice(items)[1].split()
        a = r.randrange(len(own))
        docs.append((d, " ".join([r.choice("abcdxyz") * 3 for _ in range(20)] + own[a : a + r.randint(1, 40)] + ["end"])))

    def longest(p):
        best = 0
        for _, t in docs:
            t = t.split()
            for i in range(len(p)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n]:
                        n += 1
                    best = max(best, n)
        return best

    want = {i: n for i, p in items if (n := longest(p.split())) >= leakage.SEED}
    got = leakage.longest_verbatim(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, prompt string")).collect()
    assert {r["item_id"]: r["n_words"] for r in got} == want and len(want) > 8


def test_openings_are_shared_over_blocks(spark, monkeypatch):
    own = {i: " ".join(f"w{i}x{k}" for k in range(20)) for i in range(6)}
    items = spark.createDataFrame([(i, f"Read the text and answer in a few words please. {t}.") for i, t in own.items()], "item_id bigint, prompt string")
    docs = spark.createDataFrame([(1, "Read the text and answer in a few words please. Nothing else."), (2, own[3])], "doc_id bigint, text string")
    monkeypatch.setattr(leakage, "ITEMS", 1)
    assert rows_of(leakage.find_leaks(docs, items).select("doc_id", "item_id")) == [(2, 3)]


def test_item_blocks_and_shards(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(d, f"x {passage} y") for d in range(5)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, passage if i == 7 else f"word{i} " * 12) for i in range(9)], "item_id bigint, prompt string")
    monkeypatch.setattr(leakage, "ITEMS", 2)
    assert rows_of(leakage.find_leaks(docs, items).select("doc_id", "item_id")) == [(d, 7) for d in range(5)]


# --- subjects


def test_sentences():
    text = "---\ntags: [x]\n---\n# Head line\n\nOne two. Three\nfour! - five\n\nTitle\n=====\nlast"
    assert subjects.sentences_of(text) == [["one", "two"], ["three", "four"], ["five"], ["last"]]
    assert subjects.sentences_of("") == []


def test_subjects_held_out(spark):
    r = random.Random(3)
    vocabulary = {s: [f"{s}word{c}" for c in "abcdefghij"] for s in ("law", "sport", "music")}
    vocabulary["law"].append("court")
    vocabulary["sport"].append("court")
    common = [f"plain{c}" for c in "abcdefghijkl"]

    def sentence(s):
        return " ".join([r.choice(common), r.choice(vocabulary[s] if s else common), r.choice(common), r.choice(vocabulary[s] if s and r.random() < 0.6 else common)]) + ". "

    docs, labels, truth = [], [], {}
    for d in range(240):
        own = r.sample(sorted(vocabulary), r.choice([1, 1, 2]))
        text = "".join(sentence(r.choice([*own, *own, None])) for _ in range(24))
        if r.random() < 0.3:
            text += sentence(next(s for s in vocabulary if s not in own))
        docs.append((d, text, "x"))
        truth[d] = set(own)
        if d < 160:
            labels += [(d, s, f"r{k}", d) for s in own for k in range(2)]
            if r.random() < 0.1:
                labels.append((d, r.choice(sorted(vocabulary)), "r0", d))
    docs += [(900, "", "x"), (901, None, "x"), docs[0], (902, "plaina plainb.", "x")]
    labels += [(None, "law", "r", 1), (3, None, "r", 1), (5000, "law", None, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    marks = spark.createDataFrame(labels, "doc_id bigint, subject string, rater string, n int")
    got = {}
    for d, s, share in subjects.document_subjects(df, marks).collect():
        got.setdefault(d, set()).add(s)
    assert sum(got.get(d) == truth[d] for d in range(160, 240)) >= 74
    assert not {900, 901, 902} & set(got)
    assert subjects.document_subjects(df, marks.limit(0)).count() == 0
    assert subjects.document_subjects(df.limit(0), marks).count() == 0


# --- scans

COUNTS = {"the": 900, "ohne": 500, "die": 800, "orchestra": 120, "review": 90, "treasury": 80, "mention": 60, "without": 300, "with": 400, "of": 700, "burn": 50, "corner": 60, "long": 40, "term": 40, "showed": 70, "and": 900}


@pytest.mark.parametrize(
    "text,want,how",
    [
        ("the orchestra", "the orchestra", {}), ("tbe orchcstra", "the orchestra", {"confused": 2}), ("o r c h e s t r a of", "orchestra of", {"spaced": 1}), ("ohnedie review", "ohne die review", {"split": 1}), ("the trea-\nsury", "the treasury", {"hyphen": 1}), ("the trea\u00ad\nsury", "the treasury", {"hyphen": 1}),
        ("sho\ufffded the", "showed the", {"confused": 1}), ("shovved the", "showed the", {"confused": 1}), ("the m e n t i\no n of", "the mention of", {"spaced": 1}), ("B12 and H2O of x86", "B12 and H2O of x86", {}), ("the rev1ew", "the review", {"confused": 1}), ("", "", {}), ("a b of", "a b of", {}), ("Tbe", "The", {"confused": 1}),
    ],
)
def test_decode(text, want, how):
    mended, count = scans.Decoder(COUNTS).decode(text)
    assert (mended, {k: v for k, v in count.items() if v}) == (want, how)


def test_cleaned_lexicon():
    out = scans.cleaned({"ohne": 5000, "obne": 30, "die": 4000, "ohnedie": 20, "without": 300, "with": 400, "out": 300})
    assert set(out) == {"ohne", "die", "without", "with", "out"}


def test_cleaned_alike_at_every_size():
    # Rare words' misreadings that were seen three times or more, and words that only look like some.
    wrong = {"hypothcse": (3, "hypothese", 58), "quinbashavv": (3, "quinbashaw", 45), "falbarner": (5, "falbamer", 42), "dc": (8, "de", 147), "dcnnocb": (4, "dennoch", 220)}
    assert not set(wrong) & set(scans.cleaned({w: n for w, (n, _, _) in wrong.items()} | {v: n for _, v, n in wrong.values()}))
    split = {"corneron": 3, "corner": 50, "on": 4000, "underwrote": 130, "under": 1676, "wrote": 1700, "danach": 197, "da": 1809, "nach": 2500}
    assert set(scans.cleaned(split)) == set(split)
    # A pair of words holds at any size, and so does a misreading at the rate of one in thirty.
    for size in (1, 10, 1000):
        assert set(scans.cleaned({"hut": 4 * size, "but": 20 * size, "tbe": 3 * size, "the": 90 * size})) == {"hut", "but", "the"}


def test_lexicon_is_whole_or_fails(spark, monkeypatch):
    df = spark.createDataFrame([("the corner " * 5 + "burn " * 3,)], "raw string")
    monkeypatch.setattr(scans, "MOST_WORDS", 3)
    assert scans.lexicon(df) == {"the": 5, "corner": 5, "burn": 3}
    monkeypatch.setattr(scans, "MOST_WORDS", 2)
    with pytest.raises(ValueError, match="lexicon"):
        scans.lexicon(df)


def test_page_numbers():
    for line, want in {"35": (35, "alone"), "– 107 –": (107, "marked"), "39 / 512": (39, "marked"), "Page iii": (3, "marked"), "p. 24": (24, "marked"), "[155]": (155, "marked"), "-39-": (39, "marked"), "Lawful Bench 78": (78, "inside"), "12 Lawful Bench": (12, "inside"), "mix": None, "Bench": None, "": None}.items():
        assert scans.page_number(line) == want, line
    assert [scans.roman(x) for x in ("iv", "xc", "cccxcix", "mcmxc", "iiii", "")] == [4, 90, 399, None, None, None]


def test_paragraphs():
    lines = ["The first line runs to the edge of", "the page and ends.", "A second paragraph begins here and", "goes on.", "- item", "- item"]
    assert scans.paragraphs(lines) == [lines[:2], lines[2:4], ["- item"], ["- item"]]
    assert scans.paragraphs([]) == [] and scans.paragraphs(["x"]) == [["x"]]


def book(spark):
    body = "the orchestra showed the review of the treasury and the corner without the burn"
    rows, no = [], 0
    for page in range(1, 9):
        head = ["The Lawful Bench", "Tbe Lawful Bench", "The Lawfvl Bench", "The Lawful Bcnch"][page % 4] if page % 2 else None
        own = random.Random(page).sample(body.split(), 11)
        text = "\n".join(x for x in [head, " ".join(own), " ".join(random.Random(-page).sample(body.split(), 6)) + ".", f"{40 + page}"] if x)
        rows.append((no, 1, page, text, "x"))
        no += 1
    rows.append((no, 1, 3, rows[2][3], "x"))
    rows.append((no + 1, 2, 1, "1874", "x"))
    rows.append((no + 2, 2, 2, "the or-\nchestra showed tbe rcview of thc burn", "x"))
    rows += [(no + 3, 2, 3, None, "x"), (no + 4, None, None, "", "x"), (None, 1, 1, "x", "x"), rows[0]]
    # Enough text for a lexicon.
    rows += [(1000 + i, 50 + i, 1, " ".join([body] * 20), "x") for i in range(3)]
    return spark.createDataFrame(rows, "observation_id bigint, book_id bigint, page_no bigint, raw string, noise string")


def test_noise(spark):
    df = book(spark)
    got = rows_of(scans.noise(df))
    by = {}
    for i, kind in got:
        by.setdefault(kind, set()).add(i)
    assert by["header"] == {0, 2, 4, 6, 8} and by["page_number"] == set(range(9))
    assert by["hyphen"] == {10} and by["misread"] == {10}
    texts = {r["observation_id"]: r["text"] for r in scans.repaired(df).collect()}
    assert texts[10] == "the orchestra showed the review of the burn"
    # The header and the number are gone, the lines between are one paragraph.
    assert texts[0] == " ".join(df.filter("observation_id = 0").first()["raw"].split("\n")[1:-1])
    assert scans.noise(df.limit(0)).count() == 0


def test_repaired_blocks(spark):
    df = book(spark)
    rows, no = [], 0
    for page in range(1, 6):
        # Pages of book 7 that no read covers; the header is misread on one of them.
        for ordinal, text in enumerate(["Tbe Corner Review" if page == 2 else "The Corner Review", "the or-\nchestra showed tbe rcview\nof thc burn" if page < 3 else "the or-\nchestra showed the review\nof the burn", "the corner of the treasury.", str(60 + page)]):
            rows.append((no, 5000 + page, 7, page, ordinal, text, None if page == 1 else 0.4))
            no += 1
    rows += [rows[1], (100, 5006, 7, 6, 0, None, 0.9), (None, 5006, 7, 6, 1, "the", 0.9), (101, None, None, None, None, "tbe burn", 0.9)]
    blocks = spark.createDataFrame(rows, "block_id bigint, observation_id bigint, book_id bigint, page_no bigint, ordinal int, markdown string, confidence double")
    out = scans.repaired_blocks(blocks, df).collect()
    texts = {r["block_id"]: r["text"] for r in out}
    assert len(out) == len(texts) == 21
    for k in range(0, 20, 4):
        assert [texts[k + i] for i in range(4)] == ["", "the orchestra showed the review of the burn", "the corner of the treasury.", ""]
    assert texts[101] == "the burn"


def test_confidence_is_a_weak_hint():
    decoder = scans.Decoder(COUNTS)
    assert decoder.at(None) is decoder and decoder.at(0.9) is decoder and decoder.at(0.4) is decoder.at(0.42)
    assert decoder.at(0.4).fixed("rcview")[0] < decoder.fixed("rcview")[0] < decoder.at(1.0).fixed("rcview")[0]
    assert {decoder.at(c).decode("tbe orchcstra of Zandavar")[0] for c in (0.0, 0.4, 0.9, 1.0)} == {"the orchestra of Zandavar"}


def test_long_read():
    decoder = scans.Decoder(COUNTS)
    mended, count = decoder.decode("the orchcstra " * 20_000)
    assert count["confused"] == 20_000 and len(mended) == 14 * 20_000


def test_leaves_cover_text():
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(["<b>", "</b>", "$", "\\", "[[", "]]", "*", "_", "`", "~~", "|", "\n", "{", "}", "#", "=", " a", "b1 ", "'", "&amp;", "-", "  "]) for _ in range(r.randint(0, 60)))
        assert "".join(text[x.start : x.end] for x in leaves_of(text)) == text
