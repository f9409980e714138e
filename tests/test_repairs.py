"""Differences, loops and repairs on literal cases."""

from pyspark.sql import functions as F

from foliospark.operators import repairs as R

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_differences(spark):
    df = spark.createDataFrame([("The quick fox", "the slow fox ran"), (None, "x"), ("a", "A")], "a string, b string")
    got = [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.select(R.word_differences("a", "b")).collect()]
    assert got == [[("replace", "quick", "slow"), ("insert", "", "ran")], None, []]


def test_loops(spark):
    df = spark.createDataFrame([("start " + "a b c " * 9,), (r"x_{1} + " * 12,), (" ".join(f"w{chr(97 + i)}" for i in range(26)),), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(R.looping("t")).collect()] == [True, True, False, None, False]


def test_loops_anywhere():
    far = R.atoms("a b c d " * 60 + "one two three four five")
    assert R.has_loop(far) and not R.has_loop(R.atoms("x_{1} + " * 7)) and R.has_loop(R.atoms("x_{1} + " * 12))
    assert not R.has_loop(R.atoms("| a | b |\n" * 40)) and not R.has_loop(R.atoms("<table>" + "a b " * 60)) and not R.has_loop([])
    assert R.math_runs_away("$x_1=2$, " * 32) and not R.math_runs_away("$x_1=2$, " * 31) and R.math_runs_away("$$" + "x_1+" * 300 + "$$")


def test_text_repairs(spark):
    df = spark.createDataFrame([("see https://a.org/x, `https://b.org` [c](https://c.org) <https://d.org>.",), (None,)], "t string")
    assert [r[0] for r in df.select(R.autolinked("t")).collect()] == ["see <https://a.org/x>, `https://b.org` [c](https://c.org) <https://d.org>.", None]
    assert spark.createDataFrame([("x  _ { a } ≤ b",)], "t string").select(R.tidy_latex(F.col("t"))).first()[0] == r"x_{a} \le b"
    pairs = spark.createDataFrame([("Velbalos", "Velbalas"), ("velbalos", "velbalas"), ("A12345", "A12346"), ("Abc", "Abd"), ("Something", "Different")], "a string, b string")
    assert sorted(r["a"] for r in R.safe_repairs(pairs, "a", "b").collect()) == ["A12345", "Velbalos"]
    pages = spark.createDataFrame([("b", 1, "x " + "tail of the page that is repeated here in full"), ("b", 2, "tail of the page that is repeated here in full and more"), ("b", 4, None)], "b string, p int, t string")
    assert [r["t"] for r in R.trimmed_repeats(pages, "b", "p", "t").orderBy("p").collect()][1:] == ["and more", None]


def test_pages(spark):
    native = spark.createDataFrame([(1, 1, "covered text here and more", (0.0, 0.0, 10.0, 10.0)), (1, 2, "this is not covered at all", (50.0, 50.0, 60.0, 60.0)), (2, 3, "short", (50.0, 50.0, 60.0, 60.0))], f"p int, id int, text string, bbox {BOX}")
    blocks = spark.createDataFrame([(1, (0.0, 0.0, 20.0, 20.0)), (1, None)], f"p int, bbox {BOX}")
    assert [tuple(r) for r in R.coverage_gaps(native, blocks, ["p"]).collect()] == [(1, 21)]
    state = spark.createDataFrame([(["empty"], 1.0, False, 9, 0), ([], 0.5, True, 9, 0), ([], 0.5, True, 3, 0), (None, None, None, None, 5), (None, None, None, None, None)], "w array<string>, s double, t boolean, n int, g int")
    assert [r[0] for r in state.select(R.needs_recovery(*[F.col(c) for c in "wstng"])).collect()] == [True, True, False, True, False]
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 30.0), ("a", 3, 20.0), ("a", 4, 31.0), ("a", 5, None)], "g string, o int, x double")
    assert {r["o"]: r["band"] for r in R.indent_bands(rows, ["g"], "o", "x").collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
    bundle = R.bundle_findings(
        spark.createDataFrame([("a.md", "", 1), ("b.md", "", 2), ("c.md", "", 2), ("d.md", "", 5)], "path string, text string, order_no int"),
        spark.createDataFrame([("a.md", "page", "gone.md"), ("a.md", "page", "b.md"), ("b.md", "asset", "x.png"), ("b.md", "asset", "y.png")], "source string, kind string, target string"),
        spark.createDataFrame([("x.png",), ("z.png",)], "path string"),
    )
    assert sorted((r["path"], r["finding"]) for r in bundle.collect()) == [("a.md", "missing page"), ("b.md", "missing asset"), ("b.md", "repeated order"), ("d.md", "order gap"), ("z.png", "unused asset")]
