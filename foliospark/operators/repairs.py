"""Differences, loops, gaps and repairs of page texts."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from foliospark.operators.geometry import coverage
from foliospark.operators.quality import similarity

_DIFF = ArrayType(StructType([StructField("op", StringType()), StructField("a", StringType()), StructField("b", StringType())]))
#: Bare addresses, and where none is to be linked.
_URL = re.compile(r"(?<![\w(<\"'=\[/])https?://[^\s<>\"'\])]+[^\s<>\"'\]).,;:!?]")
_SHUT = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|!?\[[^\]]*\]\([^)]*\)|<[^>\n]+>", re.S)


@F.pandas_udf(_DIFF)
def word_differences(a: pd.Series, b: pd.Series) -> pd.Series:
    """The first 50 differences of two texts by words and numbers; null if one is null."""

    def diff(x: str | None, y: str | None):
        if x is None or y is None:
            return None
        left, right = re.findall(r"[^\W_]+", x), re.findall(r"[^\W_]+", y)
        codes = difflib.SequenceMatcher(None, [w.lower() for w in left], [w.lower() for w in right], autojunk=False).get_opcodes()
        return [{"op": op, "a": " ".join(left[i:j]), "b": " ".join(right[k:m])} for op, i, j, k, m in codes if op != "equal"][:50]

    return pd.Series([diff(x, y) for x, y in zip(a, b)])


#: Atoms of a window whose end may be a loop, how far windows are apart, longest cycle; atoms a loop must cover, with counters and without (fixed values).
LOOP_WINDOW, LOOP_STEP, LOOP_CYCLE, LOOP_LEAST = 256, 16, 48, (48, 24)
#: What is no evidence of a loop: grounding marks, tables, images, tags.
_NO_LOOP = re.compile(r"<\|(?:det|ref)\|>.*?(?:<\|/(?:det|ref)\|>|\Z)|<table\b.*?(?:</table>|\Z)|^\|.*?$|!\[[^\]]*\]\([^)]*\)|<[^>]*(?:>|\Z)", re.I | re.S | re.M)


def atoms(text: str) -> list[str]:
    """Words, commands, numbers and signs of a text; numbers that count (indices, items, section chains) are ``#``."""
    bare = _NO_LOOP.sub(" ", text)
    bare = re.sub(r"([_^]\s*\{?)\s*\d+", r"\1 #", bare)
    bare = re.sub(r"\(\s*\d+\s*\)", "(#)", bare)
    bare = re.sub(r"\b\d+(?:\.\d+){2,}\b", lambda m: "#" + ".#" * m[0].count("."), bare)
    return re.findall(r"\\[a-z]+|[a-z]+|\d+|\S", bare.casefold())


def has_loop(items: list[str]) -> bool:
    """Whether some window of the atoms ends in a cycle that stands four times or more and covers enough atoms.

    Windows end every ``LOOP_STEP`` atoms and at the end of the text.
    """
    n = len(items)
    ends = [*range(48, n, LOOP_STEP), n]
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(a, len(number)) for a in items], np.int64)
    counters = np.concatenate([[0], np.cumsum(np.array([a == "#" for a in items], np.int64))])
    for size in range(1, min(LOOP_CYCLE, n // 4) + 1):
        same = np.concatenate([np.zeros(size, bool), ids[size:] == ids[:-size]])
        # Equal atoms up to each place, the place included.
        stops = np.flatnonzero(np.concatenate([[True], ~same]))
        run = np.arange(n + 1) - stops[np.searchsorted(stops, np.arange(n + 1), "right") - 1]
        for end in ends:
            counted = counters[end] > counters[max(0, end - size)]
            times = max(4, -(-LOOP_LEAST[0 if counted else 1] // size))
            if times * size <= min(end, LOOP_WINDOW) and run[end] >= size * (times - 1):
                return True
    return False


@F.pandas_udf(BooleanType())
def looping(text: pd.Series) -> pd.Series:
    """True for a text with a structural loop anywhere in it; null for a null text."""
    return text.map(lambda t: None if t is None else has_loop(atoms(t)))


#: Formulas of one form in a row, atoms of a long formula and of a streak in it (fixed values).
SAME_FORMULAS, LONG_FORMULA, STREAK = 32, 1_000, 128
_FORMULA = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\\$])\$(?=\S)([^$\n]+?)(?<=\S)\$(?!\d)", re.S)


def math_runs_away(text: str) -> bool:
    """Whether ``SAME_FORMULAS`` formulas alike but for digits follow one another, or a long formula repeats a part over ``STREAK`` atoms."""
    before, count, end = None, 0, 0
    for m in _FORMULA.finditer(text):
        tex = next(g for g in m.groups() if g)
        form = re.sub(r"\d+", "#", re.sub(r"\s+", "", tex))
        count = count + 1 if form == before and not text[end : m.start()].strip(" \t\r\n,;") else 1
        if count >= SAME_FORMULAS:
            return True
        before, end = form, m.end()
        if len(tex) <= LONG_FORMULA:
            continue
        parts = [re.sub(r"\d+", "#", a) for a in re.findall(r"\\[A-Za-z]+(?:\s*[_^]\s*\{?\d+\}?)*|\S", tex)]
        for size in range(1, 17):
            cycles = ["\0".join(parts[i : i + size]) for i in range(0, len(parts), size)]
            streak = 0
            for a, b in zip(cycles, cycles[1:]):
                streak = streak + size if a == b else 0
                if streak >= STREAK:
                    return True
    return False


@F.pandas_udf(BooleanType())
def runaway_math(text: pd.Series) -> pd.Series:
    """:func:`math_runs_away` of each text; null for a null text."""
    return text.map(lambda t: None if t is None else math_runs_away(t))


@F.pandas_udf(StringType())
def autolinked(text: pd.Series) -> pd.Series:
    """Bare web addresses in angle brackets, outside code, links and tags."""

    def link(value: str | None) -> str | None:
        if not value:
            return value
        out, at = [], 0
        for m in [*_SHUT.finditer(value), None]:
            out.append(_URL.sub(lambda u: f"<{u[0]}>", value[at : m.start() if m else len(value)]))
            if m:
                out.append(m[0])
                at = m.end()
        return "".join(out)

    return text.map(link)


def tidy_latex(text: Column) -> Column:
    """Formula text with single spaces, no space inside braces or before indices, and common signs as commands."""
    out = text
    for sign, name in (("≤", r"\\le "), ("≥", r"\\ge "), ("≠", r"\\ne "), ("×", r"\\times "), ("∞", r"\\infty "), ("→", r"\\to "), ("α", r"\\alpha "), ("β", r"\\beta "), ("π", r"\\pi ")):
        out = F.regexp_replace(out, sign, name)
    for pattern, to in ((r"\s+", " "), (r"\{ ", "{"), (r" \}", "}"), (r" ([_^])", "$1"), (r"([_^]) ", "$1")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def coverage_gaps(native: DataFrame, blocks: DataFrame, page: list[str], least: int = 18, covered: float = 0.5) -> DataFrame:
    """(page, characters): pages on which ``least`` characters or more of the native text (page, id, text, bbox) lie in no block (page, bbox)."""
    on = F.lit(True)
    for p in page:
        on = on & (F.col(f"a.{p}") == F.col(f"c.{p}"))
    held = native.alias("a").join(blocks.filter("bbox is not null").alias("c"), on & (coverage(F.col("a.bbox"), F.col("c.bbox")) >= covered), "left_anti")
    return held.groupBy(*page).agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("characters")).filter(F.col("characters") >= least)


def safe_repairs(pairs: DataFrame, found: str, better: str, like: float = 0.72) -> DataFrame:
    """Pairs of tokens of which one may replace the other: four letters or more, lengths within two, both with digits or both capitalised, and similar."""
    a, b = F.col(found), F.col(better)
    both = (a.rlike(r"\d") & b.rlike(r"\d")) | (a.rlike(r"^\p{Lu}") & b.rlike(r"^\p{Lu}"))
    rows = pairs.filter((F.least(F.length(a), F.length(b)) >= 4) & (F.abs(F.length(a) - F.length(b)) <= 2) & both & (a != b))
    return rows.filter(similarity(a, b) >= like)


def needs_recovery(warnings: Column, similar: Column, trusted: Column, n_words: Column, gap: Column) -> Column:
    """Whether a page is to be read again: a critical warning, too unlike a trusted native text of eight words or more, or a coverage gap."""
    critical = F.arrays_overlap(F.coalesce(warnings, F.array().cast("array<string>")), F.array(F.lit("empty"), F.lit("repeated_lines"), F.lit("very_long")))
    return F.coalesce(critical, F.lit(False)) | F.coalesce(trusted & (n_words >= 8) & (similar < 0.75), F.lit(False)) | (F.coalesce(gap, F.lit(0)) > 0)


def indent_bands(rows: DataFrame, by: list[str], order: str, x: str, width: float = 12.0) -> DataFrame:
    """(by, order, band): each row's indentation by the first band within ``width`` of it, bands made in order. A group is one task."""
    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*by, order]], "band int"])

    def band(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        seen: list[float] = []
        out = []
        for value in part[x]:
            at = next((i for i, s in enumerate(seen) if abs(s - value) <= width), len(seen))
            if at == len(seen):
                seen.append(value)
            out.append(at)
        return part[[*by, order]].assign(band=out)

    return rows.filter(F.col(x).isNotNull()).select(*by, order, x).groupBy(*by).applyInPandas(band, schema)


def trimmed_repeats(pages: DataFrame, book: str, page: str, text: str, least: int = 40) -> DataFrame:
    """(book, page, text): the longest start of a page, of ``least`` characters or more, that ends the page before is cut."""
    w = W.partitionBy(book).orderBy(page)
    rows = pages.select(book, page, F.col(text).alias("t"), F.when(F.lag(page).over(w) == F.col(page) - 1, F.lag(text).over(w)).alias("before"))

    @F.pandas_udf(StringType())
    def cut(here: pd.Series, before: pd.Series) -> pd.Series:
        def one(t: str | None, b: str | None) -> str | None:
            if not t or not b:
                return t
            for n in range(min(len(t), len(b)), least - 1, -1):
                if b.endswith(t[:n]):
                    return t[n:].lstrip()
            return t

        return pd.Series([one(t, b) for t, b in zip(here, before)])

    return rows.select(book, page, cut("t", "before").alias(text))


def bundle_findings(pages: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """(path, finding, detail) of a published bundle.

    ``pages``: path, text, order_no; ``links``: source, kind (page, asset, anchor), target; ``assets``:
    path. Finds missing pages and assets, assets nobody names, gaps in the order, and
    duplicate orders.
    """
    page_links = links.filter("kind = 'page'").join(pages.select(F.col("path").alias("target")), "target", "left_anti").select(F.col("source").alias("path"), F.lit("missing page").alias("finding"), F.col("target").alias("detail"))
    asset_links = links.filter("kind = 'asset'").join(assets.select(F.col("path").alias("target")), "target", "left_anti").select(F.col("source").alias("path"), F.lit("missing asset").alias("finding"), F.col("target").alias("detail"))
    unused = assets.select("path").join(links.filter("kind = 'asset'").select(F.col("target").alias("path")), "path", "left_anti").select("path", F.lit("unused asset").alias("finding"), F.lit("").alias("detail"))
    order = pages.groupBy("order_no").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    twice = order.filter("n > 1").select("path", F.lit("repeated order").alias("finding"), F.col("order_no").cast("string").alias("detail"))
    known = order.select((F.col("order_no") + 1).alias("order_no"))
    first = order.agg(F.min("order_no").alias("order_no"))
    gaps = order.join(known, "order_no", "left_anti").join(first, "order_no", "left_anti").select("path", F.lit("order gap").alias("finding"), F.col("order_no").cast("string").alias("detail"))
    return page_links.unionByName(asset_links).unionByName(unused).unionByName(twice).unionByName(gaps)
