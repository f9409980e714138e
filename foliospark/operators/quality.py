"""Measures of text quality: comparison, repetition, tables, overlap, repairs."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from foliospark.functions.text import compare_form, table_cells

#: Limits of a plausible table: columns, rows, share (and least number) of repeated rows and of one cell's value.
TABLE_COLUMNS, TABLE_ROWS, SAME_ROWS, SAME_CELLS = 64, 400, (0.40, 12), (0.45, 40)


def words(text: Column | str) -> Column:
    """Lower-cased words and numbers of a text."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1))


def token_coverage(wanted: Column, found: Column) -> Column:
    """Share of the distinct wanted words that were found, 1 for none wanted."""
    a = F.array_distinct(wanted)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, found)) / F.size(a))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer, 1 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / longest)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts, null if one is null. Alignment is quadratic: apply it to few, prefiltered pairs."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def compare(df: DataFrame, a: str, b: str, cheap_below: float = 0.2) -> DataFrame:
    """Rows with similarity, coverage, length_ratio and warnings of text ``b`` against ``a``.

    The ratio is only worked out where the length ratio allows at least ``cheap_below``;
    below, its bound 2r/(1+r) is given.
    """
    rows = df.withColumn("_a", compare_form(F.coalesce(F.col(a), F.lit("")))).withColumn("_b", compare_form(F.coalesce(F.col(b), F.lit(""))))
    rows = rows.withColumn("coverage", token_coverage(words("_a"), words("_b"))).withColumn("length_ratio", length_ratio(F.col("_a"), F.col("_b")))
    near = F.col("length_ratio") >= cheap_below
    rows = rows.withColumn("similarity", F.when(near, similarity(F.when(near, F.col("_a")), F.when(near, F.col("_b")))).otherwise(2 * F.col("length_ratio") / (1 + F.col("length_ratio"))))
    notes = [("low_similarity", F.col("similarity") < 0.75), ("low_coverage", F.col("coverage") < 0.8), ("length_mismatch", F.col("length_ratio") < 0.65)]
    return rows.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in notes]))).drop("_a", "_b")


def multiset_overlap(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, precision, recall, shared): words of ``b`` against those of ``a``, counted with repeats."""
    count = lambda c, n: df.select(*keys, F.explode(words(F.coalesce(F.col(c), F.lit("")))).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias(n))
    both = count(a, "na").join(count(b, "nb"), [*keys, "w"], "full_outer")
    out = both.groupBy(*keys).agg(F.sum(F.coalesce(F.least("na", "nb"), F.lit(0)) * F.when(F.col("na").isNotNull() & F.col("nb").isNotNull(), 1).otherwise(0)).alias("shared"), F.sum("na").alias("_na"), F.sum("nb").alias("_nb"))
    return out.select(*keys, (F.col("shared") / F.col("_nb")).alias("precision"), (F.col("shared") / F.col("_na")).alias("recall"), "shared")


def repeated_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, n_lines, n_distinct, repeated_share, top_share) of the non-empty lines of each text."""
    rows = df.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("_l")).withColumn("_l", F.trim("_l")).filter("_l != ''")
    per = rows.groupBy(*keys, "_l").agg(F.count("*").alias("_n"))
    out = per.groupBy(*keys).agg(F.sum("_n").alias("n_lines"), F.count("*").alias("n_distinct"), F.max("_n").alias("_top"))
    return out.select(*keys, "n_lines", "n_distinct", ((F.col("n_lines") - F.col("n_distinct")) / F.col("n_lines")).alias("repeated_share"), (F.col("_top") / F.col("n_lines")).alias("top_share"))


def boilerplate(blocks: DataFrame, book: str, page: str, least: int = 2) -> DataFrame:
    """(book, form, n_pages): texts at the top or bottom edge of ``least`` pages or more (boxes 0..1000: y0 <= 80 or y1 >= 940)."""
    form = F.regexp_replace(F.regexp_replace(F.lower(F.trim("markdown")), r"\d+", "#"), r"\s+", " ")
    rows = blocks.filter("bbox.y0 <= 80 or bbox.y1 >= 940").select(book, page, form.alias("form")).filter("form != ''").distinct()
    return rows.groupBy(book, "form").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least)


def triple_phrase(text: Column | str, most: int = 35) -> Column:
    """True if a phrase of up to ``most`` words stands three times in a row."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    flat = F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    return flat.rlike(rf" ((?:[^ ]+ ){{1,{most}}}?)\1\1")


def table_quality(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, n_rows, n_columns, repeated_rows, top_cell, warnings) of the pipe tables in each text."""
    lines = df.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("_l")).filter(F.col("_l").rlike(r"^\s*\|.*\|\s*$") & ~F.col("_l").rlike(r"^[\s|:-]+$"))
    rows = lines.withColumn("_c", table_cells("_l"))
    by_row = rows.groupBy(*keys, F.array_join("_c", "|").alias("_r")).agg(F.count("*").alias("_n"), F.max(F.size("_c")).alias("_w"))
    by_row = by_row.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), F.max("_w").alias("n_columns"), (F.sum("_n") - F.count("*")).alias("repeated_rows"))
    by_cell = rows.select(*keys, F.explode("_c").alias("_v")).filter("_v != ''").groupBy(*keys, "_v").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("top_cell"), F.sum("_n").alias("_cells"))
    both = by_row.join(by_cell, keys, "left").fillna(0, ["top_cell", "_cells"])
    notes = [
        ("too_wide", F.col("n_columns") > TABLE_COLUMNS), ("too_long", F.col("n_rows") > TABLE_ROWS),
        ("repeated_rows", (F.col("n_rows") >= SAME_ROWS[1]) & (F.col("repeated_rows") >= SAME_ROWS[0] * F.col("n_rows"))),
        ("one_cell", (F.col("_cells") >= SAME_CELLS[1]) & (F.col("top_cell") >= SAME_CELLS[0] * F.col("_cells"))),
    ]
    return both.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in notes]))).drop("_cells")


#: Words of a window in which a repetition must lie, and how far windows are apart (fixed values).
RUN_WINDOW, RUN_STEP = 2_000, 1_000
#: Longest repeated phrase in words; times a phrase of up to so many words must stand to be a runaway (fixed values).
RUN_LONGEST, RUN_TIMES = 35, ((1, 12), (4, 8), (12, 5), (35, 3))
#: What isn't looked at for repetition: tables, images, rows, formulas.
_UNREAD = re.compile(r"<table\b.*?</table>|!\[[^\]]*\]\([^)]+\)|^\|.*?\|[ \t]*$|\\\(.*?\\\)|\\\[.*?\\\]|\$\$.*?\$\$", re.I | re.S | re.M)


def _read_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of what lies outside the unread stretches; emphasis and case don't count."""
    shut = [m.span() for m in _UNREAD.finditer(text)]
    out, k = [], 0
    for m in re.finditer(r"\S+", text):
        while k < len(shut) and shut[k][1] <= m.start():
            k += 1
        if k < len(shut) and shut[k][0] < m.end():
            continue
        out.append((m[0].strip("*_`").casefold() or m[0], m.start(), m.end()))
    return out


def runaway_span(text: str, least_phrase: int = 1) -> tuple[int, int] | None:
    """(from, to) in characters of what repeats a phrase too often, without its first time.

    A phrase of one word must stand 12 times in a row, of up to four 8, of up to twelve 5,
    longer ones 3 times, inside ``RUN_WINDOW`` words; windows follow to the end of the text.
    Of a window the shortest phrase counts, then its first place.
    """
    found = _read_words(text)
    n = len(found)
    if n < 6:
        return None
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w, _, _ in found])
    # For each phrase length: how many words from here equal the word one phrase later.
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for size in range(least_phrase, min(RUN_LONGEST, n // 3) + 1):
        times = next(t for most, t in RUN_TIMES if size <= most)
        same = np.append(ids[:-size] == ids[size:], False)
        stops = np.flatnonzero(~same)
        run = stops[np.searchsorted(stops, np.arange(len(same)))] - np.arange(len(same))
        starts = np.flatnonzero(run >= size * (times - 1))
        if len(starts):
            held.append((size, times, run, starts))
    for begin in range(0, n, RUN_STEP):
        end = min(n, begin + RUN_WINDOW)
        for size, times, run, starts in held:
            if size > (end - begin) // 3:
                continue
            k = np.searchsorted(starts, begin)
            if k < len(starts) and starts[k] + size * times <= end:
                at = int(starts[k])
                return found[at + size][1], found[at + size * (1 + int(run[at]) // size) - 1][2]
        if end == n:
            break
    return None


@F.pandas_udf(StringType())
def truncated_runaway(text: pd.Series) -> pd.Series:
    """Texts with each runaway repetition of two words or more cut to one cycle."""

    def cut(value: str | None) -> str | None:
        for n in range(129):
            found = runaway_span(value, 2) if value and n < 128 else None
            if not found:
                return value.rstrip() if n else value
            value = value[: found[0]] + value[found[1] :]

    return text.map(cut)


@F.pandas_udf(BooleanType())
def balanced_math(text: pd.Series) -> pd.Series:
    """True if braces and environments in a text close in order."""

    def ok(value: str | None) -> bool | None:
        if value is None:
            return None
        depth, open_ = 0, []
        for m in re.finditer(r"\\begin\{(\w+\*?)\}|\\end\{(\w+\*?)\}|\\.|[{}]", value, re.S):
            if m[1]:
                open_.append(m[1])
            elif m[2]:
                if not open_ or open_.pop() != m[2]:
                    return False
            elif m[0] == "{":
                depth += 1
            elif m[0] == "}":
                depth -= 1
                if depth < 0:
                    return False
        return depth == 0 and not open_

    return text.map(ok)


def adjacent_overlap(df: DataFrame, by: list[str], order: str, text: str, probe: int = 120) -> DataFrame:
    """(by, order, next_no, kind): what a row's text shares with that of the row numbered next.

    ``equal``; ``contained`` where the shorter, of a third of the longer or more, is inside
    it; ``seam`` where a row ends with the first ``probe`` characters of the next.
    """
    here = F.regexp_replace(F.trim(F.col(text)), r"\s+", " ")
    w = W.partitionBy(*by).orderBy(order)
    rows = df.select(*by, order, here.alias("_a")).withColumn("next_no", F.lead(order).over(w)).withColumn("_b", F.lead("_a").over(w)).filter(F.col("next_no") == F.col(order) + 1)
    small, large = F.least(F.length("_a"), F.length("_b")), F.greatest(F.length("_a"), F.length("_b"))
    inside = (F.contains("_a", "_b") | F.contains("_b", "_a")) & (small >= 0.35 * large) & (small > 0)
    seam = (F.length("_b") >= probe) & F.col("_a").endswith(F.left("_b", F.lit(probe)))
    kind = F.when((F.col("_a") == F.col("_b")) & (F.col("_a") != ""), "equal").when(inside, "contained").when(seam, "seam")
    return rows.withColumn("kind", kind).filter("kind is not null").select(*by, order, "next_no", "kind")


def confidence_summary(df: DataFrame, by: list[str], logprob: str) -> DataFrame:
    """Tokens, geometric mean, 5th percentile, least probability and share below one half, rounded to six digits."""
    p = F.exp(F.greatest(F.lit(-100.0), F.least(F.lit(0.0), F.col(logprob))))
    rows = df.filter(F.col(logprob).isNotNull()).withColumn("_p", p)
    ranked = rows.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("_p"))).withColumn("_n", F.count("*").over(W.partitionBy(*by)))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n_tokens"), F.round(F.exp(F.avg(logprob)), 6).alias("mean"),
        F.round(F.min(F.when(F.col("_i") >= F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.05)), F.col("_p"))), 6).alias("low"),
        F.round(F.min("_p"), 6).alias("least"), F.round(F.avg((F.col("_p") < 0.5).cast("double")), 6).alias("below_half"),
    )
