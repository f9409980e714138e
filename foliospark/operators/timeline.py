"""Operators on time series of intervals: runs, overlaps, windows, lanes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds without speech that end a run.
GAP = 1.25


def runs(df: DataFrame, by: list[str], same: list[str], start: str, end: str, gap: float, tie: list[str]) -> DataFrame:
    """Rows with ``run``, the number of their run inside ``by``.

    Rows in (start, end, tie) order belong together while the ``same`` columns don't change
    and the next start is at most ``gap`` after the greatest end so far. Rows with a null
    start come first in a run of their own by the null gap; nulls in ``same`` are equal.
    """
    order = W.partitionBy(*by).orderBy(start, end, *tie)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    rows = df.withColumn("_island", F.sum((change | (F.row_number().over(order) == 1)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(*by, "_island").orderBy(start, end, *tie).rowsBetween(W.unboundedPreceding, -1)
    top = F.max(end).over(inside)
    rows = rows.withColumn("_new", (top.isNull() | ((F.col(start) - top) > gap)).cast("int"))
    return rows.withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_island", "_new")


def coalesce_runs(df: DataFrame, by: list[str], start: str, end: str, text: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """One row per run: first start, greatest end, rows, and its texts joined by a space in order."""
    out = [F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_rows")]
    if text:
        cells = F.array_sort(F.collect_list(F.struct(start, end, *(tie or []), F.coalesce(F.trim(text), F.lit("")).alias("_x"))))
        out.append(F.array_join(F.filter(F.transform(cells, lambda c: c["_x"]), lambda x: x != ""), " ").alias(text))
    return df.groupBy(*by, "run").agg(*out)


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: float, suffix: str = "_r") -> DataFrame:
    """Pairs of a left and a right interval (columns s, e) of equal ``by`` whose overlap is longer than nothing.

    Both sides are cut into stretches of ``width`` and joined on (by, stretch), so the join
    is an equi-join and a hot entity spreads over its stretches; a pair is kept only in the
    stretch where its overlap begins, so none comes twice. ``width`` should be near the usual
    length. Intervals with a null or reversed end pair with nothing. Right columns get ``suffix``.
    """
    cut = lambda d: d.filter("e > s").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    r = cut(right).select(*[F.col(c).alias(c if c in by or c == "_cell" else c + suffix) for c in [*right.columns, "_cell"]])
    first, last = F.greatest("s", "s" + suffix), F.least("e", "e" + suffix)
    both = cut(left).join(r, [*by, "_cell"]).filter((last > first) & (F.floor(first / width) == F.col("_cell")))
    return both.withColumn("overlap", last - first).drop("_cell")


def best_overlap(pairs: DataFrame, by: list[str], choice: str, tolerance: float = 1e-6) -> DataFrame:
    """Per ``by`` the choice of most total overlap; ``ambiguous`` where another is within ``tolerance``."""
    total = pairs.groupBy(*by, choice).agg(F.sum("overlap").alias("overlap"))
    order = W.partitionBy(*by).orderBy(F.desc("overlap"), choice)
    rows = total.withColumn("_n", F.row_number().over(order)).withColumn("_second", F.lead("overlap").over(order)).filter("_n = 1")
    return rows.withColumn("ambiguous", F.coalesce(F.col("overlap") - F.col("_second") <= tolerance, F.lit(False))).drop("_n", "_second")


def hint_of_midpoint(segments: DataFrame, hints: DataFrame, by: list[str], width: float) -> DataFrame:
    """Each segment (s, e) with the first hint (s, e, hint_no) whose half-open range holds its midpoint; null without one."""
    middle = segments.withColumn("_m", (F.col("s") + F.col("e")) / 2).withColumn("_cell", F.floor(F.col("_m") / width))
    spread = hints.filter("e > s").select(*by, F.col("s").alias("_hs"), F.col("e").alias("_he"), "hint_no", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))).alias("_cell"))
    keys = segments.columns
    found = middle.join(spread, [*by, "_cell"]).filter((F.col("_m") >= F.col("_hs")) & (F.col("_m") < F.col("_he"))).groupBy(*keys).agg(F.min("hint_no").alias("hint_no"))
    return segments.join(found, keys, "left")


def lanes_needed(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, lanes): the greatest number of intervals open at once; an end frees its lane for an equal start.

    A sweep over +1 and -1 at the ends, summed per instant before it is ordered.
    """
    steps = df.select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("x")).groupBy(*by, "x.t").agg(F.sum("x.d").alias("d"))
    open_ = steps.withColumn("open", F.sum("d").over(W.partitionBy(*by).orderBy("t").rowsBetween(W.unboundedPreceding, 0)))
    return open_.groupBy(*by).agg(F.max("open").alias("lanes"))


def assign_lanes(df: DataFrame, by: list[str], key: str, start: str, end: str) -> DataFrame:
    """(by, key, lane): greedy first free lane in (start, end, key) order; a lane is free when its end is at or before the start.

    The state is the open lanes of one group, so a group is one task; groups are meant
    to be what one chart shows.
    """
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*by, key]], "lane int"])

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        ends: list = []
        lanes = []
        rows = rows.sort_values([start, end, key])
        for s, e in zip(rows[start], rows[end]):
            lane = next((i for i, busy in enumerate(ends) if busy <= s), len(ends))
            if lane == len(ends):
                ends.append(e)
            else:
                ends[lane] = e
            lanes.append(lane)
        return rows[[*by, key]].assign(lane=lanes)

    return df.select(*by, key, start, end).groupBy(*by).applyInPandas(place, schema)


def equal_windows(df: DataFrame, key: str, length: str, most: float = 1800.0, overlap: float = 2.0) -> DataFrame:
    """(key, window, s, e, core_s, core_e): equal windows of at most ``most`` seconds that overlap their neighbours."""
    n = F.greatest(F.lit(1), F.ceil(F.col(length) / most))
    rows = df.filter(F.col(length) > 0).select(key, F.col(length).alias("_len"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    lo, hi = F.col("window") * F.col("_len") / F.col("_n"), (F.col("window") + 1) * F.col("_len") / F.col("_n")
    return rows.select(key, "window", F.greatest(F.lit(0.0), lo - overlap).alias("s"), F.least(F.col("_len").cast("double"), hi + overlap).alias("e"), lo.alias("core_s"), hi.alias("core_e"))


def in_own_share(segments: DataFrame) -> DataFrame:
    """Segments (s, e, core_s, core_e) whose midpoint lies in their window's exclusive share, half-open."""
    middle = (F.col("s") + F.col("e")) / 2
    return segments.filter((middle >= F.col("core_s")) & (middle < F.col("core_e")))


def evenly_spaced(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """``k`` rows of each group, evenly spaced in order (all, if there are no more); positions round half to even."""
    w = W.partitionBy(*by)
    rows = df.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)
    if k == 1:
        wanted = F.array(F.lit(0).cast("bigint"))
    else:
        wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1), 0).cast("bigint"))
    return rows.filter((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i").cast("bigint"))).drop("_n", "_i")


def batches(rows: Iterator[tuple[str, int]], most: int = 4, tokens: int = 2048) -> Iterator[list[tuple[str, int]]]:
    """Micro-batches of at most ``most`` items whose padded size (items times longest) stays within ``tokens``; an oversized item goes alone."""
    held: list[tuple[str, int]] = []
    for item in rows:
        longest = max([item[1], *(n for _, n in held)])
        if held and (len(held) >= most or longest * (len(held) + 1) > tokens):
            yield held
            held = []
        held.append(item)
    if held:
        yield held
