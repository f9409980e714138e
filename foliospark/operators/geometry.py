"""Boxes on pages: overlap, bands, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def area(box: Column) -> Column:
    """Area of a box struct (x0, y0, x1, y1); a reversed box has none."""
    return F.greatest(F.lit(0.0), box["x1"] - box["x0"]) * F.greatest(F.lit(0.0), box["y1"] - box["y0"])


def shared_area(a: Column, b: Column) -> Column:
    """Area that two boxes have in common; a null box has none."""
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    # greatest and least pass over nulls, so they are asked for first.
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(wide * high)


def iou(a: Column, b: Column) -> Column:
    """Shared over united area, 0 for empty boxes."""
    shared = shared_area(a, b)
    united = area(a) + area(b) - shared
    return F.when(united > 0, shared / united).otherwise(0.0)


def coverage(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that ``outer`` covers."""
    return F.when(area(inner) > 0, shared_area(inner, outer) / area(inner)).otherwise(0.0)


def padded(box: Column, by: float) -> Column:
    """The box made larger by ``by`` on every side; null stays null."""
    return F.when(box.isNotNull(), F.struct((box["x0"] - by).alias("x0"), (box["y0"] - by).alias("y0"), (box["x1"] + by).alias("x1"), (box["y1"] + by).alias("y1")))


def envelope(box: Column) -> Column:
    """Aggregate: the least box around all boxes."""
    return F.struct(F.min(box["x0"]).alias("x0"), F.min(box["y0"]).alias("y0"), F.max(box["x1"]).alias("x1"), F.max(box["y1"]).alias("y1"))


def overlapping_pairs(blocks: DataFrame, page: list[str], key: str, box: str = "bbox", cell: float = 125.0) -> DataFrame:
    """(page, key, other, iou, coverage) of the boxes of one page that share area; ``key`` < ``other``.

    Boxes are joined by grid cells of the page, each pair only in the cell where their
    common area begins, so a page full of boxes is no product.
    """
    b = F.col(box)
    span = lambda lo, hi: F.explode(F.sequence(F.floor(b[lo] / cell), F.floor(b[hi] / cell)))
    rows = blocks.filter(b.isNotNull() & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])).select(*page, key, b.alias("a")).withColumn(box, F.col("a"))
    rows = rows.withColumn("_cx", span("x0", "x1")).withColumn("_cy", span("y0", "y1")).drop(box)
    other = rows.select(*page, F.col(key).alias("other"), F.col("a").alias("b"), "_cx", "_cy")
    both = rows.join(other, [*page, "_cx", "_cy"]).filter((F.col(key) < F.col("other")) & (shared_area(F.col("a"), F.col("b")) > 0))
    begin = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("_cx")) & (F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("_cy"))
    return both.filter(begin).select(*page, key, "other", iou(F.col("a"), F.col("b")).alias("iou"), coverage(F.col("a"), F.col("b")).alias("coverage"))


def column_bands(blocks: DataFrame, page: list[str], key: str, box: str = "bbox", gap: float = 45.0) -> DataFrame:
    """(page, key, band): boxes sorted by their left edge; a step of more than ``gap`` begins a new band. Null boxes have none."""
    w = W.partitionBy(*page).orderBy(F.col(box)["x0"], key)
    rows = blocks.filter(F.col(box).isNotNull()).withColumn("_step", F.coalesce((F.col(box)["x0"] - F.lag(F.col(box)["x0"]).over(w) > gap).cast("int"), F.lit(0)))
    return rows.withColumn("band", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1).select(*page, key, "band")


def page_groups(pages: DataFrame, book: str, page: str, starts: Column, most: int = 8) -> DataFrame:
    """(book, page, group_no): runs of following pages, cut at chapter starts and at ``most`` pages."""
    w = W.partitionBy(book).orderBy(page)
    rows = pages.withColumn("_new", (starts | F.coalesce(F.col(page) - F.lag(page).over(w) != 1, F.lit(True))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = F.row_number().over(W.partitionBy(book, "_run").orderBy(page)) - 1
    rows = rows.withColumn("_part", F.floor(inside / most))
    first = F.when(F.coalesce((F.col("_run") != F.lag("_run").over(w)) | (F.col("_part") != F.lag("_part").over(w)), F.lit(True)), 1).otherwise(0)
    return rows.withColumn("group_no", F.sum(first).over(w.rowsBetween(W.unboundedPreceding, 0))).select(book, page, "group_no")


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the least node of each connected component.

    Alternating hooking of large and small neighbours: every round rewrites the edges
    around each node's least neighbour, and takes a logarithm of the path length in
    rounds. Edges live in checkpoints, none comes to the driver.
    """
    from foliospark.session import cut_lineage

    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u is not null and v is not null and u <> v")
    pairs = cut_lineage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        following = cut_lineage(small)
        stable = following.count() == pairs.count() and following.exceptAll(pairs).isEmpty()
        pairs = following
        if stable:
            break
    else:
        raise ValueError(f"the components are not settled after {rounds} rounds")
    found = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(F.col("node")).distinct().join(found, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))
