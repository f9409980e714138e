"""Walks over listings of remote stores: folders with shortcuts, page trees, numbered result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.session import cut_lineage


def walk(items: DataFrame, roots: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, depth): everything reachable from the roots, each once, at its least depth.

    ``items``: id, parent, kind, target; ``roots``: id. A ``shortcut`` leads to its target wherever
    that lies, and isn't itself listed; one whose target isn't there leads nowhere. What was
    seen isn't entered again, so cycles end. One join a level: neither the listing nor what
    was seen comes to the driver. More than ``rounds`` levels are an error.
    """
    held = items.filter("id is not null").select("id", "parent", "kind", "target").distinct()
    known = held.filter("kind != 'shortcut'").select(F.col("id").alias("_t")).distinct()
    links = held.filter("kind = 'shortcut'").join(known, F.col("target") == F.col("_t"), "left_semi").select("parent", F.col("target").alias("id"))
    inside = held.filter("kind != 'shortcut'").select("parent", "id").unionByName(links).filter("parent is not null").distinct()
    seen = frontier = cut_lineage(roots.select("id").filter("id is not null").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, rounds + 1):
        below = inside.join(frontier.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").distinct()
        frontier = cut_lineage(below.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"the listing is deeper than {rounds} levels")


def whole_listings(pages: DataFrame, by: list[str]) -> DataFrame:
    """(by, item): the items of listings that came in numbered pages (by, revision, page_no, last, items).

    Only a listing read whole at one revision counts: pages 1 to the last without a gap. Of
    several whole revisions the newest counts; a listing that changed while it was read and
    was never whole has no rows and must be asked for again. Pages sent twice count once.
    """
    once = pages.filter("page_no is not null").groupBy(*by, "revision", "page_no").agg(F.max("last").alias("last"), F.first("items").alias("items"))
    whole = once.groupBy(*by, "revision").agg(F.count("*").alias("n"), F.max("page_no").alias("top"), F.min("page_no").alias("low"), F.max(F.when(F.col("last"), F.col("page_no"))).alias("end")).filter("low = 1 and n = top and end = top")
    newest = whole.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("revision")))).filter("_n = 1").select(*by, "revision")
    return once.join(newest, [*by, "revision"]).select(*by, F.explode("items").alias("item")).distinct()
