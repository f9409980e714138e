"""Views over documents: collections, tables, boards and schedules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def collection(documents: DataFrame, key: str, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows chosen by a trusted function, checked: known keys only and none twice.

    The check is part of the plan: a wrong choice fails when the result is read.
    """
    chosen = choose(documents)
    counts = chosen.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).join(documents.select(F.col(key).alias("_d")).distinct(), F.col("_k") == F.col("_d"), "left")
    ok = counts.filter(F.assert_true((F.col("_n") == 1) & F.col("_d").isNotNull(), F.lit("a collection must return known documents, each once")).isNull()).select(F.col("_k").alias(key))
    return chosen.join(ok, key)


def board(rows: DataFrame, lane: str, order: list[Column]) -> DataFrame:
    """Rows with ``lane`` (null as Unassigned), ``lane_no`` with Unassigned last, and ``position`` inside the lane."""
    named = rows.withColumn(lane, F.coalesce(F.col(lane).cast("string"), F.lit("Unassigned")))
    lanes = named.select(lane).distinct().withColumn("lane_no", F.row_number().over(W.orderBy(F.col(lane) == "Unassigned", lane)))
    return named.join(lanes, lane).withColumn("position", F.row_number().over(W.partitionBy(lane).orderBy(*order)))


def schedule(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with ``start_day``, ``end_day`` (exclusive: the day after the inclusive end) and ``scheduled``.

    Dates are calendar days ``yyyy-MM-dd``; an unreadable or reversed pair is not scheduled.
    """
    shape = r"^\d{4}-\d{2}-\d{2}$"
    day = lambda c: F.when(F.col(c).rlike(shape), F.try_to_date(c, "yyyy-MM-dd"))
    out = rows.withColumn("start_day", day(start)).withColumn("_last", day(end))
    good = F.col("start_day").isNotNull() & F.col("_last").isNotNull() & (F.col("_last") >= F.col("start_day"))
    return out.withColumn("end_day", F.when(good, F.date_add("_last", 1))).withColumn("scheduled", F.coalesce(good, F.lit(False))).drop("_last")


def dependencies(rows: DataFrame, key: str, needs: str) -> DataFrame:
    """(key, need, state): ok, missing or self of each distinct need."""
    spread = rows.select(F.col(key).alias("_k"), F.explode(F.array_distinct(needs)).alias("need"))
    known = rows.select(F.col(key).alias("_known")).distinct()
    state = F.when(F.col("need") == F.col("_k"), "self").when(F.col("_known").isNull(), "missing").otherwise("ok")
    return spread.join(known, F.col("need") == F.col("_known"), "left").select(F.col("_k").alias(key), "need", state.alias("state"))


def moved_dates(start: Column, end: Column, by_start: Column, by_end: Column) -> tuple[Column, Column]:
    """A schedule moved or resized by whole days, at least one day long (inclusive end)."""
    first = F.date_add(start, by_start)
    return first, F.greatest(first, F.date_add(end, by_end))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place from 1 in ``order``, nulls last.

    Rows are cut into ranges of the order; each range is numbered on its own and carries
    on from the rows before it, so no task sorts the whole. The ranges are drawn from a
    sample, so they are kept in a checkpoint. Rows equal in all of ``order`` share a range.
    """
    from foliospark.session import cut_lineage

    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.select("*", *[c.alias(k) for c, k in zip(order, keys)])
    by = [F.col(k).asc_nulls_last() for k in keys]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(rows.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()))
    # One row a range.
    before = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(W.partitionBy("_range").orderBy(*by)))
    return own.join(before, "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before", *keys)
