"""Continuous periods and gaps of overlapping intervals per entity.

The rule is the running maximum: sorted by start, an interval opens a new period
when it starts after the greatest end seen so far. One entity may hold a third of
all rows, so no entity is ever sorted in one task. Every entity's span is cut into
``buckets`` equal stretches; rows are sorted inside (entity, bucket) only, the
greatest end of the earlier buckets comes in as one number per bucket, and the
next period's predecessor end comes back the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1024


def _same(keys: list[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for key in keys:
        on = on & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return on


def _scan(intervals: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Intervals as (keys, _s, _e, _lo, _hi) with ``_before``, the greatest end of all rows that start earlier (null for the first)."""
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    # Equal starts are joined before any shuffle: of many rows with one start only the longest matters.
    rows = intervals.groupBy(*keys, "_lo", "_hi", "_s").agg(F.max("_e").alias("_e"))
    rows = rows.withColumn("_b", F.least(F.lit(buckets - 1), F.floor((F.col("_s") - F.col("_lo")) / width * buckets)).cast("int"))
    per = rows.groupBy(*keys, "_b").agg(F.max("_e").alias("_top"))
    carry = per.withColumn("_carry", F.max("_top").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    inside = W.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("_inner", F.max("_e").over(inside))
    joined = local.alias("a").join(carry.alias("c"), _same([*keys, "_b"], "a", "c"), "left")
    return joined.select("a.*", F.greatest("_carry", "_inner").alias("_before"))


def _prepared(df: DataFrame, keys: list[str], start: str, end: str, lower: str | None, upper: str | None) -> DataFrame:
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    rows = df.filter(s.isNotNull() & e.isNotNull() & (e > s))
    if lower is None or upper is None:
        span = rows.groupBy(*keys).agg(F.min(s).alias("_lo"), F.max(e).alias("_hi"))
        rows = rows.select(*keys, s.alias("_s"), e.alias("_e")).alias("a").join(span.alias("c"), _same(keys, "a", "c")).select("a.*", "c._lo", "c._hi")
    else:
        lo, hi = F.col(lower).cast("bigint"), F.col(upper).cast("bigint")
        rows = rows.select(*keys, F.greatest(s, lo).alias("_s"), F.least(e, hi).alias("_e"), lo.alias("_lo"), hi.alias("_hi"))
        rows = rows.filter(F.col("_lo").isNotNull() & F.col("_hi").isNotNull() & (F.col("_e") > F.col("_s")))
    return rows


def interval_gaps(df: DataFrame, keys: list[str], start: str, end: str, lower: str | None = None, upper: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Longest stretches that no interval of the entity covers: (keys, gap_start, gap_end), half-open.

    ``start`` and ``end`` are integers (for times: microseconds). With ``lower`` and
    ``upper`` intervals are clipped to these bounds and the stretches before the
    first and after the last interval count as gaps; without them only gaps between
    intervals do. Rows with a null or not positive length, or outside the bounds,
    don't count; an entity left without rows has no gaps; touching intervals leave
    none. Null keys form one entity. Other columns are dropped, repeats and ties
    change nothing, an empty table gives an empty table.
    """
    rows = _scan(_prepared(df, keys, start, end, lower, upper), keys, buckets)
    between = rows.filter(F.coalesce("_before", "_lo") < F.col("_s")).select(*keys, F.coalesce("_before", "_lo").alias("gap_start"), F.col("_s").alias("gap_end"))
    if lower is None or upper is None:
        return between
    last = rows.groupBy(*keys).agg(F.max("_e").alias("gap_start"), F.max("_hi").alias("gap_end")).filter("gap_start < gap_end")
    return between.unionByName(last)


def interval_periods(df: DataFrame, keys: list[str], start: str, end: str, lower: str | None = None, upper: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Continuous periods per entity: (keys, period_start, period_end), with the rules of :func:`interval_gaps`."""
    rows = _scan(_prepared(df, keys, start, end, lower, upper), keys, buckets)
    total = rows.groupBy(*keys).agg(F.max("_e").alias("_end"))
    opens = rows.filter(F.col("_before").isNull() | (F.col("_before") < F.col("_s"))).select(*keys, "_b", "_s", "_before")
    # A period ends where its successor found the greatest end before it.
    first = opens.groupBy(*keys, "_b").agg(F.min_by("_before", "_s").alias("_first"))
    ahead = first.withColumn("_next", F.lead("_first").over(W.partitionBy(*keys).orderBy("_b"))).drop("_first")
    local = opens.withColumn("_lead", F.lead("_before").over(W.partitionBy(*keys, "_b").orderBy("_s")))
    out = local.alias("a").join(ahead.alias("c"), _same([*keys, "_b"], "a", "c"), "left").select("a.*", "c._next")
    out = out.alias("a").join(total.alias("c"), _same(keys, "a", "c")).select("a.*", "c._end")
    return out.select(*keys, F.col("_s").alias("period_start"), F.coalesce("_lead", "_next", "_end").alias("period_end"))
