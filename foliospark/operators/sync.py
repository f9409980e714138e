"""Snapshots compared, guarded, merged and carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*columns: str) -> Column:
    """SHA-256 over the JSON of the named columns; nulls and names count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def diff(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, change): created, updated, unchanged or deleted, by one full outer join on the key and hashes only."""
    a = old.select(F.col(key).alias("_ok"), fingerprint(*compared).alias("_oh"))
    b = new.select(F.col(key).alias("_nk"), fingerprint(*compared).alias("_nh"))
    change = F.when(F.col("_ok").isNull(), "created").when(F.col("_nk").isNull(), "deleted").when(F.col("_oh") == F.col("_nh"), "unchanged").otherwise("updated")
    return a.join(b, F.col("_ok") == F.col("_nk"), "full_outer").select(F.coalesce("_nk", "_ok").alias(key), change.alias("change"))


def change_counts(changes: DataFrame, *by: str) -> DataFrame:
    """Created, updated, unchanged and deleted rows, and ``refused``: whether the deletions are too many to be meant.

    Too many: all rows, more than 10, or, of four rows or more, over a quarter rounded up.
    """
    counts = changes.groupBy(*by).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("created", "updated", "unchanged", "deleted")])
    existing = F.col("updated") + F.col("unchanged") + F.col("deleted")
    many = (F.col("deleted") == existing) | (F.col("deleted") > 10) | ((existing >= 4) & (F.col("deleted") > F.ceil(existing * 0.25)))
    return counts.withColumn("refused", (F.col("deleted") > 0) & many)


def carry_on(old: DataFrame, new: DataFrame, key: str, revision: str, kept: str) -> DataFrame:
    """The new rows; ``kept`` (the time of first import) is the old row's where the revision is unchanged."""
    a = old.select(F.col(key).alias("_ok"), F.col(revision).alias("_or"), F.col(kept).alias("_oi"))
    same = F.col("_or").eqNullSafe(F.col(revision)) & F.col("_ok").isNotNull()
    return new.join(a, F.col(key) == F.col("_ok"), "left").withColumn(kept, F.when(same, F.col("_oi")).otherwise(F.col(kept))).drop("_ok", "_or", "_oi")


def work_list(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet: rows of ``wanted`` whose keys and fingerprint ``done`` doesn't have."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def merge_three(base: DataFrame, local: DataFrame, server: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, outcome) of a three-way merge of whole rows.

    Outcomes: same, local, server (the side that changed), deleted, conflict (both
    changed differently; the local value is given). A null value is a value.
    """
    side = lambda d, n: d.select(F.col(key).alias(f"_{n}k"), F.struct(F.col(value).alias("v")).alias(f"_{n}v"))
    joined = side(base, "b").join(side(local, "l"), F.col("_bk") == F.col("_lk"), "full_outer").withColumn("_k", F.coalesce("_bk", "_lk"))
    joined = joined.join(side(server, "s"), F.col("_k") == F.col("_sk"), "full_outer")
    b, lo, s = F.col("_bv"), F.col("_lv"), F.col("_sv")
    chosen = F.when(lo.eqNullSafe(s), lo).when(lo.eqNullSafe(b), s).otherwise(lo)
    outcome = F.when(lo.eqNullSafe(s), F.when(lo.isNull(), "deleted").otherwise("same")).when(lo.eqNullSafe(b), F.when(s.isNull(), "deleted").otherwise("server")).when(s.eqNullSafe(b), F.when(lo.isNull(), "deleted").otherwise("local")).otherwise("conflict")
    return joined.select(F.coalesce("_k", "_sk").alias(key), chosen["v"].alias(value), outcome.alias("outcome"))


def latest_by_job(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by partial aggregation instead of a sort."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
