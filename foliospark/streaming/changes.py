"""Change feeds and incremental upkeep on micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.sinks import Snapshots


def coalesced(batch: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key only the newest version in a batch."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")


def deduplicated(stream: DataFrame, key: list[str], time: str, wait: str = "1 hour") -> DataFrame:
    """A stream without repeated keys, as long as repeats come within ``wait``; later state is dropped."""
    return stream.withWatermark(time, wait).dropDuplicatesWithinWatermark(key)


def live_workers(stream: DataFrame, key: str, time: str, alive: str = "60 seconds") -> DataFrame:
    """Last sighting of every worker per window of ``alive``; later events than a window's wait are dropped."""
    return stream.withWatermark(time, alive).groupBy(F.window(time, alive), key).agg(F.max(time).alias("last_seen"))


def keep_index(snapshots: Snapshots, key: str, build: Callable[[DataFrame], DataFrame], version: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds changed rows into the newest snapshot.

    Rows are built only for what changed; the new snapshot is refused if another was
    committed meanwhile, and the batch then fails and is run again.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        ids = snapshots.ids()
        changed = build(coalesced(batch, key, version))
        if ids:
            kept = snapshots.read(ids[-1]).join(changed.select(key), key, "left_anti")
            changed = kept.unionByName(changed)
        snapshots.commit(changed, ids[-1] if ids else 0)

    return fold
