"""Profiles of vectors: centroids, best and second-best profile, assignment over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least similarity to the medoid, to a profile, and the lead over the second profile.
CLOSE, MATCH, MARGIN = 0.65, 0.65, 0.08


def unit(vector: Column) -> Column:
    """The vector at length one, in double; null for an all-zero one."""
    x = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(norm > 0, F.transform(x, lambda v: v / norm))


def robust_centroid(vectors: np.ndarray, close: float = CLOSE) -> tuple[np.ndarray, int]:
    """(unit centroid, vectors used): the mean of what is close to the medoid.

    With one or two vectors all are used. The medoid has the greatest sum of cosines; the
    first of equals wins.
    """
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    keep = np.ones(len(x), bool)
    if len(x) > 2:
        # The sum of cosines to all others is the cosine to the sum: linear, not quadratic.
        score = np.round(x @ x.sum(0), 9)
        keep = x @ x[int(np.argmax(score))] >= close
    mean = x[keep].mean(0)
    norm = np.linalg.norm(mean)
    return (mean / norm if norm else mean), int(keep.sum())


def profiles(df: DataFrame, by: str, key: str, vector: str) -> DataFrame:
    """(by, centroid, n_used, n_all) of every profile.

    Two passes of partial sums instead of one task per profile: the medoid is the row
    closest to its profile's sum, found with an aggregate, and the centroid is the mean of
    the rows close to it. Rows without a usable vector are left out.
    """
    rows = df.select(by, key, unit(F.col(vector)).alias("_v")).filter("_v is not null")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    # Profiles join by key; the sums are one row each.
    scored = rows.join(_vector_sums(rows, by).select(by, F.col("_sum")), by).withColumn("_score", F.round(dot("_v", "_sum"), 9))
    medoid = scored.groupBy(by).agg(F.max(F.struct("_score", (-F.col(key)).alias("_k"), "_v")).alias("m"), F.count("*").alias("n_all")).select(by, F.col("m._v").alias("_m"), "n_all")
    near = rows.join(medoid, by).filter((F.col("n_all") <= 2) | (dot("_v", "_m") >= CLOSE))
    mean = _vector_sums(near.select(by, key, "_v"), by).join(medoid.select(by, "n_all"), by)
    return mean.select(by, unit(F.transform("_sum", lambda x: x / F.col("n"))).alias("centroid"), F.col("n").alias("n_used"), "n_all")


def _vector_sums(rows: DataFrame, by: str) -> DataFrame:
    """(by, _sum, n) of unit vectors ``_v``: every batch is summed by profile where it is, then the few sums by dimension."""
    kind = rows.schema[by].dataType.simpleString()

    def sums(batches):
        for batch in batches:
            if not len(batch):
                continue
            code, names = pd.factorize(batch[by], use_na_sentinel=False)
            x = np.stack(batch["_v"].to_list()).astype(np.float64)
            total = np.zeros((len(names), x.shape[1]))
            np.add.at(total, code, x)
            yield pd.DataFrame({by: names, "_part": list(total), "n": np.bincount(code, minlength=len(names))})

    parts = rows.select(by, "_v").mapInPandas(sums, f"{by} {kind}, _part array<double>, n bigint")
    flat = parts.select(by, "n", F.posexplode("_part").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    held = flat.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_s"), F.max("n").alias("n"))
    return held.select(by, F.transform("_s", lambda e: e["x"]).alias("_sum"), "n")


def sample_similarity(new: DataFrame, known: DataFrame, group: str, by: str, vector: str) -> DataFrame:
    """(group, by, score): how like a group's new samples a profile is, the mean over the samples of the best cosine to one of its retained samples.

    ``new``: group, vector; ``known``: by, vector. A profile of two kinds of samples is matched by
    either, which its centroid would not be. Retained samples are a stated set, checked to be at
    most 100,000, and go to the tasks; samples without a usable vector are left out.
    """
    held = known.select(by, unit(F.col(vector)).alias("_v")).filter("_v is not null").limit(100_001).collect()
    if len(held) > 100_000:
        raise ValueError("more retained samples than one call compares")
    names = sorted({r[0] for r in held})
    held = sorted(held, key=lambda r: r[0])
    matrix = np.array([r[1] for r in held], np.float64) if held else np.zeros((0, 1))
    starts = np.searchsorted([r[0] for r in held], names) if names else np.zeros(0, int)
    kind = known.schema[by].dataType.simpleString()

    def score(batches):
        for batch in batches:
            if not len(batch) or not names:
                continue
            like = np.stack(batch["_v"].to_list()).astype(np.float64) @ matrix.T
            best = np.round(np.maximum.reduceat(like, starts, axis=1), 9)
            yield pd.DataFrame({group: np.repeat(batch[group].to_numpy(), len(names)), by: names * len(batch), "_s": best.ravel()})

    rows = new.select(group, unit(F.col(vector)).alias("_v")).filter("_v is not null")
    out = rows.mapInPandas(score, f"{group} {new.schema[group].dataType.simpleString()}, {by} {kind}, _s double")
    return out.groupBy(group, by).agg(F.round(F.avg("_s"), 9).alias("score"))


def assign_one_to_one(scores: DataFrame, groups: DataFrame, window: str, local: str, by: str, least: float = MATCH, margin: float = MARGIN) -> DataFrame:
    """(window, local, by, decision, reason, best, best_score, second_score): profiles given to the local speakers of each window, none twice.

    ``scores``: window, local, by, score; ``groups``: window, local, n_samples, every local speaker. A
    speaker whose best profile reaches ``least`` and leads by ``margin`` is eligible; the best
    score of a profile gets it, ties by the later name. The others are new, with the reason.
    """
    order = W.partitionBy(window, local).orderBy(F.desc("score"), F.desc(by))
    top = scores.withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
    two = top.groupBy(window, local).agg(F.max(F.when(F.col("_n") == 1, F.struct(by, "score"))).alias("a"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("second_score"))
    rows = groups.select(window, local, "n_samples").join(two, [window, local], "left").select(window, local, "n_samples", F.col(f"a.{by}").alias("best"), F.col("a.score").alias("best_score"), "second_score")
    lead = F.col("best_score") - F.col("second_score")
    eligible = (F.col("best_score") >= least) & (lead.isNull() | (lead >= margin))
    # Each is eligible for its best profile alone, so the greedy order is the order inside a profile.
    place = F.row_number().over(W.partitionBy(window, "best", "_e").orderBy(F.desc("best_score"), F.desc(local)))
    rows = rows.withColumn("_e", F.coalesce(eligible, F.lit(False))).withColumn("_p", place).withColumn("_ok", F.col("_e") & (F.col("_p") == 1))
    reason = (
        F.when(F.col("_ok"), F.lit("threshold_and_margin_met")).when(F.coalesce("n_samples", F.lit(0)) == 0, F.lit("no_clean_embedding")).when(F.col("best_score").isNull(), F.lit("no_existing_profile"))
        .when(F.col("best_score") < least, F.lit("below_similarity_threshold")).when(lead < margin, F.lit("ambiguous_margin")).otherwise(F.lit("one_to_one_conflict"))
    )
    return rows.select(window, local, F.when(F.col("_ok"), F.col("best")).alias(by), F.when(F.col("_ok"), F.lit("matched")).otherwise(F.lit("new")).alias("decision"), reason.alias("reason"), "best", "best_score", "second_score")


def best_two(df: DataFrame, key: str, vector: str, centroids: DataFrame, by: str, least: float = MATCH, margin: float = MARGIN) -> DataFrame:
    """(key, best, score, second, lead, matched): the two nearest of a few profiles.

    ``centroids`` must be a stated, small set: it is checked to be at most 10,000 rows and
    goes to the tasks in one matrix.
    """
    rows = centroids.select(by, "centroid").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more profiles than one call compares")
    rows = sorted(rows, key=lambda r: r[0])
    names = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], np.float64) if rows else np.zeros((0, 1))
    kind = centroids.schema[by].dataType.simpleString()

    def score(batches):
        for batch in batches:
            if not len(batch) or not names:
                continue
            x = np.stack(batch["_v"].to_list()).astype(np.float64)
            like = np.round(x @ matrix.T, 9)
            order = np.argsort(-like, axis=1, kind="stable")[:, :2]
            first = np.take_along_axis(like, order[:, :1], 1)[:, 0]
            second = np.take_along_axis(like, order[:, 1:2], 1)[:, 0] if len(names) > 1 else np.full(len(x), np.nan)
            yield pd.DataFrame({key: batch[key].to_numpy(), "best": [names[i] for i in order[:, 0]], "score": first, "second": [names[i] for i in order[:, 1]] if len(names) > 1 else None, "lead": first - second})

    out = df.select(key, unit(F.col(vector)).alias("_v")).filter("_v is not null").mapInPandas(score, f"{key} {df.schema[key].dataType.simpleString()}, best {kind}, score double, second {kind}, lead double")
    clear = F.col("lead").isNull() | F.isnan("lead") | (F.col("lead") >= margin)
    return out.withColumn("matched", (F.col("score") >= least) & clear)


def assign_runs(df: DataFrame, track: str, order: str, label: str, vector: str, least: float = MATCH, margin: float = MARGIN) -> DataFrame:
    """(track, order, identity, reason): each run's identity, in order, per track.

    A run takes the profile it matches clearly; else what its label was last given;
    else a new profile. The state is the profiles seen so far, so a track is one task.
    """
    schema = f"{track} {df.schema[track].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, identity string, reason string"

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        # The mean cosine to a profile's samples is the product with their mean: one sum and count each.
        sums: list[np.ndarray | None] = []
        counts: list[int] = []
        last: dict = {}
        out = []
        rows = rows.sort_values(order)
        for t, o, named, v in zip(rows[track], rows[order], rows[label], rows[vector]):
            x = None if v is None or len(v) == 0 else np.asarray(v, float)
            norm = 0 if x is None else np.linalg.norm(x)
            who, reason = None, "no voice"
            if norm:
                x = x / norm
                scores = [float(x @ s) / n if n else -np.inf for s, n in zip(sums, counts)]
                ranked = sorted(range(len(scores)), key=lambda i: -scores[i])
                if ranked and scores[ranked[0]] >= least and (len(ranked) == 1 or scores[ranked[0]] - scores[ranked[1]] >= margin):
                    who, reason = ranked[0], "matched"
            if who is None:
                if named in last:
                    who, reason = last[named], "label"
                else:
                    sums.append(None)
                    counts.append(0)
                    who, reason = len(sums) - 1, "new"
            if norm:
                sums[who], counts[who] = x if sums[who] is None else sums[who] + x, counts[who] + 1
            last[named] = who
            out.append((t, o, f"S{who + 1:02d}", reason))
        return pd.DataFrame(out, columns=[track, order, "identity", "reason"])

    return df.select(track, order, label, vector).groupBy(track).applyInPandas(assign, schema)
