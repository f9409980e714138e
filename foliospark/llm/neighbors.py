"""The most similar vectors of each vector, by learned partitions.

Vectors are compared only inside a space (namespace, recipe, dimensions). Exact
copies are searched once, by a representative of their class. A router fitted on a
bounded sample of each space (see :mod:`foliospark.llm.partitions`) puts every
representative into one part and sends every query to its most probable parts; the
parts are scanned exactly. The number of parts grows with the space, by a second level
of routers where one is not enough; how many of them a query is sent to is chosen on
rows the fit has not seen. A part too large for one task is cut into blocks of data
and of queries, and every block of the one meets every block of the other, so
nothing is left out of a hot part.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.partitions import GRAPH_K, Router, fit_router
from foliospark.session import cut_lineage

SPACE = ["space_namespace", "recipe", "dimensions"]
#: Vectors of each space, and of each part of the first level, in a fit; rows a part should hold; most parts of one router.
FIT, PART, MOST_PARTS = 12_000, 2_000, 600
#: Rows of the sample held out of the fit, and most parts a query may be sent to.
HELD, MOST_PROBES = 1_000, 256
#: Rows of data and of queries that meet in one task.
DATA_BLOCK, QUERY_BLOCK = 8_192, 32_768
#: Spaces the driver will fit routers for.
MOST_SPACES = 200
#: Share of the held-out rows' neighbours, and of the pairs at the limit of a pair search, the probed parts must hold.
RECALL, PAIR_RECALL = 0.93, 0.999


class Space(NamedTuple):
    """One space: its router and the expected rows of each part."""

    names: tuple
    router: Router
    probes: int
    data_blocks: np.ndarray
    query_blocks: np.ndarray


def usable(df: DataFrame) -> DataFrame:
    """Rows whose vector has ``dimensions`` finite components, not all zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter((F.size("vector") == F.col("dimensions")) & finite & F.exists("vector", lambda x: x != 0))


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _pack(df: DataFrame, key: str, spaces: dict[tuple, int]) -> DataFrame:
    """(space, id, class_key, unit) of usable rows whose space is known."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for names, rows in batch.groupby(SPACE, dropna=False):
                names = tuple(None if pd.isna(v) else v for v in names)
                if names not in spaces:
                    continue
                units = [u.tobytes() for u in _units(rows["vector"])]
                keys = [hashlib.blake2b(u, digest_size=16).digest() for u in units]
                yield pd.DataFrame({"space": spaces[names], "id": rows["_id"].to_numpy(), "class_key": keys, "unit": units})

    rows = usable(df).filter(F.col(key).isNotNull()).select(F.col(key).alias("_id"), *SPACE, "vector")
    return rows.mapInPandas(pack, "space int, id bigint, class_key binary, unit binary")


def _spaces(df: DataFrame) -> dict[tuple, int]:
    rows = df.select(*SPACE).distinct().limit(MOST_SPACES + 1).collect()
    if len(rows) > MOST_SPACES:
        raise ValueError("more spaces than one call serves; filter by namespace")
    return {tuple(r): i for i, r in enumerate(sorted(rows, key=str))}


class Index(NamedTuple):
    """Representatives (space, id, unit), members (rep, id) and the fitted spaces."""

    representatives: DataFrame
    members: DataFrame
    names: dict[tuple, int]
    spaces: dict[int, Space]


def _sampled(rows: DataFrame, share: Column | float) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)


def build_index(records: DataFrame, query_share: float = 1.0, recall: float = RECALL, least: float | None = None) -> Index:
    """Index every usable row of ``records`` (vec_id, space columns, vector).

    Rows with a null id or an unusable vector are left out; rows that repeat an id with
    the same vector count once. ``query_share`` is the number of queries per row, from
    which blocks are sized. The number of parts searched is the least that holds
    ``recall`` of the neighbours of rows held out of the fit; with ``least``, of pairs of
    that similarity, either of which may find the other.
    """
    names = _spaces(records)
    packed = _pack(records, "vec_id", names)
    classes = cut_lineage(packed.groupBy("space", "class_key").agg(F.min("id").alias("id"), F.first("unit").alias("unit")))
    members = packed.select("space", "class_key", "id").distinct().join(classes.select("space", "class_key", F.col("id").alias("rep")), ["space", "class_key"]).select("rep", "id")
    sizes = {r[0]: r[1] for r in classes.groupBy("space").count().collect()}
    spaces = {}
    for key, no in names.items():
        n = sizes.get(no, 0)
        if not n:
            continue
        if n <= PART:
            spaces[no] = Space(key, Router(None, None, 1), 1, np.array([max(1, -(-n // DATA_BLOCK))]), np.array([max(1, round(n * query_share / QUERY_BLOCK))]))
            continue
        rows = classes.filter(F.col("space") == no)
        # About FIT rows by hash; the limit only guards the driver.
        sample = np.stack([np.frombuffer(r[0], np.float32) for r in _sampled(rows, FIT / n).orderBy(F.xxhash64("id")).select("unit").limit(2 * FIT).collect()])
        held, fit = np.split(sample, [min(HELD, len(sample) // 5)])
        parts = -(-n // PART)
        router = fit_router(fit, min(MOST_PARTS, parts))
        counts = np.bincount(router.rank(fit, 1)[:, 0], minlength=router.parts) * (n / len(fit))
        if parts > router.parts:
            router, counts = _grown(router, counts, rows)
        probes = _probes(router, held, fit, recall, least)
        data = np.maximum(1, np.ceil(counts / DATA_BLOCK)).astype(int)
        asked = np.maximum(1, np.ceil(counts * probes * query_share * 1.5 / QUERY_BLOCK)).astype(int)
        spaces[no] = Space(key, router, probes, data, asked)
    return Index(classes.select("space", "id", "unit"), members, names, spaces)


def _grown(router: Router, counts: np.ndarray, rows: DataFrame) -> tuple[Router, np.ndarray]:
    """The router with children fitted in parallel, each on about ``FIT`` rows of its part, and the expected rows of the new parts."""
    shared = rows.sparkSession.sparkContext.broadcast((router, counts))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sizes = shared.value
        share = np.minimum(1.0, FIT / np.maximum(sizes, 1))
        for batch in batches:
            if len(batch):
                part = own.rank(np.frombuffer(b"".join(batch["unit"]), np.float32).reshape(len(batch), -1), 1)[:, 0]
                keep = batch["_h"].to_numpy() < share[part]
                yield pd.DataFrame({"part": part[keep], "unit": batch["unit"].to_numpy()[keep]})

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        x = np.frombuffer(b"".join(group["unit"]), np.float32).reshape(len(group), -1)
        child = fit_router(x, min(MOST_PARTS, max(1, round(float(shared.value[1][part]) / PART))))
        held = np.bincount(child.rank(x, 1)[:, 0], minlength=child.parts) * (float(shared.value[1][part]) / len(x))
        return pd.DataFrame({"part": [part], "fitted": [pickle.dumps((child, held))]})

    chosen = rows.select("unit", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) / 1_000_000).alias("_h")).mapInPandas(place, "part bigint, unit binary")
    # One row per part of the first level, of weights: at most MOST_PARTS rows.
    fitted = {r[0]: pickle.loads(r[1]) for r in chosen.groupBy("part").applyInPandas(fit, "part bigint, fitted binary").collect()}
    alone = (Router(None, None, 1), np.array([1.0]))
    kept = [fitted.get(p, alone) for p in range(router.parts)]
    return router._replace(children=tuple(c for c, _ in kept)), np.concatenate([h for _, h in kept])


def _places(ranked: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Where ``home`` stands in each row of ``ranked``, its width if nowhere."""
    hit = ranked == home[:, None]
    return np.where(hit.any(1), hit.argmax(1), ranked.shape[1])


def _probes(router: Router, held: np.ndarray, data: np.ndarray, recall: float, least: float | None) -> int:
    most = min(router.parts, MOST_PROBES)
    ranked, home = router.rank(held, most), router.rank(data, 1)[:, 0]
    like = held @ data.T
    if least is None:
        near = np.argpartition(-like, min(GRAPH_K, len(data)) - 1, axis=1)[:, :GRAPH_K]
        place = np.concatenate([_places(ranked, home[near[:, k]]) for k in range(near.shape[1])])
    else:
        # Pairs exactly at the limit, in random directions, and those the sample holds.
        aside = np.random.default_rng(5).standard_normal(held.shape).astype(np.float32)
        aside -= (aside * held).sum(1, keepdims=True) * held
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        other = least * held + (1 - least * least) ** 0.5 * aside
        back = router.rank(other, most)
        place = np.minimum(_places(ranked, back[:, 0]), _places(back, ranked[:, 0]))
        a, b = np.nonzero(like >= least)
        if len(a):
            place = np.concatenate([place, np.minimum(_places(ranked[a], home[b]), _places(router.rank(data[b], most), ranked[a, 0]))])
        recall = PAIR_RECALL
    return int(min(most, np.quantile(place, recall, method="higher") + 1))


_ROUTED = "space int, part int, data_block int, query_block int, query boolean, id bigint, unit binary"


def _route(index: Index, rows: DataFrame, query: bool, home: bool = True) -> DataFrame:
    """Rows by the parts they go to; without ``home`` not to their own part, if its data are one block."""
    spaces = rows.sparkSession.sparkContext.broadcast(index.spaces)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for no, part in batch.groupby("space"):
                space = spaces.value.get(int(no))
                if space is None:
                    continue
                x = np.frombuffer(b"".join(part["unit"]), np.float32).reshape(len(part), -1)
                ids, units = part["id"].to_numpy(), part["unit"].to_numpy()
                place = space.router.rank(x, space.probes if query else 1)
                at = np.repeat(np.arange(len(part)), place.shape[1])
                to = place.ravel()
                if not home:
                    away = (np.tile(np.arange(place.shape[1]), len(part)) > 0) | (space.data_blocks[to] > 1)
                    at, to = at[away], to[away]
                own = (space.query_blocks if query else space.data_blocks)[to]
                other = (space.data_blocks if query else space.query_blocks)[to]
                mine = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % own
                again = np.repeat(np.arange(len(at)), other)
                block = np.arange(len(again)) - np.repeat(np.cumsum(other) - other, other)
                at, to, mine = at[again], to[again], mine[again]
                yield pd.DataFrame({"space": int(no), "part": to, "data_block": block if query else mine, "query_block": mine if query else block, "query": query, "id": ids[at], "unit": units[at]})

    return rows.mapInPandas(route, _ROUTED)


_CANDIDATES = "id bigint, rep bigint, similarity double"


def search(index: Index, queries: DataFrame, k: int | None, least: float = -1.0, same_ids: bool = False) -> DataFrame:
    """(id, rep, similarity): for each query (space, id, unit) its k best representatives of similarity ``least`` or more, all of them if k is None.

    With ``same_ids`` the queries are all the representatives and don't find themselves.
    Ties in similarity go to the smaller id.
    """
    if k is not None and k < 1 or k is None and least <= -1:
        raise ValueError("k must be positive, or all of at least a similarity asked for")
    both = _route(index, index.representatives, False).unionByName(_route(index, queries, True, not same_ids))
    spaces = queries.sparkSession.sparkContext.broadcast(index.spaces)

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["query"].to_numpy(bool)
        out = []
        # The representatives of a part that is one block ask where they are; they aren't sent twice.
        first = rows.iloc[0]
        inside = same_ids and first["query_block"] == 0 and spaces.value[int(first["space"])].data_blocks[int(first["part"])] == 1
        if (inside or asks.any()) and not asks.all():
            matrix = np.frombuffer(b"".join(rows["unit"]), np.float32).reshape(len(rows), -1)
            ids = rows["id"].to_numpy()
            data, data_ids = matrix[~asks], ids[~asks]
            order = np.argsort(data_ids)
            data, data_ids = data[order], data_ids[order]
            wanted, query_ids = matrix[asks | inside], ids[asks | inside]
            for a in range(0, len(wanted), 1024):
                like = wanted[a : a + 1024] @ data.T
                mine = query_ids[a : a + 1024]
                if same_ids:
                    place = np.minimum(np.searchsorted(data_ids, mine), len(data_ids) - 1)
                    hit = data_ids[place] == mine
                    like[np.flatnonzero(hit), place[hit]] = -np.inf
                top = min(k or 1, like.shape[1])
                if least > -1:
                    # Few pass a high limit: take them all, the merge cuts at k.
                    r, c = np.nonzero(like >= least)
                else:
                    c = np.argpartition(-like, top - 1, axis=1)[:, :top].ravel()
                    r = np.repeat(np.arange(len(mine)), top)
                value = like[r, c]
                keep = np.isfinite(value)
                out.append(pd.DataFrame({"id": mine[r[keep]], "rep": data_ids[c[keep]], "similarity": value[keep].astype(np.float64)}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "rep": [], "similarity": []})

    found = both.groupBy("space", "part", "data_block", "query_block").applyInPandas(scan, _CANDIDATES)
    if k is None:
        return found
    order = W.partitionBy("id").orderBy(F.desc("similarity"), "rep")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def similar_classes(records: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Links (rep_a, rep_b), rep_a < rep_b, between classes of exact copies of similarity ``least`` or more, and members (rep, id).

    A class is named by its smallest id. No number of partners is set: every link that
    the searched parts hold is kept, and a class of copies is one name, not all its pairs.
    """
    index = build_index(records, least=least)
    found = search(index, index.representatives, None, least, same_ids=True)
    return found.select(F.least("id", "rep").alias("rep_a"), F.greatest("id", "rep").alias("rep_b")).distinct(), index.members


def similar_pairs(records: DataFrame, least: float) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of different usable vectors of one space with cosine similarity of ``least`` or more.

    The links of :func:`similar_classes` written out for their members, and the copies
    of each class with each other: only for tables in which copies are few.
    """
    links, members = similar_classes(records, least)
    left = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    right = members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    pairs = links.join(left, "rep_a").join(right, "rep_b").select("x", "y")
    # Classes of one, nearly all, leave before the join.
    several = members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep")
    copies = members.join(several, "rep").select("rep", F.col("id").alias("x"))
    copies = copies.join(copies.select("rep", F.col("x").alias("y")), "rep").filter("x < y").select("x", "y")
    return pairs.unionByName(copies).select(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b")).distinct()


def _members_up_to(index: Index, k: int) -> DataFrame:
    order = W.partitionBy("rep").orderBy("id")
    return index.members.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).select("rep", F.col("id").alias("vec_id"))


def nearest(records: DataFrame, k: int, every: int = 20) -> DataFrame:
    """(vec_id, rank, neighbor_id, similarity): the k most similar other vectors of every row whose id is divisible by ``every``."""
    index = build_index(records, query_share=1 / every)
    asked = _pack(records.filter(F.col("vec_id") % every == 0), "vec_id", index.names).select("space", "id", "unit").dropDuplicates(["id"])
    found = search(index, asked, k + 1).join(_members_up_to(index, k + 1), "rep").filter("id != vec_id")
    order = W.partitionBy("id").orderBy(F.desc("similarity"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("vec_id"), "rank", F.col("vec_id").alias("neighbor_id"), F.round("similarity", 6).alias("similarity"))


def _pairs_of(json: str):
    return F.map_entries(F.from_json(json, "map<string,string>"))


def answer_queries(records: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, similarity): each query's ``limit_k`` most similar vectors that fit its filter.

    ``queries``: query_id, space columns, vector, limit_k, filter_json (null: no filter;
    all its keys must be there with equal values). A limit of 0 or null gives no rows, nor
    does an unusable query vector; the parts are searched for the greatest limit asked; similarities equal in five digits go by id. Queries without
    filter go through the learned parts; those with one first join the records that
    have all its values, and only these are compared.
    """
    limited = queries.filter("query_id is not null and limit_k > 0").withColumn("_k", F.col("limit_k"))
    most = limited.agg(F.max("limit_k")).first()[0] or 1
    limits = limited.select("query_id", "_k")
    index = build_index(records, query_share=0.02)
    free = _pack(limited.filter("filter_json is null or filter_json = '{}'"), "query_id", index.names).select("space", "id", "unit")
    plain = search(index, free, most).join(_members_up_to(index, most), "rep").select(F.col("id").alias("query_id"), "vec_id", "similarity")
    asked = usable(limited.filter("filter_json is not null and filter_json != '{}'")).withColumn("_want", _pairs_of("filter_json"))
    wants = asked.select("query_id", *SPACE, F.size("_want").alias("_n_want"), F.explode("_want").alias("_pair")).select("query_id", *SPACE, "_n_want", "_pair.key", "_pair.value")
    held = records.filter("vec_id is not null and metadata is not null").select("vec_id", *SPACE, F.explode(_pairs_of("metadata")).alias("_pair")).select("vec_id", *SPACE, "_pair.key", "_pair.value").distinct()
    fits = held.join(wants, [*SPACE, "key", "value"]).groupBy("query_id", "vec_id").agg(F.count("*").alias("n"), F.first("_n_want").alias("_n_want")).filter("n = _n_want").select("query_id", "vec_id")
    vectors = usable(records).join(fits.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", F.col("vector").alias("_v")).dropDuplicates(["vec_id"])
    both = fits.join(vectors, "vec_id").join(asked.select("query_id", F.col("vector").alias("_q")), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    filtered = both.select("query_id", "vec_id", (dot("_v", "_q") / F.sqrt(dot("_v", "_v")) / F.sqrt(dot("_q", "_q"))).alias("similarity"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 5)), "vec_id")
    ranked = plain.unionByName(filtered).join(limits, "query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("_k"))
    return ranked.select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))
