"""Evaluation passages inside a training corpus.

Each task cuts the texts it reads into shards and builds the suffix array of a shard's
words in full order. Every suffix of every test passage is binary-searched in it,
which gives the places of its verbatim matches and its longest one. Matches on one
diagonal are then followed over single altered words. Words that no test passage
holds get one common number and end a suffix, since no test suffix can match past
them; so the array is whole for what is asked. The corpus is read once for each block
of items and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.session import cut_lineage

#: Words in a continuous part that counts as a leak.
LEAST = 20
#: Words of a verbatim match from which a diagonal is followed.
SEED = 4
#: Least share of unaltered words in a stretch.
MATCHED = 0.85
#: Characters of a shard; items searched at once (the broadcast block).
SHARD_CHARS, ITEMS = 4_000_000, 20_000
#: Words compared at a step.
STEP = 8

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
LEAKS = "doc_id bigint, item_id bigint, n_words int, n_matched int, word_start bigint, passage_start int"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


def _sentences(prompt: str | None) -> list[str]:
    return [s for s in _SENTENCE.split((prompt or "").strip()) if s]


def opening(prompt: str | None) -> str | None:
    """The words of a prompt's first sentence."""
    cut = _sentences(prompt)
    return " ".join(words_of(cut[0])) if cut else None


def passages(items: list[tuple[int, str, bool]]) -> dict[int, list[str]]:
    """The words of each item's own passage; an item is (id, prompt, whether other items share its opening sentence).

    A shared opening is an instruction, and a last sentence that asks is the question;
    both are left out, unless nothing else stays.
    """
    out = {}
    for key, prompt, shared in items:
        own = _sentences(prompt)
        if len(own) > 1 and shared:
            own = own[1:]
        if len(own) > 1 and own[-1].rstrip().endswith("?"):
            own = own[:-1]
        found = words_of(" ".join(own))
        if found:
            out[key] = found
    return out


class Tests:
    """The test passages as numbers, one after the other with a mark between."""

    def __init__(self, found: dict[int, list[str]]) -> None:
        self.ids = sorted(found)
        self.number: dict[str, int] = {}
        arrays = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in found[k]], np.int64) for k in self.ids]
        self.length = np.array([len(a) for a in arrays], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length + 1)]).astype(np.int64)
        self.flat = np.concatenate([np.append(a, -1) for a in arrays]) if arrays else np.zeros(0, np.int64)
        self.item = np.repeat(np.arange(len(arrays)), self.length + 1)
        n = len(self.flat) - SEED + 1
        ok = np.ones(max(n, 0), bool)
        for k in range(SEED):
            ok &= self.flat[k : k + n] >= 0
        #: Where suffixes of at least ``SEED`` words begin.
        self.at = np.flatnonzero(ok)


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Places of a shard in the full order of their suffixes, each ending at its first word unknown to the tests (0); shorter than ``SEED`` words they are left out.

    Ranks of 1, 2, 4 ... words by doubling, until the longest run of known words is ranked.
    """
    n = len(words)
    known = words > 0
    ends = np.flatnonzero(~np.append(known, False))
    left = np.zeros(n, np.int64)
    if n:
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    some = np.flatnonzero(known)
    at = np.flatnonzero(left >= SEED)
    if not len(at):
        return at
    rank = words.astype(np.int64)
    width, longest = 1, int(left.max())
    while width < longest:
        ahead = np.where(some + width < n, rank[np.minimum(some + width, n - 1)], 0)
        # A suffix that ended before stays; what follows its end isn't part of it.
        ahead[left[some] <= width] = 0
        pair = rank[some] * (int(rank.max()) + 1) + ahead
        fresh = np.unique(pair, return_inverse=True)[1] + 1
        rank = np.zeros(n, np.int64)
        rank[some] = fresh
        width *= 2
        if int(fresh.max()) == len(some):
            break
    return at[np.argsort(rank[at], kind="stable")]


def _compare(words: np.ndarray, places: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign, words in common) of the suffixes at ``places`` against the test suffixes at ``at``; the sign is -1 where the first is the smaller."""
    sign, common = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    open_ = np.arange(len(places))
    step, done = np.arange(STEP), 0
    while len(open_):
        a, b = places[open_, None] + done + step, at[open_, None] + done + step
        x = np.where(a < len(words), words[np.minimum(a, len(words) - 1)], 0)
        y = np.where(b < len(flat), flat[np.minimum(b, len(flat) - 1)], -1)
        differ = x != y
        some, first = differ.any(1), differ.argmax(1)
        end = open_[some]
        sign[end] = np.sign(x[some, first[some]] - y[some, first[some]])
        common[end] = done + first[some]
        open_ = open_[~some]
        done += STEP
    return sign, common


def _keys(flat: np.ndarray, at: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """An exact number of the ``SEED`` words at each place, by the numbered pairs of words; -1 where a pair isn't among them."""
    base = np.int64(1) << 31
    out = np.zeros(len(at), np.int64)
    for k in range(0, SEED, 2):
        pair = flat[at + k] * base + flat[at + k + 1]
        no = np.minimum(np.searchsorted(halves, pair), len(halves) - 1)
        out = np.where((halves[no] == pair) & (out >= 0), out * len(halves) + no, -1)
    return out


class Found(NamedTuple):
    """Test suffixes that stand in a shard: where they begin, and their range in the suffix array."""

    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def ranges(tests: Tests, words: np.ndarray, array: np.ndarray) -> Found:
    """The ranges of the array that share ``SEED`` words with a test suffix."""
    empty = np.zeros(0, np.int64)
    if not len(array) or not len(tests.at):
        return Found(empty, empty, empty)
    base = np.int64(1) << 31
    halves = np.unique(np.concatenate([tests.flat[tests.at + k] * base + tests.flat[tests.at + k + 1] for k in range(0, SEED, 2)]))
    # In the array's order equal keys stand together, though the keys themselves are not sorted.
    keys = _keys(words, array, halves)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    last = np.append(first[1:], len(keys))
    order = np.argsort(keys[first], kind="stable")
    wanted = _keys(tests.flat, tests.at, halves)
    no = np.minimum(np.searchsorted(keys[first][order], wanted), len(order) - 1)
    group = order[no]
    hit = (keys[first][group] == wanted) & (wanted >= 0)
    return Found(tests.at[hit], first[group[hit]], last[group[hit]])


def longest_matches(tests: Tests, words: np.ndarray, array: np.ndarray, found: Found) -> tuple[np.ndarray, np.ndarray]:
    """(words, place) of the longest verbatim match of each found test suffix, by binary search in its range."""
    lo, hi = found.lo.copy(), found.hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        middle = (lo[open_] + hi[open_]) // 2
        sign, _ = _compare(words, array[middle], tests.flat, found.at[open_])
        lo[open_] = np.where(sign < 0, middle + 1, lo[open_])
        hi[open_] = np.where(sign < 0, hi[open_], middle)
    best, where = np.zeros(len(lo), np.int64), np.full(len(lo), -1, np.int64)
    for beside in (lo - 1, lo):
        ok = np.flatnonzero((beside >= found.lo) & (beside < found.hi))
        _, common = _compare(words, array[beside[ok]], tests.flat, found.at[ok])
        more = common > best[ok]
        best[ok[more]], where[ok[more]] = common[more], array[beside[ok[more]]]
    return best, where


def longest_run(same: np.ndarray, least: int) -> tuple[int, int, int]:
    """(start, length, matched) of the longest stretch that is a leak, of length 0 if none is.

    A stretch begins and ends with a match, has no two altered words in a row and
    matches in at least ``MATCHED`` of its words. Where chance matches around a true
    copy spoil the share, the best-scoring stretch inside it is tried instead.
    """
    hits = np.flatnonzero(same)
    if not len(hits):
        return 0, 0, 0
    cut = np.flatnonzero(np.diff(hits) > 2) + 1
    first = hits[np.concatenate([[0], cut])]
    last = hits[np.concatenate([cut - 1, [len(hits) - 1]])]
    best = (0, 0, 0)
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a + 1 < least:
            continue
        part = same[a : b + 1]
        if part.sum() < MATCHED * len(part):
            total = np.concatenate([[0], np.cumsum(np.where(part, 1.0, -1.0 / (1 - MATCHED)))])
            low = np.minimum.accumulate(total)
            end = int(np.argmax(total - low))
            begin = int(np.argmin(total[: end + 1]))
            a, part = a + begin, part[begin:end]
        if len(part) >= least and len(part) > best[1]:
            best = (a, len(part), int(part.sum()))
    return best


def search_shard(tests: Tests, words: np.ndarray, bounds: np.ndarray, least: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document in the shard, item, words, matched, place, place in the passage) of the longest leak of each pair."""
    array = suffix_array(words)
    found = ranges(tests, words, array)
    if not len(found.at):
        return []
    count = found.hi - found.lo
    test_at = np.repeat(found.at, count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = array[np.repeat(found.lo, count) + step]
    doc = np.searchsorted(bounds, place, "right") - 1
    item = tests.item[test_at]
    # One diagonal of one pair of document and passage.
    diagonal = np.unique(np.stack([doc, item, place - test_at], 1), axis=0)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for d, i, shift in diagonal.tolist():
        a, n = int(tests.start[i]), int(tests.length[i])
        lo_w, hi_w = max(a + shift, int(bounds[d])), min(a + n + shift, int(bounds[d + 1]) - 1)
        if hi_w - lo_w < min(least, n):
            continue
        begin, length, matched = longest_run(words[lo_w:hi_w] == tests.flat[lo_w - shift : hi_w - shift], min(least, n))
        if length > best.get((d, i), (0,))[0]:
            best[d, i] = (length, matched, lo_w + begin - int(bounds[d]), lo_w + begin - shift - a)
    return [(d, i, *v) for (d, i), v in best.items()]


def find_leaks(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per (document, item) whose passage, or ``least`` words of it in a row, the text holds: :data:`LEAKS`.

    ``documents``: doc_id, text; ``items``: item_id, prompt. Case, punctuation, line
    ends, spacing and markup don't matter, and words may be altered if none stands
    beside another altered one. The longest match of a pair is given. Null texts and
    prompts match nothing; a passage shorter than ``least`` must be there whole;
    repeated documents or items give one row. The items are the stated query set:
    they go to the tasks in blocks of at most ``ITEMS``, one pass over the corpus each.
    """
    out = None
    for found in _item_blocks(items):
        leaks = _search(documents, found, least, False)
        out = leaks if out is None else out.unionByName(leaks)
    if out is None:
        out = _search(documents, {}, least, False)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_matched", "word_start", "passage_start")).alias("m"))
    return best.select("doc_id", "item_id", "m.*")


def longest_verbatim(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_words, doc_id): the longest stretch of each item's passage that stands in the corpus letter for letter, and a document that holds one.

    Words are compared as in :func:`find_leaks`; stretches of fewer than ``SEED`` words
    don't count, and an item without any has no row. Altered words end a stretch.
    """
    out = None
    for found in _item_blocks(items):
        some = _search(documents, found, 0, True)
        out = some if out is None else out.unionByName(some)
    if out is None:
        out = _search(documents, {}, 0, True)
    best = out.groupBy("item_id").agg(F.max_by("doc_id", F.struct("n_words", -F.col("doc_id"))).alias("doc_id"), F.max("n_words").alias("n_words"))
    return best.select("item_id", "n_words", "doc_id")


def _item_blocks(items: DataFrame) -> Iterator[dict[int, list[str]]]:
    """The passages of ``ITEMS`` items at a time; which openings are shared is told over all items."""

    @F.pandas_udf("string")
    def first(prompt: pd.Series) -> pd.Series:
        return prompt.map(opening)

    rows = items.filter("item_id is not null and prompt is not null").select("item_id", "prompt").distinct().withColumn("_o", first("prompt"))
    counts = rows.groupBy("_o").agg(F.count_distinct("item_id").alias("_n"))
    rows = cut_lineage(rows.join(counts, "_o", "left").select("item_id", "prompt", (F.coalesce("_n", F.lit(0)) > 1).alias("shared"), F.row_number().over(W.partitionBy("item_id").orderBy("prompt")).alias("_r")).filter("_r = 1"))
    blocks = -(-rows.count() // ITEMS)
    for block in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        yield passages([(r[0], r[1], r[2]) for r in part.collect()])


def _search(documents: DataFrame, found: dict[int, list[str]], least: int, verbatim: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(found)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = Tests(shared.value)
        number = tests.number.get
        names = [c.split()[0] for c in LEAKS.split(", ")]

        def run(ids: list, numbers: list[np.ndarray]) -> pd.DataFrame:
            bounds = np.concatenate([[0], np.cumsum([len(a) for a in numbers])])
            words = np.concatenate(numbers)
            if not verbatim:
                return pd.DataFrame([(ids[d], tests.ids[i], *rest) for d, i, *rest in search_shard(tests, words, bounds, least)], columns=names)
            array = suffix_array(words)
            hits = ranges(tests, words, array)
            length, place = longest_matches(tests, words, array, hits)
            doc = np.searchsorted(bounds, place, "right") - 1
            item = tests.item[hits.at]
            rows = pd.DataFrame({"doc_id": [ids[d] for d in doc], "item_id": [tests.ids[i] for i in item], "n_words": length, "n_matched": length, "word_start": place - bounds[doc], "passage_start": hits.at - tests.start[item]}, columns=names)
            return rows.sort_values("n_words").drop_duplicates("item_id", keep="last")

        end = np.zeros(1, np.int64)
        ids, numbers, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if not text:
                    continue
                ids.append(doc_id)
                numbers.append(np.append(np.array([number(w, 0) for w in words_of(text)], np.int64), end))
                size += len(text)
                if size >= SHARD_CHARS:
                    yield run(ids, numbers)
                    ids, numbers, size = [], [], 0
        if ids:
            yield run(ids, numbers)

    return documents.filter("doc_id is not null").select("doc_id", "text").mapInPandas(search, LEAKS)


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that hold no test passage; rows with a null id stay."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
