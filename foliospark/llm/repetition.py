"""Repeated content inside one document, and lines that run through many.

``repeated_share`` measures phrases that already stood earlier in the same text.
``line_frequency`` and ``without_frequent_lines`` are the cross-document line
method: normalised lines are hashed, distinct documents per host and line counted,
lines above the limit removed, and documents that lose too much rejected. Line
counts across documents can't see a phrase repeated inside one, so the share comes
from the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASE = 5
_MARKS = re.compile(r"<\|ref\|>.*?<\|/ref\|>|<\|det\|>.*?<\|/det\|>|<\|[^<>|]*\|>|<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(raw: str) -> list[str]:
    """Lower-cased runs of letters without grounding marks and tags."""
    return _WORD.findall(_MARKS.sub(" ", raw).lower())


def repeated_words(words: list[str], phrase: int = PHRASE) -> int:
    """Words that lie in a phrase of ``phrase`` words which already stood earlier."""
    n = len(words) - phrase + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Exact phrase numbers: pairs of numbers are renumbered, so no two phrases can collide.
    gram = ids[:n]
    for k in range(1, phrase):
        gram = np.unique(gram * np.int64(len(number)) + ids[k : k + n], return_inverse=True)[1]
    first = np.full(int(gram.max()) + 1, n, np.int64)
    np.minimum.at(first, gram, np.arange(n))
    again = np.flatnonzero(first[gram] < np.arange(n))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + phrase, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_share(df: DataFrame, key: str, text: str, phrase: int = PHRASE) -> DataFrame:
    """(key, n_words, n_repeated, repeated_share), one row per key.

    A null or empty text has 0 words and share 0. Rows that repeat a key count once
    (the one with the largest share, should their texts differ); rows without a key
    are dropped. Each text is read whole and alone, so no row is shuffled before it
    is down to three numbers.
    """

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = []
            for raw in batch["_text"]:
                words = words_of(raw) if raw else []
                counts.append((len(words), repeated_words(words, phrase)))
            yield pd.DataFrame({"_key": batch["_key"], "n_words": [a for a, _ in counts], "n_repeated": [b for _, b in counts]})

    kind = df.schema[key].dataType.simpleString()
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = rows.mapInPandas(share, f"_key {kind}, n_words bigint, n_repeated bigint")
    part = F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0))
    best = out.withColumn("repeated_share", part).groupBy("_key").agg(F.max(F.struct("repeated_share", "n_words", "n_repeated")).alias("m"))
    return best.select(F.col("_key").alias(key), "m.n_words", "m.n_repeated", "m.repeated_share")


def _lines(df: DataFrame, key: str, host: str, text: str) -> DataFrame:
    line = F.trim(F.regexp_replace(F.regexp_replace(F.lower("_line"), r"[^\p{L}]+", " "), " +", " "))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\R", -1)).alias("_pos", "_line"))
    return rows.withColumn("_norm", line).withColumn("_hash", F.xxhash64("_norm"))


def _frequency(df: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """(_host, _hash, _norm, n_docs): lines of equal hash are told apart by their text."""
    once = _lines(df, key, host, text).filter("_norm != ''").select("_host", "_hash", "_norm", "_key").distinct()
    return once.groupBy("_host", "_hash", "_norm").agg(F.count("*").alias("n_docs"))


def line_frequency(df: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """(host, line_hash, n_docs): distinct documents of the host that hold the normalised line.

    Lines are lower-cased letters only; lines without letters don't count. A line's
    documents are first counted once per (host, line, document), with partial
    aggregation before the shuffle, so one hot host spreads over its lines. A null
    text has no lines; a null host is a host of its own.
    """
    return _frequency(df, key, host, text).select(F.col("_host").alias(host), F.col("_hash").alias("line_hash"), "n_docs")


def without_frequent_lines(df: DataFrame, key: str, host: str, text: str, limit: int = 10, keep_at_least: float = 0.5) -> DataFrame:
    """(key, clean_text, n_lines, n_removed, rejected): lines on more than ``limit`` documents of a host removed.

    A document is rejected if less than ``keep_at_least`` of its non-empty lines
    stay; one without any line is kept. Repeated rows of a key must be dropped
    before. The lines above the limit are joined by hash and text, not broadcast.
    """
    many = _frequency(df, key, host, text).filter(F.col("n_docs") > limit).select(F.col("_host").alias("_h"), F.col("_hash").alias("line_hash"), F.col("_norm").alias("_m"))
    rows = _lines(df, key, host, text)
    joined = rows.join(many, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_hash") == F.col("line_hash")) & (F.col("_norm") == F.col("_m")), "left")
    drop = F.col("line_hash").isNotNull() & (F.col("_norm") != "")
    out = joined.groupBy("_key").agg(
        F.array_sort(F.collect_list(F.when(~drop, F.struct("_pos", "_line")))).alias("kept"),
        F.count_if(F.col("_norm") != "").alias("n_lines"),
        F.count_if(drop).alias("n_removed"),
    )
    text_out = F.array_join(F.transform("kept", lambda x: x["_line"]), "\n")
    return out.select(F.col("_key").alias(key), text_out.alias("clean_text"), "n_lines", "n_removed", ((F.col("n_lines") - F.col("n_removed")) < keep_at_least * F.col("n_lines")).alias("rejected"))
