"""Readers of files: pages by glob, anything by first bytes, line windows, capture manifests, transcripts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import file_kind, path_selected


def read_pages(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, text) of the files under ``root`` that the globs select.

    Paths are filtered in a listing without content first; only selected files are
    opened. Hidden files, ``.git`` and editor leftovers are never taken.
    """
    prefix = root.rstrip("/") + "/"
    relative = F.regexp_replace("path", rf"^(?:file:/*)?/?{re.escape(prefix.lstrip('/'))}", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("_full"), relative.alias("path"), "content")
    shown = ~F.col("path").rlike(r"(?:^|/)(?:\.git|\.DS_Store|\._[^/]*)(?:/|$)")
    return files.filter(shown & path_selected("path", include or ["**/*.md"], exclude or [])).select("path", F.decode("content", "UTF-8").alias("text"))


def read_kinds(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, size) of all files; the kind is by first bytes, null if unknown."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", file_kind("content").alias("kind"), F.col("length").alias("size"))


def asked_path(asked: Column) -> Column:
    """``a/b.md:12`` or ``a/b.md:3-9`` as (path, first, last); without a window both are null."""
    window = F.regexp_extract(asked, r":(\d+)(?:-(\d+))?$", 1)
    last = F.regexp_extract(asked, r":(\d+)(?:-(\d+))?$", 2)
    first = F.when(window != "", window.cast("int"))
    return F.struct(F.regexp_replace(asked, r":\d+(?:-\d+)?$", "").alias("path"), first.alias("first"), F.when(last != "", last.cast("int")).otherwise(first).alias("last"))


def read_windows(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, path, line_no, line) of the asked paths with line windows; lines count from 1, both ends inclusive."""
    wanted = asked.withColumn("_w", asked_path(F.col("asked"))).select("asked", "_w.*")
    rows = pages.join(wanted, "path").select("asked", "path", "first", "last", F.posexplode(F.split("text", r"\r?\n")).alias("_i", "line")).withColumn("line_no", F.col("_i") + 1)
    return rows.filter(F.col("first").isNull() | F.col("line_no").between(F.col("first"), F.col("last"))).select("asked", "path", "line_no", "line")


MANIFEST = "schemaVersion int, meetingID string, status string, startedAt string, endedAt string, platform string, slug string, timeZone string, title string, audio array<struct<role:string,file:string,format:string,sampleRate:int,channels:int,durationSeconds:double,sha256:string,streamIndex:int>>, warnings array<string>"


def read_manifests(texts: DataFrame, key: str, json: str) -> DataFrame:
    """(key, version, track_no, role, file, stream, seconds, error) of capture manifests of versions 1 to 3.

    Version 1 and 2 hold one file per track; version 3 one file with streams. An unreadable
    or unknown manifest gives one row with ``error``.
    """
    rows = texts.select(F.col(key), F.from_json(json, MANIFEST, {"mode": "PERMISSIVE"}).alias("m"))
    version = F.col("m.schemaVersion")
    bad = version.isNull() | ~version.between(1, 3)
    tracks = rows.filter(~bad).select(key, version.alias("version"), F.posexplode_outer("m.audio").alias("track_no", "a"))
    good = tracks.select(key, "version", "track_no", "a.role", "a.file", F.when(F.col("version") >= 3, F.coalesce("a.streamIndex", F.col("track_no"))).otherwise(0).alias("stream"), F.col("a.durationSeconds").alias("seconds"), F.when(F.col("a").isNull(), "no audio").alias("error"))
    return good.unionByName(rows.filter(bad).select(key, version.alias("version"), F.lit(None).cast("int").alias("track_no"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("stream"), F.lit(None).cast("double").alias("seconds"), F.lit("unknown manifest").alias("error")))


_TURN = r"\[(\d+(?:\.\d+)?)\]\s*\[(S\d+)\]\s*([^\[\]]*)\[(\d+(?:\.\d+)?)\]"


def transcript_turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, s, e, speaker, text) of lines ``[start][S01]text[end]``; reversed or empty ones are left out."""
    part = lambda n: F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_TURN), F.lit(n))
    zipped = F.arrays_zip(part(1).alias("s"), part(4).alias("e"), part(2).alias("speaker"), part(3).alias("text"))
    rows = df.select(key, F.posexplode(zipped).alias("ordinal", "x")).select(key, "ordinal", F.col("x.s").cast("double").alias("s"), F.col("x.e").cast("double").alias("e"), "x.speaker", F.trim("x.text").alias("text"))
    return rows.filter("e > s and text <> ''")


def cached_vectors(chunks: DataFrame, cache: DataFrame, page: str, parts: list[str]) -> DataFrame:
    """Chunks with their cached ``vector``; a page counts as cached only if every chunk's fingerprint is there, else all its vectors are null.

    ``parts`` are the columns of the fingerprint, present on both sides.
    """
    held = cache.select(*parts, "vector").dropDuplicates(parts)
    rows = chunks.join(held, parts, "left")
    whole = rows.groupBy(page).agg(F.bool_and(F.col("vector").isNotNull()).alias("_all"))
    return rows.join(whole, page).withColumn("vector", F.when(F.col("_all"), F.col("vector"))).drop("_all")


def interrupted(files: DataFrame, claimed: DataFrame) -> DataFrame:
    """(recording, path) of temporary recordings nobody claimed; a session file is preferred among a recording's files."""
    named = files.withColumn("recording", F.regexp_replace("path", r"(?:\.session\.json|\.part\d*|\.tmp|\.caf|\.m4a)+$", ""))
    best = named.groupBy("recording").agg(F.max_by("path", F.struct(F.col("path").endswith(".session.json").cast("int"), F.col("path"))).alias("path"))
    return best.join(claimed.select("recording").distinct(), "recording", "left_anti")
