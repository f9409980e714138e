"""Anchored line edits of pages and anchored rendering."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.text import line_hash

_ANCHOR = re.compile(r"(\d+):([0-9a-f]{2})")


class EditError(ValueError):
    """An edit that can't be applied to the page as it is."""


@dataclass(frozen=True)
class Edit:
    """``replace`` or ``append``; see :func:`apply_edits`."""

    op: str
    anchor: str | None
    content: str


def anchor_hash(before: str, line: str, after: str) -> str:
    """Two hex digits that tie a line to its neighbours."""
    h = hashlib.sha256()
    for part in (before, line, after):
        raw = part.encode()
        h.update(len(raw).to_bytes(8, "big") + raw)
    return h.hexdigest()[:2]


def anchored_lines(pages: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no, anchor, line): each line as ``LINE:HASH``; the hash covers the lines beside it.

    A final line end makes no extra line; a null or empty text has no lines.
    """
    body = F.regexp_replace(F.col(text), r"\r\n", "\n")
    lines = F.split(F.regexp_replace(body, r"\n\z", ""), "\n", -1)
    rows = pages.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(path).alias("path"), lines.alias("_l"))
    # Neighbours come from the array itself, so no page is shuffled.
    marked = rows.select("path", "_l", F.posexplode("_l").alias("_i", "line"))
    around = lambda n: F.coalesce(F.get("_l", F.col("_i") + n), F.lit(""))
    hashed = marked.withColumn("_h", line_hash(F.when(F.col("_i") > 0, around(-1)).otherwise(""), F.col("line"), around(1)))
    return hashed.select("path", (F.col("_i") + 1).alias("line_no"), F.concat((F.col("_i") + 1).cast("string"), F.lit(":"), "_h").alias("anchor"), "line")


def _at(anchor: str, lines: list[str]) -> int:
    m = _ANCHOR.fullmatch(anchor)
    if not m:
        raise EditError(f"not an anchor: {anchor}")
    i = int(m[1]) - 1
    if not 0 <= i < len(lines):
        raise EditError(f"no such line: {anchor}")
    got = anchor_hash(lines[i - 1] if i else "", lines[i], lines[i + 1] if i + 1 < len(lines) else "")
    if got != m[2]:
        raise EditError(f"stale anchor: {anchor}")
    return i


def apply_edits(text: str | None, edits: list[Edit]) -> str | None:
    """The page after all edits, each resolved against the page as it was; None if it is deleted.

    ``replace`` without anchor creates a missing page; with ``LINE:HH`` or ``A..B`` it
    replaces lines, and empty content deletes them; the whole page may be deleted by one edit over
    all lines. ``append`` inserts after an anchor, at the begin (``0:``) or the end. Overlaps,
    stale anchors and empty appends raise. Line ends and the final one are kept.
    """
    if len(edits) == 1 and edits[0].op == "replace" and edits[0].anchor is None:
        if text is not None:
            raise EditError("the page is there; replacing needs an anchor")
        if not edits[0].content:
            raise EditError("a page can't be created empty")
        return edits[0].content
    if text is None:
        raise EditError("the page is not there")
    if text == "" and len(edits) == 1 and edits[0].op == "replace" and edits[0].anchor == "0:":
        return edits[0].content or None
    newline = "\r\n" if "\r\n" in text else "\n"
    ended = text.endswith("\n")
    lines = text.splitlines()
    spans: list[tuple[int, int, int, Edit]] = []
    for n, edit in enumerate(edits):
        if edit.op == "append":
            if not edit.content:
                raise EditError("nothing to append")
            at = len(lines) if edit.anchor is None else 0 if edit.anchor == "0:" else _at(edit.anchor, lines) + 1
            spans.append((at, at, n, edit))
        elif edit.anchor is None:
            raise EditError("creating must be the only edit of a page")
        else:
            ends = edit.anchor.split("..")
            first, last = _at(ends[0], lines), _at(ends[-1], lines)
            if last < first:
                raise EditError("reversed range")
            spans.append((first, last + 1, n, edit))
    taken = sorted((a, b) for a, b, _, e in spans if e.op == "replace")
    if any(b > c for (_, b), (c, _) in zip(taken, taken[1:])) or any(a < p < b for a, b in taken for p, _, _, e in spans if e.op == "append"):
        raise EditError("edits overlap")
    if len(spans) == 1 and spans[0][3].op == "replace" and spans[0][:2] == (0, len(lines)):
        return spans[0][3].content or None
    for a, b, _, edit in sorted(spans, key=lambda s: (-s[0], -s[2])):
        body = edit.content.splitlines() if edit.content else []
        lines[a:b] = body
    if not lines:
        raise EditError("deleting a page needs one edit over all its lines")
    return newline.join(lines) + (newline if ended or lines[-1] == "" else "")


def edit_pages(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, text, outcome, error): pages (path, text) after their edits (path, seq, op, anchor, content).

    Outcomes: updated, created, deleted, rejected. A page's edits stand together or not at
    all; only pages with edits come out.
    """
    held = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "anchor", "content"))).alias("edits"))
    rows = held.join(pages.select("path", "text"), "path", "left")

    def run(batches):
        for batch in batches:
            out = []
            for path, items, text in zip(batch["path"], batch["edits"], batch["text"]):
                try:
                    new = apply_edits(text, [Edit(e["op"], e["anchor"], e["content"] or "") for e in items])
                    out.append((path, new, "deleted" if new is None else "created" if text is None else "updated", None))
                except EditError as e:
                    out.append((path, text, "rejected", str(e)))
            yield pd.DataFrame(out, columns=["path", "text", "outcome", "error"])

    return rows.mapInPandas(run, "path string, text string, outcome string, error string")


def span_edits(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The proposed span edits that touch no other of their text; conflicting ones all abstain."""
    w = W.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(start).over(w.rowsBetween(1, W.unboundedFollowing))
    return df.withColumn("_b", before).withColumn("_a", after).filter((F.col("_b").isNull() | (F.col("_b") <= F.col(start))) & (F.col("_a").isNull() | (F.col("_a") >= F.col(end)))).drop("_a", "_b")
