"""Pages cut into pieces under a size limit, at natural boundaries.

Lexical cohesion decides among the natural places of a size window: for every
boundary between units (headings, blocks, lines, sentences) the words of the block
before and the block after are compared by cosine, and the depth of the valley of
this similarity picks the cut, with a bonus for stronger kinds of boundary that is
small beside a clear valley. Each piece begins with up to ``overlap`` characters of
the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.pages import scan_page, sections

#: Units on each side of a boundary whose words are compared.
BLOCK = 6
#: Width of the hashed word vectors.
WIDTH = 256
#: The least share of the limit a piece should fill, where a natural place allows it.
FILL = 0.5
#: Added to the valley depth, which lies between 0 and 2: a heading decides between valleys of like depth, not against a clearly deeper one.
BONUS = {"heading": 0.5, "block": 0.25, "line": 0.1, "sentence": 0.0}
_WORD = re.compile(r"[^\W\d_]{3,}")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+(?=\S)")

#: One row per piece; ``sections`` are those that begin or go on in it.
PIECES = "page_id bigint, piece_no int, start_line int, char_start bigint, char_end bigint, overlap_used int, cut string, sections array<struct<section_line: bigint, section_chars: bigint, section_over: boolean>>, piece string"


def units_of(text: str, starts: set[int], code: list[tuple[int, int]], body: int) -> list[tuple[int, str]]:
    """(offset, kind of the boundary before it) of every unit of the body."""
    inside = set()
    for a, b in code:
        inside.update(range(a + 1, b + 1))
    out: list[tuple[int, str]] = []
    offset, blank = 0, True
    for no, line in enumerate(text.split("\n"), 1):
        if no >= body:
            if no in starts:
                out.append((offset, "heading"))
            elif line.strip():
                out.append((offset, "line" if no in inside or not blank else "block"))
            if line.strip() and no not in inside:
                out.extend((offset + m.end(), "sentence") for m in _SENTENCE.finditer(line) if m.end() < len(line))
            blank = not line.strip() and no not in inside
        offset += len(line) + 1
    return out


def valley_depths(texts: list[str]) -> np.ndarray:
    """For each unit the depth of the similarity valley before it (0 for the first)."""
    n = len(texts)
    if n < 3:
        return np.zeros(n)
    counts = np.zeros((n, WIDTH), np.float32)
    seen: dict[str, int] = {}
    for i, t in enumerate(texts):
        row = [seen.setdefault(w, crc32(w.encode()) % WIDTH) for w in _WORD.findall(t.lower())]
        if row:
            counts[i] = np.bincount(row, minlength=WIDTH)
    total = np.vstack([np.zeros((1, WIDTH), np.float32), np.cumsum(counts, 0)])
    at = np.arange(1, n)
    left = total[at] - total[np.maximum(at - BLOCK, 0)]
    right = total[np.minimum(at + BLOCK, n)] - total[at]
    norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
    like = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0.0)
    # The rise to the peaks on both sides, looked for within one block.
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(like, BLOCK, mode="edge"), 2 * BLOCK + 1)
    depth = wide[:, : BLOCK + 1].max(1) + wide[:, BLOCK:].max(1) - 2 * like
    return np.concatenate([[0.0], depth])


def cut_points(text: str, units: list[tuple[int, str]], begin: int, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut before it) of consecutive pieces of new text.

    The first piece may hold ``limit`` characters, later ones leave room for the overlap.
    """
    end = len(text)
    if end - begin <= limit:
        return [(begin, end, "start")]
    offsets = np.array([o for o, _ in units] + [end])
    depth = valley_depths([text[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
    score = depth + np.array([BONUS[k] for _, k in units]) if units else depth
    out, at, kind = [], begin, "start"
    room = limit
    while end - at > room:
        lo, hi = np.searchsorted(offsets[:-1], [at + max(1, int(room * FILL)), at + room + 1])
        if lo >= hi:
            lo = np.searchsorted(offsets[:-1], at + 1)
        if lo < hi:
            best = lo + int(np.argmax(score[lo:hi]))
            to, next_kind = int(offsets[best]), units[best][1]
        else:
            # No natural boundary: after white space, else anywhere.
            to, next_kind = at + room, "space"
            back = max(text.rfind(" ", at + 1, to), text.rfind("\n", at + 1, to))
            if back >= at + room // 2:
                to = back + 1
            else:
                next_kind = "hard"
        out.append((at, to, kind))
        at, kind = to, next_kind
        room = max(1, limit - overlap)
    out.append((at, end, kind))
    return out


def overlap_start(text: str, begin: int, at: int, overlap: int) -> int:
    """Where the repeated text before ``at`` begins: at a word, at most ``overlap`` characters back."""
    lo = max(begin, at - overlap)
    if lo >= at or lo == begin or text[lo - 1].isspace():
        return lo
    for i in range(lo, at):
        if text[i].isspace():
            return i + 1
    return lo


def split_page(text: str, headings: list[int] | None, body: int | None, limit: int, overlap: int) -> list[tuple]:
    """Rows of :func:`pieces` for one page, without its id."""
    page = scan_page(text)
    if body is not None and 0 < body <= len(page.lines):
        page = page._replace(body=int(body))
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    parts = sections(page, headings)
    line_at = [0]
    for line in page.lines:
        line_at.append(line_at[-1] + len(line) + 1)
    sizes = [len(text[line_at[a - 1] : line_at[b] - 1].rstrip()) for a, b in parts]
    begin = line_at[min(page.body, len(page.lines)) - 1] if page.body <= len(page.lines) else len(text)
    if begin >= len(text):
        return []
    units = [u for u in units_of(text, {a for a, _ in parts}, page.code, page.body) if u[0] >= begin]
    rows, starts = [], np.array([line_at[a - 1] for a, _ in parts])
    lines = np.array(line_at)
    for no, (a, b, kind) in enumerate(cut_points(text, units, begin, limit, overlap)):
        back = overlap_start(text, begin, a, overlap) if no else a
        k = int(np.searchsorted(starts, a, "right")) - 1
        first, last = max(k, 0), max(int(np.searchsorted(starts, b - 1, "right")) - 1, 0)
        touched = [(parts[s][0], sizes[s], sizes[s] > limit) for s in range(first, last + 1)]
        rows.append((no, int(np.searchsorted(lines, a, "right")), a, b, a - back, kind, touched, text[back:b]))
    return rows


def pieces(pages: DataFrame, plans: DataFrame, texts: bool = True) -> DataFrame:
    """One row per piece of a page: :data:`PIECES`.

    ``pages``: page_id, text, headings.line and body_start_line where known (null:
    found in the text); ``plans``: page_id, body_limit, overlap_chars. A page without
    plan, text or limit gives no rows; an empty body gives no pieces; a null overlap
    is 0, and one that leaves no room for new text counts as the limit less one. Plans that
    repeat a page count once; a repeated page gives its pieces again, so that texts needn't
    be shuffled. The piece with its overlap never exceeds the limit.
    """
    page = pages.filter("page_id is not null and text is not null").select("page_id", "text", F.expr("transform(headings, x -> x.line)").alias("_lines"), "body_start_line")
    plan = plans.filter("page_id is not null and body_limit > 0").groupBy("page_id").agg(F.min(F.struct("body_limit", F.coalesce("overlap_chars", F.lit(0)).alias("overlap"))).alias("p")).select("page_id", "p.*")
    rows = page.join(plan, "page_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for page_id, text, lines, body, limit, overlap in zip(batch["page_id"], batch["text"], batch["_lines"], batch["body_start_line"], batch["body_limit"], batch["overlap"]):
                found = split_page(text, None if lines is None else list(lines), None if pd.isna(body) else int(body), int(limit), int(overlap))
                out.extend((page_id, *row[:-1], row[-1] if texts else None) for row in found)
            yield pd.DataFrame(out, columns=["page_id", "piece_no", "start_line", "char_start", "char_end", "overlap_used", "cut", "sections", "piece"])

    return rows.mapInPandas(cut, PIECES)
