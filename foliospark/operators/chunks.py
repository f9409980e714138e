"""Pages parsed into headings, sections and search excerpts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.pages import Page, scan_page, sections

#: Where an oversized block is cut, the first that occurs (fixed order).
DELIMITERS = ("\n\n", "\n", ". ", "; ", ", ", " ")

PARSED = "path string, body_start_line int, frontmatter string, error string, headings array<struct<level:int,text:string,line:int,crumbs:array<string>,last_line:int>>, code_blocks array<struct<start_line:int,end_line:int>>"


def crumbs_of(page: Page) -> list[list[str]]:
    """Breadcrumb at each heading: the trail is cut to the level above and extended, never padded, so a skipped level sits closer."""
    trail: list[str] = []
    out = []
    for level, text, _ in page.headings:
        trail = [*trail[: level - 1], text]
        out.append(trail)
    return out


def frontmatter_of(text: str) -> tuple[dict | None, str | None]:
    """(fields, error): the mapping between the first two ``---`` lines; no such line, no fields."""
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        return None, None
    end = next((i for i in range(1, len(lines)) if lines[i].rstrip() == "---"), None)
    if end is None:
        return None, "frontmatter is not closed"
    try:
        import yaml

        held = yaml.safe_load("\n".join(lines[1:end]))
    except ImportError:
        held = _plain_fields(lines[1:end])
    except Exception as e:  # noqa: BLE001  (whatever the parser says is the page's fault)
        return None, f"frontmatter can't be read: {type(e).__name__}"
    if held is None:
        return {}, None
    return (held, None) if isinstance(held, dict) else (None, "frontmatter is not a mapping")


def _plain_fields(lines: list[str]) -> dict:
    """Fields of one-line values, for where no YAML parser is installed."""
    out: dict = {}
    for line in lines:
        if m := re.match(r"([\w-]+):\s*(.*)$", line):
            value: object = m[2].strip()
            if m[2].startswith("[") and m[2].endswith("]"):
                value = [x.strip() for x in m[2][1:-1].split(",") if x.strip()]
            elif re.fullmatch(r"-?\d+", m[2]):
                value = int(m[2])
            out[m[1]] = value
    return out


def parse_pages(pages: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """:data:`PARSED` of each page; ``last_line`` is the line before the next heading of the same or a higher level.

    Null texts count as empty; rows with a null path keep it.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, value in zip(batch["p"], batch["t"]):
                page = scan_page(value or "")
                fields, error = frontmatter_of(value or "")
                heads = []
                for i, ((level, title, line), trail) in enumerate(zip(page.headings, crumbs_of(page))):
                    last = next((h[2] - 1 for h in page.headings[i + 1 :] if h[0] <= level), len(page.lines))
                    heads.append({"level": level, "text": title, "line": line, "crumbs": trail, "last_line": last})
                out.append((p, page.body, None if fields is None else json.dumps(fields, default=str, sort_keys=True), error, heads, [{"start_line": a, "end_line": b} for a, b in page.code]))
            yield pd.DataFrame(out, columns=["path", "body_start_line", "frontmatter", "error", "headings", "code_blocks"])

    return pages.select(F.col(path).alias("p"), F.col(text).alias("t")).mapInPandas(parse, PARSED)


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters: the aim is four a token, at most ``most``; ``overlap`` is in per cent."""

    tokens: int = 400
    most: int = 3000
    overlap: int = 15
    skipped_sections: tuple[str, ...] = field(default_factory=tuple)

    @property
    def aim(self) -> int:
        """Characters a chunk should not exceed."""
        return min(4 * self.tokens, self.most)

    def room(self, trail: list[str]) -> tuple[str, int, int]:
        """(prefix, characters for the body, for the overlap) under a breadcrumb; the body keeps at least its aim or three quarters of all, and the prefix is cut to what that leaves."""
        spare = self.most - max(1, min(self.aim, self.most * 3 // 4))
        prefix = " > ".join(trail)[: max(0, spare - 2)]
        cost = len(prefix) + 2 if prefix else 0
        overlap = min(self.aim * self.overlap // 100, max(0, spare - cost - 2))
        return prefix, max(1, min(self.aim, self.most - cost - (overlap + 2 if overlap else 0))), overlap


def _blocks(page: Page, config: ChunkConfig) -> Iterator[tuple[int, int, list[str], str]]:
    """(first line, last line, breadcrumb, text) of every block between empty lines, headings and code."""
    heads = {line: (level, title, trail) for (level, title, line), trail in zip(page.headings, crumbs_of(page))}
    under = {line + 1 for line in heads if line < len(page.lines) and re.fullmatch(r"\s*(?:=+|-+)\s*", page.lines[line]) and not page.lines[line - 1].lstrip().startswith("#")}
    code = {n for a, b in page.code for n in range(a, b + 1)}
    trail: list[str] = []
    skipping = 0
    held: list[tuple[int, str]] = []

    def done() -> Iterator[tuple[int, int, list[str], str]]:
        if held:
            yield held[0][0], held[-1][0], trail, "\n".join(x for _, x in held)
            held.clear()

    was_code = False
    for n in range(page.body, len(page.lines) + 1):
        line = page.lines[n - 1].rstrip("\r")
        if n in heads:
            yield from done()
            level, title, trail = heads[n]
            if title in config.skipped_sections:
                skipping = min(skipping, level) if skipping else level
            elif skipping and level <= skipping:
                skipping = 0
            continue
        if n in under or skipping:
            continue
        listed = bool(re.match(r"(?:[-*+]|\d+[.)])\s", line)) and not (held and re.match(r"\s*(?:[-*+]|\d+[.)])\s", held[-1][1]))
        if (n in code) != was_code or listed and n not in code:
            yield from done()
            was_code = n in code
        if line.strip() or n in code:
            held.append((n, line))
        else:
            yield from done()
    yield from done()


def _cut(text: str, limit: int) -> Iterator[tuple[int, str]]:
    """(offset, part) of an oversized block, cut at the best delimiter before the limit."""
    at = 0
    while at < len(text):
        part = text[at : at + limit]
        if at + limit < len(text):
            for mark in DELIMITERS:
                k = part.rfind(mark)
                if k >= 0:
                    part = part[: k + len(mark)]
                    break
        yield at, part
        at += len(part)


def chunk_page(text: str, config: ChunkConfig, context: tuple[str, ...] = ()) -> list[tuple[int, int, list[str], str, str]]:
    """(first line, last line, breadcrumb, text, embedding text) of each excerpt of a page.

    Blocks are merged while they share a breadcrumb and fit; larger ones are cut. The
    overlap with the excerpt before stands only in the embedding text.
    """
    merged: list[list] = []
    for a, b, trail, body in _blocks(scan_page(text), config):
        _, limit, _ = config.room([*context, *trail])
        if len(body) > limit:
            for at, part in _cut(body, limit):
                first = a + body.count("\n", 0, at)
                merged.append([first, a + body.count("\n", 0, max(at, at + len(part) - 1)), trail, part, False])
        elif merged and merged[-1][4] and merged[-1][2] == trail and len(merged[-1][3]) + 2 + len(body) <= limit:
            merged[-1][1], merged[-1][3] = b, f"{merged[-1][3]}\n\n{body}"
        else:
            merged.append([a, b, trail, body, True])
    out, before = [], ""
    for a, b, trail, body, _ in merged:
        prefix, _, overlap = config.room([*context, *trail])
        spare = config.most - len(body)
        parts = []
        if prefix and spare > 2:
            parts.append(prefix[: spare - 2])
            spare -= len(parts[0]) + 2
        tail = before[-overlap:].lstrip() if overlap else ""
        if tail and spare > 2:
            parts.append(tail[-(spare - 2) :].lstrip())
        out.append((a, b, list(trail), body, "\n\n".join([*parts, body])))
        before = body
    return out


CHUNKS = "path string, chunk_no int, start_line int, end_line int, heading array<string>, text string, embedding_text string"


def chunk_pages(pages: DataFrame, config: ChunkConfig = ChunkConfig(), path: str = "path", text: str = "text") -> DataFrame:
    """:data:`CHUNKS` of every page, in one pass without a shuffle; a null or empty text has none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, value in zip(batch["p"], batch["t"]):
                out.extend((p, n, *chunk) for n, chunk in enumerate(chunk_page(value, config) if value else []))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return pages.select(F.col(path).alias("p"), F.col(text).alias("t")).mapInPandas(cut, CHUNKS)


__all__ = ["ChunkConfig", "chunk_page", "chunk_pages", "crumbs_of", "frontmatter_of", "parse_pages", "sections"]
