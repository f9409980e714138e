"""Structure of a Markdown page: frontmatter, headings, fenced code, sections."""

from __future__ import annotations

import re
from typing import NamedTuple

_FENCE = re.compile(r" {0,3}(?:(`{3,})[^`]*|(~{3,}).*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_NOT_PARAGRAPH = re.compile(r"\s*(?:[-*+>|]|\d+[.)])\s")


class Page(NamedTuple):
    """What a scan finds; lines count from 1."""

    lines: list[str]
    body: int
    headings: list[tuple[int, str, int]]
    code: list[tuple[int, int]]
    comments: list[tuple[int, int]]


def scan_page(text: str) -> Page:
    """Frontmatter's end, headings of both styles and fenced code outside comments."""
    lines = text.split("\n")
    body, at = 1, 0
    if lines[0].rstrip() == "---":
        for j in range(1, len(lines)):
            if lines[j].rstrip() == "---":
                body, at = j + 2, j + 1
                break
    headings: list[tuple[int, str, int]] = []
    code: list[tuple[int, int]] = []
    comments: list[tuple[int, int]] = []
    close, opened, comment, paragraph = None, 0, 0, False
    for i in range(at, len(lines)):
        line, no = lines[i].rstrip("\r"), i + 1
        if close:
            if close.match(line):
                code.append((opened, no))
                close = None
            continue
        if comment:
            if "-->" in line:
                comments.append((comment, no))
                comment = 0
            continue
        bare = line.strip()
        if not bare:
            paragraph = False
            continue
        first = bare[0]
        if first in "`~" and (m := _FENCE.match(line)):
            mark = m[1] or m[2]
            close, opened, paragraph = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$"), no, False
        elif "<!--" in line and "-->" not in line.split("<!--", 1)[1]:
            comment, paragraph = no, False
        elif first == "#" and (m := _ATX.match(line)):
            headings.append((len(m[1]), m[2] or "", no))
            paragraph = False
        elif paragraph and first in "=-" and (m := _SETEXT.match(line)):
            headings.append((1 if m[1][0] == "=" else 2, lines[i - 1].strip(), no - 1))
            paragraph = False
        else:
            paragraph = not _NOT_PARAGRAPH.match(line)
    if close:
        code.append((opened, len(lines)))
    if comment:
        comments.append((comment, len(lines)))
    return Page(lines, body, headings, code, comments)


def sections(page: Page, starts: list[int] | None = None) -> list[tuple[int, int]]:
    """(first line, last line) of each section; the lines before the first heading are one too."""
    at = sorted({n for n in (starts if starts is not None else [h[2] for h in page.headings]) if n >= page.body})
    if not at or at[0] > page.body:
        at = [page.body, *at]
    ends = [n - 1 for n in at[1:]] + [len(page.lines)]
    return [(a, b) for a, b in zip(at, ends) if a <= b]
