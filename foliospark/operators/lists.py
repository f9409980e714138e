"""Lists of scanned pages: items with their markers, nesting and ordinals, followed over pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Signs that begin an unordered item (fixed values).
BULLETS = "-*+•▪◦‣·"
#: Columns by which indentations of one level may differ.
SLACK = 1
_MARKER = re.compile(rf"^([ \t]*)(?:([{re.escape(BULLETS)}])|\(?(\d{{1,3}}|[A-Za-z]|[ivxlcdm]{{2,7}}|[IVXLCDM]{{2,7}})[.)])[ \t]+(\S.*)$")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}

ITEMS = "list_no int, item_no int, level int, style string, ordinal int, text string, at_top boolean, at_end boolean"


class Item(NamedTuple):
    """One item: what its ordinal would be in each style it may have."""

    indent: int
    label: str
    values: dict[str, int]
    text: str


def roman_value(label: str) -> int | None:
    """Value of a well-formed Roman numeral, None for other words."""
    low = label.lower()
    if not low or not re.fullmatch(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", low):
        return None
    values = [_ROMAN[c] for c in low]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))


def parse_marker(line: str) -> Item | None:
    """The item a line begins, or None. A single letter may count as a letter and as a Roman numeral."""
    m = _MARKER.match(line)
    if not m:
        return None
    indent = len(m[1].expandtabs(4))
    if m[2]:
        return Item(indent, m[2], {"bullet": 0}, m[4].strip())
    label, values = m[3], {}
    if label.isdigit():
        values["decimal"] = int(label)
    else:
        if len(label) == 1:
            values["alpha"] = ord(label.lower()) - 96
        if (n := roman_value(label)) is not None:
            values["roman"] = n
    return Item(indent, label, values, m[4].strip()) if values else None


def _levels(items: list[Item]) -> list[int]:
    """Nesting by indentation: an item deeper than the one before by more than the slack opens a level."""
    out, stack = [], []
    for item in items:
        while len(stack) > 1 and item.indent < stack[-1] - SLACK:
            stack.pop()
        if not stack:
            stack.append(item.indent)
        elif item.indent > stack[-1] + SLACK:
            stack.append(item.indent)
        elif len(stack) == 1 and item.indent < stack[0]:
            stack[0] = item.indent
        out.append(len(stack) - 1)
    return out


def _styles(items: list[Item], levels: list[int]) -> list[str]:
    """The style of each item: what goes on from the item before on its level, else what the next goes on from."""
    out: list[str] = []
    before: dict[int, int] = {}
    for i, (item, level) in enumerate(zip(items, levels)):
        for deeper in [k for k in before if k > level]:
            del before[deeper]
        style = None
        if len(item.values) == 1:
            style = next(iter(item.values))
        elif level in before:
            j = before[level]
            style = out[j] if item.values.get(out[j]) == items[j].values.get(out[j], -9) + 1 else None
        if style is None:
            after = next((items[k] for k in range(i + 1, len(items)) if levels[k] <= level), None)
            fits = [s for s, v in item.values.items() if after is not None and after.values.get(s) == v + 1]
            style = fits[0] if len(fits) == 1 else "roman" if item.values.get("roman") == 1 and not fits else "alpha"
        out.append(style)
        before[level] = i
    return out


def lists_of(text: str | None) -> list[tuple[int, int, int, str, int, str, bool, bool]]:
    """:data:`ITEMS` of a page. A list ends at text that isn't indented under it after an empty line, at headings and at rulers.

    Lines without a marker go on the item before them; a word divided there is joined.
    """
    lists: list[tuple[list[Item], int, int]] = []
    held: list[Item] = []
    first = last = 0
    blank = False
    lines = (text or "").split("\n")
    for no, line in enumerate(lines):
        if not line.strip():
            blank = True
            continue
        item = None if re.match(r"[ \t]*(?:-{3,}|\*{3,}|#{1,6}[ \t])", line) else parse_marker(line)
        if item:
            if not held:
                first = no
            held.append(item)
            last = no
        elif held and (not blank or line[:1].isspace()) and not re.match(r"[ \t]*(?:#{1,6}[ \t]|-{3,}|```|\|)", line):
            own = held[-1].text
            more = line.strip()
            joined = own[:-1] + more if re.search(r"[^\W\d_]-$", own) and more[:1].islower() else f"{own} {more}"
            held[-1] = held[-1]._replace(text=joined)
            last = no
        elif held:
            lists.append((held, first, last))
            held = []
        blank = False
    if held:
        lists.append((held, first, last))
    out = []
    for list_no, (items, a, b) in enumerate(lists):
        levels = _levels(items)
        top, end = not any(x.strip() for x in lines[:a]), not any(x.strip() for x in lines[b + 1 :])
        for n, (item, level, style) in enumerate(zip(items, levels, _styles(items, levels))):
            out.append((list_no, n, level, style, item.values[style], item.text, top, end))
    return out


def page_lists(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """(book, page, ...) with :data:`ITEMS` of every page, read where it is; pages without lists have no rows."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(b, p, *row) for b, p, t in zip(batch["b"], batch["p"], batch["t"]) for row in lists_of(t)]
            yield pd.DataFrame(out, columns=[book, page, *(c.split()[0] for c in ITEMS.split(", "))])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select(F.col(book).alias("b"), F.col(page).alias("p"), F.col(text).alias("t")).mapInPandas(parse, f"{book} {kind(book)}, {page} {kind(page)}, {ITEMS}")


def stitched_lists(items: DataFrame, book: str, page: str) -> DataFrame:
    """Items with ``first_page`` and ``first_list``, the page and number where their list begins.

    The last list of a page goes on in the first of the next if nothing stands between and
    their outer items have one style, in order where they are numbered. Only one row per
    list is sorted by page.
    """
    outer = items.filter("level = 0")
    ends = outer.groupBy(book, page, "list_no").agg(F.min(F.struct("item_no", "style", "ordinal")).alias("a"), F.max(F.struct("item_no", "style", "ordinal")).alias("z"), F.max("at_top").alias("at_top"), F.max("at_end").alias("at_end"))
    w = W.partitionBy(book).orderBy(page, "list_no")
    before = lambda c: F.lag(c).over(w)
    goes_on = (before(page) == F.col(page) - 1) & before("at_end") & F.col("at_top") & (before("z.style") == F.col("a.style")) & ((F.col("a.style") == "bullet") | (before("z.ordinal") + 1 == F.col("a.ordinal")))
    begins = F.when(~F.coalesce(goes_on, F.lit(False)), F.struct(F.col(page).alias("p"), F.col("list_no").alias("n")))
    heads = ends.withColumn("_h", begins).withColumn("_h", F.last("_h", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).select(book, page, "list_no", F.col("_h.p").alias("first_page"), F.col("_h.n").alias("first_list"))
    return items.join(heads, [book, page, "list_no"])


def rendered(rows: list[tuple[int, str, int, str]]) -> str:
    """Markdown of a list's (level, style, ordinal, text): bullets as ``-``, numbers kept, letters and Roman numerals in bold."""
    out = []
    for level, style, ordinal, text in rows:
        mark = "-" if style == "bullet" else f"{ordinal}." if style == "decimal" else f"- **{chr(96 + ordinal) if style == 'alpha' else _roman(ordinal)}.**"
        out.append("    " * level + f"{mark} {text}")
    return "\n".join(out)


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + sign * (n // value), n % value
    return out
