"""Assembly of page reads into documents: matching, merging, selecting, aligning."""

from __future__ import annotations

import difflib
import json
import html
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliospark.functions.text import table_cells
from foliospark.operators.geometry import coverage, iou
from foliospark.operators.quality import similarity, token_coverage, words

#: Words that stay small inside a title (fixed values).
SMALL = frozenset("a an and as at but by for from in into nor of on or over per the to up via with".split())
#: Acronyms as they are written (fixed values).
ACRONYMS = {a.lower(): a for a in "AI AOR AORs API APIs CBZ CEO CEOs CFO CRM DjVu EPUB FAQ FAQs GFM HR IPO KPI KPIs MLX OCR OKR OKRs PDF SaaS SVG UI UX VC".split()}


def ratio(a: str, b: str) -> float:
    """Matching-block ratio of two texts."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


# --- scalar functions on text


@F.pandas_udf(StringType())
def pipe_table(text: pd.Series) -> pd.Series:
    """HTML tables as pipe tables: row spans repeat their cell, column spans pad, pipes are escaped; null without a table."""
    return text.map(lambda t: table_of(t) if t else None)


class _Table(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            held = dict(attrs)
            span = lambda k: max(1, min(200, int(held[k]))) if (held.get(k) or "").isdigit() else 1
            self.cell = ["", span("rowspan"), span("colspan")]
        elif tag == "br" and self.cell:
            self.cell[0] += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell:
            self.rows[-1].append((re.sub(r"\s+", " ", self.cell[0]).strip().replace("|", r"\|"), self.cell[1], self.cell[2]))
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[0] += data


def table_of(text: str) -> str | None:
    """The first HTML table of a text as a pipe table."""
    found = re.search(r"<table\b.*?</table>", text, re.S | re.I)
    if not found:
        return None
    parser = _Table()
    parser.feed(found[0])
    grid: list[list[str]] = []
    carried: dict[int, tuple[str, int]] = {}
    for row in parser.rows:
        line, cells = [], iter(row)
        item = next(cells, None)
        while item is not None or any(k >= len(line) for k in carried):
            at = len(line)
            if at in carried:
                value, left = carried.pop(at)
                line.append(value)
                if left > 1:
                    carried[at] = (value, left - 1)
            elif item is not None:
                value, down, across = item
                for k in range(across):
                    line.append(value if k == 0 else "")
                    if down > 1:
                        carried[at + k] = (value if k == 0 else "", down - 1)
                item = next(cells, None)
            else:
                line.append("")
        grid.append(line)
    wide = max((len(r) for r in grid), default=0)
    if not wide:
        return None
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in grid]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("content", StringType())])))
def math_spans(text: pd.Series) -> pd.Series:
    r"""Formulas of a text outside code: display (``$$``, ``\[``) and inline (``\(``, ``$``)."""
    code = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`", re.S)
    form = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$])([^$\n]*?)(?<=[^\s\\])\$(?![\d$])", re.S)

    def scan(value: str | None):
        if value is None:
            return None
        bare = code.sub(lambda m: " " * len(m[0]), value)
        return [{"kind": "display" if m[1] or m[2] else "inline", "content": next(g for g in m.groups() if g)} for m in form.finditer(bare)]

    return text.map(scan)


_KEPT = re.compile(r"\[\^[^\]]+\]|\]\([^)]*\)")
_TITLE_WORD = re.compile(r"([^A-Za-z0-9]*)(.*?)([^A-Za-z0-9']*)", re.S)


def _title_word(word: str, first: bool, last: bool) -> str:
    """One word of a title; ``first`` also stands for the first after a colon."""
    before, core, after = _TITLE_WORD.fullmatch(word).groups()
    if not core:
        return word
    parts = core.split("-")
    out = []
    for i, part in enumerate(parts):
        low = part.casefold()
        edge = first and i == 0 or last and i == len(parts) - 1
        mixed = part != part.lower() and part != part.upper()
        if low in ACRONYMS:
            out.append(ACRONYMS[low])
        elif low in SMALL and not edge:
            out.append(low)
        elif mixed or re.fullmatch(r"[IVXLCDM]+", part):
            out.append(part)
        else:
            out.append(low[:1].upper() + low[1:])
    return before + "-".join(out) + after


def title_cased(value: str) -> str:
    """A heading in title case.

    Small words stay small but at the ends and after a colon; a leading number or letter
    isn't the beginning. Acronyms are written as they are known; mixed spellings, Roman
    numbers, notes and link targets stay.
    """
    kept: list[str] = []
    bare = _KEPT.sub(lambda m: kept.append(m[0]) or f"\ue000{len(kept) - 1}\ue001", value)
    words = re.split(r"(\s+)", bare)
    at = [i for i, w in enumerate(words) if w and not w.isspace()]
    firsts = set(at[:1])
    if len(at) > 1 and re.fullmatch(r"\d+(?:\.\d+)*\.?|[A-Z]\.?", words[at[0]].strip("*_`[](){}")):
        firsts = {at[1]}
    firsts |= {b for a, b in zip(at, at[1:]) if words[a].rstrip("*_`])}").endswith(":")}
    for i in at:
        marks = re.split("(\ue000\\d+\ue001)", words[i])
        words[i] = "".join(m if m.startswith("\ue000") else _title_word(m, i in firsts, i == at[-1]) if m else "" for m in marks)
    return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], "".join(words))


@F.pandas_udf(StringType())
def title_case(text: pd.Series) -> pd.Series:
    """:func:`title_cased` of each text; null stays null."""
    return text.map(lambda t: title_cased(t) if t else t)


def anchors(headings: DataFrame, by: list[str], order: str, title: str) -> DataFrame:
    """Headings with ``anchor``: the slug of the title, later equal ones numbered from ``-1``."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}_\s-]", ""), r"\s", "-")
    rows = headings.withColumn("_s", bare)
    n = F.row_number().over(W.partitionBy(*by, "_s").orderBy(order)) - 1
    return rows.withColumn("anchor", F.when(n > 0, F.concat("_s", F.lit("-"), n.cast("string"))).otherwise(F.col("_s"))).drop("_s")


def hotwords(terms: DataFrame, term: str, order: str, most: int = 40) -> DataFrame:
    """Trimmed terms without repeats of another case, the first spelling kept. Empty or many-line terms, and too many, fail when read."""
    rows = terms.withColumn("_t", F.trim(term)).filter(F.assert_true((F.col("_t") != "") & ~F.col("_t").rlike(r"[\r\n]"), F.lit("a hotword must be one non-empty line")).isNull())
    first = rows.groupBy(F.lower("_t").alias("_l")).agg(F.min(F.struct(order, "_t")).alias("r"))
    total = first.agg(F.count("*")).scalar()
    return first.filter(F.assert_true(total <= most, F.lit("too many hotwords")).isNull()).select(F.col(f"r.{order}").alias(order), F.col("r._t").alias(term))


# --- pairs on one page


def repeated_regions(blocks: DataFrame, page: list[str], order: str, text: str = "markdown", box: str = "bbox", back: int | None = None, least: int = 64) -> DataFrame:
    """(page, order, earlier): blocks that repeat an earlier one of the page, and the first such.

    Same kind, boxes of IoU .85 or more, texts of ``least`` characters or more and ratio
    .85 or more. With ``back`` only that many blocks before are looked at. The ratio is worked out
    last, for pairs whose lengths allow it.
    """
    rows = blocks.filter((F.length(text) >= least) & F.col(box).isNotNull()).select(*page, order, "kind", F.col(text).alias("t"), F.col(box).alias("b"))
    other = rows.select(*page, F.col(order).alias("earlier"), "kind", F.col("t").alias("t2"), F.col("b").alias("b2"))
    near = rows.join(other, [*page, "kind"]).filter(F.col("earlier") < F.col(order))
    if back is not None:
        near = near.filter(F.col("earlier") >= F.col(order) - back)
    near = near.filter((iou(F.col("b"), F.col("b2")) >= 0.85) & (2 * F.least(F.length("t"), F.length("t2")) >= 0.85 * (F.length("t") + F.length("t2"))))
    return near.withColumn("_r", similarity("t", "t2")).filter("_r >= 0.85").groupBy(*page, order).agg(F.min("earlier").alias("earlier"))


def match_blocks(left: DataFrame, right: DataFrame, page: str, least: float = 0.55) -> DataFrame:
    """(page, l, r, score): greedy one-to-one matches of two reads of a page by ``0.75 ratio + 0.25 IoU``, best first.

    ``left`` and ``right``: page, id, text, bbox. A page is one task; it holds what one page has.
    """

    def match(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        scored = []
        for i, t, x in zip(a["id"], a["text"], a["bbox"]):
            for j, u, y in zip(b["id"], b["text"], b["bbox"]):
                t, u = t or "", u or ""
                if 2 * min(len(t), len(u)) < 0.4 * (len(t) + len(u)):
                    continue
                scored.append((0.75 * ratio(t, u) + 0.25 * _iou(x, y), i, j))
        used_l, used_r, out = set(), set(), []
        for score, i, j in sorted(scored, key=lambda s: (-s[0], s[1], s[2])):
            if score < least:
                break
            if i not in used_l and j not in used_r:
                used_l.add(i)
                used_r.add(j)
                out.append((key[0], i, j, round(score, 9)))
        return pd.DataFrame(out, columns=[page, "l", "r", "score"])

    columns = [page, "id", "text", "bbox"]
    kind = left.schema[page].dataType.simpleString()
    return left.select(*columns).groupBy(page).cogroup(right.select(*columns).groupBy(page)).applyInPandas(match, f"{page} {kind}, l bigint, r bigint, score double")


def _iou(a, b) -> float:
    if a is None or b is None:
        return 0.0
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    shared = max(0.0, w) * max(0.0, h)
    area = lambda q: max(0.0, q["x1"] - q["x0"]) * max(0.0, q["y1"] - q["y0"])
    united = area(a) + area(b) - shared
    return shared / united if united > 0 else 0.0


def unsupported_blocks(blocks: DataFrame, evidence: DataFrame, page: list[str], text: str = "markdown", least: float = 0.8) -> DataFrame:
    """Blocks without a box whose words the page's evidence (page, text) covers by less than ``least``."""
    known = evidence.groupBy(*page).agg(F.array_distinct(F.flatten(F.collect_list(words(F.coalesce("text", F.lit("")))))).alias("_e"))
    rows = blocks.filter("bbox is null").join(known, page, "left")
    return rows.filter(token_coverage(words(F.coalesce(F.col(text), F.lit(""))), F.coalesce("_e", F.array().cast("array<string>"))) < least).drop("_e")


def covered_links(blocks: DataFrame, found: DataFrame, page: list[str], key: str, least: float = 0.5) -> DataFrame:
    """(page, key, url): links (page, url, bbox) whose box a block covers by at least ``least``."""
    on = F.lit(True)
    for p in page:
        on = on & (F.col(f"a.{p}") == F.col(f"c.{p}"))
    return blocks.alias("a").join(found.alias("c"), on).filter(coverage(F.col("c.bbox"), F.col("a.bbox")) >= least).select(*[f"a.{p}" for p in page], f"a.{key}", "c.url")


def footnote_pairs(markers: DataFrame, notes: DataFrame, page: list[str], label: str = "label") -> DataFrame:
    """Markers joined with the note of their page and label, where both are there once."""
    once = lambda d: d.join(d.groupBy(*page, label).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n"), [*page, label])
    return once(markers).join(once(notes), [*page, label])


# --- across pages


def next_page_paragraphs(pages: DataFrame, book: str, page: str, last: str, first: str) -> DataFrame:
    """(book, page, joined): whether the last block of a page runs on in the first of the next.

    It does if the next page follows, the block ends no sentence and the next begins small,
    or the block ends in a dividing hyphen.
    """
    # What the ends of a page say is told before the sort, so no text is moved.
    ends = F.when(F.col(last).rlike(r"\p{L}-\s*$"), 2).when(~F.col(last).rlike(r"[.!?:…»\"”)]\s*$"), 1).otherwise(0)
    rows = pages.select(book, page, ends.alias("_e"), F.col(first).rlike(r"^\s*\p{Ll}").alias("_small"))
    w = W.partitionBy(book).orderBy(page)
    runs_on = (F.col("_e") == 2) | ((F.col("_e") == 1) & F.lead("_small").over(w))
    return rows.withColumn("joined", F.coalesce((F.lead(page).over(w) == F.col(page) + 1) & runs_on, F.lit(False))).select(book, page, "joined")


def paragraph_chains(joined: DataFrame, book: str, page: str) -> DataFrame:
    """(book, page, chain): pages numbered by the paragraph that joins them with the page before."""
    w = W.partitionBy(book).orderBy(page)
    new = F.when(F.coalesce(F.lag("joined").over(w), F.lit(False)), 0).otherwise(1)
    return joined.withColumn("_new", new).withColumn("chain", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).select(book, page, "chain")


def merged_table(a: list[list[str]], b: list[list[str]], most: int = 20) -> list[list[str]] | None:
    """Rows of a table continued in another: a repeated header and up to ``most`` repeated rows count once; None if the widths differ."""
    if not a or not b or len(a[0]) != len(b[0]):
        return None
    rest = b[1:] if b[0] == a[0] else b
    for n in range(min(most, len(a), len(rest)), 0, -1):
        if a[-n:] == rest[:n]:
            return a + rest[n:]
    return a + rest


def continued_tables(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """(book, first_page, n_pages, n_rows): pipe tables at page ends merged with those the next page begins with.

    Pages are read where they are; only the cells of pages with a table are sent to their
    book, which is one task.
    """

    def cells_of(batches):
        for batch in batches:
            out = []
            for b, no, value in zip(batch[book], batch[page], batch[text]):
                cells = [[c.strip() for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))] for x in (value or "").split("\n") if x.strip().startswith("|") and not re.fullmatch(r"[\s|:-]+", x)]
                if cells:
                    out.append((b, no, json.dumps(cells)))
            yield pd.DataFrame(out, columns=[book, page, "_cells"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for no, held in sorted(zip(rows[page], rows["_cells"])):
            cells = json.loads(held)
            joined = merged_table(out[-1][3], cells) if out and out[-1][1] + out[-1][2] == no else None
            if joined is not None:
                out[-1][2], out[-1][3] = out[-1][2] + 1, joined
            else:
                out.append([rows[book].iloc[0], no, 1, cells])
        return pd.DataFrame([(b, f, n, len(r)) for b, f, n, r in out], columns=[book, "first_page", "n_pages", "n_rows"])

    kind, number = pages.schema[book].dataType.simpleString(), pages.schema[page].dataType.simpleString()
    found = pages.select(book, page, text).mapInPandas(cells_of, f"{book} {kind}, {page} {number}, _cells string")
    return found.groupBy(book).applyInPandas(merge, f"{book} {kind}, first_page bigint, n_pages int, n_rows int")


def chapter_starts(outline: DataFrame, contents: DataFrame, headings: DataFrame, book: str) -> DataFrame:
    """(book, page, title, source, confidence, last_page): chapters by the best source a book has.

    ``outline`` (1.0), matched ``contents`` (0.85) and ``headings`` (0.8) each have book, page, title.
    """
    tagged = [d.select(book, "page", "title", F.lit(n).alias("source"), F.lit(c).alias("confidence")) for d, n, c in ((outline, "outline", 1.0), (contents, "contents", 0.85), (headings, "headings", 0.8))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    best = rows.groupBy(book).agg(F.max("confidence").alias("confidence"))
    kept = rows.join(best, [book, "confidence"]).groupBy(book, "source", "confidence", "page").agg(F.min("title").alias("title"))
    return kept.withColumn("last_page", F.lead("page").over(W.partitionBy(book).orderBy("page")) - 1)


def match_contents(entries: DataFrame, headings: DataFrame, book: str, least: float = 0.82) -> DataFrame:
    """(book, entry_no, title, page): each entry of a table of contents with the most similar heading after the last match. A book is one task."""

    def match(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        heads = sorted(zip(b["page"], b["title"]))
        out, after = [], -1
        for no, title in sorted(zip(a["entry_no"], a["title"])):
            scored = [(ratio((title or "").lower(), (h or "").lower()), -p, p) for p, h in heads if p > after]
            if scored and max(scored)[0] >= least:
                after = max(scored)[2]
                out.append((key[0], no, title, after))
        return pd.DataFrame(out, columns=[book, "entry_no", "title", "page"])

    kind = entries.schema[book].dataType.simpleString()
    return entries.groupBy(book).cogroup(headings.groupBy(book)).applyInPandas(match, f"{book} {kind}, entry_no bigint, title string, page bigint")


def align_pages(segments: list[str], pages: list[str]) -> list[tuple[int, int, int]]:
    """(page, first segment, end) of the monotone division of segments over pages that maximises similarity less 0.01 a segment off the even share."""
    n, m = len(segments), len(pages)
    even = n / max(m, 1)
    best = np.full((m + 1, n + 1), -np.inf)
    back = np.zeros((m + 1, n + 1), int)
    best[0, 0] = 0
    for p in range(1, m + 1):
        for end in range(n + 1):
            for begin in range(end + 1):
                if best[p - 1, begin] == -np.inf:
                    continue
                value = best[p - 1, begin] + ratio("\n".join(segments[begin:end]), pages[p - 1]) - 0.01 * abs(end - begin - even)
                if value > best[p, end]:
                    best[p, end], back[p, end] = value, begin
    out, end = [], n
    for p in range(m, 0, -1):
        out.append((p - 1, int(back[p, end]), end))
        end = int(back[p, end])
    return out[::-1]


# --- choosing between reads


def consensus(candidates: DataFrame, page: list[str], key: str, text: str, penalty: Column | None = None, primary: Column | None = None) -> DataFrame:
    """(page, key, score): the read that is on average most similar to the page's others, less its penalty; the primary wins ties."""
    rows = candidates.select(*page, F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"), (penalty if penalty is not None else F.lit(0.0)).alias("_p"), (primary if primary is not None else F.lit(False)).alias("_first"))
    other = rows.select(*page, F.col("_k").alias("_k2"), F.col("_t").alias("_t2"))
    both = rows.join(other, page, "left").withColumn("_s", F.when(F.col("_k") != F.col("_k2"), similarity("_t", "_t2")))
    scored = both.groupBy(*page, "_k", "_p", "_first").agg(F.avg("_s").alias("_s")).withColumn("score", F.round(F.coalesce("_s", F.lit(0.0)) - F.col("_p"), 9))
    order = W.partitionBy(*page).orderBy(F.desc("score"), F.desc("_first"), "_k")
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*page, F.col("_k").alias(key), "score")


def supported_choice(candidates: DataFrame, page: list[str], key: str, precision: float = 0.65, recall: float = 0.7, gain: float = 0.18, least: int = 2) -> DataFrame:
    """(page, key): the best candidate (precision, recall, base_recall, supported) that is precise, complete and clearly better than the base."""
    good = candidates.filter((F.col("precision") >= precision) & (F.col("recall") >= recall) & (F.col("recall") - F.col("base_recall") >= gain) & (F.col("supported") >= least))
    return good.groupBy(*page).agg(F.max(F.struct(F.col("recall"), F.col("precision"), (-F.col(key)).alias("_k"))).alias("m")).select(*page, (-F.col("m._k")).alias(key))


def boundary_repeats(segments: DataFrame, track: str, least: float = 0.5, like: float = 0.65) -> DataFrame:
    """(track, id): segments (id, s, e, speaker, text) that repeat an overlapping one of the same speaker; the longer text stays. A track is one task."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        gone = []
        for r in rows.sort_values(["s", "e", "id"]).to_dict("records"):
            rival = next((k for k in reversed(kept) if k["speaker"] == r["speaker"] and min(k["e"], r["e"]) - max(k["s"], r["s"]) >= least and ratio((k["text"] or "").lower(), (r["text"] or "").lower()) >= like), None)
            if rival is None:
                kept.append(r)
            elif len(r["text"] or "") > len(rival["text"] or ""):
                kept[kept.index(rival)] = r
                gone.append((r[track], rival["id"]))
            else:
                gone.append((r[track], r["id"]))
            kept = [k for k in kept if k["e"] > r["s"] - 60]
        return pd.DataFrame(gone, columns=[track, "id"])

    kind = segments.schema[track].dataType.simpleString()
    return segments.select(track, "id", "s", "e", "speaker", "text").groupBy(track).applyInPandas(find, f"{track} {kind}, id bigint")


def quietest_cut(samples: DataFrame, by: list[str], at: str, level: str, ideal: Column, span: int) -> DataFrame:
    """(by, cut): where the mean square of the last ``span`` samples is least; of equals the one nearest to ``ideal``."""
    w = W.partitionBy(*by).orderBy(at).rowsBetween(-(span - 1), 0)
    rows = samples.withColumn("_e", F.avg(F.col(level) * F.col(level)).over(w)).withColumn("_n", F.count("*").over(w)).filter(F.col("_n") == span)
    return rows.groupBy(*by).agg(F.min_by(at, F.struct(F.round("_e", 9), F.abs(F.col(at) - ideal), F.col(at))).alias("cut"))


def quality_warnings(text: Column) -> Column:
    """Sorted names of what looks wrong with a read."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    flags = [
        ("empty", F.trim(text) == ""), ("very_long", F.length(text) > 20_000), ("replacement_characters", F.contains(text, F.lit("�"))),
        ("repeated_lines", (F.size(lines) >= 12) & (F.size(F.array_distinct(lines)) * 10 <= F.size(lines) * 6)),
        ("open_fence", F.size(F.regexp_extract_all(text, F.lit(r"(?m)(^ {0,3}```)"), F.lit(1))) % 2 == 1),
        ("ragged_table", F.size(F.array_distinct(F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*\|.*\|\s*$")), lambda x: F.size(table_cells(x))))) > 1),
    ]
    return F.sort_array(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags])))


def plain_entities(text: str) -> str:
    """A text with its character references resolved."""
    return html.unescape(text)
