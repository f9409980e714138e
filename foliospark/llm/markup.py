"""Clean text from marked-up text, with its structure kept recognisable.

The labeller says which family every leaf belongs to; the leaf is then rewritten by
its family and shape. What comes out has one notation: ``#`` headings, ``- `` and
``1. `` lists, cells joined by `` | ``, fenced code, and formulas in dollars.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.labeller import Labeller
from foliospark.llm.leaves import FAMILIES, Leaf

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)")
_ALT = re.compile(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?((?:\{[^{}]*\})*)")
_ENVIRONMENT = re.compile(r"\\begin\{([A-Za-z]+)\*?\}(.*)\\end\{", re.S)
#: LaTeX names by what becomes of them (fixed values).
_HEADS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_DROPPED = frozenset("label ref eqref pageref cite citep citet index hspace vspace noindent bibliography usepackage documentclass".split())
_FORMULAS = frozenset("equation align gather multline eqnarray displaymath math".split())
_BLOCKS = frozenset("p div ul ol table section article header footer blockquote dl figure".split())


def _html(part: str, kind: str) -> str:
    if kind in ("comment", "doctype"):
        return ""
    if kind == "entity":
        return html.unescape(part).replace("\xa0", " ")
    close, name = _TAG.match(part).groups()
    name = name.lower()
    if name == "img":
        alt = _ALT.search(part)
        return (alt[1] or alt[2] or "") if alt else ""
    if re.fullmatch(r"h[1-6]", name):
        return "\n\n" if close else "\n\n" + "#" * int(name[1]) + " "
    if name == "li":
        return "" if close else "\n- "
    if name in ("td", "th"):
        return " | " if close else ""
    if name in ("tr", "br"):
        return "\n"
    if name == "pre":
        return "\n```\n"
    if name in _BLOCKS:
        return "\n\n"
    return ""


def _markdown(part: str, kind: str) -> str:
    if kind == "fence":
        lines = part.strip("\n").split("\n")
        inner = lines[1:-1] if len(lines) > 1 and re.match(r"\s*[`~]{3}", lines[-1]) else lines[1:]
        return "```\n" + "\n".join(inner) + "\n```"
    if kind == "hashes":
        return re.sub(r"[ \t]+#+[ \t]*$", "", part.strip())
    if kind == "underlined":
        head, line = part.strip("\n").rsplit("\n", 1)
        return ("# " if "=" in line else "## ") + head.strip()
    if kind in ("task", "bullet"):
        return re.match(r"[ \t]*", part)[0] + "- "
    if kind == "pipe":
        return " | "
    if kind in ("quote", "row", "ruler", "note", "definition"):
        return ""
    if kind in ("image", "link"):
        return re.match(r"!?\[([^\]]*)\]", part)[1]
    if kind == "autolink":
        return part[1:-1]
    if kind in ("strong", "strike"):
        return part[2:-2]
    if kind in ("stars", "unders"):
        return part[1:-1]
    return part


def _wiki(part: str, kind: str) -> str:
    if kind == "wiki_link":
        return part[2:-2].rsplit("|", 1)[-1].strip()
    if kind == "quotes":
        return part.strip("'")
    if kind == "equals":
        bare = part.strip()
        level = len(bare) - len(bare.lstrip("="))
        return "#" * level + " " + bare.strip("= \t")
    if kind == "template":
        values = [p.split("=", 1)[-1].strip() for p in part[2:-2].split("|")[1:]]
        return ", ".join(v for v in values if v)
    return " | " if kind == "pipe" else ""


def _latex(part: str, kind: str) -> str:
    if kind == "display":
        return "$$" + part[2:-2].strip() + "$$"
    if kind == "inline":
        return "$" + part[2:-2].strip() + "$"
    if kind == "dollar":
        return part
    if kind == "group":
        return re.sub(r"^\{\\[A-Za-z]+\s+", "", part)[:-1]
    if kind == "environment":
        name, body = _ENVIRONMENT.match(part).groups()
        if name in _FORMULAS:
            return "$$" + body.strip() + "$$"
        return "\n" + _COMMAND.sub(lambda m: _latex(m[0], "command"), body).strip() + "\n"
    name, args = _COMMAND.match(part).groups()
    given = re.findall(r"\{([^{}]*)\}", args)
    if name in _HEADS:
        return "\n\n" + "#" * _HEADS[name] + " " + " ".join(given) + "\n"
    if name == "item":
        return "\n- " + " ".join(given)
    if name == "footnote":
        return f" ({' '.join(given)})"
    return "" if name in _DROPPED else (given[-1] if given else "")


_BY = {"html": _html, "markdown": _markdown, "wiki": _wiki, "latex": _latex}


def render(text: str, leaves: list[Leaf], families) -> str:
    """The clean text of labelled leaves."""
    out = []
    for leaf, family in zip(leaves, families):
        part = text[leaf.start : leaf.end]
        if family and leaf.kind == "pipe" and out:
            out[-1] = out[-1].rstrip(" \t")
        out.append(_BY[FAMILIES[family]](part, leaf.kind) if family else part)
    joined = re.sub(r"[ \t]+\n", "\n", "".join(out))
    joined = re.sub(r"(?: \|)+[ \t]*(?=\n|\Z)", "", joined)
    return re.sub(r"\n{3,}", "\n\n", joined).strip()


#: Blocks of a page that are read as one sequence; more are read in stretches, so that no page is a task of its own.
STRETCH = 256
CLEANED = "_key bigint, families array<string>, clean_text string, n_leaves int, n_formulas int, n_code int"


def clean_markup(df: DataFrame, key: str, text: str, texts: bool = True, frontmatter: bool = False, page: str | None = None, order: str | None = None) -> DataFrame:
    """(key, families, clean_text, n_leaves, n_formulas, n_code), one row per key.

    ``families`` are the markup families found in the text, sorted. Every text is read
    whole; with ``page`` and ``order`` the texts of a page are read as one sequence in
    their order (a null page is a page of one text), without them each text is alone and
    not shuffled. Of repeated keys one stays. A null or empty text has no families and
    empty clean text; a null key is dropped. ``texts=False`` leaves the clean text out;
    ``frontmatter`` drops a leading block of fields, which is no text.
    """

    front = re.compile(r"\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)

    def rows_of(model: Labeller, pages: list[list[tuple[int, str]]]) -> pd.DataFrame:
        rows = []
        for own, labelled in zip(pages, model.label([[t for _, t in p] for p in pages])):
            for (k, value), (leaves, families) in zip(own, labelled):
                kinds = [(leaf.kind, f) for leaf, f in zip(leaves, families) if f]
                rows.append((k, sorted({FAMILIES[f] for _, f in kinds}), render(value, leaves, families) if texts else None, len(leaves), sum(n in ("display", "inline", "dollar", "environment") for n, _ in kinds), sum(n == "fence" for n, _ in kinds)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CLEANED.split(", ")])

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Labeller.load()
        last, own = None, []
        for batch in batches:
            pages: list[list[tuple[int, str]]] = []
            for place, k, value in zip(batch["_page"], batch["_key"], batch["_text"]):
                if place is None or place != last:
                    pages.append(own)
                    last, own = place, []
                if not own or own[-1][0] != k:
                    own.append((k, front.sub("", value) if frontmatter and value else value or ""))
            yield rows_of(model, [p for p in pages if p])
        if own:
            yield rows_of(model, [own])

    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"), *([F.col(page).alias("_p"), F.coalesce(F.col(order).cast("bigint"), F.lit(0)).alias("_o")] if page else []))
    if page:
        place = F.concat_ws("/", F.coalesce(F.col("_p").cast("string"), F.concat(F.lit("alone "), F.col("_key").cast("string"))), F.floor(F.col("_o") / STRETCH).cast("string"))
        rows = rows.withColumn("_page", place).repartition("_page").sortWithinPartitions("_page", "_o", "_key").select("_key", "_text", "_page")
    else:
        rows = rows.withColumn("_page", F.lit(None).cast("string"))
    return rows.mapInPandas(clean, CLEANED).dropDuplicates(["_key"]).withColumnRenamed("_key", key)
