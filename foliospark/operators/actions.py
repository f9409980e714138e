"""Documents as objects for trusted functions, actions on them, and derived results kept by fingerprint."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.pages import scan_page, sections
from foliospark.operators.chunks import frontmatter_of

_ENTRY = re.compile(r"^[-*+][ \t]+(?:\[?(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})?)?)\]?[ \t:–—-]*)?(.*)$")
_TARGET = re.compile(r"(?<!!)\[[^\]\n]*\]\(([^()\s]+)\)|\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]")


def _targets(text: str) -> list[str]:
    return [m[1] or m[2].strip() for m in _TARGET.finditer(text)]


def document_of(path: str, text: str) -> dict[str, Any]:
    """A page as an object: path, text, frontmatter, links, and sections by name.

    A section has text, level, line and entries (the items of its list, with timestamp, text,
    line and links). Of sections of one name the first counts; the title's page has its name too.
    """
    page = scan_page(text)
    held: dict[str, Any] = {}
    bounds = {a: b for a, b in sections(page)}
    for level, title, line in page.headings:
        if title in held:
            continue
        own = page.lines[line : bounds.get(line, len(page.lines))]
        entries: list[dict[str, Any]] = []
        for n, row in enumerate(own, line + 1):
            if m := _ENTRY.match(row):
                entries.append({"timestamp": m[1], "text": m[2], "line": n, "links": _targets(row)})
            elif entries and row[:1].isspace() and row.strip():
                entries[-1]["text"] += " " + row.strip()
                entries[-1]["links"] += _targets(row)
        held[title] = {"text": "\n".join(own).strip(), "level": level, "line": line, "entries": entries}
    fields, _ = frontmatter_of(text)
    return {"path": path, "text": text, "frontmatter": fields or {}, "sections": held, "links": _targets(text)}


def updated(document: dict[str, Any], fields: dict[str, Any], timeline: str | None = None, section: str = "Timeline") -> str:
    """The page's text with frontmatter fields set (None removes one) and an entry added at the end of a section.

    The section is made where it isn't there; other lines stay as they are.
    """
    text = document["text"]
    if fields:
        lines = text.split("\n")
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), 0) if lines[0].strip() == "---" else 0
        kept = [x for x in lines[1:end] if x.split(":", 1)[0].strip() not in fields]
        added = [f"{k}: {v if isinstance(v, str) and re.fullmatch(r'[A-Za-z][A-Za-z0-9 ]*', v) else json.dumps(v, ensure_ascii=False)}" for k, v in fields.items() if v is not None]
        text = "\n".join(["---", *kept, *added, "---", *lines[end + 1 if end else 0 :]])
    if timeline:
        page = scan_page(text)
        at = next((line for _, title, line in page.headings if title == section), None)
        if at is None:
            return text.rstrip("\n") + f"\n\n## {section}\n\n- {timeline}\n"
        end = next((b for a, b in sections(page) if a == at), len(page.lines))
        while end > at and not page.lines[end - 1].strip():
            end -= 1
        lines = text.split("\n")
        lines[end:end] = [f"- {timeline}"] if end > at else ["", f"- {timeline}"]
        text = "\n".join(lines)
    return text


def acted(pages: DataFrame, action: Callable[[dict[str, Any]], str | None], where: Column | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """(path, text, outcome, error): the pages an action changes, by a trusted function of the document object.

    The action gives the new text, or None to leave a page; the outcome is ``updated``,
    ``unchanged`` or ``rejected`` with the error. One page's error fails that page only. A null text is
    an empty page. Functions run in the tasks without limits: they are trusted code.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, t in zip(batch["p"], batch["t"]):
                try:
                    new = action(document_of(p, t or ""))
                    if new is not None and not isinstance(new, str):
                        raise TypeError("an action gives a text or None")
                    out.append((p, t if new is None else new, "unchanged" if new is None or new == t else "updated", None))
                except Exception as error:  # noqa: BLE001
                    out.append((p, t, "rejected", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "text", "outcome", "error"])

    rows = pages if where is None else pages.filter(where)
    return rows.select(F.col(path).alias("p"), F.col(text).alias("t")).mapInPandas(run, f"path {pages.schema[path].dataType.simpleString()}, text string, outcome string, error string")


def stale_results(sources: DataFrame, kept: DataFrame, key: str, fields: list[str], recipe: str) -> DataFrame:
    """(key, fingerprint, reason): derived results to be made: ``missing``, or ``outdated`` where the recipe or a declared field changed.

    ``kept``: key, fingerprint. Other columns of the source don't matter, so their change
    makes nothing new. ``orphan`` results are those whose source is gone.
    """
    own = F.sha2(F.to_json(F.struct(F.lit(recipe).alias("recipe"), *[F.col(f) for f in fields])), 256)
    wanted = sources.select(F.col(key).alias("_k"), own.alias("_w")).dropDuplicates(["_k"])
    held = kept.groupBy(key).agg(F.max("fingerprint").alias("_f"))
    both = wanted.join(held, F.col("_k") == F.col(key), "full")
    reason = F.when(F.col("_k").isNull(), "orphan").when(F.col("_f").isNull(), "missing").when(F.col("_f") != F.col("_w"), "outdated")
    return both.select(F.coalesce("_k", key).alias(key), F.col("_w").alias("fingerprint"), reason.alias("reason")).filter("reason is not null")


def sync_state(local: Column, base: Column, server: Column, valid: Column) -> Column:
    """What a background synchronisation does by revisions: ``nothing``, ``fast-forward``, ``push``, or ``blocked`` where both moved or what came is invalid."""
    moved_here, moved_there = ~local.eqNullSafe(base), ~server.eqNullSafe(base)
    return (
        F.when(local.eqNullSafe(server), F.lit("nothing")).when(moved_here & moved_there, F.lit("blocked")).when(moved_there & ~F.coalesce(valid, F.lit(False)), F.lit("blocked"))
        .when(moved_there, F.lit("fast-forward")).otherwise(F.lit("push"))
    )
