"""Relations declared by rules, references with their places, corrections, and sets of paths."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliospark.functions import text as T


def link_edges(links: DataFrame, relation: str, include: str | None = None, section: str | None = None, syntax: str | None = None) -> DataFrame:
    """(source, relation, target) of a rule over links (source, target, syntax, sections).

    Only sources that match the glob ``include``, links under a heading ``section``, and links
    of ``syntax`` count, each where it is given; null targets don't.
    """
    rows = links.filter("source is not null and target is not null")
    if include is not None:
        rows = rows.filter(F.col("source").rlike(T.glob_regex(include)))
    if section is not None:
        rows = rows.filter(F.array_contains("sections", section))
    if syntax is not None:
        rows = rows.filter(F.col("syntax") == syntax)
    return rows.select("source", F.lit(relation).alias("relation"), "target")


def _path_of(pointer: str) -> str:
    """A JSON path of a JSON pointer; ``~1`` is a slash and ``~0`` a tilde in a name."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)


def field_items(pages: DataFrame, path: str, json: str, array_pointer: str) -> DataFrame:
    """(path, index, item): the items of the array a pointer names, as JSON; pages without it have none."""
    found = F.from_json(F.get_json_object(json, _path_of(array_pointer)), "array<string>")
    return pages.select(F.col(path).alias("path"), F.posexplode(found).alias("index", "item")).filter("item is not null")


def field_edges(pages: DataFrame, relation: str, array_pointer: str, target_pointer: str = "", type_pointer: str | None = None, type_value: str | None = None, path: str = "path", json: str = "frontmatter") -> DataFrame:
    """(source, relation, target, pointer) of a rule over an array of the frontmatter.

    An item counts if the value at ``type_pointer`` is ``type_value``, where both are given;
    its target is the text at ``target_pointer`` (empty: the item itself).
    """
    rows = field_items(pages, path, json, array_pointer)
    if type_pointer is not None and type_value is not None:
        rows = rows.filter(F.get_json_object("item", _path_of(type_pointer)) == type_value)
    target = F.get_json_object("item", _path_of(target_pointer)) if target_pointer else F.col("item")
    pointer = F.concat(F.lit(array_pointer + "/"), F.col("index").cast("string"), F.lit(target_pointer))
    return rows.select(F.col("path").alias("source"), F.lit(relation).alias("relation"), target.alias("target"), pointer.alias("pointer")).filter("target is not null")


def field_at(json: Column | str, pointer: str) -> Column:
    """The text at a JSON pointer; null where there is none or it is null."""
    return F.get_json_object(json, _path_of(pointer))


def of_type(pages: DataFrame, type_pointer: str, type_value: str, json: str = "frontmatter") -> DataFrame:
    """Pages whose frontmatter has the value at the pointer."""
    return pages.filter(F.get_json_object(json, _path_of(type_pointer)) == type_value)


def wiki_references(pages: DataFrame, path: str, text: str) -> DataFrame:
    """(path, raw, first_byte, end_byte): targets of wiki links outside code and comments with the bytes they stand at (end exclusive), once per place."""
    shut = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|<!--.*?-->", re.S)
    link = re.compile(r"\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]")

    def find(batches):
        for batch in batches:
            out = []
            for p, value in zip(batch["p"], batch["t"]):
                bare = shut.sub(lambda m: " " * len(m[0]), value) if value else ""
                for m in link.finditer(bare):
                    own = m[1].strip()
                    begin = m.start(1) + len(m[1]) - len(m[1].lstrip())
                    first = len(value[:begin].encode())
                    out.append((p, own, first, first + len(own.encode())))
            yield pd.DataFrame(out, columns=["path", "raw", "first_byte", "end_byte"])

    kind = pages.schema[path].dataType.simpleString()
    return pages.select(F.col(path).alias("p"), F.col(text).alias("t")).mapInPandas(find, f"path {kind}, raw string, first_byte bigint, end_byte bigint")


def corrected(segments: DataFrame, edits: DataFrame, by: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Segments with the corrections applied, and (edit, n) of corrections that don't name exactly one place.

    ``segments``: by, key, s, e, role, text; ``edits``: by, edit, s, e, role (null: any), before,
    after. A correction looks at segments whose time overlaps its own (touching is not
    overlapping) and that hold ``before``; it counts only if that stands there exactly once
    in all. Corrections of one segment are applied in their order.
    """
    a, b = segments.select(by, key, "s", "e", "role", "text").alias("a"), edits.filter("before != ''").alias("b")
    on = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.least("a.e", "b.e") > F.greatest("a.s", "b.s")) & (F.col("b.role").isNull() | (F.col("a.role") == F.col("b.role"))) & F.contains("a.text", F.col("b.before"))
    times = ((F.length("a.text") - F.length(F.replace(F.col("a.text"), F.col("b.before"), F.lit("")))) / F.length("b.before")).cast("bigint")
    hits = a.join(b, on).select(F.col(f"a.{key}").alias(key), "b.edit", "b.before", "b.after", times.alias("n"))
    total = hits.groupBy("edit").agg(F.sum("n").alias("n"))
    once = hits.join(total.filter("n = 1").select("edit"), "edit").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("edit", "before", "after"))).alias("_e"))

    # Each stands exactly once, so replacing all is replacing it.
    step = lambda t, x: F.replace(t, x["before"], x["after"])
    mended = segments.join(once, key, "left").withColumn("text", F.when(F.col("_e").isNotNull(), F.aggregate("_e", F.col("text"), step)).otherwise(F.col("text"))).drop("_e")
    refused = edits.select("edit").join(total, "edit", "left").fillna(0, ["n"]).filter("n != 1")
    return mended, refused


#: A page's identity in an address: 32 hexadecimal digits, with or without hyphens (a fixed form).
_PAGE_ID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32}"


def page_id_of(url: Column | str) -> Column:
    """The last page identity in an address's path or fragment, lower-case without hyphens; empty where there is none."""
    c = F.col(url) if isinstance(url, str) else url
    place = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"\?[^#]*", "")
    found = F.regexp_extract_all(F.coalesce(F.try_url_decode(place), place), F.lit(f"({_PAGE_ID})"), F.lit(1))
    return F.coalesce(F.lower(F.regexp_replace(F.element_at(F.when(F.size(found) > 0, found), -1), "-", "")), F.lit(""))


_SHUT = re.compile(r"^```.*?^```[ \t]*$|^~~~.*?^~~~[ \t]*$|\$\$.*?\$\$|(?<!\\)\$(?:\\.|[^$\n])+(?<!\\)\$|`[^`\n]*`", re.M | re.S)
_PAGE_LINK = re.compile(r"<page\s+url=\"(https://[^\"]+)\">(.*?)</page>|(?<!!)\[([^\]]+)\]\((https://[^)\s]+)\)")


def with_page_links(pages: DataFrame, paths: DataFrame, path: str, text: str) -> DataFrame:
    """(path, text): links and page tags to known pages written as relative paths, outside code and formulas.

    ``paths``: page_id, target. Addresses are exploded and joined, so no page table is sent
    to the tasks; links to pages that aren't known stay.
    """
    urls = F.regexp_extract_all(text, F.lit(r"(https://[^)\s\"]+)"), F.lit(1))
    asked = pages.select(F.col(path).alias("_p"), F.explode(F.array_distinct(urls)).alias("_u")).withColumn("page_id", page_id_of("_u")).filter("page_id != ''")
    known = asked.join(paths.select("page_id", "target"), "page_id").groupBy("_p").agg(F.map_from_entries(F.collect_list(F.struct("_u", T.relative_path(F.col("_p"), F.col("target"))))).alias("_m"))

    @F.pandas_udf(StringType())
    def rewrite(value: pd.Series, names: pd.Series) -> pd.Series:
        def one(t: str | None, m) -> str | None:
            held = dict(m) if m is not None else {}
            if not t or not held:
                return t

            def link(x: re.Match) -> str:
                to = held.get(x[1] or x[4])
                return f"[{x[2] if x[1] else x[3]}]({to})" if to else x[0]

            out, at = [], 0
            for s in _SHUT.finditer(t):
                out += [_PAGE_LINK.sub(link, t[at : s.start()]), s[0]]
                at = s.end()
            return "".join([*out, _PAGE_LINK.sub(link, t[at:])])

        return pd.Series([one(t, m) for t, m in zip(value, names)])

    return pages.select(F.col(path).alias("_p"), F.col(text).alias("_t")).join(known, "_p", "left").select(F.col("_p").alias(path), rewrite("_t", "_m").alias(text))


def referenced(assets: DataFrame, pages: DataFrame, text: str, asset: str = "path") -> DataFrame:
    """Assets whose path some page names in a Markdown link or image, or in a ``src`` or ``href``."""
    found = pages.select(F.explode(F.array_union(F.regexp_extract_all(text, F.lit(r"\]\(([^()\s]+)\)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\b(?:src|href)=[\"']([^\"']+)[\"']"), F.lit(1)))).alias("_a"))
    return assets.join(found.distinct(), F.col(asset) == F.col("_a"), "left_semi")


def united(*inventories: DataFrame) -> DataFrame:
    """Distinct paths of several inventories (path)."""
    return reduce(lambda a, b: a.unionByName(b), [i.select("path") for i in inventories]).filter("path is not null").distinct()


def within(small: DataFrame, large: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, contained, n_missing): for every group of ``small`` whether all its values are in the same group of ``large``; nulls are left out."""
    a, b = small.filter(F.col(value).isNotNull()).select(*by, value).distinct(), large.select(*by, value).distinct().withColumn("_in", F.lit(1))
    return a.join(b, [*by, value], "left").groupBy(*by).agg(F.count_if(F.col("_in").isNull()).alias("n_missing")).withColumn("contained", F.col("n_missing") == 0)


def identity_differences(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, side): what only one of two sets of identities has, ``missing`` or ``unexpected``; nulls equal nulls."""
    a, b = expected.select(*columns).distinct(), actual.select(*columns).distinct()
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("unexpected")))
