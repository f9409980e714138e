"""A schema language for pages, compiled to column expressions that give findings."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One frontmatter field: kind, whether it must be there or may be null, and its limits."""

    kind: str
    required: bool = False
    nullable: bool = False
    limits: dict[str, Any] = field(default_factory=dict)


def string(required: bool = False, nullable: bool = False, **limits: Any) -> Field:
    """A string; limits ``min_length``, ``max_length``, ``pattern``."""
    return Field("string", required, nullable, limits)


def integer(required: bool = False, nullable: bool = False, **limits: Any) -> Field:
    """A whole number; limits ``minimum``, ``maximum``."""
    return Field("integer", required, nullable, limits)


def boolean(required: bool = False, nullable: bool = False) -> Field:
    """True or false."""
    return Field("boolean", required, nullable)


def enum(values: list[str], required: bool = False, nullable: bool = False) -> Field:
    """One of the given strings."""
    return Field("enum", required, nullable, {"values": tuple(values)})


def list_of(required: bool = False, nullable: bool = False, **limits: Any) -> Field:
    """A list of strings; limits ``min_items``, ``unique``."""
    return Field("list", required, nullable, limits)


@dataclass(frozen=True)
class Schema:
    """Rules of one kind of page."""

    fields: dict[str, Field]
    allow_extra: bool = False
    sections: tuple[str, ...] = ()
    ordered_sections: bool = False
    extra_sections: bool = True
    filename: str | None = None


def _check(name: str, rule: Field, doc: Column) -> list[tuple[str, Column]]:
    path = f"$.{name}"
    kind = F.schema_of_variant(F.variant_get(doc, path, "variant"))
    there = F.array_contains(F.json_object_keys(F.to_json(doc)), name)
    null = there & (F.coalesce(kind, F.lit("VOID")) == "VOID")
    value = there & ~null
    out: list[tuple[str, Column]] = []
    if rule.required:
        out.append(("missing", ~there))
    if not rule.nullable:
        out.append(("null", null))
    text = F.try_variant_get(doc, path, "string")
    wanted = {"string": kind == "STRING", "integer": kind.isin("BIGINT"), "boolean": kind == "BOOLEAN", "enum": kind == "STRING", "list": kind.startswith("ARRAY")}[rule.kind]
    out.append(("type", value & ~wanted))
    good = value & wanted
    lim = rule.limits
    if rule.kind == "enum":
        out.append(("value", good & ~text.isin(*lim["values"])))
    if "min_length" in lim:
        out.append(("too short", good & (F.length(text) < lim["min_length"])))
    if "max_length" in lim:
        out.append(("too long", good & (F.length(text) > lim["max_length"])))
    if "pattern" in lim:
        out.append(("pattern", good & ~text.rlike(lim["pattern"])))
    number = F.try_variant_get(doc, path, "bigint")
    if "minimum" in lim:
        out.append(("too small", good & (number < lim["minimum"])))
    if "maximum" in lim:
        out.append(("too large", good & (number > lim["maximum"])))
    items = F.try_variant_get(doc, path, "array<string>")
    if "min_items" in lim:
        out.append(("too few", good & (F.size(items) < lim["min_items"])))
    if lim.get("unique"):
        out.append(("repeated", good & (F.size(items) != F.size(F.array_distinct(items)))))
    return out


def field_findings(pages: DataFrame, key: str, frontmatter: str, schema: Schema) -> DataFrame:
    """(key, field, finding) of the frontmatter (a JSON string) of each page.

    No frontmatter (null) is an empty one; JSON that can't be read gives one finding for
    the whole. All rules are one expression per row: no shuffle, one pass.
    """
    raw = F.coalesce(F.col(frontmatter), F.lit("{}"))
    doc = F.try_parse_json(raw)
    rows = pages.select(F.col(key).alias("_k"), raw.alias("_raw"), doc.alias("_doc"))
    d = F.col("_doc")
    cells = [F.when(d.isNull(), F.struct(F.lit("").alias("field"), F.lit("unreadable").alias("finding")))]
    for name, rule in schema.fields.items():
        for finding, bad in _check(name, rule, d):
            cells.append(F.when(d.isNotNull() & F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit(finding).alias("finding"))))
    found = F.array_compact(F.array(*cells))
    if not schema.allow_extra:
        known = F.array(*[F.lit(n) for n in schema.fields]) if schema.fields else F.array().cast("array<string>")
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys("_raw"), F.array().cast("array<string>")), known), lambda n: F.struct(n.alias("field"), F.lit("unknown").alias("finding")))
        found = F.concat(found, extra)
    return rows.select(F.col("_k").alias(key), F.explode(found).alias("_f")).select(key, "_f.field", "_f.finding")


def section_findings(pages: DataFrame, key: str, headings: str, schema: Schema, level: int = 2) -> DataFrame:
    """(key, field, finding) of a page's sections: missing, repeated, unknown, out of order.

    ``headings``: array of (level, text, line); null is none.
    """
    names = F.transform(F.filter(F.coalesce(F.col(headings), F.array().cast(pages.schema[headings].dataType)), lambda h: h["level"] == level), lambda h: h["text"])
    rows = pages.select(F.col(key).alias("_k"), names.alias("_n"))
    wanted = F.array(*[F.lit(s) for s in schema.sections]) if schema.sections else F.array().cast("array<string>")
    tell = lambda items, finding: F.transform(items, lambda n: F.struct(n.alias("field"), F.lit(finding).alias("finding")))
    parts = [tell(F.array_except(wanted, "_n"), "missing"), tell(F.filter(F.array_distinct("_n"), lambda n: F.size(F.filter("_n", lambda x: x == n)) > 1), "repeated")]
    if not schema.extra_sections:
        parts.append(tell(F.array_except("_n", wanted), "unknown"))
    if schema.ordered_sections:
        places = F.filter(F.transform(wanted, lambda s: F.struct(s.alias("s"), F.array_position("_n", s).alias("p"))), lambda x: x["p"] > 0)
        late = F.filter(F.transform(places, lambda x, i: F.when((i > 0) & (x["p"] < F.get(places, F.greatest(i - 1, F.lit(0)))["p"]), x["s"])), lambda s: s.isNotNull())
        parts.append(tell(late, "out of order"))
    return rows.select(F.col("_k").alias(key), F.explode(F.concat(*parts)).alias("_f")).select(key, "_f.field", "_f.finding")


def filename_findings(pages: DataFrame, path: str, pattern: str) -> DataFrame:
    """(path, field, finding) of pages whose file name doesn't match the whole pattern."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    return pages.filter(~name.rlike(f"^(?:{pattern})$")).select(F.col(path), F.lit("filename").alias("field"), F.lit("pattern").alias("finding"))


def next_serials(pages: DataFrame, path: str, pattern: str) -> DataFrame:
    """(scope, next_serial): one more than the greatest serial of each scope; group 1 of the pattern is the scope, group 2 the serial."""
    rows = pages.select(F.regexp_extract(F.col(path), pattern, 1).alias("scope"), F.try_to_number(F.regexp_extract(F.col(path), pattern, 2), F.lit("999999999999")).cast("bigint").alias("n"))
    return rows.filter("n is not null").groupBy("scope").agg((F.max("n") + 1).alias("next_serial"))


def dated_findings(items: DataFrame, by: list[str], order: str, at: str, ascending: bool = True, equal: bool = True) -> DataFrame:
    """(by, order, finding) of list items: unreadable times, and times out of order against the last readable one."""
    time = F.try_to_timestamp(F.col(at))
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = items.withColumn("_t", time).withColumn("_p", F.last("_t", ignorenulls=True).over(w))
    wrong = (F.col("_t") < F.col("_p")) if ascending else (F.col("_t") > F.col("_p"))
    if not equal:
        wrong = wrong | (F.col("_t") == F.col("_p"))
    finding = F.when(F.col("_t").isNull(), "unreadable").when(wrong, "out of order")
    return rows.withColumn("finding", finding).filter("finding is not null").select(*by, order, "finding")


def change_findings(before: DataFrame, after: DataFrame, key: str, state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """(key, finding): pages whose state went where it may not, or that vanished while in one that has successors.

    A moved page is a deletion and a creation. New pages may begin in any state.
    """
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs])
    a = before.select(F.col(key).alias("_bk"), F.col(state).alias("_bs"))
    b = after.select(F.col(key).alias("_ak"), F.col(state).alias("_as"))
    joined = a.join(b, F.col("_bk") == F.col("_ak"), "full_outer")
    moved = F.col("_bk").isNotNull() & F.col("_ak").isNotNull() & ~F.col("_bs").eqNullSafe(F.col("_as"))
    finding = F.when(moved & ~F.array_contains(pairs, F.concat_ws(">", F.coalesce("_bs", F.lit("")), F.coalesce("_as", F.lit("")))), "transition").when(F.col("_ak").isNull() & F.col("_bs").isin(*[s for s, to in allowed.items() if to]), "vanished")
    return joined.withColumn("finding", finding).filter("finding is not null").select(F.coalesce("_ak", "_bk").alias(key), "finding")


def rule_problems(schema: Schema) -> list[str]:
    """What is wrong with the rules themselves."""
    out = [f"section {s} is declared twice" for s in sorted({s for s in schema.sections if schema.sections.count(s) > 1})]
    for name, rule in schema.fields.items():
        for low, high in (("min_length", "max_length"), ("minimum", "maximum")):
            if rule.limits.get(low) is not None and rule.limits.get(high) is not None and rule.limits[low] > rule.limits[high]:
                out.append(f"{name}: {low} exceeds {high}")
        if rule.kind == "enum" and not rule.limits["values"]:
            out.append(f"{name}: no values")
    return out
