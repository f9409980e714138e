"""Links between pages: extraction, resolution, typed edges, folders, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T

_MARKDOWN = r"(!?)\[([^\[\]\n]*)\]\(([^()\s]+)\)"
_WIKI = r"\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]"
_HREF = r"""(?i)\bhref=["']([^"']+)["']"""
#: What holds no links.
_CODE = r"(?s)```.*?```|~~~.*?~~~|`[^`\n]*`|<!--.*?-->"


def links_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, syntax, target, ordinal) of the links of each text, outside code and comments.

    ``syntax`` is markdown, image, wiki or html. A null text has none.
    """
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _CODE, " ")
    group = lambda pattern, n: F.regexp_extract_all(bare, F.lit(pattern), F.lit(n))
    marked = F.transform(F.arrays_zip(group(_MARKDOWN, 1).alias("mark"), group(_MARKDOWN, 3).alias("target")), lambda x: F.struct(F.when(x["mark"] == "!", "image").otherwise("markdown").alias("syntax"), x["target"].alias("target")))
    plain = lambda name, found: F.transform(found, lambda x: F.struct(F.lit(name).alias("syntax"), F.trim(x).alias("target")))
    found = F.concat(marked, plain("wiki", group(_WIKI, 1)), plain("html", group(_HREF, 1)))
    return df.select(*keys, F.posexplode(found).alias("ordinal", "_l")).select(*keys, "_l.syntax", "_l.target", "ordinal")


def resolved_path(source: Column, syntax: Column, target: Column) -> Column:
    """The page path a link names: null for an external link or one to another kind of file.

    Wiki targets count from the root, others from the source's folder; anchors and
    queries are cut, components percent-decoded, ``.md`` added where there is no ending.
    """
    bare = F.regexp_replace(target, "[#?].*$", "")
    decoded = F.when(syntax == "wiki", bare).otherwise(T.decoded_path(bare))
    folder = F.regexp_extract(source, r"^(.*/)?[^/]*$", 1)
    joined = F.when((syntax == "wiki") | decoded.startswith("/"), F.regexp_replace(decoded, "^/+", "")).otherwise(F.concat(F.coalesce(folder, F.lit("")), decoded))
    path = T.normal_path(joined)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    page = F.when(path.rlike(r"\.md$"), path).when((syntax == "wiki") | ~name.contains("."), F.concat(path, F.lit(".md")))
    return F.when(~T.is_external(target) & (bare != "") & (syntax != "image"), page)


def resolve(links: DataFrame, pages: DataFrame, source: str = "source") -> DataFrame:
    """Links with ``path`` and ``dangling``: true where no page has the path, null where the link names none."""
    known = pages.select(F.col("path").alias("_p")).distinct()
    rows = links.withColumn("path", resolved_path(F.col(source), F.col("syntax"), F.col("target")))
    joined = rows.join(known, rows["path"] == known["_p"], "left")
    return joined.withColumn("dangling", F.when(F.col("path").isNotNull(), F.col("_p").isNull())).drop("_p")


def missing_reciprocals(edges: DataFrame, reciprocal: dict[str, str]) -> DataFrame:
    """Edges (source, relation, target) whose counterpart (target, reciprocal, source) isn't there."""
    pairs = F.create_map(*[F.lit(x) for kv in reciprocal.items() for x in kv])
    wanted = edges.distinct().withColumn("_r", F.try_element_at(pairs, F.col("relation"))).filter("_r is not null")
    have = edges.select(F.col("target").alias("source"), F.col("relation").alias("_r"), F.col("source").alias("target")).distinct()
    return wanted.join(have, ["source", "_r", "target"], "left_anti").select("source", "relation", "target")


def list_folder(pages: DataFrame, folder: str = "") -> DataFrame:
    """(name, is_folder, n_pages): the children of a folder, from the pages' paths."""
    prefix = folder + "/" if folder else ""
    rows = pages.filter(F.col("path").startswith(prefix)).select(F.substring(F.col("path"), len(prefix) + 1, 1_000_000).alias("_rest"))
    return rows.groupBy(F.split("_rest", "/")[0].alias("name"), F.contains("_rest", F.lit("/")).alias("is_folder")).agg(F.count("*").alias("n_pages"))


def folder_rollup(pages: DataFrame, *measures: Column) -> DataFrame:
    """Measures of every folder over its whole subtree (``folder``, empty for the root)."""
    return pages.withColumn("folder", F.explode(T.folders("path"))).groupBy("folder").agg(*measures)


def nearest_policy(pages: DataFrame, policies: DataFrame) -> DataFrame:
    """Pages with the policy (folder, policy) of their nearest ancestor folder; null without one."""
    spread = pages.select("path", F.posexplode(T.folders("path")).alias("_depth", "folder"))
    best = spread.join(policies, "folder").groupBy("path").agg(F.max_by("policy", "_depth").alias("policy"))
    return pages.join(best, "path", "left")


def ancestor_paths(df: DataFrame, key: str, parent: str, name: str, most: int = 64) -> DataFrame:
    """(key, path, depth): names from the top to each row along its parents.

    Works by doubling: after n rounds 2^n ancestors are known, so ``most`` levels take
    log2 rounds of one join. A cycle, or more than ``most`` levels, gives null; a parent
    that isn't there ends the path.
    """
    from foliospark.session import cut_lineage

    rows = df.select(F.col(key).alias("k"), F.col(parent).alias("up"), F.array(F.col(name).cast("string")).alias("names"))
    have = rows.select(F.col("k").alias("_h"))
    rows = rows.join(have, rows["up"] == have["_h"], "left").withColumn("up", F.col("_h")).drop("_h")
    rounds = max(1, (most - 1).bit_length())
    for _ in range(rounds):
        above = rows.select(F.col("k").alias("_k"), F.col("up").alias("_up"), F.col("names").alias("_names"))
        rows = cut_lineage(rows.join(above, rows["up"] == above["_k"], "left").select("k", F.col("_up").alias("up"), F.when(F.col("_k").isNull(), F.col("names")).otherwise(F.concat("_names", "names")).alias("names")))
        if rows.filter("up is not null").isEmpty():
            break
    done = F.col("up").isNull() & (F.size("names") <= most)
    return rows.select(F.col("k").alias(key), F.when(done, F.array_join("names", "/")).alias("path"), F.when(done, F.size("names")).alias("depth"))


def moved_links(links: DataFrame, moves: DataFrame, source: str = "source") -> DataFrame:
    """Resolved links (source, syntax, target, path) with ``new_source`` and ``new_target`` after simultaneous moves (old, new).

    Swaps and chains are safe, since every path is looked up once in the old names. A
    link is rewritten only if its page or its target moves.
    """
    a = moves.select(F.col("old").alias("_so"), F.col("new").alias("_sn"))
    b = moves.select(F.col("old").alias("_to"), F.col("new").alias("_tn"))
    rows = links.join(a, links[source] == a["_so"], "left").join(b, F.col("path") == F.col("_to"), "left")
    here, there = F.coalesce("_sn", source), F.coalesce("_tn", "path")
    written = F.when(F.col("syntax") == "wiki", F.regexp_replace(there, r"\.md$", "")).otherwise(T.encoded_path(T.relative_path(here, there)))
    changed = F.col("path").isNotNull() & (F.col("_tn").isNotNull() | (F.col("_sn").isNotNull() & (F.col("syntax") != "wiki")))
    return rows.withColumn("new_source", here).withColumn("new_target", F.when(changed, written).otherwise(F.col("target"))).drop("_so", "_sn", "_to", "_tn")
