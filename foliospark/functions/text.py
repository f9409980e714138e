"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def raw_tokens(text: Column | str) -> Column:
    """Runs of letters and digits of at least two bytes, in their own case; null gives null.

    One regular expression that stays in generated code: two characters or more, or a
    single one outside ASCII.
    """
    return F.regexp_extract_all(_c(text), F.lit(r"[\p{L}\p{N}]{2,}|[[\p{L}\p{N}]&&[^\x00-\x7F]]"), F.lit(0))


def tokens(text: Column | str) -> Column:
    """The raw tokens, lower-cased after their bytes were counted."""
    return F.transform(raw_tokens(text), lambda x: F.lower(x))


def lowered_tokens(text: Column | str, low: Column | str) -> Column:
    """What :func:`tokens` gives, in generated code: ``low``, the lower-cased text, is cut.

    Only texts with a letter whose lower case depends on its place or becomes shorter
    (a sigma, the Kelvin sign, a dotted I) are cut first.
    """
    c = _c(text)
    return F.when(c.rlike("[\u03a3\u212a\u0130]"), tokens(c)).otherwise(raw_tokens(low))


def search_text(*parts: Column | str) -> Column:
    """Searchable text of a row: its parts joined by spaces, nulls left out."""
    return F.concat_ws(" ", *[_c(p) for p in parts])


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path glob: ``*`` and ``?`` inside a name, ``**`` across folders, ``{a,b}`` and ``[..]``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out += "[" + glob[i + 1 : end].replace("!", "^", 1 if glob[i + 1] == "!" else 0).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def path_selected(path: Column | str, include: list[str], exclude: list[str]) -> Column:
    """True where some include glob matches and no exclude glob does."""
    p = _c(path)
    hit = F.lit(False)
    for g in include:
        hit = hit | p.rlike(glob_regex(g))
    for g in exclude:
        hit = hit & ~p.rlike(glob_regex(g))
    return hit


def folders(path: Column | str) -> Column:
    """All ancestor folders of a path, outermost first, the root (empty) included."""
    parts = F.split(_c(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def slug(text: Column | str, fallback: str = "untitled", most: int = 80) -> Column:
    """Lower-cased word characters joined by single hyphens, at most ``most`` characters."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), r"[^\p{L}\p{N}_\s-]", ""), r"[\s_-]+", "-")
    bare = F.regexp_replace(F.left(F.regexp_replace(cut, "^-+|-+$", ""), F.lit(most)), "-+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(fallback)).otherwise(bare)


def short_id(text: Column | str) -> Column:
    """The last twelve letters and digits."""
    return F.right(F.regexp_replace(_c(text), "[^A-Za-z0-9]", ""), F.lit(12))


def natural_key(text: Column | str, width: int = 12) -> Column:
    """A string that sorts digits by value: each run of digits is padded to ``width``."""
    marked = F.regexp_replace(F.lower(_c(text)), r"(\d+)", "\u0001" + "0" * width + "$1\u0002")
    return F.regexp_replace(marked, "\u0001" + r"\d*?(\d{" + str(width) + "})\u0002", "$1")


def clock(seconds: Column | str) -> Column:
    """``HH:MM:SS.cc`` of seconds, rounded half to even."""
    total = F.bround(_c(seconds).cast("double") * 100, 0).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%02d", (total / 360000).cast("bigint"), ((total / 6000).cast("bigint") % 60), ((total / 100).cast("bigint") % 60), total % 100)


def display(value: Column | str) -> Column:
    """A value for a table view: null as an em dash, arrays joined by commas."""
    c = _c(value)
    return F.coalesce(c.cast("string"), F.lit("—"))


def is_external(target: Column | str) -> Column:
    """True for a link with a scheme or a leading double slash."""
    return _c(target).rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")


def safe_path(path: Column | str) -> Column:
    """True for a relative path of normal components without ``.git``."""
    p = _c(path)
    return F.coalesce(~p.rlike(r"^/|^$|(?:^|/)(?:\.{1,2}|\.git|)(?:/|$)|\\|\x00"), F.lit(False))


def normal_path(path: Column | str) -> Column:
    """``a/./b/../c`` as ``a/c``; null where it would leave the root."""
    parts = F.filter(F.split(_c(path), "/"), lambda x: (x != "") & (x != "."))
    # Pop on "..": an underflow is kept as a mark that makes the result null.
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array(F.lit("\u0000"))))
    return F.when(~F.exists(folded, lambda x: x == "\u0000"), F.array_join(folded, "/"))


def relative_path(source: Column | str, target: Column | str) -> Column:
    """How ``target`` is written in a link of the page ``source``."""
    here = F.split(_c(source), "/")
    folder = F.slice(here, 1, F.size(here) - 1)
    there = F.split(_c(target), "/")
    shared = F.coalesce(
        F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(folder), F.lit(0))), lambda i: F.when((i >= F.size(folder)) | (i >= F.size(there) - 1) | ~F.get(folder, i).eqNullSafe(F.get(there, i)), i)), lambda x: x.isNotNull())),
        F.lit(0),
    )
    return F.concat(F.repeat(F.lit("../"), F.size(folder) - shared), F.array_join(F.slice(there, shared + 1, F.size(there)), "/"))


def decoded_path(path: Column | str) -> Column:
    """Percent-decoded by component: ``+`` stays, an encoded slash, backslash or NUL or bad UTF-8 gives null."""
    p = _c(path)
    bad = p.rlike(r"(?i)%(?:2f|5c|00)")
    return F.when(~bad, F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))


def encoded_path(path: Column | str) -> Column:
    """Percent-encoded with slashes kept."""
    return F.array_join(F.transform(F.split(_c(path), "/"), lambda x: F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))), "/")


#: Media types by file ending (fixed values).
MEDIA = {"md": "text/markdown", "txt": "text/plain", "html": "text/html", "css": "text/css", "js": "text/javascript", "json": "application/json", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "mp3": "audio/mpeg", "m4a": "audio/mp4", "wav": "audio/wav", "caf": "audio/x-caf", "mp4": "video/mp4", "zip": "application/zip"}


def media_type(path: Column | str) -> Column:
    """Media type by file ending, ``application/octet-stream`` if unknown."""
    table = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def file_kind(content: Column | str) -> Column:
    """pdf, djvu, zip, png, jpeg, or null, by the first bytes."""
    head = F.hex(F.substring(_c(content), 1, 16))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("41542654464F524D"), "djvu").when(head.startswith("504B0304"), "zip").when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg")


def heading_level(line: Column | str) -> Column:
    """Level of an ATX heading line, 0 for any other."""
    return F.length(F.regexp_extract(_c(line), r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1))


def table_cells(line: Column | str) -> Column:
    """Cells of a pipe-table row; an escaped pipe is part of its cell."""
    bare = F.regexp_replace(F.trim(_c(line)), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda x: F.trim(F.replace(x, F.lit("\\|"), F.lit("|"))))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compare_form(text: Column | str) -> Column:
    """Text as comparisons see it: link and image syntax, heading marks and tags removed, words joined over line ends, white space collapsed."""
    out = F.regexp_replace(_c(text), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    for pattern, to in ((r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"<[^>\n]+>", " "), (r"(\p{L})-\s*\n\s*(\p{Ll})", "$1$2"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def line_hash(before: Column, line: Column, after: Column) -> Column:
    """First two hex digits of SHA-256 over the three lines, each after its byte length in eight bytes."""
    framed = [x for c in (before, line, after) for x in (F.unhex(F.lpad(F.hex(F.octet_length(c).cast("bigint")), 16, "0")), F.encode(c, "UTF-8"))]
    return F.left(F.sha2(F.concat(*framed), 256), F.lit(2))
