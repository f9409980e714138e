"""Leaves of a marked-up text: what a block labeller reads, in document order.

A leaf is a run of plain text or one candidate for a piece of markup. Which family
a candidate belongs to, or none, is for the labeller to say; the lexer only knows
its shape (``kind``) and the path of what is open around it. Shapes are wide: a pipe
may be a cell of either kind of table or plain text, a backslash word a command or
part of a file's path, stars and underscores emphasis or signs.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

FAMILIES = ("text", "html", "markdown", "wiki", "latex")

#: Shapes by the first alternative that matches, and the families a shape can belong to.
_SHAPES: list[tuple[str, str, tuple[str, ...]]] = [
    ("fence", r"^[ ]{0,3}(?P<fm>`{3,}|~{3,})[^\n]*(?:\n(?:.*?\n)??[ ]{0,3}(?P=fm)[`~]*[ \t]*$|\Z|\n.*\Z)", ("markdown",)),
    ("tick", r"(?P<tm>`{1,2})(?!`)[^\n]+?(?<!`)(?P=tm)(?!`)", ("markdown",)),
    ("comment", r"<!--.*?-->", ("html",)),
    ("doctype", r"<![A-Za-z][^<>]*>", ("html",)),
    ("tag", r"</?[A-Za-z][A-Za-z0-9]*(?:[ \t\n]+[^<>]*?)?/?>", ("html",)),
    ("entity", r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", ("html",)),
    ("environment", r"\\begin\{(?P<env>[A-Za-z]+\*?)\}.*?\\end\{(?P=env)\}", ("latex",)),
    ("display", r"\$\$.+?\$\$|\\\[.+?\\\]", ("latex",)),
    ("inline", r"\\\(.+?\\\)", ("latex",)),
    ("dollar", r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\$])\$(?![\d$])|(?<![\\$\w])\$[ ][^$\n]+?[ ]\$(?![\d$])", ("latex",)),
    ("group", r"\{\\[A-Za-z]+\s[^{}]*\}", ("latex",)),
    ("command", r"(?<![\\\w])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}]*\})*", ("latex",)),
    ("brace", r"^[ \t]*(?:\{\||\|\}|\|[-+])[^\n]*$", ("wiki",)),
    ("wiki_link", r"\[\[[^\[\]\n]+\]\]", ("wiki",)),
    ("template", r"\{\{[^{}]+\}\}", ("wiki",)),
    ("quotes", r"(?<!')'{2,5}(?!')[^\n]+?'{2,5}", ("wiki",)),
    ("equals", r"^(?P<eq>={1,6})[ \t]*[^=\s][^\n]*?[ \t]*(?P=eq)[ \t]*$", ("wiki",)),
    ("hashes", r"^[ ]{0,3}#{1,6}[ \t]+\S[^\n]*$", ("markdown",)),
    ("ruler", r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|[ \t]*$|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+$", ("markdown",)),
    ("row", r"^[ \t]*[|!](?![\[}|!])[ \t]*", ("markdown", "wiki")),
    ("underlined", r"^[ ]{0,3}(?![-*+>|#=]|\d+[.)])\S[^\n]*\n[ ]{0,3}(?:=+|-+)[ \t]*$", ("markdown",)),
    ("task", r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]+(?=\S)", ("markdown",)),
    ("bullet", r"^[ \t]*[-*+][ \t]+(?=\S)", ("markdown",)),
    ("number", r"^[ \t]*\d{1,3}[.)][ \t]+(?=\S)", ("markdown",)),
    ("quote", r"^[ ]{0,3}>[ \t]?", ("markdown",)),
    ("image", r"!\[[^\]\n]*\]\([^()\n]*\)", ("markdown",)),
    ("link", r"\[[^\[\]\n]+\](?:\([^()\n]*\)|\[[^\[\]\n]*\])", ("markdown",)),
    ("note", r"\[\^[^\]\s]+\]:?", ("markdown",)),
    ("definition", r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]*\S+", ("markdown",)),
    ("autolink", r"<(?:https?://|mailto:)[^<>\s]+>", ("markdown",)),
    ("strong", r"\*\*(?=[^\s*])[^*]+?(?<=[^\s*])\*\*|(?<!\w)__(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?!\w)", ("markdown",)),
    ("stars", r"(?<!\*)\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?!\*)", ("markdown",)),
    ("unders", r"(?<!_)_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?!_)", ("markdown",)),
    ("strike", r"~~(?=\S)[^~\n]+?~~", ("markdown",)),
    ("pipe", r"(?:\|\||(?<!\\)\||!!)[ \t]*", ("markdown", "wiki")),
    ("sign", r"[*_~`$\\{}\[\]|<>=#&]+", ()),
]
KINDS = ["run", *(k for k, _, _ in _SHAPES)]
ALLOWED = {k: f for k, _, f in _SHAPES} | {"run": ()}
#: Shapes begin at these characters or at the start of a line; looking there first keeps plain text cheap.
_LEXER = re.compile(r"(?=[*_~`$\\{}\[\]|<>=#&'!]|^)(?:" + "|".join(f"(?P<{k}>{p})" for k, p, _ in _SHAPES) + ")", re.M | re.S)
#: Without one of these no shape can match.
_ANY = re.compile(r"[*_~`$\\{}\[\]|<>=#&']|^[ \t]*[-+][ \t]|^[ \t]*\d{1,3}[.)][ \t]|^[ ]{0,3}-+[ \t]*$", re.M)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
#: HTML elements that have no content (a fixed list).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


#: A tag of these ends the last open one of its name (a fixed list).
_SIBLINGS = frozenset("p li td th tr dt dd option".split())


class Open(NamedTuple):
    """What is open around a leaf: its name, and what is open around that."""

    name: str
    around: "Open | None"


class Leaf(NamedTuple):
    """One leaf; ``path`` is the innermost of what is open around it, or None."""

    kind: str
    start: int
    end: int
    path: Open | None


class _Stack:
    """The open elements; closing is amortised, so deep or unclosed markup costs no more."""

    def __init__(self) -> None:
        self.held: list[Open] = []
        self.count: Counter[str] = Counter()

    @property
    def top(self) -> Open | None:
        return self.held[-1] if self.held else None

    def open(self, name: str) -> None:
        self.held.append(Open(name, self.top))
        self.count[name] += 1

    def close(self, name: str) -> None:
        while self.count[name]:
            last = self.held.pop().name
            self.count[last] -= 1
            if last == name:
                break


def leaves_of(text: str) -> list[Leaf]:
    """All leaves of a text; together they cover it."""
    if not text:
        return []
    if not _ANY.search(text):
        return [Leaf("run", 0, len(text), None)]
    out: list[Leaf] = []
    at, stack = 0, _Stack()
    for m in _LEXER.finditer(text):
        a, b, kind = m.start(), m.end(), m.lastgroup
        if kind in ("fm", "tm", "env", "eq"):
            kind = next(k for k in KINDS[1:] if m[k] is not None)
        if b == a:
            continue
        if a > at:
            out.append(Leaf("run", at, a, stack.top))
        if kind == "tag":
            name = _NAME.match(m[0])[1].lower()
            if m[0].startswith("</"):
                out.append(Leaf(kind, a, b, Open(name, stack.top)))
                stack.close(name)
            else:
                if name in _SIBLINGS and stack.top and stack.top.name == name:
                    stack.close(name)
                out.append(Leaf(kind, a, b, Open(name, stack.top)))
                if name not in VOID and not m[0].endswith("/>"):
                    stack.open(name)
        else:
            bare = m[0].lstrip()
            if kind == "brace" and bare.startswith("{|"):
                stack.open("{|")
            out.append(Leaf(kind, a, b, Open(kind, stack.top)))
            if kind == "brace" and bare.startswith("|}"):
                stack.close("{|")
        at = b
    if at < len(text):
        out.append(Leaf("run", at, len(text), stack.top))
    return out
