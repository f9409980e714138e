"""Text from scanned pages, repaired.

The words of a page are decoded jointly over its de-lined character stream: a path
through kept words, words with confused characters, letters and fragments drawn
apart, words run together and words divided at a line's end, at the least cost under
a lexicon counted over all observations. Line ends are characters of the stream like
others. Where no edge but that of single words can exist, the path is theirs alone. Paragraph ends are chosen by dynamic programming over
the lines. Running lines and page numbers show only across the pages of a book: lines
at the edges of pages are compared by keys of their folded characters, page numbers by
their constant distance from the page's place.
"""

from __future__ import annotations

import copy
import math
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut_lineage

#: Words of the lexicon: least count, and most words that may be sent to the tasks (with more, a run fails).
MIN_COUNT, MOST_WORDS = 3, 300_000
#: A word this many times rarer than what it could be a misreading of is one.
RARER = 20
#: Standard deviations by which a misreading may by chance be more frequent than that.
CHANCE = 2.5
#: Misread words that count as noise; pages a running line is on.
MISREAD, PAGES = 3, 3
#: Letters of a word beyond which it is no word of a language, and is not looked at for two confusions or more than two words.
LONGEST = 64
#: Least share of a book's most frequent distance between number and place that another one needs.
SHIFT_SHARE = 0.1

#: Cost of a word that was misread, at the usual confidence, and how it changes with confidence (a weak hint).
WRONG, USUAL, HINT = 5.0, 0.9, 2.0

#: What is read for what (fixed values: characters that look alike in print).
CONFUSED = {"c": ("e",), "cl": ("d",), "ſ": ("s",), "ii": ("u",), "b": ("h",), "rn": ("m",), "vv": ("w",), "@": ("a",), "†": ("t",), "0": ("o",), "1": ("l", "i"), "5": ("s",)}
_SPOTS = tuple(re.compile("(?=(" + "|".join(k for k in CONFUSED if len(k) == width) + "))") for width in (1, 2))
#: Signs that divide a word at a line's end.
HYPHENS = "-­¬‐‑"

_MARK = re.compile(r"<\|ref\|>(.*?)<\|/ref\|>\s*<\|det\|>.*?<\|/det\|>", re.S)
_DIVIDED = re.compile(rf"([^\W\d_]+)[{HYPHENS}][ \t]*\n[ \t]*([^\W\d_]+)")
#: Formulas, code, tags and commands hold no words to mend.
_OPAQUE = re.compile(r"```.*?```|~~~.*?~~~|\$\$.*?\$\$|\$[^$\n]*\$|\\\[.*?\\\]|\\\(.*?\\\)|`[^`\n]*`|<!--.*?-->|</?[A-Za-z][^<>]*>|&#?\w+;|\\begin\{equation\*?\}.*?\\end\{equation\*?\}|\\begin\{align\*?\}.*?\\end\{align\*?\}|\\[A-Za-z]+\*?(?:\{[^{}]*\})?|\{\{[^{}]*\}\}|\S*[/_\\]\S*|\[\[|\]\]", re.S)
#: Without one of these signs nothing is opaque.
_SIGNS = re.compile(r"[`~$<&{/_\\]|\[\[|\]\]")
_TOKEN = re.compile(r"[^\W_]+(?:[@†�]+[^\W_]*)*|[@†�]+[^\W_][\w@†�]*|[^\s\w]|\s+")
_ODD = re.compile(r"[@†�ſ]")
#: Cost of a letter after a pair that no word has.
_UNSEEN = -math.log(0.02)
#: The tokens of letters, digits and odd signs.
_WORDS = re.compile(r"[^\W_]+(?:[@†�]+[^\W_]*)*|[@†�]+[^\W_][\w@†�]*|[@†�]")
#: Where an edge over several tokens may begin: a dividing mark before a line's end, or letters drawn apart.
_JOINED = re.compile(rf"[{HYPHENS}][ \t]*\n|(?:^|[\W_])(?:[^\W\d_]|[@†�])(?:[{HYPHENS}]?\s+(?:[^\W\d_]|[@†�])(?![^\W_])){{2}}")


def bare(raw: str) -> str:
    """A read without its grounding marks."""
    return _MARK.sub("\n\n", raw)


def blocks_of(raw: str) -> list[tuple[str, list[str]]]:
    """(kind, non-empty lines) of each block; blocks of a free read end at empty lines."""
    out = []
    if "<|ref|>" in raw:
        marks = list(_MARK.finditer(raw))
        head = raw[: marks[0].start()] if marks else raw
        parts = [("free", head)] + [(m[1].strip(), raw[m.end() : n]) for m, n in zip(marks, [*(m.start() for m in marks[1:]), len(raw)])]
    else:
        parts = [("free", p) for p in re.split(r"\n[ \t]*\n", raw)]
    for kind, part in parts:
        lines = [x.strip() for x in part.split("\n") if x.strip()]
        if lines:
            out.append((kind, lines))
    return out


def lexicon(observations: DataFrame, text: str = "raw") -> dict[str, int]:
    """Counts of the words of all reads, misreadings taken out.

    Counting runs over every row; only words seen ``MIN_COUNT`` times come to the
    driver. More than ``MOST_WORDS`` of them are an error: without the rarer ones true
    words would be taken for misreadings. What goes is told by :func:`cleaned`.
    """
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?s)<\|ref\|>.*?<\|/ref\|>|<\|det\|>.*?<\|/det\|>|</?[A-Za-z][^<>]*>|\$[^$\n]*\$", " ")
    joined = F.regexp_replace(whole, rf"([\p{{L}}])[{HYPHENS}][ \t]*\n[ \t]*([\p{{L}}])", "$1$2")
    words = observations.select(F.explode(F.regexp_extract_all(F.lower(joined), F.lit(r"(\p{L}{2,})"), F.lit(1))).alias("w"))
    rows = words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError("the lexicon is larger than what may be sent to the tasks")
    return cleaned({r[0]: r[1] for r in rows})


def cleaned(counts: dict[str, int]) -> dict[str, int]:
    """A lexicon without the words that are frequent words misread or run together.

    A word goes if one or two confusions, or a missing space, make it words ``RARER`` times
    as frequent. Of a word seen N times, N / ``RARER`` such forms are expected at most, and
    by chance some standard deviations more: a form seen three times is trusted as little
    as one seen three hundred times, and as sizes grow the ratio alone decides. Two words
    that are frequent say little about whether they stood together, so chance isn't
    allowed for a missing space: names (Corner|on) would be divided.
    """
    out = {}
    for w, n in counts.items():
        if any(_by_chance(n, counts.get(v, 0)) for v in unconfused(w)):
            continue
        if len(w) > 4 and any(min(counts.get(w[:k], 0), counts.get(w[k:], 0)) >= RARER * n for k in range(2, len(w) - 1)):
            continue
        out[w] = n
    return out


def _by_chance(n: int, of: int) -> bool:
    """Whether a form seen ``n`` times may be a misreading of one seen ``of`` times."""
    expected = of / RARER
    return n <= expected + CHANCE * math.sqrt(expected)


def unconfused(word: str, most: int = 2) -> list[str]:
    """What a lower-case word may be a reading of, with up to ``most`` confusions undone."""
    spots = [(m.start(), m.end(m.lastindex), to) for pattern in _SPOTS for m in pattern.finditer(word) for to in CONFUSED[m[1]]]
    if not spots:
        return []
    out = [word[:a] + to + word[b:] for a, b, to in spots]
    if most > 1 and len(word) <= LONGEST:
        for (a, b, x), (c, d, y) in product(spots, spots):
            if b <= c:
                out.append(word[:a] + x + word[b:c] + y + word[d:])
    return out


def _zones(text: str) -> list[tuple[int, int]]:
    """Stretches of whole words in which edges over several tokens may lie, with a word on each side."""
    out: list[tuple[int, int]] = []
    for m in _JOINED.finditer(text):
        a, b = m.start(), m.end()
        if out and b <= out[-1][1]:
            continue
        for _ in range(2):
            while a and text[a - 1].isspace():
                a -= 1
            while a and not text[a - 1].isspace():
                a -= 1
        # On over single letters, then one word more.
        more = True
        while b < len(text) and more:
            while b < len(text) and not text[b].isspace():
                b += 1
            begin = b
            while begin < len(text) and text[begin].isspace():
                begin += 1
            b = begin
            while b < len(text) and not text[b].isspace():
                b += 1
            more = b - begin <= 2
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _first(text: str) -> str:
    m = _WORDS.search(text)
    return m[0] if m else ""


def _last(text: str) -> str:
    words = _WORDS.findall(text[text.rstrip().rfind(" ") + 1 :])
    return words[-1] if words else ""


class Decoder:
    """Least-cost reading of a token stream under a lexicon."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.known = set(counts)
        # Letter trigrams of the lexicon's words, for names it doesn't hold: the cost of each, and of none after a pair.
        grams: dict[str, int] = {}
        ends: dict[str, int] = {}
        for w in counts:
            padded = f"^^{w}$"
            for i in range(len(padded) - 2):
                grams[padded[i : i + 3]] = grams.get(padded[i : i + 3], 0) + 1
                ends[padded[i : i + 2]] = ends.get(padded[i : i + 2], 0) + 1
        self.grams = {g: -math.log((n + 0.02) / (ends[g[:2]] + 1.0)) for g, n in grams.items()}
        self.ends = {e: -math.log(0.02 / (n + 1.0)) for e, n in ends.items()}
        self.holes: dict[tuple[int, int, str], list[str]] = {}
        self.wrong = WRONG
        # The least cost of a part of one, two and more letters that isn't known, at any confidence.
        self.least = (0.0, 5.0, math.inf, WRONG - HINT + min(self.cost.values(), default=0.0))
        self.hinted: dict[float, Decoder] = {}
        self.seen: dict[str, int | tuple[tuple[str, str] | None]] = {}
        self.fixed = lru_cache(maxsize=200_000)(self._fixed)
        self.spelled = lru_cache(maxsize=200_000)(self._spelled)
        self.part = lru_cache(maxsize=200_000)(self._part)

    def at(self, confidence: float | None) -> Decoder:
        """The decoder for a text of this confidence: what is less sure is sooner a misreading; null is the usual."""
        if confidence is None or not 0 <= confidence <= 1:
            return self
        wrong = round(WRONG + HINT * (round(confidence, 1) - USUAL), 2)
        if wrong == self.wrong:
            return self
        if wrong not in self.hinted:
            other = copy.copy(self)
            other.wrong, other.hinted, other.seen = wrong, {}, {}
            other.fixed, other.part = lru_cache(maxsize=200_000)(other._fixed), lru_cache(maxsize=200_000)(other._part)
            self.hinted[wrong] = other
        return self.hinted[wrong]

    def _spelled(self, word: str) -> float:
        """Cost of a word by its letters, as if it were a name."""
        padded, grams, ends = f"^^{word}$", self.grams, self.ends
        total = 0.0
        for i in range(len(padded) - 2):
            own = grams.get(padded[i : i + 3])
            total += ends.get(padded[i : i + 2], _UNSEEN) if own is None else own
        return total

    def _fill(self, word: str) -> list[str]:
        """Lexicon words that fit where single letters couldn't be read."""
        if not self.holes:
            for w in self.known:
                for i, c in enumerate(w[:LONGEST]):
                    self.holes.setdefault((len(w), i, c), []).append(w)
        # The rarest of its letters by place leaves the fewest words to look at.
        read = [self.holes.get((len(word), i, c), []) for i, c in enumerate(word[:LONGEST]) if c != "�"]
        pattern = re.compile(re.escape(word).replace("�", "."))
        return [w for w in min(read, key=len, default=[]) if pattern.fullmatch(w)]

    def _fixed(self, word: str) -> tuple[float, str, str]:
        """(cost, reading, how) of one lower-case token that the lexicon doesn't hold."""
        best = (26.0 + self.spelled(word) * 0.2, word, "kept")
        if word.isdigit():
            return (8.0, word, "kept")
        has_digit = any(c.isdigit() for c in word)
        letters = sum(c.isalpha() for c in word)
        odd = bool(_ODD.search(word))
        if has_digit and not (letters >= 2 and letters > len(word) - letters):
            return (12.0, word, "kept")
        spell = self.spelled(word) if not (has_digit or odd) else 99.0
        if not (has_digit or odd):
            best = min(best, (14.0 + spell, word, "kept"))
        if "�" in word:
            for v in self._fill(word):
                best = min(best, (self.cost[v] + 4.0 * word.count("�"), v, "confused"))
        for v in unconfused(word):
            if v in self.known:
                best = min(best, (self.cost[v] + self.wrong, v, "confused"))
            elif len(v) > 4 and "�" not in v and v.isalpha() and not _ODD.search(v):
                best = min(best, (14.0 + self.spelled(v) + self.wrong, v, "confused"))
        if len(word) > 3 and not has_digit:
            for k in range(1, len(word)):
                a, b = word[:k], word[k:]
                # No reading of a part that isn't known is cheaper than this.
                if self.cost.get(a, self.least[min(len(a), 3)]) + self.cost.get(b, self.least[min(len(b), 3)]) + self.wrong >= best[0]:
                    continue
                if (len(a) == 1 and a not in "aàyeoé") or (len(b) == 1 and b not in "aày"):
                    continue
                for x, ca in self.part(a):
                    for y, cb in self.part(b):
                        best = min(best, (ca + cb + self.wrong, f"{x} {y}", "split"))
        if 8 < len(word) <= LONGEST and word.isalpha():
            best = min(best, self._several(word))
        if best[2] == "kept" and odd:
            best = (best[0], word, "odd")
        return best

    def _several(self, word: str) -> tuple[float, str, str]:
        """The cheapest reading as three known words or more that ran together."""
        n = len(word)
        # By end and by number of parts, three standing for more: (cost, begin, parts before). Ends that no words reach aren't looked on from.
        cost: dict[int, list[tuple[float, int, int]]] = {0: [(0.0, 0, 0)] + [(math.inf, 0, 0)] * 3}
        for j in range(n - 1):
            if j not in cost:
                continue
            for k in range(j + 2, n + 1):
                own = self.cost.get(word[j:k])
                if own is None:
                    continue
                there = cost.setdefault(k, [(math.inf, 0, 0)] * 4)
                for parts in range(4):
                    step = (cost[j][parts][0] + own + (2 * self.wrong if parts else 0.0), j, parts)
                    to = min(parts + 1, 3)
                    if step[0] < there[to][0]:
                        there[to] = step
        if n not in cost:
            return (math.inf, word, "split")
        total, at, parts = cost[n][3][0], n, 3
        if total == math.inf:
            return (math.inf, word, "split")
        out = []
        while at:
            _, j, before = cost[at][parts]
            out.append(word[j:at])
            at, parts = j, before
        return (total, " ".join(reversed(out)), "split")

    def _part(self, word: str) -> list[tuple[str, float]]:
        if word in self.known:
            return [(word, self.cost[word])]
        if len(word) == 1:
            return [(word, 5.0)]
        out = [(v, self.cost[v] + self.wrong) for v in unconfused(word, 1) if v in self.known] if len(word) > 2 else []
        if not out and len(word) > 5 and word.isalpha() and self.spelled(word) < 3.0 * len(word):
            out = [(word, 14.0 + self.spelled(word))]
        return out

    def decode(self, text: str) -> tuple[str, dict[str, int]]:
        """The mended text and how many words were mended in each way.

        A word divided at a line's end, a run of letters drawn apart and every other
        token are edges of one lattice; the cheapest path wins.
        """
        count = {"confused": 0, "odd": 0, "split": 0, "spaced": 0, "hyphen": 0}
        out, at = [], 0
        for a, b in [*_zones(text), (len(text), len(text))]:
            plain, zone = text[at:a], text[a:b]
            if plain:
                edge = zone and self._fragments(_last(plain).lower(), _first(zone).lower())
                if edge or out and self._fragments(_last(text[:at]).lower(), _first(plain).lower()):
                    count.update(dict.fromkeys(count, 0))
                    return self._lattice(text, count), count
                alone = self._alone(plain, count)
                out.append(self._lattice(plain, count) if alone is None else alone)
            if zone:
                out.append(self._lattice(zone, count))
            at = b
        return "".join(out), count

    def _lattice(self, text: str, count: dict[str, int]) -> str:
        """The cheapest path over all edges; ``count`` is added to."""
        tokens = _TOKEN.findall(text)
        n = len(tokens)
        best: list[tuple[float, int, str, str]] = [(math.inf, 0, "", "")] * (n + 1)
        best[0] = (0.0, 0, "", "")
        for i, token in enumerate(tokens):
            base = best[i][0]
            if base == math.inf:
                continue

            def offer(j: int, cost: float, reading: str, how: str, i: int = i, base: float = base) -> None:
                if base + cost < best[j][0]:
                    best[j] = (base + cost, i, reading, how)

            if not (token[0].isalnum() or _ODD.match(token)):
                offer(i + 1, 0.0, token, "kept")
                continue
            low = token.lower()
            if low in self.known:
                offer(i + 1, self.cost[low], token, "kept")
            elif len(token) == 1:
                offer(i + 1, 9.0, token, "kept")
            else:
                cost, reading, how = self.fixed(low)
                offer(i + 1, cost, token if how in ("kept", "odd") else _cased(token, reading), how)
            # Divided at a line's end: the mark, then white space with a line end, then the rest.
            if i + 3 < n and len(token) > 0 and tokens[i + 1] in HYPHENS and "\n" in tokens[i + 2] and tokens[i + 3][0].isalpha() and token[-1].isalpha():
                whole = low + tokens[i + 3].lower()
                if whole in self.known:
                    offer(i + 4, self.cost[whole], token + tokens[i + 3], "hyphen")
                else:
                    cost, reading, how = self.fixed(whole)
                    offer(i + 4, cost, _cased(token, reading) if how == "confused" else token + tokens[i + 3], "hyphen")
            # Two fragments of a word.
            if i + 2 < n and tokens[i + 1].isspace() and self._fragments(low, tokens[i + 2].lower()):
                whole = low + tokens[i + 2].lower()
                offer(i + 3, self.cost[whole] + self.wrong, token + tokens[i + 2], "spaced")
            # Letters drawn apart.
            if len(token) == 1 and i + 4 < n:
                j, word = i, ""
                while j < n and len(tokens[j]) == 1 and (tokens[j].isalpha() or _ODD.match(tokens[j])):
                    word += tokens[j]
                    letters = len(word)
                    if letters >= 3:
                        whole = word.lower()
                        cost, reading, _ = (self.cost[whole], word, "") if whole in self.known else self.fixed(whole)
                        offer(j + 1, min(cost, 5.0 * letters) + 2.0, word if whole in self.known else _cased(word, reading), "spaced")
                    # Between the letters one space, or a line's end, perhaps after a dividing mark.
                    if j + 2 < n and tokens[j + 1].isspace():
                        j += 2
                    elif j + 3 < n and tokens[j + 1] in HYPHENS and "\n" in tokens[j + 2]:
                        j += 3
                    else:
                        break
        out, at = [], n
        while at:
            _, i, reading, how = best[at]
            out.append(reading)
            if how in count:
                count[how] += 1
            at = i
        return "".join(reversed(out))


    def _fragments(self, a: str, b: str) -> bool:
        """Whether two tokens (not both words) may be the halves of a known word of five letters or more."""
        return len(a) > 1 and len(b) > 1 and len(a) + len(b) > 4 and not (a in self.known and b in self.known) and a + b in self.known

    def _reading(self, token: str) -> tuple[str, str] | None:
        """How a token of several characters reads by itself; None if as it is."""
        low = token.lower()
        if low in self.known:
            return None
        _, reading, how = self.fixed(low)
        return (token if how == "odd" else _cased(token, reading), how) if how != "kept" else None

    def _alone(self, text: str, count: dict[str, int]) -> str | None:
        """The mended text if only single words can be edges of its lattice, else None; outside the zones of :func:`_zones`."""
        words = _WORDS.findall(text)
        seen = self.seen
        # Words the lexicon holds are marked by 0 and passed over at once.
        marks = [seen.get(t, 1) for t in words]
        if not any(marks):
            return text
        changed, found = {}, dict.fromkeys(count, 0)
        for i, mark in enumerate(marks):
            if mark == 0:
                continue
            token = words[i]
            low = token.lower()
            if mark == 1:
                if len(seen) > 200_000:
                    seen.clear()
                mark = seen[token] = 0 if low in self.known or len(token) == 1 else (self._reading(token),)
                if mark == 0:
                    continue
            if mark[0] is not None:
                changed[token] = mark[0][0]
                found[mark[0][1]] += 1
            if i and self._fragments(words[i - 1].lower(), low) or i + 1 < len(words) and self._fragments(low, words[i + 1].lower()):
                return None
        if not changed:
            return text
        for how, n in found.items():
            count[how] += n
        return _WORDS.sub(lambda m: changed.get(m[0], m[0]), text)


#: The decoder a worker holds: tasks that follow one another in it share what it has worked out.
_HELD: dict[str, Decoder] = {}


def _decoder(name: str, counts: dict[str, int]) -> Decoder:
    """The decoder of a lexicon, made once in each worker; one is held at a time."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Decoder(counts)
    return _HELD[name]


def _cased(token: str, reading: str) -> str:
    return reading[:1].upper() + reading[1:] if token[:1].isupper() else reading


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines of one block in paragraphs, by dynamic programming.

    A break costs less after a line that ends a sentence and is clearly shorter than
    the widest, and before a list item or heading; it costs more inside a sentence.
    """
    if not lines:
        return []
    wide = max(len(x) for x in lines)
    cost = np.zeros(len(lines))
    for i in range(1, len(lines)):
        before, here = lines[i - 1], lines[i]
        ended = before[-1:] in ".!?:…»\"”)|>"
        item = bool(re.match(r"(?:[-*+•]|\d{1,3}[.)]|#{1,6}|\||>)\s|\[\^", here))
        cost[i] = 3.0 - 4.0 * ended - 5.0 * item + 3.0 * (len(before) > 0.85 * wide) + 2.0 * (here[:1].islower()) + 6.0 * (before[-1:] in HYPHENS)
    # State: whether the line opens a paragraph; two single lines in a row cost a little.
    join, open_ = math.inf, 0.0
    trace = []
    for i in range(1, len(lines)):
        stay = min((join, 0), (open_, 1))
        start = min((join + cost[i], 0), (open_ + cost[i] + 0.5, 1))
        trace.append((stay[1], start[1]))
        join, open_ = stay[0], start[0]
    state = int(open_ < join) if len(lines) > 1 else 1
    opens = [state]
    for stay, start in reversed(trace):
        state = start if state else stay
        opens.append(state)
    out: list[list[str]] = []
    for line, begins in zip(lines, reversed(opens)):
        if begins or not out:
            out.append([])
        out[-1].append(line)
    return out


_PAGE = re.compile(r"^\W*(?P<word>p(?:age|ag|\.|g\.|ágina|ág)|seite|s\.|pág\.?|página|f\.)?\W{0,3}(?P<n>[0-9]{1,4}|[ivxlcdm]{1,7})(?:\s*(?P<of>/|of|von|de|sur)\s*\d{1,4})?\W*$", re.I)
_INLINE = re.compile(r"^\W*(?P<a>\d{1,4})(?=[\s|·•–—-]+\S)|(?<=\S)[\s|·•–—-]+(?P<b>\d{1,4})\W*$")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(text: str) -> int | None:
    """Value of a well-formed Roman numeral below 400; larger ones are words (mix, mild) rather than pages."""
    if not re.fullmatch(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", text) or not text:
        return None
    values = [_ROMAN[c] for c in text]
    total = sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))
    return total if total < 400 else None


def page_number(line: str) -> tuple[int, str] | None:
    """(number, "alone" | "marked" | "inside") of a line at a page's edge."""
    bare_line = line.strip()
    if len(bare_line) > 100:
        return None
    if m := _PAGE.match(bare_line):
        text = m["n"].lower()
        n = int(text) if text.isdigit() else roman(text)
        if n is not None:
            decorated = m["word"] or m["of"] or re.match(r"^[\[(–—-]", bare_line)
            return n, "marked" if decorated and (text.isdigit() or m["word"] or bare_line[0] in "[(–—-") else "alone"
    if m := _INLINE.search(bare_line):
        return int(m["a"] or m["b"]), "inside"
    return None


_FOLD = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u")]
_FOLD1 = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "ſ": "s", "@": "a", "†": "t", "e": "c", "h": "b", "|": "l"})


def skeleton(line: str) -> str:
    """A line's letters with characters that look alike made the same; page numbers and spaces are gone."""
    bare_line = _INLINE.sub(" ", line.strip().lower())
    kept = re.sub(r"[^\w@†�]|_", "", re.sub(r"(?<![^\W\d])\d+(?![^\W\d])", "", bare_line))
    for a, b in _FOLD:
        kept = kept.replace(a, b)
    return kept.translate(_FOLD1)


EDGES = "observation_id bigint, book_id bigint, page_no bigint, line_no int, line string, own boolean, number int, number_kind string, skeleton string"


def _edges_of(lines: list[tuple[str, bool]]) -> Iterator[tuple]:
    """(line_no, line, own, number, number_kind, skeleton) of a page's (line, own) that could be running lines."""
    for at in (0, 1, -1, -2):
        if not -len(lines) <= at < len(lines) or (at == 1 and len(lines) < 4) or (at == -2 and len(lines) < 4):
            continue
        if at in (1, -2) and not _running(*lines[0 if at == 1 else -1]):
            continue
        line, own = lines[at]
        if not _running(line, own):
            continue
        yield at, line, own, *(page_number(line) or (None, None)), skeleton(line)


def _edge_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in EDGES.split(", ")])
    frame["number"] = frame["number"].astype("Int64")
    return frame


def page_edges(observations: DataFrame) -> DataFrame:
    """The one or two lines at the top and bottom of each read that could be running lines: :data:`EDGES`.

    ``line_no`` counts from 0 at the top, from -1 at the bottom.
    """

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for oid, book, page, raw in zip(batch["observation_id"], batch["book_id"], batch["page_no"], batch["raw"]):
                parts = blocks_of(raw) if raw else []
                lines = [(line, len(block) == 1 or (kind == "free" and "<|ref|>" not in raw)) for kind, block in parts for line in block]
                out += [(oid, book, page, *edge) for edge in _edges_of(lines)]
            yield _edge_frame(out)

    rows = observations.filter("observation_id is not null and raw is not null").select("observation_id", "book_id", "page_no", "raw")
    return rows.mapInPandas(edges, EDGES)


def _running(line: str, own: bool) -> bool:
    return own and len(line) <= 100 and not re.search(r"[a-zäöüßéèà]{2,}[.!?;,:]$", line.strip()) and not re.match(r"[<|>$\\{*-]+[^\d\s]|\[\^|#{1,6}\s", line.strip())


def running_lines(edges: DataFrame, pages: int = PAGES) -> DataFrame:
    """(observation_id, line_no, noise) of the running headers and page numbers among the edges.

    A header is a line whose folded letters, or those of its first or last half, stand
    at the edges of ``pages`` different pages of the book, and which is close to the
    most frequent line with that key. A page number stands alone or in a line, and its
    distance from the page's place holds for at least two pages of the book, and a tenth
    of those of the book's most frequent distance, or it is set off by a word or signs;
    in a line, the line must be a header. Groups are counted by partial aggregation, so a hot
    book is never gathered; a null book is a book of its own.
    """
    lines = edges.filter(F.length("skeleton") >= 5).select("observation_id", "book_id", "page_no", "line_no", "skeleton")
    n = F.length("skeleton")
    keys = F.array(
        F.struct(F.lit(0).alias("part"), F.col("skeleton").alias("key")),
        F.struct(F.lit(1).alias("part"), F.substring("skeleton", 1, 7).alias("key")),
        F.struct(F.lit(2).alias("part"), F.expr("right(skeleton, 7)").alias("key")),
        F.struct(F.lit(3).alias("part"), F.expr("substring(skeleton, cast(floor(length(skeleton) / 2) as int) - 2, 6)").alias("key")),
    )
    keyed = lines.withColumn("k", F.explode(F.when(n >= 8, keys).otherwise(F.slice(keys, 1, 1)))).select("book_id", "page_no", "skeleton", "k.part", "k.key")
    group = ["book_id", "part", "key"]
    forms = keyed.groupBy(*group, "skeleton").agg(F.count_distinct("page_no").alias("n"))
    # The form most often seen, the smaller on a tie. From here on a line text of a book is one row, however many pages it is on.
    mode = forms.groupBy(*group).agg(F.max(F.struct("n", "skeleton")).alias("m"), F.sum("n").alias("total")).filter(F.col("total") >= pages).select(*group, F.col("m.skeleton").alias("form"))
    same = F.col("a.book_id").eqNullSafe(F.col("c.book_id")) & (F.col("a.part") == F.col("c.part")) & (F.col("a.key") == F.col("c.key"))
    near = forms.alias("a").join(mode.alias("c"), same).select("a.book_id", "a.skeleton", "c.form")
    near = near.filter(F.levenshtein("skeleton", "form") <= F.greatest(F.lit(1), (F.length("form") * 0.3).cast("int"))).distinct()
    placed = lines.select("book_id", "skeleton", "page_no").distinct().alias("a").join(near.alias("c"), F.col("a.book_id").eqNullSafe(F.col("c.book_id")) & (F.col("a.skeleton") == F.col("c.skeleton")))
    often = placed.groupBy("c.book_id", "c.form").agg(F.count_distinct("a.page_no").alias("n")).filter(F.col("n") >= pages).select(F.col("book_id").alias("_b"), F.col("form").alias("_f"))
    kept = near.join(often, F.col("book_id").eqNullSafe(F.col("_b")) & (F.col("form") == F.col("_f")), "left_semi").select(F.col("book_id").alias("_b"), F.col("skeleton").alias("_k")).distinct()
    headers = lines.join(kept, F.col("book_id").eqNullSafe(F.col("_b")) & (F.col("skeleton") == F.col("_k")), "left_semi").select("observation_id", "line_no", F.lit("header").alias("noise")).distinct()
    numbers = edges.filter("number is not null").withColumn("shift", F.col("number") - F.col("page_no"))
    votes = numbers.groupBy("book_id", "shift").agg(F.count_distinct("page_no").alias("votes"))
    # One row per book and distance; the most frequent distance of a book by partial aggregation.
    most = votes.groupBy("book_id").agg(F.max("votes").alias("most")).withColumnRenamed("book_id", "_b")
    good = votes.join(most, F.col("book_id").eqNullSafe(F.col("_b"))).filter((F.col("votes") >= 2) & (F.col("votes") >= SHIFT_SHARE * F.col("most"))).select(F.col("book_id").alias("_b"), F.col("shift").alias("_s"), F.lit(True).alias("held"))
    told = numbers.join(good, F.col("book_id").eqNullSafe(F.col("_b")) & (F.col("shift") == F.col("_s")), "left")
    inside = told.filter("held and number_kind = 'inside'").select("observation_id", "line_no").join(headers.select("observation_id", "line_no"), ["observation_id", "line_no"], "left_semi")
    alone = told.filter("number_kind = 'marked' or held and number_kind = 'alone'").select("observation_id", "line_no")
    placed = alone.unionByName(inside).withColumn("noise", F.lit("page_number")).distinct()
    return headers.unionByName(placed)


WORDS = "observation_id bigint, hyphen int, misread int, text string"


def decoded(observations: DataFrame, counts: dict[str, int], running: DataFrame | None = None, texts: bool = True, told: int | None = None) -> DataFrame:
    """(observation_id, hyphen, misread, text) of each read.

    Without texts, ``told`` ends the counts of a read as soon as it has a divided word and so
    many misread ones: what else it has changes nothing then.

    ``text`` holds the mended paragraphs, separated by empty lines, without the lines of
    ``running``; opaque stretches (formulas, code, tags) are left as they are. A null or
    empty read gives no row.
    """
    if len(counts) > MOST_WORDS:
        raise ValueError("the lexicon is larger than what may be sent to the tasks")
    rows = observations.filter("observation_id is not null and raw != ''").select("observation_id", "raw")
    if running is None:
        rows = rows.withColumn("drop", F.array().cast("array<int>"))
    else:
        drop = running.groupBy("observation_id").agg(F.collect_set("line_no").alias("drop"))
        rows = rows.join(drop, "observation_id", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    shared, name = rows.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _decoder(name, shared.value)
        for batch in batches:
            out = []
            for oid, raw, drop in zip(batch["observation_id"], batch["raw"], batch["drop"]):
                parts = blocks_of(raw)
                total = sum(len(b) for _, b in parts)
                gone = {int(d) % total for d in drop} if total else set()
                hyphen = misread = at = 0
                pieces = []
                for _, block in parts:
                    marked, shown = [], []
                    for line in block:
                        marked.append(line)
                        if at not in gone:
                            shown.append(line)
                        at += 1
                    stream = "\n".join(marked)
                    mended, count = mend_text(decoder, stream)
                    hyphen += count["hyphen"]
                    misread += count["confused"] + count["odd"] + count["split"] + count["spaced"]
                    if told is not None and not texts and hyphen and misread >= told:
                        break
                    if texts and shown:
                        pieces += _continuous(decoder, shown, mended if len(shown) == len(marked) else None)
                out.append((oid, hyphen, misread, "\n\n".join(pieces) if texts else None))
            yield pd.DataFrame(out, columns=["observation_id", "hyphen", "misread", "text"])

    return rows.mapInPandas(mend, WORDS)


def _continuous(decoder: Decoder, shown: list[str], mended: str | None = None) -> list[str]:
    """The mended paragraphs of a block's lines; ``mended`` is the whole block's text where that is known."""
    out = []
    for group in paragraphs(shown):
        if mended is None or len(group) < len(shown):
            mended, _ = mend_text(decoder, "\n".join(group))
        out.append(re.sub(r"\s*\n\s*", " ", mended) if "```" not in mended and "~~~" not in mended else mended)
    return out


def mend_text(decoder: Decoder, stream: str) -> tuple[str, dict[str, int]]:
    """Decode what lies between the opaque stretches of a text."""
    if not _SIGNS.search(stream):
        return decoder.decode(stream)
    count = {"confused": 0, "odd": 0, "split": 0, "spaced": 0, "hyphen": 0}
    out, at = [], 0
    for m in [*_OPAQUE.finditer(stream), None]:
        part = stream[at : m.start() if m else len(stream)]
        if part:
            mended, some = decoder.decode(part)
            out.append(mended)
            for k, v in some.items():
                count[k] += v
        if m:
            out.append(m[0])
            at = m.end()
    return "".join(out), count


def noise(observations: DataFrame) -> DataFrame:
    """(observation_id, noise): the kinds of noise of every read, each once.

    ``hyphen``, ``misread`` (``MISREAD`` words or more), ``header``, ``page_number``.
    """
    words = decoded(observations, lexicon(observations), texts=False, told=MISREAD)
    kinds = F.array_compact(F.array(F.when(F.col("hyphen") > 0, F.lit("hyphen")), F.when(F.col("misread") >= MISREAD, F.lit("misread"))))
    own = words.select("observation_id", F.explode(kinds).alias("noise"))
    # The edges are read a dozen times; they are short, the reads are not.
    edges = running_lines(cut_lineage(page_edges(observations))).select("observation_id", "noise")
    return own.unionByName(edges).distinct()


def repaired(observations: DataFrame) -> DataFrame:
    """(observation_id, text): every read as continuous paragraphs, one row per id."""
    once = observations.dropDuplicates(["observation_id"])
    return decoded(once, lexicon(observations), running_lines(cut_lineage(page_edges(observations)))).select("observation_id", "text")


_BLOCK_PAGE = ["observation_id", "book_id", "page_no"]
BLOCK_WORDS = "block_id bigint, hyphen int, misread int, text string"


def block_pages(blocks: DataFrame) -> DataFrame:
    """(page, book_id, page_no, parts): the blocks of each page in order, each id once.

    ``page`` is a negative number, so that it is no observation's.
    """
    once = blocks.filter("block_id is not null and markdown is not null").dropDuplicates(["block_id"])
    part = F.struct("ordinal", "block_id", "markdown", "confidence")
    pages = once.groupBy(*_BLOCK_PAGE).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return pages.select((-1 - F.array_min(F.transform("parts", lambda p: p["block_id"]))).alias("page"), "book_id", "page_no", "parts")


def _block_lines(markdown: str) -> list[str]:
    return [x.strip() for x in markdown.split("\n") if x.strip()]


def block_edges(pages: DataFrame) -> DataFrame:
    """The edges of :func:`block_pages` as :data:`EDGES`; ``observation_id`` is the page."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, book, no, parts in zip(batch["page"], batch["book_id"], batch["page_no"], batch["parts"]):
                blocks = [_block_lines(p["markdown"]) for p in parts]
                lines = [(line, len(block) == 1) for block in blocks for line in block]
                out += [(page, book, no, *edge) for edge in _edges_of(lines)]
            yield _edge_frame(out)

    return pages.mapInPandas(edges, EDGES)


def repaired_blocks(blocks: DataFrame, observations: DataFrame) -> DataFrame:
    """(block_id, hyphen, misread, text) of every block with a text, one row per id.

    ``text`` is as in :func:`decoded`; it is empty for a block that is a running line or a
    page number. Running lines are told from the pages of reads and of blocks. Blocks
    are stretches of their reads, so only those without a read are counted for the
    lexicon as well.
    """
    alone = blocks.join(observations.filter("raw != ''").select("observation_id").distinct(), "observation_id", "left_anti").dropDuplicates(["block_id"])
    counts = lexicon(observations.select("raw").unionByName(alone.select(F.col("markdown").alias("raw"))))
    pages = block_pages(blocks)
    # The edges are read a dozen times; without a checkpoint the pages would be put together as often.
    edges = cut_lineage(page_edges(observations).unionByName(block_edges(pages)))
    running = running_lines(edges).filter("observation_id < 0")
    drop = running.groupBy(F.col("observation_id").alias("page")).agg(F.collect_set("line_no").alias("drop"))
    rows = pages.join(drop, "page", "left").select("parts", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    shared, name = rows.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usual = _decoder(name, shared.value)
        for batch in batches:
            out = []
            for parts, drop in zip(batch["parts"], batch["drop"]):
                blocks = [_block_lines(p["markdown"]) for p in parts]
                total = sum(map(len, blocks))
                gone = {int(d) % total for d in drop} if total else set()
                at = 0
                for part, lines in zip(parts, blocks):
                    decoder = usual.at(part["confidence"])
                    shown = [x for i, x in enumerate(lines, at) if i not in gone]
                    at += len(lines)
                    mended, count = mend_text(decoder, "\n".join(lines))
                    pieces = _continuous(decoder, shown, mended if len(shown) == len(lines) else None)
                    out.append((part["block_id"], count["hyphen"], count["confused"] + count["odd"] + count["split"] + count["spaced"], "\n\n".join(pieces)))
            yield pd.DataFrame(out, columns=["block_id", "hyphen", "misread", "text"])

    return rows.mapInPandas(mend, BLOCK_WORDS)
