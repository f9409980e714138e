"""Training of the block labeller on pages composed here: ``python -m foliospark.llm.markup_train``.

Every page is a sequence of blocks put together from pieces of known family (with decoys of none), so each
leaf's label is known. A tenth is held out and its accuracy printed.
"""

from __future__ import annotations

import random

import numpy as np

from foliospark.llm.labeller import INPUT, WEIGHTS, Labeller, features
from foliospark.llm.leaves import FAMILIES, Leaf, leaves_of

#: Pages, passes over them, pages of a step.
TEXTS, EPOCHS, BATCH = 9_000, 6, 64

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu ar el in or un sch tr pl gr".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))


def _words(r: random.Random, a: int = 1, b: int = 6) -> str:
    return " ".join(_word(r) for _ in range(r.randint(a, b)))


def _sentence(r: random.Random) -> str:
    number = f" {r.randint(1, 999)}" if r.random() < 0.2 else ""
    return _words(r, 3, 9).capitalize() + number + r.choice([".", ".", ".", "?", ", " + _words(r) + "."])


def _math(r: random.Random) -> str:
    x, y = r.choice("abcdefxyz"), r.choice("mnpqruv")
    n = r.randint(1, 99)
    return r.choice([rf"\frac{{{x}_{n}}}{{{y}}}={x}", rf"\alpha_{x}+\sqrt{{{y}}}\le {n}", rf"\int_0^{{{n}}} {x}({y})\,d{y}", f"{x}={y}^2+{n}{x}", f"{x}", f"{x}_{y}", f"{n}{x}+{y}", rf"\sum_{{{x}=1}}^{{{n}}} {y}^{{{x}}}", f"O({y} \\log {y})"])


def _code(r: random.Random) -> str:
    return "\n".join(r.choice(["for x in rows:", "    total += x", "$x = 5", "# a note", "<b>%s</b>", "SELECT * FROM t -- [[n]]", "if (a < b && c > d) { }", r"print('\alpha')", "**k", "== y =="]) for _ in range(r.randint(1, 5)))


def _inline(r: random.Random) -> tuple[str, str]:
    w, two = _words(r, 1, 3), _word(r)
    return r.choice([
        ("html", f"<{two[:4]}>{w}</{two[:4]}>"), ("html", f"<b>{w}</b>"), ("html", f'<a href="/{two}.md">{w}</a>'), ("html", f"<!-- {w} -->"), ("html", "<br/>"), ("html", "<br>"),
        ("html", f'<img src="{two}.png" alt="{w}"/>'), ("html", f"<sup>{r.randint(1, 30)}</sup>"), ("html", f'<span style="color:#333">{w}</span>'), ("html", "&nbsp;"), ("html", f"{_word(r)}{r.choice(['&#8217;', '&amp;', '&rsquo;', '&nbsp;', '&#x27;'])}{r.choice(['', 's'])}"), ("html", f"&lt;{w}&gt;"), ("html", "&amp;"),
        ("markdown", f"**{w}**"), ("markdown", f"*{w}*"), ("markdown", f"_{w}_"), ("markdown", f"__{w}__"), ("markdown", f"~~{w}~~"), ("markdown", f"[{w}]({two}.md)"), ("markdown", f"![{w}]({two}.png)"),
        ("markdown", f"`{r.choice([w, '<div>', '$x$', '[[a]]', chr(92) + 'alpha'])}`"), ("markdown", f"[^{r.randint(1, 9)}]"), ("markdown", f"<https://{two}.org/>"), ("markdown", f"[{w}][{r.randint(1, 9)}]"),
        ("wiki", f"[[{w}]]"), ("wiki", f"[[{two}|{w}]]"), ("wiki", f"''{w}''"), ("wiki", f"'''{w}'''"), ("wiki", f"{{{{{two}|{w}={r.randint(1, 30)}}}}}"), ("wiki", f"{{{{{two}}}}}"),
        ("latex", f"${_math(r)}$"), ("latex", f"${_math(r)}$"), ("latex", rf"\({_math(r)}\)"), ("latex", f"$${_math(r)}$$"), ("latex", rf"\{r.choice(['emph', 'textbf', 'cite', 'ref', 'footnote', 'section', 'label'])}{{{w}}}"), ("latex", f"{{\\em {w}}}"), ("latex", r"\item"),
        ("text", f"{r.randint(2, 99)} * {r.randint(2, 9)} = {r.randint(2, 99)} and x == y {{maybe}}"), ("text", f"${r.randint(1, 99)}, then ${r.randint(1, 99)} more"), ("text", f"{r.randint(1, 9)} < {r.randint(1, 99)} and {r.randint(4, 9)} > 3"),
        ("text", f"row_{two}_id"), ("text", f"R&D kept {two}"), ("text", f"C:\\{two}\\new was lost"), ("text", f"Seat #{r.randint(1, 99)} [sic] was free"), ("text", f"between ${r.randint(1, 99)}-{r.randint(1, 99)}$ a {two}"), ("text", f"{two}'s {two}' "), ("text", f"{two} ~ {two} | {two}"),
        ("text", f"a {two} of {r.randint(2, 9)}'' and {r.randint(2, 30)}'' "), ("text", f"$ {r.randint(1, 99)} and {r.randint(1, 99)} $ {two}"), ("text", f"{r.randint(2, 9)}*{r.choice([two, str(r.randint(2, 99))])}*{r.randint(2, 9)}"), ("text", f"{two}_{w.split()[0]}_{two}_x"),
        ("text", f"{r.choice('CDE')}:\\{two}\\{two}.txt"), ("text", f"so {two[:2]} <{two} and {two}> {two}"), ("text", f"{w}!! {two}"), ("text", f"{two}|{two} or {w}"), ("text", f"R&D; {w}"), ("text", f"{two} = {two} == {r.randint(1, 9)}"), ("latex", f"$ {_math(r)} $"),
    ])


Pieces = list[tuple[str, str]]


def _cell(r: random.Random, family: str) -> Pieces:
    """A table cell: a word, a number, or markup of the table's family or of tags."""
    if r.random() < 0.7:
        return [(family, r.choice([_words(r, 1, 2), str(r.randint(1, 99))]))]
    for _ in range(20):
        kind, text = _inline(r)
        if kind in (family, "html") and "|" not in text and "\n" not in text:
            return [(kind, text)]
    return [(family, _word(r))]


def _table(r: random.Random) -> Pieces:
    """A pipe table, with or without outer pipes, or a brace table."""
    rows, columns = r.randint(1, 4), r.randint(1, 4)
    out: Pieces = []
    put = lambda family, text: out.append((family, text))
    if r.random() < 0.5:
        outer = columns == 1 or r.random() < 0.7
        for row in range(rows + 1):
            put("markdown", "| " if outer else "")
            for c in range(columns):
                put("markdown", " | " if c else "")
                out += _cell(r, "markdown")
            put("markdown", " |\n" if outer else "\n")
            if not row:
                rule = r.choice(["---", ":---", "--:"])
                put("markdown", ("| " if outer else "") + " | ".join([rule] * columns) + (" |\n" if outer else "\n"))
        return [(k, t.rstrip("\n") if i == len(out) - 1 else t) for i, (k, t) in enumerate(out)]
    put("wiki", r.choice(["{|\n", '{| class="plain"\n', "{| border=1\n"]))
    if r.random() < 0.2:
        put("wiki", f"|+ {_words(r)}\n")
    for row in range(rows):
        if row or r.random() < 0.7:
            put("wiki", "|-\n")
        mark, flat = ("! " if not row and r.random() < 0.3 else "| "), r.random() < 0.7
        for c in range(columns):
            put("wiki", mark if not c or not flat else (" !! " if mark == "! " else " || "))
            out += _cell(r, "wiki")
            put("wiki", "\n" if not flat or c == columns - 1 else "")
    put("wiki", "|}")
    return out


def _block(r: random.Random) -> Pieces:
    w = _words(r, 2, 4).title()
    rows = range(r.randint(1, 4))
    if r.random() < 0.15:
        return _table(r)
    return [r.choice([
        ("html", f"<h2>{w}</h2>"), ("html", "<ul>" + "".join(f"<li>{_sentence(r)}</li>" for _ in rows) + "</ul>"), ("html", f"<p>{_sentence(r)}</p>"), ("html", "<table>" + "".join(f"<tr><td>{_word(r)}</td><td>{r.randint(1, 99)}</td></tr>" for _ in rows) + "</table>"), ("html", f'<div class="x">{_sentence(r)}</div>'), ("html", f"<!-- {_words(r)} | {_words(r)} -->"),
        ("markdown", "#" * r.randint(1, 4) + f" {w}"), ("markdown", f"{w}\n" + r.choice(["=====", "----"])), ("markdown", "\n".join(f"{r.choice(['- ', '* ', '+ ', '- [ ] ', '- [x] ', '   * '])}{_sentence(r)}" for _ in rows)), ("markdown", "\n".join(f"{i + 1}{r.choice('.)')} {_sentence(r)}" for i in rows)),
        ("markdown", "\n".join(f"> {_sentence(r)}" for _ in rows)), ("markdown", f"{(m := r.choice(['```', '~~~']))}{r.choice(['', 'python'])}\n{_code(r)}\n{m}"), ("markdown", f"[^{r.randint(1, 9)}]: {_sentence(r)}"),
        ("wiki", "=" * (k := r.randint(2, 3)) + f" {w} " + "=" * k), ("wiki", f"{{{{infobox|{_word(r)}={r.randint(1, 9)}}}}}"), ("wiki", f"{{{{quote\n| text = {_sentence(r)}\n| who = {_word(r)}\n}}}}"),
        ("latex", f"$$\n{_math(r)}\n$$"), ("latex", f"\\[\n{_math(r)}\n\\]"), ("latex", f"\\begin{{equation}}\n{_math(r)}\n\\end{{equation}}"), ("latex", f"\\begin{{itemize}}\n\\item {_sentence(r)}\n\\end{{itemize}}"), ("latex", f"\\section{{{w}}}"),
        ("text", f"{r.randint(1200, 2000)}"), ("text", _sentence(r)), ("text", f"– {r.randint(1, 99)} –"),
    ])]


def compose(r: random.Random, liked: str | None = None) -> tuple[str, np.ndarray]:
    """A block's text and the family of every character."""
    out, family = [], []

    def put(kind: str, text: str) -> None:
        out.append(text)
        family.append(np.full(len(text), FAMILIES.index(kind), np.int8))

    mixed = r.random() < 0.3
    liked = liked or r.choice(FAMILIES)
    for _ in range(r.choice([1, 1, 1, 2, 3])):
        if out:
            put("text", r.choice(["\n\n", "\n\n", "\n"]))
        if r.random() < 0.4:
            pieces = _block(r)
            for _ in range(6):
                if mixed or pieces[0][0] in (liked, "text"):
                    break
                pieces = _block(r)
            for kind, text in pieces:
                put(kind, text)
        else:
            for k in range(r.randint(1, 4)):
                if k:
                    put("text", " ")
                put("text", _sentence(r))
                if r.random() < 0.5:
                    kind, text = _inline(r)
                    put("text", "" if text[0] in "&[<" and r.random() < 0.4 else " ")
                    put(kind, text)
    return "".join(out), np.concatenate(family)


def page(r: random.Random) -> list[tuple[str, list[Leaf], np.ndarray]]:
    """The blocks of a page: text, leaves and the leaves' families."""
    out = []
    liked = r.choice(FAMILIES) if r.random() < 0.4 else None
    for _ in range(r.randint(1, 9)):
        text, family = compose(r, liked)
        leaves = leaves_of(text)
        out.append((text, leaves, np.array([0 if leaf.kind in ("run", "sign") else np.bincount(family[leaf.start : leaf.end]).argmax() for leaf in leaves])))
    return out


def examples(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of ``n`` composed pages with at least one candidate."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        blocks = page(r)
        if any(leaf.kind != "run" for _, leaves, _ in blocks for leaf in leaves):
            out.append((np.concatenate([features(t, leaves) for t, leaves, _ in blocks]), np.concatenate([y for _, _, y in blocks])))
    return out


def _batch(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(y) for _, y in rows)
    x, mask, label = np.zeros((t, len(rows), INPUT), np.float32), np.zeros((t, len(rows), 1), np.float32), np.zeros((t, len(rows)), np.int64)
    for k, (f, y) in enumerate(rows):
        x[: len(y), k], mask[: len(y), k], label[: len(y), k] = f, 1, y
    return x, mask, label


def train(texts: int = TEXTS, epochs: int = EPOCHS, seed: int = 11) -> tuple[Labeller, float]:
    """A trained labeller and its accuracy on held-out candidates."""
    rows = examples(texts, seed)
    held, rows = rows[: texts // 10], rows[texts // 10 :]
    model = Labeller()
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.w.items()}
    r, step = random.Random(seed), 0
    for epoch in range(epochs):
        r.shuffle(rows)
        rows.sort(key=lambda q: len(q[1]) // 6)
        starts = list(range(0, len(rows), BATCH))
        r.shuffle(starts)
        rate = 0.01 * 0.5**epoch + 0.0005
        for a in starts:
            loss, grad = model.train_batch(*_batch(rows[a : a + BATCH]))
            norm = sum(float((g * g).sum()) for g in grad.values()) ** 0.5
            step += 1
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.001 * (g * g - v2[k])
                model.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        good = total = 0
        for a in range(0, len(held), 256):
            x, mask, y = _batch(held[a : a + 256])
            ok = (model.scores(x, mask).argmax(2) == y) & (mask[:, :, 0] > 0)
            good, total = good + ok.sum(), total + int(mask.sum())
        print(f"pass {epoch}: loss {loss:.4f}, held-out accuracy {good / total:.5f}", flush=True)
    return model, good / total


if __name__ == "__main__":
    trained, _ = train()
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in trained.w.items()})
