"""Documents of known structure in four markups, for training and measuring the block labeller: what each block is, is known because it was made so.

Every element carries a word of its own, so the leaf it becomes is found again in the segmented document, whatever the segmentation; leaves without such a word are no elements.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np

from docweave.llm.markup import CLASS, Leaf

_ONSETS = ("b", "c", "ch", "d", "đ", "g", "gi", "h", "k", "kh", "l", "m", "n", "ng", "nh", "ph", "qu", "s", "t", "th", "tr", "v", "x", "")
_RHYMES = ("a", "ai", "an", "anh", "ao", "ăn", "âm", "âu", "ang", "e", "em", "ê", "i", "iên", "inh", "o", "oi", "ong", "ô", "ôn", "ơ", "u", "uc", "ung", "ư", "ương", "y", "á", "ạch", "ả", "ấp", "ậ", "ế", "ộ", "ợ", "ứ", "ụng")


#: Blocks of a short, a middling and a long document besides its first, at most.
_MOST = (3, 6, 12)
_MARKER = re.compile(r"zq\d+zq")


class Writer:
    """One document in the making: ``parts`` is its text, ``truth`` the class of the element that carries each marker word."""

    def __init__(self, rng: random.Random):
        self.rng, self.truth = rng, {}
        self.n = 0

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(_ONSETS) + self.rng.choice(_RHYMES) for _ in range(self.rng.randint(low, high)))

    def marked(self, low: int, high: int, markup: str | None = None, kind: str | None = None) -> str:
        """Some words, one of them the marker of an element (or of nothing, without ``markup``)."""
        self.n += 1
        word = f"zq{self.n}zq"
        if markup:
            self.truth[word] = CLASS[markup, kind]
        text = self.words(low, high).split()
        text.insert(self.rng.randint(0, len(text)), word)
        text = " ".join(text)
        return text[0].upper() + text[1:] if self.rng.random() < 0.7 else text

    def formula(self, markup: str) -> str:
        self.n += 1
        word = f"zq{self.n}zq"
        self.truth[word] = CLASS[markup, "formula"]
        return self.rng.choice((r"{0} = a + b", r"\frac{{{0}}}{{2}}", r"{0}^2 \le x_i", r"\sum_{{i}} {0}_i", r"S = {0} \times h")).format(word)

    def pick(self, *options):
        return self.rng.choice(options)()


def _sentence(w: Writer, inline: list) -> str:
    parts = [w.words(3, 14)]
    for make in inline:
        if w.rng.random() < 0.25:
            parts += [make(), w.words(1, 6)]
    return " ".join(parts) + w.rng.choice((".", ";", ",", ""))


def _tex_inline(w: Writer, label: str):
    return lambda: w.rng.choice(("${}$", r"\({}\)", "$$ {} $$", r"\[ {} \]")).format(w.formula(label))


def _html(w: Writer, tex: str) -> str:
    r = w.rng
    tag = lambda t: f"<{t}{r.choice(('', '', ' class="x"', ' style="margin:0"'))}>"
    inline = [lambda: f"<b>{w.words(1, 3)}</b>", lambda: f'<a href="#">{w.words(1, 3)}</a>', lambda: w.words(1, 2) + "&nbsp;" + w.words(1, 2), _tex_inline(w, tex)]

    def heading():
        h = f"h{r.randint(1, 6)}"
        return f"{tag(h)}{w.marked(1, 7, 'html', 'heading')}</{h}>"

    def items():
        t = r.choice(("ul", "ol"))
        each = [f"{tag('li')}{w.marked(1, 9, 'html', 'list_item')}{r.choice(('</li>', '</li>', ''))}" for _ in range(r.randint(1, 5))]
        if r.random() < 0.3:
            each.insert(1, f"<ul>{tag('li')}{w.marked(1, 5, 'html', 'list_item')}</li></ul>")
        return f"{tag(t)}" + r.choice(("", "\n")).join(each) + f"</{t}>"

    def rows():
        n = r.randint(1, 4)
        each = ["<tr>" + "".join(f"<{c}>{w.marked(0, 3, 'html', 'table_row') if k == 0 else w.words(1, 3)}</{c}>" for k in range(n)) + "</tr>" for c in ("th", *["td"] * r.randint(1, 4))]
        return tag("table") + r.choice(("", "\n")).join(each) + "</table>"

    def code():
        return "<pre>" + r.choice(("", "<code>")) + w.marked(1, 4, "html", "code_block") + r.choice(("\n# " + w.words(1, 3), "\n&lt;li&gt;" + w.words(1, 2), "")) + "</pre>"

    def maths():
        return f"<p>{w.words(1, 5)} <math><mi>{w.marked(0, 0, 'html', 'formula')}</mi></math> {w.words(1, 4)}</p>"

    def text():
        t = r.choice(("p", "p", "div"))
        return f"{tag(t)}{_sentence(w, inline)}</{t}>"

    def alone():
        return r.choice((f"<p>{inline[-1]()}</p>", inline[-1]()))

    def nothing():
        return r.choice((f"<!-- {w.marked(1, 4)} <h1>{w.words(1, 2)}</h1> -->", f"<script>var x = '{w.marked(0, 1)}';</script>", f"<style>.x {{ }} /* {w.marked(0, 2)} */</style>", f"<p><b>{w.marked(1, 5)}</b></p>", f'<p align="center">{w.marked(1, 5)}</p>'))

    blocks = [w.pick(heading, text, text, items, rows, code, maths, alone, nothing) for _ in range(r.randint(1, r.choice(_MOST)))]
    return r.choice(("\n", "\n\n", "")).join(blocks)


def _markdown(w: Writer) -> str:
    r = w.rng
    inline = [lambda: f"**{w.words(1, 3)}**", lambda: f"[{w.words(1, 3)}](http://x.y/z)", lambda: f"`# {w.words(1, 2)}`", lambda: f"*{w.words(1, 2)}*", _tex_inline(w, "markdown")]

    def heading():
        if r.random() < 0.25:
            return w.marked(1, 6, "markdown", "heading") + "\n" + r.choice(("=", "-")) * r.randint(3, 12)
        return "#" * r.randint(1, 6) + " " + w.marked(1, 7, "markdown", "heading") + r.choice(("", "", " ##"))

    def items():
        mark = r.choice("-*+")
        lines = [f"{mark} {r.choice(('', '', '', '[ ] ', '[x] '))}{w.marked(1, 9, 'markdown', 'list_item')}" for _ in range(r.randint(1, 5))]
        if r.random() < 0.3:
            lines.insert(1, f"  {mark} {w.marked(1, 5, 'markdown', 'list_item')}")
        return "\n".join(lines)

    def rows():
        n = r.randint(2, 4)
        line = lambda: "| " + " | ".join(w.marked(0, 3, "markdown", "table_row") if k == 0 else w.words(1, 3) for k in range(n)) + " |"
        return "\n".join([line(), "|" + "---|" * n, *(line() for _ in range(r.randint(1, 4)))])

    def text():
        return _sentence(w, inline)

    def nothing():
        return r.choice((f"{r.randint(1, 9)}. {w.marked(1, 6)}", f"**{w.marked(1, 5)}**", "---", f"> {w.marked(2, 8)}", f"<!-- # {w.marked(1, 3)} -->", f"{w.words(2, 4)} giá $5 và $6 {w.words(1, 3)}", rf"\# {w.marked(1, 6)}", rf"\- {w.marked(1, 6)}"))

    def alone():
        return inline[-1]()

    # a record that uses Markdown shows it somewhere: its first block is a clear one
    blocks = [w.pick(heading, rows, _fence_of(w)), *(w.pick(heading, text, text, items, rows, _fence_of(w), alone, nothing) for _ in range(r.randint(0, r.choice(_MOST))))]
    r.shuffle(blocks)
    return "\n\n".join(blocks)


def _fence(w: Writer) -> str:
    mark = w.rng.choice(("```", "~~~"))
    return mark + w.rng.choice(("", "python")) + "\n" + w.marked(1, 4, "markdown", "code_block") + w.rng.choice(("\n# " + w.words(1, 3), "\n- " + w.words(1, 3), "")) + "\n" + mark


def _fence_of(w: Writer):
    return lambda: _fence(w)


def _wiki(w: Writer) -> str:
    r = w.rng
    inline = [lambda: f"'''{w.words(1, 3)}'''", lambda: f"[[{w.words(1, 2)}|{w.words(1, 2)}]]", lambda: f"<nowiki>== {w.words(1, 2)} ==</nowiki>", lambda: f"<math>{w.formula('wiki')}</math>", lambda: "{{" + w.words(1, 2) + "}}"]

    def heading():
        mark = "=" * r.randint(2, 5)
        return f"{mark} {w.marked(1, 7, 'wiki', 'heading')} {mark}"

    def items():
        mark = r.choice(("*", "#", "* ", "# ", "**", "##", "#*"))
        return "\n".join(mark + r.choice(("", " ")) + w.marked(1, 8, "wiki", "list_item") for _ in range(r.randint(1, 5)))

    def rows():
        line = lambda c: f"|-\n{c} {w.marked(0, 3, 'wiki', 'table_row')} {c * 2} {w.words(1, 3)}"
        return "\n".join(['{| class="wikitable"', line("!"), *(line("|") for _ in range(r.randint(1, 4))), "|}"])

    def code():
        t = r.choice(("source", "syntaxhighlight"))
        return f'<{t} lang="x">{w.marked(1, 4, "wiki", "code_block")}\n# {w.words(1, 2)}</{t}>'

    def text():
        return _sentence(w, inline)

    def nothing():
        return r.choice((f"- {w.marked(1, 6)}", f"<!-- == {w.marked(1, 3)} == -->", f"'''{w.marked(1, 5)}'''", f"{r.randint(1, 9)}. {w.marked(1, 6)}"))

    blocks = [w.pick(heading, rows, code), *(w.pick(heading, text, text, items, rows, code, nothing) for _ in range(r.randint(0, r.choice(_MOST))))]
    r.shuffle(blocks)
    return "\n\n".join(blocks)


def _latex(w: Writer) -> str:
    r = w.rng
    inline = [lambda: r"\textbf{" + w.words(1, 3) + "}", lambda: r"\verb|# " + w.words(1, 2) + "|", lambda: r"\emph{" + w.words(1, 2) + "}", _tex_inline(w, "latex")]

    def heading():
        return "\\" + r.choice(("section", "subsection", "section*", "chapter", "paragraph")) + "{" + w.marked(1, 7, "latex", "heading") + "}"

    def items():
        e = r.choice(("itemize", "enumerate"))
        return f"\\begin{{{e}}}\n" + "\n".join(f"\\item {w.marked(1, 8, 'latex', 'list_item')}" for _ in range(r.randint(1, 5))) + f"\n\\end{{{e}}}"

    def rows():
        line = lambda: f"{w.marked(0, 3, 'latex', 'table_row')} & {w.words(1, 3)} \\\\"
        return "\\begin{tabular}{ll}\n\\hline\n" + "\n".join(line() for _ in range(r.randint(1, 5))) + "\n\\end{tabular}"

    def code():
        return "\\begin{verbatim}\n" + w.marked(1, 4, "latex", "code_block") + "\n# " + w.words(1, 2) + "\n\\end{verbatim}"

    def maths():
        e = r.choice(("equation", "align*", "displaymath"))
        return f"\\begin{{{e}}}\n{w.formula('latex')}\n\\end{{{e}}}"

    def text():
        return _sentence(w, inline)

    def nothing():
        return r.choice((f"% \\section{{{w.marked(1, 3)}}}", f"- {w.marked(1, 6)}", f"\\begin{{comment}}\n{w.marked(1, 3)}\n\\end{{comment}}", f"\\textbf{{{w.marked(1, 4)}}}"))

    blocks = [w.pick(heading, items, rows), *(w.pick(heading, text, text, items, rows, code, maths, nothing) for _ in range(r.randint(0, r.choice(_MOST))))]
    r.shuffle(blocks)
    return "\n\n".join(blocks)


def _plain(w: Writer) -> str:
    r = w.rng
    lines = [r.choice((lambda: w.words(3, 15), lambda: f"- {w.marked(1, 6)}", lambda: f"{r.randint(1, 20)}. {w.marked(1, 6)}", lambda: _sentence(w, [_tex_inline(w, "latex")]), lambda: f"{w.words(1, 3)} $5, $6 {w.words(1, 3)}"))() for _ in range(r.randint(1, 8))]
    return r.choice(("\n", "\n\n")).join(lines)


def document(rng: random.Random) -> tuple[str, dict[str, int]]:
    """A text and the class of each marker word: one markup, or HTML with another one, sometimes escaped as a whole."""
    w = Writer(rng)
    kind = rng.choice(("html", "html", "markdown", "markdown", "wiki", "wiki", "latex", "latex", "plain", "html+markdown", "html+wiki", "html+latex"))
    makers = {"markdown": _markdown, "wiki": _wiki, "latex": _latex, "plain": _plain}
    if kind == "html":
        text = _html(w, "latex")
    elif "+" in kind:
        other = kind.split("+")[1]
        parts = [_html(w, "markdown" if other == "markdown" else "latex"), makers[other](w)]
        rng.shuffle(parts)
        text = "\n\n".join(parts)
    else:
        text = makers[kind](w)
    if kind == "html" and rng.random() < 0.1:
        text = html.escape(text)
    return text, w.truth


def classes(leaves: list[Leaf], truth: dict[str, int]) -> np.ndarray:
    """The true class of each leaf: that of the element whose word it carries."""
    out = np.zeros(len(leaves), np.int64)
    for k, leaf in enumerate(leaves):
        out[k] = next((truth[m[0]] for m in _MARKER.finditer(leaf.text.lower()) if m[0] in truth), 0)
    return out


def unmarked(leaves: list[Leaf], rng: random.Random) -> list[Leaf]:
    """The leaves with any other word, letter or number in the marker words' places, which must not give an element away."""
    w = Writer(rng)
    for leaf in leaves:
        leaf.text = re.sub("(?i)" + _MARKER.pattern, lambda _: rng.choice((w.words(1, 1), rng.choice("abcdhklmnpqstxyzLMNPQRST"), str(rng.randint(0, 99)))), leaf.text)
    return leaves
