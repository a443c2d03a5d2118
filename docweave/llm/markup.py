"""Problem 2: markup residue to clean text that keeps headings, list items, table rows, code blocks and formulas.

A document is cut into the sequence of its leaves: what a tag, an environment, a fence or a line delimits.  Each leaf has a path (the tags or line
marks it stands in) and words.  A bidirectional LSTM in numpy reads path and hashed-word vectors of the whole sequence, every word of a leaf, and labels every leaf
with its markup and kind; what it knows of the rest of the document it has read on the way there.  The same mark means different things in different
documents (``#`` a heading or an item, a dash an item or a dash, ``$x$`` one markup's formula or another's); it's the network that tells.  An exact check
follows: a leaf can only become what its path admits.  The network is trained by train_markup.py on documents that are generated from a known structure; its weights are in markup_model.npz.

Defined results: null and blank texts have no leaf; a repeated row counts once; text of unclosed code, comments and literals goes to the end of the document;
a record that was escaped once too often as a whole is unescaped first; very long documents are read whole.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("heading", "list_item", "table_row", "code_block", "formula")
MARKUPS = ("html", "markdown", "wiki", "latex")
CLASSES = (None, *((m, k) for m in MARKUPS for k in KINDS))
CLASS = {c: n for n, c in enumerate(CLASSES)}

#: Path marks; each is one input of the network.
MARKS = (
    "html", "markdown", "wiki", "tex", "line", "text", "heading", "li", "tr", "pre", "math", "literal", "comment", "template", "#", "# tight", "* ", "*", "+ ", "- ", "nested",
    "==", "setext =", "setext -", "pipe row", "pipe", "rule", "number", "quote", "fence", "verbatim", "env", "$$", "$", "\\[", "\\(", "section", "item", "tabular", "cells",
    "bold **", "bold '''", "link [](", "link [[", "tick", "textbf", "command", "escape \\", "tag", "ref", "dollar", "task", "blank", "percent", "chapter", "long", "short",
)
MARK = {m: n for n, m in enumerate(MARKS)}
#: Hash buckets of words, and numbers a leaf's words are brought to.
WORD_BUCKETS, WORD_SIZE = 512, 16
INPUTS = len(MARKS) + WORD_SIZE


class Leaf:
    __slots__ = ("admits", "at", "marks", "text")

    def __init__(self, at: int, marks: tuple[str, ...], text: str, admits: tuple[tuple[str, str], ...] = ()):
        self.at, self.marks, self.text, self.admits = at, marks, text, admits


_RAW_TAG = re.compile(r"<[a-zA-Z/!]")
_ESCAPED_TAG = re.compile(r"&(?:lt|#60|#x3c);[a-zA-Z/!]", re.I)
_TEX = re.compile(r"\\(?:begin|end|section|subsection|subsubsection|chapter|paragraph|part|textbf|item|documentclass)\b")
# What is delimited by more than a line, leftmost first.
_SPANS = re.compile(
    r"""(?=[<`~\\$%{])(?:(?P<comment><!--.*?(?:-->|\Z))
    |(?P<dead><(?P<dead_tag>script|style|title|textarea|xmp|noscript)\b[^>]*>.*?(?:</(?P=dead_tag)\s*>|\Z))
    |(?P<nowiki><nowiki\s*>.*?(?:</nowiki\s*>|\Z))
    |(?P<pre><pre\b[^>]*>(?P<pre_text>.*?)(?:</pre\s*>|\Z))
    |(?P<source><(?P<source_tag>source|syntaxhighlight)\b[^>]*>(?P<source_text>.*?)(?:</(?P=source_tag)\s*>|\Z))
    |(?P<math><math\b[^>]*>(?P<math_text>.*?)(?:</math\s*>|\Z))
    |(?P<fence>(?:\A|(?<=\n)|(?<=\n[ ])|(?<=\n[ ]{2})|(?<=\n[ ]{3}))(?P<mark>`{3,}|~{3,})[^\n]*\n(?P<fence_text>.*?)(?:(?m:^[ ]{0,3})(?P=mark)[`~]*[ \t]*(?=\n|\Z)|\Z))
    |(?P<verbatim>\\begin\{(?P<verb_env>verbatim\*?|lstlisting|Verbatim|minted)\}(?P<verb_text>.*?)(?:\\end\{(?P=verb_env)\}|\Z))
    |(?P<texnote>\\begin\{comment\}.*?(?:\\end\{comment\}|\Z))
    |(?P<verb>\\verb\*?(?P<bar>[^\w\s*])[^\n]*?(?P=bar))
    |(?P<percent>(?:\A|(?<=\n)|(?<=\n[ \t])|(?<=\n[ ]{2})|(?<=\n[ ]{4}))%[^\n]*)
    |(?P<env>\\begin\{(?P<env_name>equation|align|gather|multline|eqnarray|displaymath|math)(?P<star>\*?)\}(?P<env_text>.*?)\\end\{(?P=env_name)(?P=star)\})
    |(?P<tick>(?<!`)(?P<ticks>`{1,2})(?!`)[^`\n]+(?P=ticks)(?!`))
    |(?P<display>(?<!\\)\$\$(?P<display_text>(?:(?!\n[ \t]*\n)[^$]|\\\$)+?)\$\$)
    |(?P<bracket>(?<!\\)\\\[(?P<bracket_text>(?:(?!\n[ \t]*\n).)+?)\\\])
    |(?P<paren>(?<!\\)\\\((?P<paren_text>[^\n]+?)\\\))
    |(?P<inline>(?<![\\$\w])\$(?![\s$])(?P<inline_text>(?:\\.|[^$\\\n])*?(?:\\.|[^\s$\\]))\$(?![\w$]))
    |(?P<template>\{\{(?:[^{}]|\{\{[^{}]*\}\}|\{(?!\{)|\}(?!\}))*\}\}))
    """,
    re.X | re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:]*)((?:\s[^<>]*)?/?)>", re.S)
_PLACE = "\ue000"
_DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_RULE = re.compile(r"^\s*(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_INLINE_MARKS = (
    ("bold **", re.compile(r"\*\*[^*\s][^*]*\*\*")), ("bold '''", re.compile(r"'''[^']")), ("link [](", re.compile(r"\[[^\]\[]+\]\([^)\s]+\)")), ("link [[", re.compile(r"\[\[[^\]]+\]\]")),
    ("textbf", re.compile(r"\\text(?:bf|it)\{")), ("escape \\", re.compile(r"\\[_#*%$&]")), ("ref", re.compile(r"</?ref\b|\\footnote|\\cite")), ("dollar", re.compile(r"\$")),
)

_ANY_TEX = (("latex", "formula"), ("markdown", "formula"))


def unescaped(text: str) -> str:
    """The record as it was before it was escaped as a whole, if it was."""
    return html.unescape(text) if not _RAW_TAG.search(text) and _ESCAPED_TAG.search(text) else text


def _inline(text: str) -> tuple[str, ...]:
    return tuple(name for name, pattern in _INLINE_MARKS if pattern.search(text))


def segment(text: str) -> list[Leaf]:
    """The leaves of a record in document order."""
    text = unescaped(text).replace("\r\n", "\n").replace("\r", "\n")
    tex = bool(_TEX.search(text))
    leaves: list[Leaf] = []
    out: list[str] = []
    last = 0
    for m in _SPANS.finditer(text):
        kind = next(k for k in ("comment", "dead", "nowiki", "pre", "source", "math", "fence", "verbatim", "texnote", "verb", "percent", "env", "tick", "display", "bracket", "paren", "inline", "template") if m[k] is not None)
        at = m.start()
        leaf = None
        if kind == "percent" and not tex:
            continue
        if kind == "pre":
            leaf = Leaf(at, ("html", "pre"), m["pre_text"], (("html", "code_block"), ("wiki", "code_block")))
        elif kind == "source":
            leaf = Leaf(at, ("wiki", "pre"), m["source_text"], (("wiki", "code_block"),))
        elif kind == "math":
            inner = m["math_text"]
            leaf = Leaf(at, ("html", "math"), inner, (("html", "formula"),)) if _TAG.search(inner) else Leaf(at, ("wiki", "math"), inner, (("wiki", "formula"),))
        elif kind == "fence":
            leaf = Leaf(at, ("line", "fence"), m["fence_text"], (("markdown", "code_block"),))
        elif kind == "verbatim":
            leaf = Leaf(at, ("tex", "verbatim"), m["verb_text"], (("latex", "code_block"),))
        elif kind == "env":
            leaf = Leaf(at, ("tex", "env"), m["env_text"], _ANY_TEX)
        elif kind in ("display", "bracket", "paren", "inline"):
            mark = {"display": "$$", "bracket": "\\[", "paren": "\\(", "inline": "$"}[kind]
            leaf = Leaf(at, ("tex", mark), m[kind + "_text"], _ANY_TEX)
        elif kind == "tick":
            leaf = Leaf(at, ("literal", "tick"), m[kind].strip("`"))
        elif kind == "template":
            leaf = Leaf(at, ("wiki", "template"), "")
        elif kind == "nowiki":
            leaf = Leaf(at, ("wiki", "literal"), re.sub(r"</?nowiki\s*>", "", m[kind], flags=re.I))
        elif kind == "verb":
            leaf = Leaf(at, ("tex", "literal"), m[kind][5:].strip(m["bar"]))
        else:
            leaf = Leaf(at, ("comment",), "")
        leaves.append(leaf)
        # the span leaves one mark and its line ends' number is kept out: lines around it stay lines
        out += [text[last:at], _PLACE]
        last = m.end()
    out.append(text[last:])
    rest = "".join(out)
    # positions in ``rest`` to positions in the text, at each mark
    marks = [k.start() for k in re.finditer(_PLACE, rest)] if leaves else []
    real = np.array([0, *(leaf.at for leaf in leaves)])
    shrunk = np.array([-1, *marks])

    def place(k: int) -> float:
        """A key that sorts like the place in the text."""
        j = int(np.searchsorted(shrunk, k, "right")) - 1
        return float(real[j]) + (k - shrunk[j]) * 1e-6

    if tex:
        _tex_lines(rest, leaves, place)
    else:
        _lines(rest, leaves, place)
    leaves.sort(key=lambda leaf: leaf.at)
    return leaves


_TEX_MARK = re.compile(r"\\(?P<sec>part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]]*\])?\{(?P<title>[^{}\n]*(?:\{[^{}]*\}[^{}\n]*)*)\}|(?P<item>\\item\b(?:\[[^\]\n]*\])?)|\\begin\{(?P<tab>tabular\*?|tabularx|longtable|array)\}(?P<body>.*?)(?:\\end\{(?P=tab)\}|\Z)", re.S)


def _tex_lines(rest: str, leaves: list[Leaf], place) -> None:
    last = 0
    found = list(_TEX_MARK.finditer(rest))
    for k, m in enumerate(found):
        _text_lines(rest[last : m.start()], last, leaves, place, "tex")
        if m["sec"]:
            leaves.append(Leaf(place(m.start()), ("tex", "section", *(("chapter",) if m["sec"] in ("part", "chapter") else ())), m["title"], (("latex", "heading"),)))
            last = m.end()
        elif m["item"]:
            stop = found[k + 1].start() if k + 1 < len(found) else len(rest)
            end = next((x for x in (rest.find("\n\\end{", m.end(), stop), rest.find("\n\n", m.end(), stop)) if x >= 0), stop)
            leaves.append(Leaf(place(m.start()), ("tex", "item"), rest[m.end() : end].strip(), (("latex", "list_item"),)))
            last = max(m.end(), end)
        else:
            body = re.sub(r"\A(?:\[[^\]]*\])?\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", lambda x: " " * len(x[0]), m["body"])
            at = m.start("body")
            for row in re.finditer(r"(.*?)(?:\\\\(?:\[[^\]]*\])?|\Z)", body, re.S):
                cells = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|endhead|endfirsthead|endfoot|cline\{[^}]*\})", "", row[1])
                if cells.strip():
                    leaves.append(Leaf(place(at + row.start()), ("tex", "tabular", "cells"), " | ".join(c.strip() for c in re.split(r"(?<!\\)&", cells)), (("latex", "table_row"),)))
            last = m.end()
    _text_lines(rest[last:], last, leaves, place, "tex")


def _text_lines(part: str, at: int, leaves: list[Leaf], place, mark: str) -> None:
    if (m := _TAG.search(part)) and any(t[2].lower() in _BLOCK for t in _TAG.finditer(part, m.start())):
        _html_and_lines(part, at, leaves, place)
        return
    for line in re.finditer(r"[^\n]+", part):
        body = line[0].strip()
        if body.strip(_PLACE + " ") and not re.fullmatch(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?|\\hline", body):
            leaves.append(Leaf(place(at + line.start()), (mark, "text", *(("command",) if body.startswith("\\") else ()), *_inline(body)), body))


_WIKI_ROW = re.compile(r"^\s*\|-", re.M)


def _lines(rest: str, leaves: list[Leaf], place) -> None:
    # wiki tables first: from a line that starts with {| to one that starts with |}
    last, pieces = 0, []
    for m in re.finditer(r"(?m)^[ \t:]*\{\|(?P<head>[^\n]*)\n(?P<body>.*?)(?:^[ \t]*\|\}|\Z)", rest, re.S):
        pieces.append((last, rest[last : m.start()]))
        start = m.start("body")
        bounds = [0]
        for r in _WIKI_ROW.finditer(m["body"]):
            bounds.append(r.start())
        bounds.append(len(m["body"]))
        for a, b in zip(bounds, bounds[1:], strict=False):
            row = m["body"][a:b]
            row = re.sub(r"\A\s*\|-+[^\n]*", "", row)
            row = re.sub(r"(?m)^\s*\|\+[^\n]*", "", row)
            if cells := re.findall(r"(?m)^[ \t]*[|!](?![-}+])(.*)", row):
                leaves.append(Leaf(place(start + a), ("wiki", "tr"), " | ".join(c.strip() for line in cells for c in re.split(r"\|\||!!", line)), (("wiki", "table_row"),)))
        last = m.end()
    pieces.append((last, rest[last:]))
    for at, piece in pieces:
        _html_and_lines(piece, at, leaves, place)


_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "table", "ul", "ol", "td", "th", "body", "html", "head", "tbody", "thead", "tfoot", "br", "hr"}


def _html_and_lines(piece: str, at: int, leaves: list[Leaf], place) -> None:
    if "<" not in piece or not _TAG.search(piece):
        _plain_lines(piece, at, leaves, place)
        return
    # tags split the piece; text right after a block tag is that tag's leaf, text in no tag is read as lines
    chunks: list[tuple[int, str, str | None]] = []  # start, text, tag that opened it
    last = 0
    buffer: list[tuple[int, str]] = []

    def flush(upto: int, tag: str | None) -> None:
        nonlocal buffer
        if buffer:
            chunks.append((buffer[0][0], "".join(b for _, b in buffer), tag))
            buffer = []

    current: str | None = None
    for m in _TAG.finditer(piece):
        close, name = m[1] == "/", m[2].lower()
        text = piece[last : m.start()]
        last_end = m.end()
        if text:
            buffer.append((last, text))
        last = last_end
        if name not in _BLOCK:
            if buffer or current:
                buffer.append((m.start(), "\ue001" if name in ("b", "i", "em", "strong", "u", "span", "a", "font", "sup", "sub", "code") else " "))
            continue
        if name == "br":
            buffer.append((m.start(), "\ue002"))
            continue
        if name in ("td", "th"):
            if not close and current == "tr":
                buffer.append((m.start(), " | "))
            elif not close and current != "tr":
                flush(m.start(), current)
                current = "tr"
                buffer.append((m.start(), " | "))
            continue
        if name in ("tbody", "thead", "tfoot", "html", "head", "body", "ul", "ol", "table", "hr"):
            flush(m.start(), current)
            current = None
            continue
        if current == "tr" and name in ("p", "div") or current == "li" and name in ("p", "div") and not close:
            buffer.append((m.start(), " "))
            continue
        flush(m.start(), current)
        if close:
            current = None
        else:
            current = name
            buffer.append((m.start(), "\ue003"))
    tail = piece[last:]
    if tail:
        buffer.append((last, tail))
    flush(len(piece), current)
    for start, text, tag in chunks:
        key = place(at + start)
        body = text.replace("\ue003", "").replace("\ue001", "")
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            if body.strip("\ue002 \n\t\xa0"):
                leaves.append(Leaf(key, ("html", "heading", tag if tag in MARK else "tag"), body, (("html", "heading"),)))
        elif tag == "li":
            leaves.append(Leaf(key, ("html", "li"), body, (("html", "list_item"),)))
        elif tag == "tr":
            if "|" in body:
                leaves.append(Leaf(key, ("html", "tr"), body.strip(" |\n"), (("html", "table_row"),)))
        elif tag in ("p", "div"):
            # the first line belongs to the tag, unclosed ones may be followed by other markup's lines
            head, newline, more = text.partition("\n\n")
            if head.strip("\ue003\ue001\ue002 \n" + _PLACE):
                leaves.append(Leaf(key, ("html", "text", *_inline(head)), head))
            if newline:
                _plain_lines(more, at + start + len(head) + 2, leaves, place)
        else:
            _plain_lines(text, at + start, leaves, place)


def _plain_lines(piece: str, at: int, leaves: list[Leaf], place) -> None:
    lines = []
    pos = 0
    for line in piece.split("\n"):
        lines.append((pos, line))
        pos += len(line) + 1
    n = len(lines)
    table_until = -1
    for k, (start, line) in enumerate(lines):
        key = place(at + start)
        body = line.strip()
        if not body.strip(_PLACE + "\ue001\ue002\ue003"):
            continue
        quoted = ()
        while body.startswith(">"):
            body, quoted = body[1:].lstrip(), ("quote",)
        inline = _inline(body)
        nested = ("nested",) if line[:1] in " \t" else ()
        gap = ("blank",) if k == 0 or not lines[k - 1][1].strip() else ()

        def add(marks: tuple[str, ...], text: str, *admits: tuple[str, str]) -> None:
            leaves.append(Leaf(key, ("line", *marks, *quoted, *nested, *gap, *inline), text, admits))  # noqa: B023

        if k <= table_until and _DELIMITER.match(body) and "|" in body:
            continue
        if k <= table_until:
            add(("pipe row",), body.strip("| "), ("markdown", "table_row"))
            continue
        if "|" in body and k + 1 < n and "|" in lines[k + 1][1] and _DELIMITER.match(lines[k + 1][1]):
            table_until = k + 1
            while table_until + 1 < n and "|" in lines[table_until + 1][1] and lines[table_until + 1][1].strip():
                table_until += 1
            add(("pipe row",), body.strip("| "), ("markdown", "table_row"))
            continue
        if m := re.match(r"(={1,6})\s*([^=\s].*?)\s*={1,6}\s*(?:<!--.*)?$", body):
            add(("==",), m[2], ("wiki", "heading"))
        elif m := re.match(r"(#{1,6})(\s+)(.*?)(?:\s+#+)?$", body):
            add(("#",), m[3], ("markdown", "heading"), ("wiki", "list_item"))
        elif m := re.match(r"(#+)([*#:]*)\s*(.+)$", body):
            add(("# tight",), m[3], ("wiki", "list_item"))
        elif _RULE.match(body) or re.fullmatch(r"=+", body):
            before = lines[k - 1][1].strip() if k else ""
            if not (re.fullmatch(r"=+|-+", body) and before and not re.match(r"[#>|]|[-*+]\s|=+$", before)):
                add(("rule",), "")
        elif k + 1 < n and re.fullmatch(r"=+|-{2,}", nxt := lines[k + 1][1].strip()) and not re.match(r"[-*+]\s|>|\|", body) and not quoted:
            add(("setext =" if nxt[0] == "=" else "setext -",), body, ("markdown", "heading"))
        elif m := re.match(r"([*+-])(\s+)(\[[ xX]\]\s+)?(.+)$", body):
            admits = [("markdown", "list_item"), *([("wiki", "list_item")] if m[1] == "*" else [])]
            add((m[1] + " ", *(("task",) if m[3] else ())), m[4], *admits)
        elif (m := re.match(r"(\*+)([*#:]*)\s*([^*\s].*)$", body)) and not re.match(r"\*{1,3}[^*\s][^*]*\*", body):
            add(("*",), m[3], ("wiki", "list_item"))
        elif re.match(r"\d+[.)]\s", body):
            add(("number",), body)
        elif body.startswith("|"):
            add(("pipe",), body.strip("| "))
        else:
            add(("text",), body)


# ---- network -------------------------------------------------------------------------------------------------------------------------


@lru_cache(1 << 16)
def _word(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORD_BUCKETS


_WORDS = re.compile(r"\w+")


def vectors(leaves: list[Leaf]) -> np.ndarray:
    """Path marks and shares of the hashed words of each leaf, whole: len(MARKS) + WORD_BUCKETS columns."""
    x = np.zeros((len(leaves), len(MARKS) + WORD_BUCKETS), np.float32)
    at: list[int] = []
    sizes: list[int] = []
    for k, leaf in enumerate(leaves):
        x[k, [MARK[mark] for mark in leaf.marks]] = 1
        words = _WORDS.findall(leaf.text.lower())
        at += map(_word, words)
        sizes.append(len(words))
        if len(leaf.text) > 160:
            x[k, MARK["long"]] = 1
        elif len(leaf.text) < 40:
            x[k, MARK["short"]] = 1
    n = np.array(sizes)
    np.add.at(x, (np.repeat(np.arange(len(leaves)), n), len(MARKS) + np.array(at, np.int64)), np.repeat(1 / np.maximum(n, 1), n).astype(np.float32))
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Weights: words (WORD_BUCKETS x WORD_SIZE), for each direction wx (INPUTS x 4h), wh (h x 4h), b (4h); out (2h + INPUTS) x classes and its bias."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}
        self.h = self.w["wh0"].shape[0]

    @staticmethod
    def inputs(x: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Marks as they are, words by their vectors."""
        return np.concatenate([x[..., : len(MARKS)], x[..., len(MARKS) :] @ words], -1)

    def run(self, x: np.ndarray, mask: np.ndarray, direction: int) -> np.ndarray:
        docs, steps, _ = x.shape
        wx, wh, b = (self.w[f"{p}{direction}"] for p in ("wx", "wh", "b"))
        gates = x.reshape(docs * steps, -1) @ wx + b
        gates = gates.reshape(docs, steps, -1)
        h, c = np.zeros((docs, self.h), np.float32), np.zeros((docs, self.h), np.float32)
        out = np.zeros((docs, steps, self.h), np.float32)
        n = self.h
        for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
            g = gates[:, t] + h @ wh
            s = sigmoid(g[:, : 3 * n])
            c2 = s[:, n : 2 * n] * c + s[:, :n] * np.tanh(g[:, 3 * n :])
            h2 = s[:, 2 * n :] * np.tanh(c2)
            live = mask[:, t, None]
            c, h = np.where(live, c2, c), np.where(live, h2, h)
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        z = self.inputs(x, self.w["words"])
        both = np.concatenate([self.run(z, mask, 0), self.run(z, mask, 1), z], 2)
        return both @ self.w["out"] + self.w["out_b"]


@lru_cache(1)
def network() -> BiLSTM:
    with np.load(Path(__file__).with_name("markup_model.npz")) as file:
        return BiLSTM({k: file[k] for k in file.files})


def admitted(leaves: list[Leaf]) -> np.ndarray:
    """What the check lets each leaf become, as a mask over CLASSES."""
    ok = np.zeros((len(leaves), len(CLASSES)), bool)
    ok[:, 0] = True
    for k, leaf in enumerate(leaves):
        for a in leaf.admits:
            ok[k, CLASS[a]] = True
    return ok


def label(documents: list[list[Leaf]], net: BiLSTM | None = None, cells: int = 20_000) -> list[np.ndarray]:
    """Class numbers of the leaves of each document; documents of like length run side by side."""
    net = net or network()
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(documents)
    order = sorted((k for k in range(len(documents)) if documents[k]), key=lambda k: len(documents[k]))
    at = 0
    while at < len(order):
        steps, stop = len(documents[order[at]]), at
        while stop < len(order) and (stop == at or (stop - at + 1) * len(documents[order[stop]]) <= cells):
            steps = len(documents[order[stop]])
            stop += 1
        group = order[at:stop]
        x, mask = np.zeros((len(group), steps, len(MARKS) + WORD_BUCKETS), np.float32), np.zeros((len(group), steps), bool)
        for j, k in enumerate(group):
            n = len(documents[k])
            x[j, :n], mask[j, :n] = vectors(documents[k]), True
        scores = net.scores(x, mask)
        for j, k in enumerate(group):
            own = scores[j, : len(documents[k])]
            out[k] = np.where(admitted(documents[k]), own, -np.inf).argmax(1)
        at = stop
    return out


# ---- clean text ----------------------------------------------------------------------------------------------------------------------

_CLEAN = (
    (re.compile(r"[\ue000\ue001\ue003]"), ""), (re.compile(r"\ue002"), "\n"), (re.compile(r"</?[a-zA-Z][^<>]*>"), ""),
    (re.compile(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]"), r"\1"), (re.compile(r"!?\[([^\]\[]+)\]\([^)\s]+\)"), r"\1"), (re.compile(r"\*\*\*?([^*]+)\*\*\*?"), r"\1"), (re.compile(r"'''?(.+?)'''?"), r"\1"),
    (re.compile(r"\\(?:footnote|cite|label|ref)\{[^{}]*\}"), ""), (re.compile(r"\\(?:textbf|textit|emph|underline|texttt)\{([^{}]*)\}"), r"\1"), (re.compile(r"\\([_#*%$&{}])"), r"\1"), (re.compile(r"(?<!\\)~"), " "),
)


def clean_leaf(text: str) -> str:
    """A leaf's text without inline markup."""
    for pattern, by in _CLEAN:
        text = pattern.sub(by, text)
    text = html.unescape(text).replace("\xa0", " ")
    return "\n".join(x for x in (re.sub(r"[ \t]+", " ", line).strip() for line in text.split("\n")) if x)


def clean_document(leaves: list[Leaf], classes: np.ndarray) -> str:
    """Clean text: headings led by #, items by -, rows' cells parted by |, code fenced, formulas between $."""
    parts = []
    for leaf, c in zip(leaves, classes, strict=True):
        kind = CLASSES[c][1] if c else None
        if kind == "code_block":
            parts.append("```\n" + html.unescape(re.sub(r"</?code[^<>]*>", "", leaf.text)).strip("\n") + "\n```")
            continue
        if "comment" in leaf.marks or "template" in leaf.marks:
            continue
        if kind == "formula":
            parts.append("$" + re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^<>]*>", " ", leaf.text))).strip() + "$")
            continue
        body = clean_leaf(leaf.text)
        if kind:
            body = body.replace("\n", " ")
        if body:
            parts.append({"heading": "# ", "list_item": "- ", "table_row": "| "}.get(kind, "") + body)
    return "\n".join(parts)


def _label_batches(batches: Iterator[pd.DataFrame], want: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), 500):
            part = batch.iloc[a : a + 500]
            ids = part["id"].tolist()
            documents = [segment(t) for t in part["text"]]
            labelled = label(documents)
            if want == "clean":
                yield pd.DataFrame({"id": ids, "text": [clean_document(d, c) for d, c in zip(documents, labelled, strict=True)]})
                continue
            rows = []
            for i, leaves, classes in zip(ids, documents, labelled, strict=True):
                seen: dict[int, int] = {}
                for leaf, c in zip(leaves, classes.tolist(), strict=True):
                    if c:
                        seen[c] = seen.get(c, 0) + 1
                        rows.append((i, *CLASSES[c], seen[c], *((clean_leaf(leaf.text),) if want == "text" else ())))
            yield pd.DataFrame(rows, columns=["id", "markup", "kind", "pos", *["text"] * (want == "text")])


def _texts(contents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = contents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))


def elements(contents: DataFrame, id_col: str = "id", text_col: str = "content_html", with_text: bool = False) -> DataFrame:
    """``id, markup, kind, pos`` (+ ``text``) of the elements of each document.  No shuffle but the one that drops repeated rows."""
    schema = "id long, markup string, kind string, pos int" + ", text string" * with_text
    return _texts(contents, id_col, text_col).mapInPandas(lambda b: _label_batches(b, "text" if with_text else "places"), schema).distinct()


def clean_texts(contents: DataFrame, id_col: str = "id", text_col: str = "content_html") -> DataFrame:
    """``id, text``: the clean text of each document."""
    return _texts(contents, id_col, text_col).mapInPandas(lambda b: _label_batches(b, "clean"), "id long, text string").distinct()
