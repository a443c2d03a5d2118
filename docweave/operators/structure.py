"""Legal structure of a text (P1-P13): parts, chapters, sections, articles, clauses, points, appendices.

A text is parsed line by line in one pass that keeps the open node of each level; nodes come out flat, in document order, with their parents.  The parse is
sequential within a document and independent between documents, so it runs in Arrow batches without a shuffle.

Defined results: null and blank texts have no node; within an article the first kind of clause mark (``Khoản 1``, ``1.``, ``1.1``) and of point mark is the one
that counts, others are text; single letters i), v), x) are points; equal ids of a document get ``__dup_0, __dup_1, ...``, the first included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import NUMBER_WORDS
from docweave.operators.references import find_references

_spaced = lambda words: words.replace(" ", r"\s+")


def _roman(n: int) -> str:
    return "x" * (n // 10) + ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[n % 10]


_longest_first = lambda values: "|".join(sorted(values, key=lambda v: (-len(v), v)))
#: Kinds of index that may follow a section word.
INDEXES = {
    "ordinal": _longest_first(map(_spaced, NUMBER_WORDS)), "roman": _longest_first(map(_roman, range(1, 40))), "digits": r"\d+", "dotted": r"[0-9a-zđ]+(?:\.[0-9a-zđ]+)*",
    "appendix": r"i{1,3}|[a-zđ]|\d+", "letter": "[a-zđ]",
}
# Lines that end the text or open an appendix (kind, words, index, marks that close it) and, coarse to fine, section words (kind, words, kinds of
# index, marks that may follow), numbers that stand alone (kind, levels, marks), letters and numerals that stand alone.  They are tried in this order.
BOUNDARIES = (("phu_luc", ("phụ lục",), "appendix", ".:)"), ("muc_luc", ("mục lục",), None, ".:)"), ("tu_viet_tat", ("từ viết tắt", "chữ viết tắt", "danh mục từ viết tắt", "danh mục chữ viết tắt"), None, ".:)"))
TAILS = (("noi_nhan", r"nơi\s+nhận\s*[:.]?$"), ("chu_ky", r"(?:kt\.|kí\s+tên|chữ\s+ký)(?:\s|$)"))
SECTIONS = (
    ("phan", "phần thứ", ("ordinal",), ".:),"), ("phan", "phần", ("roman", "digits"), ".:),"), ("chuong", "chương", ("roman", "digits"), ".:),"), ("muc", "mục", ("roman", "digits"), ".:)"),
    ("dieu", "điều", ("dotted",), ".:);"), ("khoan", "khoản", ("dotted",), ".:);"), ("diem", "điểm", ("dotted",), ".:);"),
)
NUMBERS = (("so_cap_3", 3, r"\\.)", True), ("so_cap_2", 2, r"\\.)", True), ("so_cap_1", 1, r"\\.)", False))
SIGNS = (("chu_thuong", "letter", r"\\.),;"), ("muc_roman", "roman", r"\\/.)"))


def _headings() -> tuple[tuple[str, str], ...]:
    """(kind, pattern) of heading lines in the order they are tried; a pattern's first group is the index."""
    out = []
    for kind, names, index, marks in BOUNDARIES:
        own = rf"(?:\s+({INDEXES[index]}))?" if index else ""
        out.append((kind, rf"(?i)^(?:{'|'.join(map(_spaced, names))}){own}(?:\s*[{marks}]|$)"))
    out += [(kind, f"(?i)^{pattern}") for kind, pattern in TAILS]
    out += [(kind, rf"(?i)^{_spaced(word)}\s+({'|'.join(INDEXES[i] for i in indexes)})(?:[{marks}\s]|$)") for kind, word, indexes, marks in SECTIONS]
    for kind, levels, marks, bare in NUMBERS:
        number = r"\.".join([r"\d+"] * levels)
        out.append((kind, rf"^({number})(?:[{marks}\s]|$)" if bare else rf"^({number})[{marks}]"))
    return (*out, *((kind, f"^({INDEXES[index]})[{marks}]") for kind, index, marks in SIGNS))


HEADINGS = _headings()
_COMPILED = [(kind, re.compile(pattern)) for kind, pattern in HEADINGS]
CLAUSES, POINTS, ENDS = ("khoan", "so_cap_1", "so_cap_2", "so_cap_3"), ("diem", "chu_thuong"), ("phu_luc", "muc_luc", "tu_viet_tat", "noi_nhan", "chu_ky")
NODE = "id string, parent_id string, type string, title string, content string, full_text string, parent_context string, reference array<string>, position int"


def heading(line: str) -> tuple[str, str] | None:
    """(kind, index) of a heading line."""
    for kind, pattern in _COMPILED:
        if m := pattern.match(line):
            index = (m[1] or "").lower().strip() if m.lastindex else ""
            if kind == "phan":
                index = NUMBER_WORDS.get(re.sub(r"\s+", " ", index), index)
            elif kind == "phu_luc":
                index = index or "1"
            return kind, index.replace(".", "_")
    return None


def heading_columns(line: Column) -> tuple[Column, Column]:
    """P1 as expressions: kind and raw index of a line."""
    kind, index = None, None
    for name, pattern in HEADINGS:
        pattern = pattern.replace("(?i)", "(?iu)")  # the JVM folds only ASCII letters without u
        hit = F.rlike(line, F.lit(pattern))
        found = F.lower(F.regexp_extract(line, pattern, 1)) if "(" in pattern.replace("(?", "") else F.lit("")
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        index = F.when(hit, found) if index is None else index.when(hit, found)
    return kind, index


def pack_sentences(text: str, most_words: int = 2000) -> list[str]:
    """Sentences (by ``". "``) packed greedily into chunks of at most ``most_words`` words; a longer sentence is a chunk of its own."""
    chunks: list[str] = []
    held, size = [], 0
    for sentence in text.split(". "):
        n = len(sentence.split())
        if held and size + n > most_words:
            chunks.append(". ".join(held))
            held, size = [], 0
        held.append(sentence)
        size += n
    if held and any(s.strip() for s in held):
        chunks.append(". ".join(held))
    return chunks


class _Node:
    __slots__ = ("body", "full", "id", "kind", "level", "parent", "titles")

    def __init__(self, kind: str, id_: str, parent: _Node | None, level: int, title: str | None = None):
        self.kind, self.id, self.parent, self.level = kind, id_, parent, level
        self.titles = [title] if title is not None else []
        self.body: list[str] = []
        self.full: list[str] = []


LEVEL = {"phan": 1, "chuong": 2, "muc": 3, "dieu": 4, "khoan": 5, "diem": 6, "phu_luc": 1}


def parse(doc_id: str, text: str, most_words: int = 2000, references: bool = True) -> list[dict]:
    """The nodes of one text, in order."""
    lines = [x for x in (raw.strip() for raw in (text or "").split("\n")) if x]
    nodes: list[_Node] = []
    front: list[str] = []
    k = 0
    while k < len(lines) and heading(lines[k]) is None:
        front.append(lines[k])
        k += 1
    for n, chunk in enumerate(pack_sentences(". ".join(front), most_words) if front else [], 1):
        node = _Node("mo_dau", f"{doc_id}.modau_{n}", None, 1)
        node.body.append(chunk)
        nodes.append(node)
    open_: list[_Node] = []
    article_marks: dict[str, str] = {}
    titling = False

    def opened(kind: str, index: str, line: str, level: int) -> _Node:
        while open_ and open_[-1].level >= level:
            open_.pop()
        parent = open_[-1] if open_ else None
        node = _Node(kind, f"{parent.id if parent else doc_id}.{kind}_{index}" if index else f"{parent.id if parent else doc_id}.{kind}", parent, level, line if level <= 4 else None)
        if level > 4:
            node.body.append(line)
        nodes.append(node)
        open_.append(node)
        return node

    def article() -> _Node | None:
        return next((n for n in open_ if n.level == 4), None)

    for line in lines[k:]:
        found = heading(line)
        kind, index = found or (None, "")
        inside = article()
        if inside and kind == "muc_roman" and re.fullmatch("[a-z]", index):
            kind = "chu_thuong"  # i), v), x) within an article
        if kind in ("phan", "chuong", "muc", "dieu"):
            opened(kind, index, line, LEVEL[kind])
            titling, article_marks = kind in ("phan", "chuong"), {}
            if kind == "dieu":
                open_[-1].full.append(line)
            continue
        if kind == "phu_luc":
            open_.clear()
            opened(kind, index, line, 1)
            titling = False
            continue
        if kind in ENDS:
            open_.clear()
            titling = False
            continue
        if inside is None and kind in ("so_cap_1", "muc_roman") and open_ and open_[-1].kind == "phan":
            opened("muc" if kind == "muc_roman" else "dieu", index, line, 3 if kind == "muc_roman" else 4)
            titling, article_marks = False, {}
            continue
        if inside is not None and kind in CLAUSES + POINTS:
            group = "khoan" if kind in CLAUSES else "diem"
            inside.full.append(line)
            if article_marks.setdefault(group, kind) == kind:
                opened(group, index, line, LEVEL[group])
            else:
                open_[-1].body.append(line)
            continue
        # text, or a mark that means nothing here
        if not open_:
            continue
        if titling and kind is None:
            open_[-1].titles.append(line)
            continue
        titling = False
        open_[-1].body.append(line)
        if inside is not None:
            inside.full.append(line)
    return _rows(doc_id, nodes, references)


def _rows(doc_id: str, nodes: list[_Node], references: bool) -> list[dict]:
    counts: dict[str, int] = {}
    for n in nodes:
        counts[n.id] = counts.get(n.id, 0) + 1
    seen: dict[str, int] = {}
    final: dict[int, str] = {}
    contexts: dict[int, str | None] = {}
    children: dict[int, list[_Node]] = {}
    for n in nodes:
        if n.parent:
            children.setdefault(id(n.parent), []).append(n)
    out = []
    for n in nodes:
        number = seen[n.id] = seen.get(n.id, -1) + 1
        final[id(n)] = f"{n.id}__dup_{number}" if counts[n.id] > 1 else n.id
        title = " : ".join(n.titles) or None
        content = ". ".join(n.body)
        if n.kind == "khoan":
            full = ". ".join([*n.body, *(x for c in children.get(id(n), []) for x in c.body)])
        else:
            full = ". ".join(n.full) if n.full else ". ".join(x for x in (title, content) if x)
        above = n.parent
        contexts[id(n)] = "\n".join(x for x in (contexts.get(id(above)), " : ".join(above.titles), ". ".join(above.body)) if x) or None if above else None
        refs = find_references(f"{title}. {content}" if title and content else title or content, _context(doc_id, n)) if references else []
        if title or content or refs:
            out.append({"id": final[id(n)], "parent_id": final[id(above)] if above else doc_id, "type": n.kind, "title": title, "content": content, "full_text": full, "parent_context": contexts[id(n)], "reference": refs, "position": len(out)})
    return out


def _context(doc_id: str, node: _Node) -> dict[str, str]:
    context = {"luat": doc_id}
    while node is not None:
        context[node.kind] = node.id
        node = node.parent
    return context


def parse_documents(documents: DataFrame, id_col: str, text_col: str, most_words: int = 2000, references: bool = True) -> DataFrame:
    """NODE rows of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.iloc[a : a + 500]
                rows = [r for i, t in zip(part["id"], part["text"], strict=True) for r in parse(i, t, most_words, references)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])

    rows = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows.mapInPandas(run, NODE)


def parent_context(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """P5 for stored nodes: the titles of a node's ancestors, root first, one a line.  ``tree(id, path)`` has the ids from the root down to the node."""
    above = tree.where("path is not null").select("id", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "above"))
    titles = nodes.groupBy(F.col("id").alias("above")).agg(F.min("title").alias("title"))
    told = above.join(titles, "above").where("title is not null and title <> ''")
    return told.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]), "\n").alias("context"))


def suffixed(rows: DataFrame, id_col: str, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """Ids that occur more than once (within ``group``) get ``__dup_N`` in the given order."""
    keys = [*(group or []), id_col]
    n = F.count("*").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn(id_col, F.when(n > 1, F.concat(F.col(id_col), F.lit("__dup_"), place.cast("string"))).otherwise(F.col(id_col)))


def windows(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Character windows of ``size`` that share ``overlap``; blank windows are dropped but keep their numbers: array of (number, piece)."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - overlap - 1, F.lit(0)), F.lit(step))
    pieces = F.transform(starts, lambda s, i: F.struct(i.alias("number"), F.substr(text, s + 1, F.lit(size)).alias("piece")))
    return F.filter(pieces, lambda p: F.trim(p["piece"]) != "")


def word_windows(text: Column, most: int = 2000, size: int = 1900, overlap: int = 200) -> Column:
    """Texts of more than ``most`` words in windows of ``size`` words that share ``overlap``; others as they are."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.size(words) > most, F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " "))).otherwise(F.array(text))


def embedding_text(kind: Column, context: Column, title: Column, content: Column) -> Column:
    """What is embedded of a node."""
    return F.trim(F.concat_ws("\n", F.nullif(F.trim(context), F.lit("")), F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(content), F.lit(""))))


def too_long(rows: DataFrame, text: str, key: str, group: str, most: int) -> DataFrame:
    """A row for every text of more than ``most`` words, with their number and how many such texts its group has."""
    words = F.size(F.split(F.trim(F.col(text)), r"\s+"))
    long = rows.select(group, key, words.alias("n_words")).where(F.col("n_words") > most)
    n = long.groupBy(group).agg(F.count("*").alias("n_long"))
    return long.join(n.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group"))).select(group, key, "n_words", "n_long")


# Separators of the recursive splitter, strongest first; the last cuts anywhere.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ", "")


def recursive_pieces(text: str, size: int = 1200, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters cut at the strongest separator that occurs, weaker ones within what is still too long; a piece begins with what fits into ``overlap`` of the one before."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap from 0 to below size")
    k = next(k for k, s in enumerate(separators) if s in text)
    mark, weaker = separators[k], separators[k + 1 :]
    # a separator stays with what follows it
    parts = list(text) if not mark else [p for p in (text.split(mark)[0], *(mark + x for x in text.split(mark)[1:])) if p]
    out: list[str] = []
    run: list[str] = []

    def pack() -> None:
        held: list[str] = []
        n = 0
        for part in run:
            if held and n + len(part) > size:
                out.append("".join(held).strip())
                while held and (n > overlap or n + len(part) > size):
                    n -= len(held.pop(0))
            held.append(part)
            n += len(part)
        if held:
            out.append("".join(held).strip())
        run.clear()

    for part in parts:
        if len(part) < size or not weaker and len(part) <= size:
            run.append(part)
            continue
        pack()
        out += recursive_pieces(part, size, overlap, weaker) if weaker else [part]
    pack()
    return [p for p in out if p]


def fixed_size_chunks(documents: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """P8 over a table: ``id, number, piece``; blank pieces are dropped but keep their numbers."""
    recursive_pieces("", size, overlap, ("",))  # fails here rather than in a task

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([recursive_pieces(t, size, overlap) if isinstance(t, str) else [] for t in texts], index=texts.index)

    each = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(cut(F.col(text_col))).alias("number", "piece"))
    return each.where(F.trim("piece") != "")


def chunked(documents: DataFrame, id_col: str, text_col: str, strategy: str, **options) -> DataFrame:
    """P10: NODE rows by a named strategy: ``hierarchical`` by structure, ``fixed_size`` by length."""
    name = strategy.strip().lower()
    if name == "hierarchical":
        return parse_documents(documents, id_col, text_col, **options)
    if name == "fixed_size":
        pieces = fixed_size_chunks(documents, id_col, text_col, **options)
        none = F.lit(None).cast("string")
        return pieces.select(F.concat(F.col("id").cast("string"), F.lit(".chunk_"), F.col("number").cast("string")).alias("id"), F.col("id").cast("string").alias("parent_id"), F.lit("chunk").alias("type"), none.alias("title"), F.col("piece").alias("content"), F.col("piece").alias("full_text"), none.alias("parent_context"), F.array().cast("array<string>").alias("reference"), F.col("number").alias("position"))
    raise ValueError(f"no chunking strategy {strategy!r}")
