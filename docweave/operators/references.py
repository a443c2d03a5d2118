"""References in legal text (R1-R7): which sections of which documents a text speaks of.

A text is read once into words; a small grammar over them finds mentions of sections, lists, ranges and documents, each with its place.  Which document
an article belongs to is a question of its own: the nearest mention by place (``nearest``), unless the words right after the reference point to one.

Defined results: ids come in the order in which the text mentions them, each once; null and empty texts have none; what would not make a valid id is left out.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Section words, coarse to fine, with what they are called in ids; kinds of documents, and those of them that can be named instead of numbered.
UNITS = {"phần": "phan", "chương": "chuong", "mục": "muc", "điều": "dieu", "khoản": "khoan", "điểm": "diem"}
DOCUMENTS = ("bộ luật", "luật", "nghị định", "thông tư", "quyết định", "nghị quyết", "pháp lệnh")
NAMED = ("bộ luật", "luật", "nghị định", "thông tư", "nghị quyết", "hiến pháp")
OWN_LAW = ("bộ luật", "luật", "nghị định", "thông tư")
# Words before ``... này`` that make it something else.
NOT_SELF = {
    "muc": {"danh", "hạng", "thư", "chuyên", "tiết"}, "phan": {"thành", "cổ", "một", "đóng"}, "khoan": {"điều", "tài"},
    "diem": {"thời", "địa", "đặc", "ưu", "nhược", "quan", "khuyết", "trọng", "nhiệm", "tiêu", "tâm", "nhận", "giao"},
}
# The longest ranges that are written out; characters before an article in which its clauses and points may stand, after it in which a document
# may be pointed to, between a document's kind and its number, and before ``luật này`` in which an article takes it.
MOST_ARTICLES, MOST_CLAUSES = 500, 100
BEFORE, ANCHOR, TO_NUMBER, TAKEN = 300, 120, 60, 80
NAME_WORDS = 12
POINTERS, NAME_ENDS = {"của", "theo", "trong", "tại"}, {"của", "được", "có", "về"}


def _candidate() -> str:
    """R1 from the tables: a section with an index or ``này``, a kind of document, or an official number."""
    spaced = lambda words: "|".join(w.replace(" ", r"\s+") for w in words)
    edge = r"(?:[^\p{L}\p{N}]|$)"
    section = rf"(?:{spaced(UNITS)})\s+[0-9a-zđ]+(?:\.[0-9a-zđ]+)*{edge}"
    here = rf"(?:{spaced([*UNITS, 'văn bản'])})\s+này{edge}"
    return rf"(?iu)(?:^|[^\p{{L}}\p{{N}}])(?:{section}|(?:{spaced(DOCUMENTS)}){edge}|(?:số\s+)?\d+/\d{{4}}/[0-9a-zđ/\-]+|{here})"


CANDIDATE = _candidate()


def is_candidate(text: Column) -> Column:
    return F.rlike(text, F.lit(CANDIDATE))


def sentences(text: Column) -> Column:
    """R2: sentences, by ``.!?;`` and a blank."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def candidate_sentences(text: Column) -> Column:
    return F.filter(sentences(text), lambda s: is_candidate(s))


def key_of(name: str) -> str | None:
    """A document name or number as a key: marks dropped, đ as d."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c)).replace("đ", "d")
    return re.sub(r"^[_\-]+|[_\-]+$", "", re.sub(r"[^a-z0-9\-]+", "_", plain)) or None


# ---- words ---------------------------------------------------------------------------------------------------------------------------


class Word(NamedTuple):
    """A word of a text: ``kind`` is unit, document, number (an official one), mark or word."""

    kind: str
    value: str
    at: int
    end: int


_PIECE = re.compile(r"(?P<number>\d+/[0-9a-zđ/\-]+)|(?P<word>\w+(?:\.\w+)*)|(?P<mark>\S|\n)")
_TWO = {tuple(d.split()) for d in (*DOCUMENTS, *NAMED) if " " in d}
_ONE = {d for d in (*DOCUMENTS, *NAMED, "lệnh") if " " not in d}
_INDEX = re.compile(r"(?:\d{1,3}[a-zđ]?|([a-zđ])\1?)(?:\.\d{1,3})*")
_ARTICLE = re.compile(r"\d+[a-zđ]?")
_CHAPTER = re.compile(r"[ivxlcdm]+|\d+")
_SECTION = re.compile(r"[a-zđ0-9.]+")
VALID = re.compile(r"[a-z0-9_.\-đ]+")


def words(text: str) -> list[Word]:
    found = [Word("number" if m["number"] else "word" if m["word"] else "mark", m[0], m.start(), m.end()) for m in _PIECE.finditer(text.lower())]
    out: list[Word] = []
    k = 0
    while k < len(found):
        w = found[k]
        after = found[k + 1] if k + 1 < len(found) else None
        if after and (w.value, after.value) in _TWO:
            out.append(Word("document", f"{w.value} {after.value}", w.at, after.end))
            k += 1
        elif w.kind == "word" and (w.value in UNITS or w.value in _ONE):
            out.append(Word("unit" if w.value in UNITS else "document", UNITS.get(w.value, w.value), w.at, w.end))
        else:
            out.append(w)
        k += 1
    return out


class _Reading:
    """A place in a text's words from which they can be asked for."""

    def __init__(self, text: str):
        self.text, self.words = text, words(text)

    def value(self, k: int) -> str:
        return self.words[k].value if 0 <= k < len(self.words) else ""

    def is_unit(self, k: int, unit: str) -> bool:
        return 0 <= k < len(self.words) and self.words[k].kind == "unit" and self.words[k].value == unit

    def list_at(self, k: int) -> list[str]:
        """The indexes of a list such as ``1, 2 và 3`` from word ``k`` on."""
        items: list[str] = []
        while k < len(self.words) and self.words[k].kind == "word" and _INDEX.fullmatch(self.value(k)) and re.match(r"[\s,;)]|$", self.text[self.words[k].end :][:1]):
            items.append(self.value(k))
            if self.value(k + 1) == "," or self.value(k + 1) == "và":
                k += 2
                if self.value(k - 1) == "và" and items and not _INDEX.fullmatch(self.value(k)):
                    break
            else:
                break
        return items

    def range_at(self, k: int, unit: str) -> tuple[int, int, int] | None:
        """(first, last, next word) of ``a đến [unit] b`` whose first index is word ``k``, if ``từ [các]`` stands before the unit."""
        lead = k - 2
        if self.value(lead) == "các":
            lead -= 1
        if self.value(lead) != "từ" or self.value(k + 1) != "đến":
            return None
        last = k + 3 if self.is_unit(k + 2, unit) else k + 2
        return (int(self.value(k)), int(self.value(last)), last + 1) if self.value(k).isdigit() and self.value(last).isdigit() else None


def listed(kind: str, text: str) -> list[str]:
    """R4 over a text: the indexes of all its lists of ``khoan`` or ``diem``."""
    r = _Reading(text)
    return [x for k in range(len(r.words)) if r.is_unit(k, kind) for x in r.list_at(k + 1)]


# ---- documents -----------------------------------------------------------------------------------------------------------------------


def _named(r: _Reading, k: int) -> str | None:
    """The name of a document whose kind is word ``k``: up to NAME_WORDS words of letters that a mark, an ending word or the text's end follows; it may run over lines."""
    run = [j for j in range(k + 1, min(len(r.words), k + 4 * NAME_WORDS)) if r.value(j) != "\n"]
    said = [r.value(j) for j in run] + [""]
    if said[0] in ("này", "số"):
        return None
    for n, word in enumerate(said[:NAME_WORDS]):
        if not word.replace(" ", "").isalpha():
            return None
        year = said[n + 1] == "năm" and len(said) > n + 2 and re.fullmatch(r"\d{4}", said[n + 2])
        stop = said[n + 3] if year else said[n + 1]
        if stop in {"", ",", ".", ";"} or stop in NAME_ENDS:
            return r.text[r.words[k].at : r.words[run[n]].end] + (" " + said[n + 2] if year else "")
    return None


def documents(r: _Reading) -> list[tuple[int, str]]:
    """Where which document is mentioned, by number or by name."""
    found: list[tuple[int, str]] = []
    k = 0
    while k < len(r.words):
        w = r.words[k]
        k += 1
        if w.kind != "document" or r.value(k) == "này":
            continue
        key = None
        for j in range(k, len(r.words)):
            if r.words[j].value == "\n" or r.words[j].at - w.end > TO_NUMBER + 1 + len("số "):
                break
            if r.words[j].kind == "number":
                key, k = key_of(r.words[j].value), j + 1
                break
        if key is None and w.value in NAMED and (name := _named(r, k - 1)):
            key = key_of(name)
        if key:
            found.append((w.at, key))
    return found


def nearest(at: int, laws: list[tuple[int, str]], r: _Reading) -> str | None:
    """The document that the words after the reference point to, else the nearest one, the earlier of two."""
    if not laws:
        return None
    places = [p for p, _ in laws]
    first = bisect_left([w.at for w in r.words], at)
    for j in range(first, len(r.words) - 1):
        if r.words[j + 1].end > at + ANCHOR:
            break
        if r.value(j) in POINTERS and r.words[j + 1].kind == "document" and r.value(j + 1) in DOCUMENTS:
            ahead = bisect_left(places, r.words[j].at)
            if ahead < len(laws):
                return laws[ahead][1]
            break
    j = bisect_left(places, at)
    return min(laws[max(0, j - 1) : j + 1], key=lambda x: abs(x[0] - at))[1]


# ---- sections ------------------------------------------------------------------------------------------------------------------------


class _Mention(NamedTuple):
    at: int
    id: str
    whole: bool  # the id needs no document any more


def _sections(r: _Reading, context: dict[str, str]) -> Iterator[_Mention]:
    own = context.get("luat")
    within = lambda x: x if not own or x == own or x.startswith(own + ".") else f"{own}.{x}"
    waiting: list[tuple[int, str, list[str]]] = []  # clauses and points that no article has taken yet
    alone: list[tuple[int, str, list[str]]] = []
    here: dict[str, int] = {}
    articles = 0
    last_article = None
    for k, w in enumerate(r.words):
        after = r.value(k + 1)
        if after == "này" and w.kind in ("unit", "document"):
            kind = w.value if w.kind == "unit" else "luat"
            before = r.words[k - 1] if k else None
            lead = before.value if before and before.kind != "mark" and r.text[before.end : w.at].isspace() else ""
            here.setdefault(kind, w.at)
            if kind == "dieu":
                articles += 1
                if context.get("dieu"):
                    yield from (_Mention(w.at, within(x), True) for x in _under(context["dieu"], waiting, w.at))
                waiting = []
            elif kind in ("muc", "chuong", "phan", "luat") and context.get(kind) and lead not in NOT_SELF.get(kind, ()):
                if not (kind == "luat" and (w.value not in DOCUMENTS or last_article is not None and last_article >= w.at - TAKEN)):
                    yield _Mention(w.at, within(context[kind]), True)
            continue
        if w.kind != "unit":
            continue
        if w.value in ("khoan", "diem"):
            items = r.list_at(k + 1)
            if items:
                waiting.append((w.at, w.value, items))
                alone.append((w.at, w.value, items))
            if w.value == "khoan" and (ends := r.range_at(k + 1, "khoan")) and r.is_unit(ends[2], "dieu") and _ARTICLE.fullmatch(r.value(ends[2] + 1)):
                if ends[0] <= ends[1] < ends[0] + MOST_CLAUSES:
                    yield from (_Mention(w.at, f"dieu_{r.value(ends[2] + 1)}.khoan_{n}", False) for n in range(ends[0], ends[1] + 1))
        elif w.value == "chuong" and _CHAPTER.fullmatch(after):
            yield _Mention(w.at, f"chuong_{after}", False)
        elif w.value == "muc" and _SECTION.fullmatch(after):
            chapter = k + 3 if r.value(k + 2) == "của" else k + 2
            if r.is_unit(chapter, "chuong") and _CHAPTER.fullmatch(r.value(chapter + 1)):
                yield _Mention(w.at, f"chuong_{r.value(chapter + 1)}.muc_{after.rstrip('.')}", False)
        elif w.value == "dieu" and (m := _ARTICLE.match(after)) and (m.end() == len(after) or after[m.end()] == "."):
            articles += 1
            last_article = w.at
            if (ends := r.range_at(k + 1, "dieu")) and ends[0] <= ends[1] < ends[0] + MOST_ARTICLES:
                yield from (_Mention(w.at, f"dieu_{n}", False) for n in range(ends[0], ends[1] + 1))
            law = k + 3 if r.value(k + 2) == "của" else k + 2
            whole = r.value(law) in OWN_LAW and r.value(law + 1) == "này"
            yield from (_Mention(w.at, within(x) if whole else x, whole) for x in _under(f"dieu_{m[0]}", waiting, w.at))
            waiting = []
    if not articles and context.get("dieu"):
        # a text without an article speaks of its own one
        clause = context.get("khoan") if "khoan" in here else None
        points = [(at, x) for at, kind, items in alone if kind == "diem" for x in items]
        clauses = [(at, x) for at, kind, items in alone if kind == "khoan" for x in items]
        if points or clauses:
            base, kind = (clause or context["dieu"], "diem") if points else (context["dieu"], "khoan")
            yield from (_Mention(at, f"{base}.{kind}_{x.replace('.', '_')}", True) for at, x in points or clauses)
        elif clause:
            yield _Mention(here["khoan"], clause, True)
        elif "diem" in here and context.get("diem"):
            yield _Mention(here["diem"], context["diem"], True)


def _under(article: str, waiting: list[tuple[int, str, list[str]]], at: int) -> list[str]:
    """An article with the clauses and points that stand before it: every point in every clause."""
    levels = [[f"{kind}_{x.replace('.', '_')}" for place, k, items in waiting if k == kind and place >= at - BEFORE for x in items] or [""] for kind in ("khoan", "diem")]
    return [".".join(x for x in (article, *parts) if x) for parts in product(*levels)]


def find_references(text: str | None, context: dict[str, str] | None = None) -> list[str]:
    """Ids the text refers to, in the order in which it does.  ``context`` has the ids of the node's own document and sections by type."""
    if not text:
        return []
    context = context or {}
    r = _Reading(text)
    own = context.get("luat")
    laws = documents(r) or ([(0, own)] if own else [])
    out: dict[str, None] = {}
    for mention in sorted(_sections(r, context), key=lambda m: m.at):
        law = None if mention.whole else nearest(mention.at, laws, r)
        name = f"{law}.{mention.id}" if law else mention.id
        if VALID.fullmatch(name.lower()) and "none" not in name:
            out[name] = None
    return list(out)


def references(rows: DataFrame, key: str, text: str, document: str | None = None) -> DataFrame:
    """R3 over a table: ``key, position, reference``; only texts with a candidate leave the JVM."""
    picked = rows.where(is_candidate(F.col(text))).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), (F.col(document) if document else F.lit(None).cast("string")).alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t, own in zip(batch["key"], batch["text"], batch["own"], strict=True):
                context = {"luat": own} if isinstance(own, str) else {}
                if isinstance(own, str):
                    parts = k.split(".")
                    for n, part in enumerate(parts[1:], 2):
                        context[part.split("_")[0]] = ".".join(parts[:n])
                out += [(k, n, r) for n, r in enumerate(find_references(t, context))]
            yield pd.DataFrame(out, columns=["key", "position", "reference"])

    return picked.mapInPandas(run, "key string, position int, reference string")


def article_ranges(text: Column) -> Column:
    """Numbers of all ranges ``từ Điều a đến Điều b``."""
    found = F.regexp_extract_all(text, F.lit(r"(?iu)từ\s+(?:các\s+)?điều\s+(\d+\s+đến\s+(?:điều\s+)?\d+)"), F.lit(1))
    ends = F.transform(found, lambda x: F.transform(F.split(x, r"[^0-9]+"), lambda n: n.cast("int")))
    good = F.filter(ends, lambda e: (e[0] <= e[1]) & (e[1] < e[0] + MOST_ARTICLES))
    return F.array_distinct(F.flatten(F.transform(good, lambda e: F.sequence(e[0], e[1]))))


def positions(text: Column, word: str) -> Column:
    """Places (from 0) of each occurrence of a word in a text, whatever its case."""
    pieces = F.split(F.lower(text), word, -1)
    ends = F.transform(pieces, lambda _, k: F.aggregate(F.slice(pieces, F.lit(1), k + 1), F.lit(0), lambda n, p: n + F.char_length(p)) + k * len(word))
    return F.slice(ends, F.lit(1), F.size(ends) - 1)


def nearest_places(asked: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """R6 as a plan: for each ``(key, at)`` the nearest ``place`` of ``(key, place)``, the earlier of two; an as-of join from both sides in one sort, no pairs."""
    both = asked.select(key, "at", F.lit(None).cast("int").alias("place")).unionByName(places.select(key, F.col("place").alias("at"), "place"))
    order = Window.partitionBy(key).orderBy("at")
    before = F.last("place", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("place", ignorenulls=True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    met = both.select(key, "at", "place", before.alias("before"), after.alias("after")).where("place is null")
    return met.select(key, "at", F.when(F.col("before").isNull() | (F.col("after") - F.col("at") < F.col("at") - F.col("before")), F.col("after")).otherwise(F.col("before")).alias("nearest"))
