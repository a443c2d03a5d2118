"""Problem 7: items above a size limit into overlapping pieces, cut at natural boundaries.

Recursive bisection: a stretch that still exceeds the limit minus the overlap is cut at the strongest boundary near its midpoint (paragraph, line, sentence,
clause, word), and both halves go on.  Where there is no boundary near the midpoint the nearest one anywhere in the stretch is taken, and only a stretch without
any is cut between two characters, never before a combining mark.  At last every piece but the first gets the end of its predecessor in front, up to
the overlap, from a sentence or word start where there is one.

Defined results: a null item gives no piece, an empty or small one a single piece that is the item; sizes are code points; the pieces without their overlaps
are the item, character for character; recursion is a stack, so very long items only take memory in proportion to their length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1200
OVERLAP = 200
#: Boundaries, strongest first; a cut lies after the match.
BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+"),
    re.compile(r"[;:,]\s+"),
    re.compile(r"\s+"),
)
SENTENCE = 2


def _boundaries(text: str) -> list[list[int]]:
    """Places of the cuts by strength, each list sorted; a place is in the list of its strongest boundary and all weaker ones."""
    out: list[list[int]] = []
    known: set[int] = set()
    for pattern in BOUNDARIES:
        known.update(m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text))
        out.append(sorted(known))
    return out


def _nearest(places: list[int], lo: int, hi: int, mid: int) -> int | None:
    """The place in [lo, hi] that is nearest to mid."""
    a, b = bisect_left(places, lo), bisect_right(places, hi)
    if a >= b:
        return None
    k = bisect_left(places, mid, a, b)
    if k == b or (k > a and mid - places[k - 1] <= places[k] - mid):
        k -= 1
    return places[k]


def _joined(text: str, at: int) -> bool:
    return bool(unicodedata.combining(text[at])) or text[at] in "‍︎️" or text[at - 1] == "‍"


def split_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core, end) of each piece: text[start:end] is the piece, text[start:core] what it shares with the one before."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and the overlap at least 0 and below it")
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    room = limit - overlap
    by_strength = _boundaries(text)
    cuts: list[int] = []
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        size = hi - lo
        if size <= room:
            continue
        mid, reach = lo + size // 2, size // 4
        cut = None
        for places in by_strength:
            if (cut := _nearest(places, max(lo + 1, mid - reach), min(hi - 1, mid + reach), mid)) is not None:
                break
        if cut is None:
            cut = _nearest(by_strength[-1], lo + 1, hi - 1, mid)
        if cut is None:
            cut = mid
            while cut > lo + 1 and _joined(text, cut):
                cut -= 1
            if _joined(text, cut):
                cut = mid
        cuts.append(cut)
        stack += [(lo, cut), (cut, hi)]
    edges = [0, *sorted(cuts), n]
    spans = []
    for k in range(len(edges) - 1):
        core, start = edges[k], edges[k]
        if k and overlap:
            lo = max(edges[k - 1], core - overlap)
            start = lo
            for places in (by_strength[SENTENCE], by_strength[-1]):
                j = bisect_left(places, lo)
                if j < len(places) and places[j] < core:
                    start = places[j]
                    break
            else:
                while start < core and start > 0 and _joined(text, start):
                    start += 1
        spans.append((start, core, edges[k + 1]))
    return spans


def _pieces(batches: Iterator[pd.DataFrame], limit: int, overlap: int, with_text: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, field, text in zip(batch["id"], batch["field"], batch["text"], strict=True):
            spans = split_spans(text, limit, overlap)
            for k, (start, core, end) in enumerate(spans, 1):
                rows.append((key, field, k, len(spans), start, core, end, *([text[start:end]] if with_text else [])))
        yield pd.DataFrame(rows, columns=["id", "field", "piece_no", "n_pieces", "start", "core", "end", *["piece"] * with_text])


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = False) -> DataFrame:
    """``items(id, field, text)`` -> ``id, field, piece_no, n_pieces, start, core, end`` (+ ``piece``), positions in code points from 0.

    Items within the limit never leave the JVM.  There is no shuffle; the work of a task is in proportion to the text it reads.
    """
    schema = "id string, field string, piece_no int, n_pieces int, start int, core int, end int" + ", piece string" * with_text
    rows = items.select(F.col("id").cast("string").alias("id"), "field", "text").where(F.col("text").isNotNull())
    large = rows.where(F.char_length("text") > limit).mapInPandas(lambda b: _pieces(b, limit, overlap, with_text), schema)
    one, zero = F.lit(1).cast("int"), F.lit(0).cast("int")
    fit = rows.where(F.char_length("text") <= limit).select("id", "field", one.alias("piece_no"), one.alias("n_pieces"), zero.alias("start"), zero.alias("core"), F.char_length("text").alias("end"), *([F.col("text").alias("piece")] if with_text else []))
    return large.unionByName(fit)
