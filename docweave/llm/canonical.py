"""Problem 1: freely typed values to the entries of a reference list.

A value is brought to a plain form (printed skeleton, no marks, lower case, abbreviations written out) and looked up in a BK-tree over the plain forms
of the reference entries.  The metric is the unrestricted Damerau-Levenshtein distance (insert, delete, replace, and swaps of letters with anything
edited between them), a true metric, so the triangle inequality prunes the tree and every entry within the threshold is returned.  The tree is walked
for whole batches of values at once: one node's distances to all values that reach it are one vectorised table.

Reference entries are dealt out over shards of bounded size, each with its own tree; values go to every shard and the shards' winners are merged.

Defined results: null and blank values give no row, nor do values that are exactly an entry of their field; a value within no threshold gives -1; of
several entries the nearest wins, then the smaller ref_id; a value that as a whole means no entry, but is made of parts that do, gives a row per part;
repeated rows count once; an empty reference list gives -1 everywhere.
"""

from __future__ import annotations

import dataclasses
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.confusables import skeleton
from docweave.runtime import settled

#: Reference entries a tree holds at most, and entries of all lists that are handed to tasks inside a closure.
SHARD_ENTRIES = 20_000



@dataclass(frozen=True)
class Vocabulary:
    """What is known about how the values of a field are typed, by field; all of it may be empty, then only the plain forms and the metric decide."""

    #: Written-out words of abbreviations that stand within names.
    abbreviations: dict[str, dict[str, str]] = dataclasses.field(default_factory=dict)
    #: Words before a name, and after any name, that aren't part of it.
    leading: dict[str, tuple[str, ...]] = dataclasses.field(default_factory=dict)
    trailing: tuple[str, ...] = ()
    #: First words of entries that may be left out or be typed last.
    movable: dict[str, tuple[str, ...]] = dataclasses.field(default_factory=dict)
    #: A word between words that counts for nothing.
    link_word: str = ""

    def __hash__(self) -> int:
        return hash(repr(self))


NOTHING_KNOWN = Vocabulary()
#: For Vietnamese issuing bodies and kinds of documents.
VOCABULARY = Vocabulary(
    abbreviations={"co_quan_ban_hanh": {"ubnd": "uy ban nhan dan", "hdnd": "hoi dong nhan dan", "t cuc": "tong cuc", "ub": "uy ban", "hd": "hoi dong", "nd": "nhan dan", "t": "tinh", "tc": "tong cuc", "b": "bo"}},
    leading={"co_quan_ban_hanh": ("co quan",), "loai": ("loai van ban", "loai")}, trailing=("da ky",), movable={"co_quan_ban_hanh": ("bo",)}, link_word="va",
)
#: Separators between two bodies in one value, strongest first.
SEPARATORS = (r"[;|]+", r"\s+/\s+|/", r"\s+[-–—]\s+", r",|\+", r"\s+(?:va|&)\s+")
#: Distinct values a task looks up, and numbers a distance table holds, at most (a single pair of very long texts may need more).
VALUES_A_TASK, TABLE_CELLS = 5_000, 30_000_000


def plain(text: str) -> str:
    """Printed form without marks, in lower case, words parted by one blank."""
    text = "".join(c for c in skeleton(text) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D").lower()
    return re.sub(r"[^0-9a-z]+", " ", text).strip()


def written_out(words: str, field: str, known: Vocabulary = VOCABULARY) -> str:
    """Abbreviations written out, link words and words around the name left out, a movable word that was typed last moved to the front."""
    words = _bare(words, field, known)
    short = known.abbreviations.get(field, {})
    if " " in words:
        for several in (k for k in short if " " in k):
            words = re.sub(rf"\b{several}\b", short[several], words)
        words = " ".join(short.get(w, w) for w in words.split())
    parts = words.split()
    if len(parts) > 1 and parts[-1] in known.movable.get(field, ()):
        parts = [parts[-1], *parts[:-1]]
    return " ".join(w for w in parts if w != known.link_word)


def _bare(words: str, field: str, known: Vocabulary) -> str:
    """A value without the words around its name."""
    for tail in known.trailing:
        words = words.removesuffix(" " + tail).strip()
    for lead in known.leading.get(field, ()):
        if words.startswith(lead + " "):
            return words[len(lead) + 1 :]
    return words


def _unlinked(words: str, known: Vocabulary) -> str:
    return " ".join(w for w in words.split() if w != known.link_word)


def forms(text: str, field: str, known: Vocabulary = VOCABULARY) -> list[str]:
    """The forms under which a value is looked up: as typed, written out, and as a code."""
    words = plain(text)
    if not words:
        return []
    found = [words, written_out(words, field, known), _unlinked(words, known), "=" + _bare(words, field, known).replace(" ", "")]
    return list(dict.fromkeys(f for f in found if f))


def entry_forms(field: str, name: str | None, code: str | None, former: str | None, known: Vocabulary = VOCABULARY) -> list[tuple[str, int]]:
    """(form, threshold) of a reference entry.  Codes are led by ``=`` and admit no edit."""
    out: dict[str, int] = {}
    for value in (name, former):
        if not value or not (words := plain(value)):
            continue
        for form in (words, _unlinked(words, known)):
            out[form] = tolerance(form)
            for lead in known.movable.get(field, ()):
                if form.startswith(lead + " "):
                    rest = form[len(lead) + 1 :]
                    out.setdefault(rest, min(2, tolerance(rest)))
    if code and (words := plain(code)):
        out["=" + words.replace(" ", "")] = 0
    return list(out.items())


def tolerance(form: str) -> int:
    """Edits a typed form may be away from an entry's form."""
    n = len(form)
    return 0 if n <= 2 else 1 if n <= 6 else 2 if n <= 13 else 3


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance of two strings."""
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, above, db = [far, i], table[i], 0
        for j, y in enumerate(b, 1):
            i1 = seen.get(y, 0)
            swap = table[i1][db] + (i - i1 - 1) + 1 + (j - db - 1)
            row.append(min(above[j] + (x != y), row[j] + 1, above[j + 1] + 1, swap))
            if x == y:
                db = j
        seen[x] = i
        table.append(row)
    return table[-1][-1]


LETTERS = 48


def _letters(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % LETTERS, minlength=LETTERS).astype(np.int16)


class Batch:
    """Values of one batch as padded code points, for distances to one string at a time."""

    def __init__(self, values: list[str]):
        self.lengths = np.array([len(v) for v in values], np.int64)
        width = int(self.lengths.max(initial=0))
        self.codes = np.zeros((len(values), width), np.int32)
        for k, v in enumerate(values):
            if v:
                self.codes[k, : len(v)] = np.frombuffer(v.encode("utf-32-le"), np.int32)

        self.letters = np.stack([_letters(v) for v in values]) if values else np.zeros((0, LETTERS), np.int16)

    def at_least(self, word: str, rows: np.ndarray) -> np.ndarray:
        """A lower bound of the distances, by letters that one has more often than the other: an edit changes at most one of each side, a swap none."""
        more = self.letters[rows] - _letters(word)
        return np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))

    def distances(self, word: str, rows: np.ndarray) -> np.ndarray:
        """Unrestricted Damerau-Levenshtein distance of ``word`` to each of the rows (Lowrance and Wagner's recurrence, over all rows at once)."""
        lengths = self.lengths[rows]
        width = int(lengths.max(initial=0))
        n, m = len(word), len(rows)
        if m > 1 and (n + 2) * (width + 2) * m > TABLE_CELLS:
            half = m // 2
            return np.concatenate([self.distances(word, rows[:half]), self.distances(word, rows[half:])])
        codes = self.codes[rows, :width]
        far = n + width + 1
        table = np.full((n + 2, width + 2, m), far, np.int16 if far < 1 << 15 else np.int32)
        table[1:, 1, :] = np.arange(n + 1)[:, None]
        table[1, 1:, :] = np.arange(width + 1)[:, None]
        lane = np.arange(m)
        # seen[j] for each row: the last i at which word[i] equals the row's letter j
        seen = np.zeros((width, m), np.int64)
        for i in range(1, n + 1):
            letter = ord(word[i - 1])
            db = np.zeros(m, np.int64)
            same_all = (codes == letter).T
            for j in range(1, width + 1):
                same = same_all[j - 1]
                i1 = seen[j - 1]
                swap = table[i1, db, lane].astype(np.int32) + (i - i1 - 1) + 1 + (j - db - 1)
                best = np.minimum(table[i, j] + np.where(same, 0, 1), np.minimum(table[i + 1, j], table[i, j + 1]) + 1)
                table[i + 1, j + 1] = np.minimum(best, swap)
                db = np.where(same, j, db)
            seen[same_all] = i
        return table[n + 1, lengths + 1, lane].astype(np.int64)


class BKTree:
    """BK-tree over forms; each node keeps the largest threshold found below it, so a walk returns all entries within their own thresholds."""

    def __init__(self, entries: list[tuple[str, int, int]]):
        self.words: list[str] = []
        self.refs: list[list[tuple[int, int]]] = []
        self.children: list[dict[int, int]] = []
        self.reach: list[int] = []
        self.longest = max((len(word) + limit for word, _, limit in entries), default=-1)
        for word, ref, limit in entries:
            self._add(word, ref, limit)
        #: Distance from a node within which a value may find it or something below it.
        self.below = [max([limit for _, limit in refs] + [edge + self.reach[child] for edge, child in children.items()]) for refs, children in zip(self.refs, self.children, strict=True)]

    def _add(self, word: str, ref: int, limit: int) -> None:
        if not self.words:
            self._node(word, ref, limit)
            return
        at = 0
        while True:
            self.reach[at] = max(self.reach[at], limit)
            d = distance(self.words[at], word)
            if d == 0:
                self.refs[at].append((ref, limit))
                return
            if d not in self.children[at]:
                self.children[at][d] = self._node(word, ref, limit)
                return
            at = self.children[at][d]

    def _node(self, word: str, ref: int, limit: int) -> int:
        self.words.append(word)
        self.refs.append([(ref, limit)])
        self.children.append({})
        self.reach.append(limit)
        return len(self.words) - 1

    def within(self, values: list[str]) -> list[list[tuple[int, int]]]:
        """For each value all (ref, distance) within that entry's threshold."""
        out: list[list[tuple[int, int]]] = [[] for _ in values]
        # a value is at least as far from an entry as their lengths are apart: whole texts typed into a field never reach the tables
        asked = [k for k, v in enumerate(values) if len(v) <= self.longest]
        if not self.words or not asked:
            return out
        batch = Batch([values[k] if len(values[k]) <= self.longest else "" for k in range(len(values))])
        stack = [(0, np.array(asked))]
        while stack:
            node, rows = stack.pop()
            # whoever is surely farther than this finds neither the node nor anything below it
            rows = rows[batch.at_least(self.words[node], rows) <= self.below[node]]
            if not len(rows):
                continue
            d = batch.distances(self.words[node], rows)
            for ref, limit in self.refs[node]:
                for k in np.flatnonzero(d <= limit):
                    out[rows[k]].append((ref, int(d[k])))
            for edge, child in self.children[node].items():
                near = np.abs(d - edge) <= self.reach[child]
                if near.any():
                    stack.append((child, rows[near]))
        return out


@lru_cache(8)
def _trees(entries: tuple[tuple[str, int, str | None, str | None, str | None], ...], known: Vocabulary) -> dict[str, BKTree]:
    by_field: dict[str, list[tuple[str, int, int]]] = {}
    for field, ref, name, code, former in entries:
        for form, limit in entry_forms(field, name, code, former, known):
            by_field.setdefault(field, []).append((form, ref, limit))
    return {field: BKTree(sorted(rows, key=lambda x: (-len(x[0]), x))) for field, rows in by_field.items()}


def _lookup(tree: BKTree, asked: dict[str, list[str]], chunk: int = 8000) -> dict[str, list[tuple[int, int]]]:
    """value -> (distance, ref), nearest first; asked: value -> its forms."""
    words = sorted({f for fs in asked.values() for f in fs}, key=len)
    hits: dict[str, list[tuple[int, int]]] = {}
    for k in range(0, len(words), chunk):
        part = words[k : k + chunk]
        hits.update(zip(part, tree.within(part), strict=True))
    return {v: sorted({(d, ref) for f in fs for ref, d in hits[f]}) for v, fs in asked.items()}


def pieces(value: str, field: str) -> list[list[str]]:
    """Ways to read a value as several names, strongest separators first."""
    text = skeleton(re.sub(r"[\n\r\v\f\x85\u2028\u2029]+", ";", value))  # a skeleton keeps no line ends
    flat = "".join(c for c in text if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D").lower()
    ways = []
    for separator in SEPARATORS:
        parts = [p for p in re.split(separator, flat) if plain(p)]
        if len(parts) > 1:
            ways.append(parts)
            if len(parts) > 2:  # a name may hold the separator itself
                ways += [[" ".join(parts[:k]), " ".join(parts[k:])] for k in range(1, len(parts))]
    return ways


def match(values: list[str], field: str, tree: BKTree, known: Vocabulary = VOCABULARY) -> dict[str, list[tuple[int, int]]]:
    """value -> (ref, distance) of what it names; an empty list where it names no entry of this tree."""
    out: dict[str, list[tuple[int, int]]] = {}
    whole = _lookup(tree, {v: forms(v, field, known) for v in values})
    rest = []
    for v in values:
        if whole[v]:
            d, ref = whole[v][0]
            out[v] = [(ref, d)]
        else:
            out[v] = []
            rest.append(v)
    ways = {v: pieces(v, field) for v in rest}
    parts = sorted({p for ws in ways.values() for w in ws for p in w})
    hits = _lookup(tree, {p: forms(p, field, known) for p in parts})
    for v in rest:
        for way in ways[v]:
            if all(hits[p] for p in way):
                out[v] = sorted({(hits[p][0][1], hits[p][0][0]) for p in way})
                break
    return out


def map_to_canonical(values: DataFrame, reference: DataFrame, shard_entries: int = SHARD_ENTRIES, known: Vocabulary = VOCABULARY) -> DataFrame:
    """``values(id, field, value)`` -> ``id, field, value, ref_id, distance``.

    Only distinct values meet the tree; typed copies are joined back, so a value that fills a third of all rows is looked up once.  The reference list is
    counted and dealt out over shards of at most ``shard_entries``; a list of one shard is looked up in a closure, more shards are matched side by
    side (the values are sent to each) and the nearest of their winners is kept.
    """
    asked = values.select("id", "field", "value").where(F.col("value").isNotNull() & F.col("field").isNotNull())
    exact = reference.select(F.col("field"), F.col("ref_name").alias("value")).distinct()
    n_ref = reference.count()
    n_shards = max(1, -(-n_ref // shard_entries))
    asked = asked.join(F.broadcast(exact) if n_shards == 1 else exact, ["field", "value"], "left_anti")
    # tasks by the number of values, not by their few bytes; no finer ones: a node's distance table costs about the same for 10 values as for 1000
    distinct = settled(asked.groupBy("field", "value").count().select("field", "value"))
    n_values = distinct.count()
    distinct = distinct.repartition(max(1, -(-n_values // VALUES_A_TASK)))
    if n_shards == 1:
        entries = tuple((r["field"], int(r["ref_id"]), r["ref_name"], r["short_code"], r["former_name"]) for r in reference.select("field", "ref_id", "ref_name", "short_code", "former_name").distinct().collect() if r["field"])

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees = _trees(entries, known)
            for batch in batches:
                yield from _matched(batch, trees, known)

        found = distinct.mapInPandas(look, "field string, value string, ref_id long, distance int")
    else:
        found = _sharded(distinct, reference, n_shards, known)
    blank = F.regexp_replace("value", r"(?U)[\s\p{Z}\p{Cf}\p{Cc}]+", "") == ""
    return asked.where(~blank).join(found, ["field", "value"]).select("id", "field", "value", "ref_id", "distance").distinct()


def _matched(batch: pd.DataFrame, trees: dict[str, BKTree], known: Vocabulary) -> Iterator[pd.DataFrame]:
    for field, part in batch.groupby("field"):
        tree = trees.get(field)
        texts = part["value"].tolist()
        found = match(texts, field, tree, known) if tree else {v: [] for v in texts}
        rows = [(field, v, ref, d) for v in texts for ref, d in (found[v] or [(-1, None)])]
        yield pd.DataFrame(rows, columns=["field", "value", "ref_id", "distance"]).astype({"distance": "Int32"})


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ways to read each value: way 0 is the value as a whole, the others are its splits, strongest separators first."""
    for batch in batches:
        rows = []
        for field, value in zip(batch["field"], batch["value"], strict=True):
            for way, parts in enumerate([[value], *pieces(value, field)]):
                rows += [(field, value, way, len(parts), p) for p in parts]
        yield pd.DataFrame(rows, columns=["field", "value", "way", "n_parts", "part"])


def _sharded(distinct: DataFrame, reference: DataFrame, n_shards: int, known: Vocabulary) -> DataFrame:
    """Each shard's tree answers for every part of every reading; the winners are merged per part, then the first reading all of whose parts are entries counts."""
    readings = distinct.mapInPandas(_readings, "field string, value string, way int, n_parts int, part string")
    entries = reference.select("field", "ref_id", "ref_name", "short_code", "former_name").withColumn("shard", F.pmod(F.xxhash64("field", "ref_id"), F.lit(n_shards)).cast("int"))
    parts = settled(readings.select("field", "part").distinct())
    lanes = max(1, -(-parts.count() // VALUES_A_TASK))
    spread = parts.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).withColumn("lane", F.pmod(F.xxhash64("part"), F.lit(lanes)).cast("int"))
    wide = entries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = tuple(sorted((r.field, int(r.ref_id), *(x if isinstance(x, str) else "" for x in (r.ref_name, r.short_code, r.former_name))) for r in right.itertuples()))
        trees, out = _trees(rows, known), []
        for field, part in left.groupby("field"):
            if field in trees:
                found = _lookup(trees[field], {v: forms(v, field, known) for v in part["part"]})
                out += [(field, v, hits[0][1], hits[0][0]) for v, hits in found.items() if hits]
        return pd.DataFrame(out, columns=["field", "part", "ref_id", "distance"]).astype({"ref_id": "int64", "distance": "int32"})

    cells = n_shards * lanes
    each = spread.repartition(cells, "shard", "lane").groupBy("shard", "lane").cogroup(wide.repartition(cells, "shard", "lane").groupBy("shard", "lane")).applyInPandas(look, "field string, part string, ref_id long, distance int")
    best = each.groupBy("field", "part").agg(F.min(F.struct("distance", "ref_id")).alias("hit"))
    met = readings.join(best, ["field", "part"]).groupBy("field", "value", "way", "n_parts").agg(F.count("*").alias("n"), F.collect_set("hit").alias("hits")).where("n = n_parts")
    first = met.groupBy("field", "value").agg(F.min(F.struct("way", "hits"))["hits"].alias("hits"))
    told = distinct.join(first, ["field", "value"], "left").select("field", "value", F.explode_outer("hits").alias("hit"))
    return told.select("field", "value", F.coalesce("hit.ref_id", F.lit(-1)).cast("long").alias("ref_id"), F.col("hit.distance").alias("distance"))
