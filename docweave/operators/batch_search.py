"""Search for a whole batch of questions (B7, B8, B13, B14): the results of ``lexical``'s operators without a row for each pair of a question and a document.

Documents are rows of ``key, dl, terms, tfs`` (``counted``), cut into words once.  A task reads blocks of them, lays each block out by term and answers every question
on it by adding up whole posting lists; only the k best of each question leave a task.  So what is shuffled grows with questions and tasks, not with the pairs that share
a word.  Workers hold the vocabulary with its idf and the questions, each question text once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import normalize_text
from docweave.operators.lexical import B, K1
from docweave.runtime import settled

#: Documents of a block; a question's sums over it stay in a core's cache.
BLOCK = 16_384
#: A term that at least one document in so many holds is laid out over the whole block.
DENSE = 8
#: Fewer than one document in so many are scored one by one, more by adding up whole posting lists.
FEW = 4


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """B1, B2: a row for each document, empty ones included: ``key, dl, terms, tfs``; of ``wanted(term)`` only those are counted."""
    rows = docs.select(F.col(key), F.coalesce(normalize_text(F.col(text)), F.lit("")).alias("words"))
    known = None if wanted is None else pa.array(sorted(r[0] for r in wanted.select("term").distinct().collect()), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _count(batch, known)

    return settled(rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, dl long, terms array<string>, tfs array<int>"))


def _count(batch: pa.RecordBatch, known: pa.Array | None) -> pa.RecordBatch:
    n, split = batch.num_rows, pc.split_pattern(batch.column(1), " ")
    row, words = pc.list_parent_indices(split).to_numpy(), split.flatten()
    there = pc.not_equal(words, "")
    row, words = row[there.to_numpy(zero_copy_only=False)], words.filter(there)
    dl = np.bincount(row, minlength=n)
    if known is None:
        coded = words.dictionary_encode()
        codes, held = coded.indices.to_numpy(), coded.dictionary
    else:
        codes, held = pc.index_in(words, value_set=known.cast(words.type)).fill_null(-1).to_numpy(), known
        row, codes = row[codes >= 0], codes[codes >= 0]
    pairs, tf = np.unique(row.astype(np.int64) * max(len(held), 1) + codes, return_counts=True)
    row, codes = np.divmod(pairs, max(len(held), 1))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
    terms = held.take(pa.array(codes)).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl.astype(np.int64)), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], [batch.schema.names[0], "dl", "terms", "tfs"])


def frequencies(rows: DataFrame) -> DataFrame:
    """``term, df`` of counted documents."""
    return rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@dataclass
class Weighing:
    """The known terms in order, and what a term weighs in a document: ``impacts(row, term, tf, dl)`` of a block's postings."""

    terms: pa.Array
    impacts: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _in_order(idf: DataFrame) -> tuple[pa.Array, np.ndarray]:
    held = idf.select("term", "idf").toArrow().sort_by("term")
    return held["term"].combine_chunks().cast(pa.string()), held["idf"].to_numpy()


def bm25_weighing(rows: DataFrame, k1: float = K1, b: float = B) -> Weighing:
    """B3, B4 of counted documents."""
    total = rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).first()
    n_docs, avgdl = total["n_docs"], total["avgdl"]
    terms, idf = _in_order(frequencies(rows).select("term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))

    def impacts(row, term, tf, dl):
        norm = k1 * (1 - b + b * dl / avgdl) if avgdl else np.full(len(dl), k1)
        return idf[term] * tf * (k1 + 1) / (tf + norm[row])

    return Weighing(terms, impacts)


def cosine_weighing(idf: DataFrame, scheme: str = "log") -> Weighing:
    """TF-IDF weights of documents of length 1; ``idf`` holds every term of the documents."""
    terms, held = _in_order(idf)
    if scheme not in ("log", "augmented"):
        raise ValueError(f"no tf scheme {scheme!r}")

    def impacts(row, term, tf, dl):
        if scheme == "log":
            weight = 1 + np.log(tf)
        else:
            most = np.zeros(len(dl))
            np.maximum.at(most, row, tf)
            weight = 0.5 + 0.5 * tf / most[row]
        weight = weight * held[term]
        return weight / np.maximum(np.sqrt(np.bincount(row, weight * weight, len(dl))), 1e-12)[row]

    return Weighing(terms, impacts)


@dataclass
class Questions:
    """Question texts by number, each once: its terms (places in the vocabulary) and their weights from ``starts[number]`` on; ``of`` has ``qid, no``."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    of: DataFrame

    def __len__(self) -> int:
        return len(self.starts) - 1


def questions(asked: DataFrame, weighing: Weighing) -> Questions:
    """Of ``asked(qid, term)``, or ``(qid, term, weight)``; unknown terms are left out."""
    weight = F.col("weight") if "weight" in asked.columns else F.lit(1.0)
    held = asked.select("qid", "term", weight.alias("weight")).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("words")).toArrow()
    lists = held["words"].combine_chunks()
    row, words = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    terms = pc.index_in(words.field("term").cast(pa.string()), value_set=weighing.terms).fill_null(-1).to_numpy()
    weights = words.field("weight").to_numpy()
    row, terms, weights = row[terms >= 0], terms[terms >= 0].astype(np.int32), weights[terms >= 0]
    ends = np.cumsum(np.bincount(row, minlength=len(held)))
    number: dict[bytes, int] = {}
    at, nos, starts = [], [], [0]
    for q, (a, z) in enumerate(zip(np.concatenate([[0], ends])[:-1], ends, strict=True)):
        if z > a:
            nos.append(number.setdefault(terms[a:z].tobytes() + weights[a:z].tobytes(), len(number)))
            at.append(q)
            if nos[-1] == len(starts) - 1:
                starts.append(starts[-1] + z - a)
    first = dict(zip(reversed(nos), reversed(at), strict=True))
    picked = [np.arange(ends[q] - (starts[no + 1] - starts[no]), ends[q]) for no, q in sorted(first.items())]
    picked = np.concatenate(picked) if picked else np.zeros(0, np.int64)
    of = asked.sparkSession.createDataFrame(pa.table({"qid": held["qid"].take(pa.array(at, pa.int64())), "no": pa.array(nos, pa.int32())}))
    return Questions(np.array(starts), terms[picked], weights[picked], of)


class _Block:
    """Some documents, in the order of their keys, by term: a whole row for a frequent term, places and impacts for another."""

    def __init__(self, batches: list[pa.RecordBatch], weighing: Weighing, used: np.ndarray):
        rows = pa.Table.from_batches(batches).combine_chunks()
        keys, dl = rows.column(0).to_numpy(), rows["dl"].to_numpy()
        lists, tfs = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks()
        row, tf = pc.list_parent_indices(lists).to_numpy(), tfs.flatten().to_numpy().astype(np.float64)
        term = pc.index_in(lists.flatten().cast(pa.string()), value_set=weighing.terms).to_numpy()
        impact = weighing.impacts(row, term, tf, dl)
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys, self.n = keys[order], len(keys)
        asked = used[term]
        row, term, impact = place[row[asked]], term[asked], impact[asked]
        order = np.argsort(term, kind="stable")
        row, term, impact = row[order], term[order], impact[order]
        cuts = np.flatnonzero(np.diff(term, prepend=-1, append=len(used)))
        self.lists = {int(term[a]): (row[a:z], impact[a:z]) for a, z in zip(cuts, cuts[1:])}
        self.rows = {}
        for t, (places, impacts) in self.lists.items():
            if len(places) * DENSE >= self.n:
                self.rows[t] = np.zeros(self.n)
                self.rows[t][places] = impacts

    def sums(self, terms: list[int], weights: list[float], into: np.ndarray, spare: np.ndarray) -> None:
        into.fill(0)
        for t, w in zip(terms, weights, strict=True):
            if t in self.rows:
                into += self.rows[t] if w == 1 else np.multiply(self.rows[t], w, out=spare)
            elif t in self.lists:
                places, impacts = self.lists[t]
                into[places] += impacts * w

    def sums_at(self, places: np.ndarray, terms: list[int], weights: list[float], spare: np.ndarray) -> np.ndarray:
        """The same sums at some documents."""
        out = np.zeros(len(places))
        for t, w in zip(terms, weights, strict=True):
            if t in self.rows:
                out += self.rows[t][places] * w
            elif t in self.lists:
                held, impacts = self.lists[t]
                spare[held] = impacts
                out += spare[places] * w
                spare[held] = 0
        return out

    def holding(self, terms: list[int]) -> np.ndarray:
        """Which documents hold one of the terms."""
        out = np.zeros(self.n, bool)
        for t in terms:
            if t in self.lists:
                out[self.lists[t][0]] = True
        return out

    def few_holding(self, terms: list[int]) -> np.ndarray | None:
        """The documents that hold one of the terms, if they are fewer than one in ``FEW``; a term that alone has more ends the search for them."""
        if any(len(self.lists[t][0]) * FEW >= self.n for t in terms if t in self.lists):
            return None
        places = np.flatnonzero(self.holding(terms))
        return places if len(places) * FEW < self.n else None


def _blocks(batches: Iterator[pa.RecordBatch], weighing: Weighing, used: np.ndarray, most: int = BLOCK) -> Iterator[_Block]:
    held, n = [], 0
    for batch in batches:
        for part in (batch.slice(a, most) for a in range(0, batch.num_rows, most)):
            if held and n + part.num_rows > most:
                yield _Block(held, weighing, used)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield _Block(held, weighing, used)


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e6 + 0.5) / 1e6


def _used(asked: Questions, weighing: Weighing) -> np.ndarray:
    used = np.zeros(len(weighing.terms), bool)
    used[asked.terms] = True
    return used


def _answers(rows: DataFrame, asked: Questions, weighing: Weighing, k: int, pruning: tuple[np.ndarray, np.ndarray] | None = None, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(``no, key, score`` of the k best of each task, ``no, n_evaluated`` of each task).

    With ``pruning``, each question's bound and which terms are essential: scores below the bound are left out, and where few documents hold an essential term, only they are scored.
    """
    key, used = rows.columns[0], _used(asked, weighing)
    starts, all_terms, all_weights = asked.starts, asked.terms, asked.weights
    bounds, essential = (np.zeros(len(asked)), None) if pruning is None else pruning

    def each():
        for no in range(len(starts) - 1):
            a, z = starts[no], starts[no + 1]
            terms = all_terms[a:z].tolist()
            yield no, terms, all_weights[a:z].tolist(), None if essential is None else [t for t, e in zip(terms, essential[a:z], strict=True) if e]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for block in _blocks(batches, weighing, used, most):
            sums, spare, zeros = np.zeros(block.n), np.empty(block.n), np.zeros(block.n)
            for no, terms, weights, needed in each():
                scores, keys = found.get(no, (None, None))
                # ranking is by rounded scores, so the bound gives way by more than a rounding step
                least = max(0.0, bounds[no] - 1e-5, scores[-1] - 1e-6 if scores is not None and len(scores) == k else 0.0)
                candidates = None if needed is None else block.few_holding(needed)
                if candidates is not None:
                    at = block.sums_at(candidates, terms, weights, zeros)
                    hits, at = candidates[at > least], at[at > least]
                else:
                    block.sums(terms, weights, sums, spare)
                    hits = np.flatnonzero(sums > least)
                    at = sums[hits]
                if len(hits) > 4 * k:
                    top = at >= np.partition(at, len(at) - k)[len(at) - k] - 1e-6
                    hits, at = hits[top], at[top]
                if not len(hits):
                    continue
                at, names = _rounded(at), block.keys[hits]
                if scores is not None:
                    at, names = np.concatenate([scores, at]), np.concatenate([keys, names])
                order = np.lexsort((names, -at))[:k]
                found[no] = at[order], names[order]
        for part in _parts(sorted(found)):
            yield pa.RecordBatch.from_pydict({"no": pa.array(np.repeat(part, [len(found[no][0]) for no in part]), pa.int32()), key: pa.array(np.concatenate([found[no][1] for no in part])), "score": np.concatenate([found[no][0] for no in part])})

    def evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(starts) - 1, np.int64)
        for block in _blocks(batches, weighing, used, most):
            bits = {t: np.packbits(block.holding([t])) for t in block.lists}
            for no, terms, _, needed in each():
                held = [bits[t] for t in (terms if needed is None else needed) if t in bits]
                if held:
                    count[no] += int(np.bitwise_count(np.bitwise_or.reduce(held)).sum())
        yield pa.RecordBatch.from_pydict({"no": pa.array(np.flatnonzero(count), pa.int32()), "n_evaluated": count[count > 0]})

    return rows.mapInArrow(best, f"no int, {key} {rows.schema[key].dataType.simpleString()}, score double"), rows.mapInArrow(evaluated, "no int, n_evaluated long")


def _parts(numbers: list[int], most: int = 10_000) -> Iterator[list[int]]:
    return (numbers[a : a + most] for a in range(0, len(numbers), most))


def _ranked(scored: DataFrame, asked: Questions, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("no").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(asked.of, "no").select("qid", key, "score", "rank")


def search(rows: DataFrame, asked: DataFrame, weighing: Weighing, k: int, most: int = BLOCK) -> DataFrame:
    """``qid, key, score, rank`` of the k best of counted documents by the sum of impact times weight."""
    posed = questions(asked, weighing)
    return _ranked(_answers(rows, posed, weighing, k, None, most)[0], posed, k, rows.columns[0])


def _champions(rows: DataFrame, asked: Questions, weighing: Weighing, size: int, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(``t, key, score`` of the ``size`` best postings of each asked term, ``t, max_score``)."""
    key, used = rows.columns[0], _used(asked, weighing)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, weighing, used, most):
            terms, keys, scores, largest = [], [], [], []
            for t, (places, impacts) in block.lists.items():
                order = np.lexsort((places, -_rounded(impacts)))[:size]
                terms.append(np.full(len(order), t, np.int32))
                keys.append(block.keys[places[order]])
                scores.append(impacts[order])
                largest.append(np.full(len(order), impacts.max()))
            if terms:
                yield pa.RecordBatch.from_pydict({"t": np.concatenate(terms), key: pa.array(np.concatenate(keys)), "score": np.concatenate(scores), "largest": np.concatenate(largest)})

    found = settled(rows.mapInArrow(run, f"t int, {key} {kind}, score double, largest double"))
    order = Window.partitionBy("t").orderBy(F.desc(F.round("score", 6)), key)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("t", key, "score"), found.groupBy("t").agg(F.max("largest").alias("max_score"))


def _essential(rows: DataFrame, asked: Questions, weighing: Weighing, k: int, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The bound of ``lexical.pruned_search`` on each question's k-th best score, and which terms of the questions are essential by it."""
    best, peaks = (x.toArrow() for x in _champions(rows, asked, weighing, size, most))
    largest = np.zeros(len(weighing.terms))
    largest[peaks["t"].to_numpy()] = peaks["max_score"].to_numpy()
    best = best.sort_by("t")
    keys, scores = best.column(1).combine_chunks().dictionary_encode().indices.to_numpy() if len(best) else np.zeros(0, int), best["score"].to_numpy()
    cuts = np.searchsorted(best["t"].to_numpy(), np.arange(len(weighing.terms) + 1))
    starts, terms, weights = asked.starts, asked.terms, asked.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, bounds = [], []
            for no in batch.column(0).to_pylist():
                own, w = terms[starts[no] : starts[no + 1]], weights[starts[no] : starts[no + 1]]
                spans = [slice(cuts[t], cuts[t + 1]) for t in own]
                _, place = np.unique(np.concatenate([keys[s] for s in spans]), return_inverse=True)
                sums = np.bincount(place, np.concatenate([scores[s] * x for s, x in zip(spans, w, strict=True)]))
                bound = np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) >= k else 0.0
                order = np.lexsort((own, largest[own] * w))
                mark = np.empty(len(own), bool)
                # ranking is by rounded scores, so the bound gives way by more than a rounding step
                mark[order] = np.cumsum((largest[own] * w)[order]) >= bound - 1e-5
                marks.append(mark.tolist())
                bounds.append(float(bound))
            yield pa.RecordBatch.from_pydict({"no": batch.column(0), "bound": pa.array(bounds, pa.float64()), "marks": pa.array(marks, pa.list_(pa.bool_()))})

    marked = rows.sparkSession.range(len(asked)).mapInArrow(run, "no long, bound double, marks array<boolean>").toArrow().sort_by("no")
    return marked["bound"].to_numpy(), pc.list_flatten(marked["marks"]).to_numpy().astype(bool)


def pruned_search(rows: DataFrame, asked: DataFrame, weighing: Weighing, k: int, champion_size: int = 50, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """As ``search``, exactly, scoring only documents that hold an essential term; also ``qid, n_evaluated``."""
    posed = questions(asked, weighing)
    best, evaluated = _answers(rows, posed, weighing, k, _essential(rows, posed, weighing, k, champion_size, most), most)
    counts = evaluated.groupBy("no").agg(F.sum("n_evaluated").alias("n_evaluated"))
    return _ranked(best, posed, k, rows.columns[0]), counts.join(posed.of, "no").select("qid", "n_evaluated")


def with_zeros(found: DataFrame, asked: DataFrame, qid: str, rows: DataFrame, k: int) -> DataFrame:
    """``found``, the k best matches of each question, with the places that they leave filled by documents without a common term, at 0, in the order of the key.

    No document beyond the 2k smallest keys can fill one.
    """
    key = rows.columns[0]
    first = rows.select(key).orderBy(key).limit(2 * k).agg(F.sort_array(F.collect_list(key)).alias("first"))
    zeros = asked.select(F.col(qid).alias("qid")).distinct().crossJoin(F.broadcast(first)).select("qid", F.explode("first").alias(key), F.lit(0.0).alias("score"))
    both = found.select("qid", key, "score").unionByName(zeros.join(found, ["qid", key], "left_anti"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", key, "score", "rank")
