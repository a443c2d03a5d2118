"""Problem 10: reading level of each document.

Regularised proportional-odds regression over lexical diversity, word rarity, connectives, clause depth and length, calibrated to graded text.

Two passes over the texts.  The first counts words and pairs of neighbouring words over all documents, and per level of the graded ones, in tables of a fixed number
of hash buckets, so what reaches the driver and the tasks has the same size for any corpus.  The second computes the features; the model is fitted on
the driver to the graded documents' features (of about ``max_graded`` documents, chosen by a hash of their id before any text is read) and scores the others where they are read.

Rarity is measured in the corpus (how rare a word is, how surprising after the word before it) and in the texts of each level (how much likelier a word, or a
word after the one before it, is there than on the whole).  A text may quote a passage of another level, so the latter is also summed line by line
and sentence by sentence with one foreign passage set aside.  A graded document's own words are taken out of the counts it is described by.

Defined results: a text that is null or has no word gets no level; graded documents keep being graded and get no estimate from ``estimate_levels`` unless asked;
a graded document repeated counts once; without two different levels in the graded rows the result is empty; a text of any length is read whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.confusables import skeleton
from docweave.runtime import settled, small

LEVELS = 5
#: Hash buckets of words and of pairs.
WORDS, PAIRS = 1 << 16, 1 << 18
BUCKETS = WORDS + PAIRS
#: Buckets of a packed part of the counts on its way to the driver.
PART = 1 << 14
#: Texts that are described at once.
TEXTS = 500
#: Graded documents the model is fitted to, about.
MAX_GRADED = 6_000
#: Words by which a word's share of each level leans on the levels' sizes, and a pair's on its two words.
WORD_PRIOR, PAIR_PRIOR = 3.0, 20.0
#: (unit, pairs?, weight of the log likelihood, chance of a foreign unit or, as one run of units, what it costs)
READINGS = (("line", False, 0.5, 0.02), ("line", True, 0.8, 0.02), ("sentence", False, 0.3, 0.02), ("run", False, 0.3, 10.0), ("all", False, 0.3, 0.0), ("all", True, 0.6, 0.0))

#: Words that join clauses in the graded texts' language: of everyday speech, and of formal writing.  A parameter; these are for Vietnamese.
EVERYDAY = ("vì vậy", "sau đó", "trước hết", "nhớ rằng", "nếu", "lúc này", "bây giờ", "khi", "rồi", "kẻo", "vì", "để", "và", "thì", "hôm nay", "mỗi")
FORMAL = ("căn cứ", "trừ trường hợp", "trong đó", "qua đó", "đồng thời", "nhằm", "đối với", "theo quy định", "phù hợp với", "trên cơ sở", "tùy thuộc", "không phụ thuộc", "với điều kiện", "trong phạm vi", "liên quan đến", "dưới hình thức", "trên nguyên tắc", "mà", "theo thủ tục", "kể từ")
CONNECTIVES = (EVERYDAY, FORMAL)

_END, _COMMA, _LINE, _ID = 1 << 20, 1 << 21, 1 << 22, (1 << 20) - 1
_BREAK = " \ue000 "
_DIGITS = re.compile(r"\d+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class Words(dict):
    """Typed word -> bucket of its printed form (0 if it has no letter or digit) with marks of a sentence's end and of a comma, remembered for the words of a task."""

    def __missing__(self, typed: str) -> int:
        if len(self) > 200_000:
            self.clear()
        if typed == "\ue000":
            return self.setdefault(typed, _LINE)
        plain = unicodedata.normalize("NFC", skeleton(typed)).lower()
        word = _EDGES.sub("", _DIGITS.sub("0", plain))
        code = 1 + zlib.crc32(word.encode("utf-8", "replace")) % (WORDS - 1) if word else 0
        code |= (plain[-1:] in tuple(".;!?…")) * _END | ("," in plain) * _COMMA
        self[typed] = code
        return code


def _numbered(group: np.ndarray) -> np.ndarray:
    """Ascending labels as 0, 1, 2, ..."""
    return np.cumsum(np.diff(group, prepend=group[:1]) > 0, dtype=np.int32)


class Batch:
    """The words of several texts, one after another: ``ids``, with the text, line and sentence each stands in.  Texts without a word are left out of ``texts``."""

    def __init__(self, words: Words, texts: pa.Array):
        typed = pc.utf8_split_whitespace(pc.binary_join_element_wise(pc.replace_substring(texts, "\n", _BREAK), _BREAK, ""))
        stops = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.list_value_length(typed).to_numpy(zero_copy_only=False), dtype=np.int64)])
        coded = typed.flatten().dictionary_encode()  # each typed word is looked at once a batch
        known = np.fromiter(map(words.__getitem__, coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        codes = known[coded.indices.to_numpy()] if len(known) else known
        keep = np.flatnonzero(codes & _ID)
        ends = np.cumsum(codes & (_END | _LINE) > 0, dtype=np.int32)
        lines = np.cumsum(codes & _LINE > 0, dtype=np.int32)
        codes = codes[keep]
        self.ids, self.comma = codes & _ID, codes & _COMMA > 0
        # a word with a mark of an end stands in the sentence it ends
        self.line, self.sentence = _numbered(lines[keep]), _numbered(ends[keep] - (codes & _END > 0))
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.searchsorted(keep, stops)))
        self.text = _numbered(owner)
        self.texts = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
        first = np.ones(len(self.ids), bool)
        first[1:] = self.text[1:] != self.text[:-1]
        self.before = np.roll(self.ids, 1)
        self.before[first] = 0
        self.pairs = ((self.before.astype(np.uint32) * np.uint32(0x9E3779B1) + self.ids.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(7)).astype(np.int32) & (PAIRS - 1)
        self.chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)[self.texts].astype(float)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), TEXTS):
            yield batch.slice(a, TEXTS)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, level or 0) -> counts of the task by level and bucket; pairs come after words."""
    totals = np.zeros((LEVELS + 1) * BUCKETS, np.int64)
    words = Words()
    for part in _parts(batches):
        read = Batch(words, part["text"])
        at = _numbers(part["level"]).astype(np.int64)[read.texts][read.text] * BUCKETS
        np.add.at(totals, at + read.ids, 1)
        np.add.at(totals, at + WORDS + read.pairs, 1)
    place = np.flatnonzero(totals)
    yield pa.RecordBatch.from_pydict({"place": place, "n": totals[place]})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        place, n = _numbers(batch["place"]), _numbers(batch["n"]).astype(np.float32)
        for part in np.unique(place // PART):
            own = place // PART == part
            parts.setdefault(int(part), np.zeros(PART, np.float32))[place[own] % PART] = n[own]
    yield pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int64()), "counts": pa.array([x.tobytes() for x in parts.values()], pa.binary())})


def word_counts(graded: DataFrame) -> np.ndarray:
    """``graded(text, level)`` with level 0 for ungraded -> (LEVELS + 1) x BUCKETS counts; row 0 is over all documents.  At most (LEVELS + 1) x BUCKETS numbers, packed, come to the driver."""
    rows = graded.where(F.col("text").isNotNull()).select("text", F.col("level").cast("int").alias("level"))
    sums = rows.mapInArrow(_count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    packed = sums.repartition(rows.sparkSession.sparkContext.defaultParallelism, F.floor(F.col("place") / PART)).mapInArrow(_pack, "part long, counts binary")
    table = np.zeros((LEVELS + 1) * BUCKETS, np.float32)
    for r in packed.collect():
        table[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.float32)[: len(table) - r["part"] * PART]
    table = table.reshape(LEVELS + 1, BUCKETS)
    table[0] = table.sum(0)
    return table


def _sums(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sums of the rows of each group; groups follow one another and none is empty."""
    return np.add.reduceat(values, np.flatnonzero(np.diff(group, prepend=-1)), axis=0)


def _across(x: np.ndarray) -> np.ndarray:
    """Row sums as a column (faster over five columns than along the rows)."""
    return (x[:, 0] + x[:, 1] + x[:, 2] + x[:, 3] + x[:, 4])[:, None]


def _tilt(scores: np.ndarray) -> np.ndarray:
    """How much more the two highest levels are spoken for than the two lowest."""
    return 0.5 * (scores[:, 3] + scores[:, 4] - scores[:, 0] - scores[:, 1])


def _quantiles(values: np.ndarray, group: np.ndarray, n: int, at: tuple[float, ...]) -> list[np.ndarray]:
    ordered = values[np.lexsort((values, group))]
    size = np.bincount(group, minlength=n)
    start = np.cumsum(size) - size
    return [ordered[start + (q * (size - 1) + 0.5).astype(np.int64)] for q in at]


def _moments(values: np.ndarray, group: np.ndarray, n: int) -> list[np.ndarray]:
    size = np.bincount(group, minlength=n)
    mean = np.bincount(group, values, n) / size
    return [mean, np.sqrt(np.maximum(0, np.bincount(group, values * values, n) / size - mean**2))]


def _with_foreign_units(scores: np.ndarray, group: np.ndarray, chance: float) -> np.ndarray:
    """Log likelihood of each level where every unit may, by a small chance, be of another level."""
    top = scores.max(1, keepdims=True)
    each = np.exp(scores - top)
    return _sums(top + np.log((1 - chance) * each + chance / (LEVELS - 1) * (_across(each) - each)), group)


def _with_foreign_run(scores: np.ndarray, group: np.ndarray, n: int, cost: float) -> np.ndarray:
    """Log likelihood of each level where one run of units may be of another level, at a cost."""
    out = _sums(scores, group)
    size = np.bincount(group, minlength=n)
    start, order = np.cumsum(size) - size, np.argsort(size, kind="stable")
    a = 0
    while a < n:
        b = min(n, a + 128)
        while b > a + 1 and int(size[order[b - 1]]) * (b - a) > 20_000:
            b = (a + b + 1) // 2
        docs, steps = order[a:b], int(size[order[b - 1]])
        at = start[docs][:, None] + np.arange(steps)
        padded = np.where((np.arange(steps) < size[docs][:, None])[:, :, None], scores[np.minimum(at, len(scores) - 1)], 0).astype(np.float32)
        for level in range(LEVELS):
            run = np.cumsum(padded - padded[:, :, level : level + 1], 1)
            low = np.minimum.accumulate(np.concatenate([np.zeros((len(docs), 1, LEVELS), np.float32), run[:, :-1]], 1), 1)
            out[docs, level] += np.maximum(0, (run - low).max(1).max(1) - cost)
        a = b
    return out


def _odds(scores: np.ndarray) -> list[np.ndarray]:
    """Log odds of each level and above, and the expected level."""
    p = np.exp(scores - scores.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    above = np.cumsum(p[:, ::-1], 1)[:, ::-1][:, 1:]
    return [*np.log((above + 1e-4) / (1 - above + 1e-4)).T, p @ np.arange(LEVELS)]


class Features:
    """Texts -> feature vectors, given the counts.  ``GROUPS`` of the features are kept apart for ablation."""

    GROUPS = ("length", "diversity", "clauses", "connectives", "rarity", "rarity by level", "passages")

    def __init__(self, counts: np.ndarray, connectives: tuple[tuple[str, ...], tuple[str, ...]] = CONNECTIVES):
        self.all_words, self.all_pairs = counts[0, :WORDS], counts[0, WORDS:]
        self.by_word, self.by_pair = (np.ascontiguousarray(counts[1:, s].T, np.float32) for s in (slice(WORDS), slice(WORDS, None)))
        sizes = self.by_word.sum(0) + 1
        self.share = (sizes / sizes.sum()).astype(np.float32)
        rare = np.log((self.all_words + 0.5) / (self.all_words.sum() + 1))
        self.ratio = self._ratio(self.by_word)
        self.by_id = np.concatenate([self._leaning(self.ratio), np.stack([rare, rare**2, *(rare < x for x in (-11, -9, -7, -5))], 1)], 1).astype(np.float32)
        self.words = Words()
        self.connectives = [[[self.words[w] & _ID for w in phrase.split()] for phrase in group] for group in connectives]
        self.leads = np.zeros(WORDS, bool)
        self.leads[[phrase[0] for group in self.connectives for phrase in group]] = True

    def _ratio(self, counts: np.ndarray) -> np.ndarray:
        """How much likelier than on the whole a word is in each level."""
        return (counts / self.share + WORD_PRIOR) / (_across(counts) + WORD_PRIOR)

    @staticmethod
    def _leaning(ratio: np.ndarray) -> np.ndarray:
        """Ten columns of a word: log ratio of each level, and how the word leans to the high or the low levels."""
        logs = np.log(ratio)
        tilt = _tilt(logs)
        return np.concatenate([logs, np.stack([tilt**2, tilt > 1, tilt > 0.5, tilt < -0.5, tilt < -1], 1)], 1).astype(np.float32)

    def _described(self, b: Batch, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each word, by itself (``by_id``) and after the word before it: log ratio of each level, surprise and its square."""
        rows, ratio, pair = self.by_id[b.ids], self.ratio[b.ids], self.by_pair[b.pairs]
        if own is not None:  # a graded text is described by the others' words
            level, lane = own[b.text] - 1, np.arange(len(b.ids))
            word = self.by_word[b.ids]
            for table, key, n in ((word, b.ids, WORDS), (pair, b.pairs, PAIRS)):
                _, back, times = np.unique(b.text.astype(np.int64) * n + key, return_inverse=True, return_counts=True)
                table[lane, level] = np.maximum(0, table[lane, level] - times[back])
            ratio = self._ratio(word)
            rows[:, :10] = self._leaning(ratio)
        before = np.roll(ratio, 1, 0)
        first = b.before == 0
        before[first] = 1
        both = ratio * before * self.share
        both *= PAIR_PRIOR / _across(both)
        both += pair
        both /= (_across(pair) + PAIR_PRIOR) * self.share * before
        surprise = np.log((np.where(first, 0, self.all_words[b.before]) + 1) / (self.all_pairs[b.pairs] + 0.1))
        after = np.empty((len(rows), 7), np.float32)
        after[:, :5], after[:, 5], after[:, 6] = np.log(np.maximum(both, 1e-9)), surprise, surprise**2
        return rows, after

    def groups(self, texts: pa.Array, own: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(places of the texts that have words, features by group); ``own``: the texts' levels where they are graded."""
        b = Batch(self.words, texts)
        n = len(b.texts)
        if not n:
            return b.texts, [np.zeros((0, 0)) for _ in self.GROUPS]
        t, s = b.text, b.sentence
        heads = np.flatnonzero(np.diff(s, prepend=-1))
        owner, line = t[heads], b.line[heads]
        line_owner = owner[np.flatnonzero(np.diff(line, prepend=-1))]
        rows, after = self._described(b, None if own is None else np.asarray(own)[b.texts])
        rows, after = np.add.reduceat(rows, heads), np.add.reduceat(after, heads)  # of sentences from here on
        sentence = rows[:, :5], after[:, :5]
        unit = {"sentence": sentence, "line": tuple(_sums(x, line) for x in sentence)}
        rows, after = _sums(rows, owner), _sums(after, owner)  # of texts from here on
        size, m = np.bincount(t, minlength=n).astype(float), np.bincount(owner, minlength=n).astype(float)
        lengths, commas = np.bincount(s).astype(float), np.bincount(s, b.comma)
        mean_length, all_commas = size / m, np.bincount(owner, commas, n)
        own_words = np.sort(t.astype(np.int64) * WORDS + b.ids)
        kinds = np.bincount(own_words[np.flatnonzero(np.diff(own_words, prepend=-1))] // WORDS, minlength=n).astype(float)
        joined = [np.zeros(n) for _ in self.connectives]
        leads = np.flatnonzero(self.leads[b.ids])
        lead_ids = b.ids[leads]
        for k, group in enumerate(self.connectives):
            for phrase in group:
                at = leads[lead_ids == phrase[0]]
                for j, w in enumerate(phrase[1:], 1):
                    at = at[at + j < len(t)]
                    at = at[(b.ids[at + j] == w) & (t[at + j] == t[at])]
                joined[k] += np.bincount(t[at], minlength=n)
        everyday, formal = joined
        by_sentence, by_pairs = _tilt(sentence[0]) / lengths, _tilt(sentence[1])
        passages = []
        for name, with_pairs, weight, x in READINGS:
            scores = weight * unit["line" if name == "line" else "sentence"][int(with_pairs)]
            of = line_owner if name == "line" else owner
            passages += _odds(_with_foreign_run(scores, of, n, x) if name == "run" else _with_foreign_units(scores, of, x) if x else _sums(scores, of))
        each = lambda x: np.bincount(owner, x, n) / m
        mean = lambda table, j: table[:, j] / size
        spread = lambda first, second: np.sqrt(np.maximum(0, second - first**2))
        tilt = _tilt(rows[:, :5]) / size
        columns = (
            [mean_length, _moments(lengths, owner, n)[1], np.log(mean_length), *_quantiles(lengths, owner, n, (0.1, 0.25, 0.5, 0.75, 0.9)), np.log(size), b.chars / size, np.log(m)],
            [kinds / size, kinds / np.sqrt(size), np.log(kinds) / np.log(size + 1)],
            [all_commas / m, each(commas >= 2), each(commas == 0), size / (all_commas + m), *_quantiles(commas, owner, n, (0.25, 0.75))],
            [everyday / size, formal / size, formal / m, everyday / m, (formal - everyday) / (formal + everyday + 1)],
            [mean(rows, 10), spread(mean(rows, 10), mean(rows, 11)), *(mean(rows, j) for j in range(12, 16)), mean(after, 5), spread(mean(after, 5), mean(after, 6))],
            [*(mean(rows, j) for j in range(5)), *(mean(after, j) for j in range(5)), spread(tilt, mean(rows, 5)), *(mean(rows, j) for j in range(6, 10)), *_moments(by_sentence, owner, n), *_quantiles(by_sentence, owner, n, (0.1, 0.25, 0.5, 0.75, 0.9)), *_quantiles(by_pairs, owner, n, (0.1, 0.25, 0.5, 0.75, 0.9)), each(by_sentence > 0.5), each(by_sentence < -0.5)],
            passages,
        )
        return b.texts, [np.stack(c, 1).astype(float) for c in columns]

    def of(self, texts: pa.Array, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at, groups = self.groups(texts, own)
        return at, np.concatenate(groups, 1)


class OrdinalModel:
    """Proportional odds with an L2 penalty on standardised features and their squares, fitted by Fisher scoring."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 40):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        n, m = z.shape
        k = LEVELS - 1
        share = np.clip(np.cumsum([(y == level).mean() for level in range(1, LEVELS)]), 0.01, 0.99)
        share = np.maximum.accumulate(share + 1e-3 * np.arange(k))
        theta = np.concatenate([np.zeros(m), np.log(share / np.maximum(1e-3, 1 - share))])
        at = np.arange(n)

        def parts(t: np.ndarray):
            below = 1 / (1 + np.exp(-np.clip(t[m:][None, :] - (z @ t[:m])[:, None], -30, 30)))
            edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
            p = np.maximum(np.diff(edges, axis=1), 1e-9)
            return edges * (1 - edges), p, -np.log(p[at, y - 1]).sum() + 0.5 * penalty * n * t[:m] @ t[:m]

        slopes, p, loss = parts(theta)
        for _ in range(steps):
            own = p[at, y - 1]
            up, down = slopes[at, y] / own, slopes[at, y - 1] / own
            grad = np.concatenate([z.T @ (up - down) + penalty * n * theta[:m], [down[y == j + 2].sum() - up[y == j + 1].sum() for j in range(k)]])
            step_up = np.diff(slopes, axis=1)
            info = np.zeros((m + k, m + k))
            info[:m, :m] = z.T @ (z * (step_up**2 / p).sum(1)[:, None]) + penalty * n * np.eye(m)
            for j in range(k):
                d = slopes[:, j + 1]
                info[:m, m + j] = info[m + j, :m] = -z.T @ (d * (step_up[:, j] / p[:, j] - step_up[:, j + 1] / p[:, j + 1]))
                info[m + j, m + j] = (d * d * (1 / p[:, j] + 1 / p[:, j + 1])).sum() + 1e-6
                if j + 1 < k:
                    info[m + j, m + j + 1] = info[m + j + 1, m + j] = -(d * slopes[:, j + 2] / p[:, j + 1]).sum()
            move = np.linalg.solve(info + 1e-9 * n * np.eye(m + k), grad)
            size = 1.0
            while size > 1e-4:
                tried = theta - size * move
                if (np.diff(tried[m:]) > 0).all() and (found := parts(tried))[2] <= loss:
                    break
                size /= 2
            else:
                break
            gained = loss - found[2]
            theta, (slopes, p, loss) = tried, found
            if gained < 1e-6 * abs(loss):
                break
        self.w, self.gaps = theta[:m], theta[m:]

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, (z * z - 1) / 3], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 + ((self._design(x) @ self.w)[:, None] > self.gaps[None, :]).sum(1)


def _features(batches: Iterator[pa.RecordBatch], features: Features) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        at, x = features.of(part["text"], _numbers(part["level"]))
        yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].take(pa.array(at)), "level": part["level"].take(pa.array(at)), "x": pa.array([row.astype(np.float32).tobytes() for row in x], pa.binary())})


def fit(documents: DataFrame, known: DataFrame, features: Features, max_graded: int = MAX_GRADED) -> OrdinalModel | None:
    """``documents(doc_id, text)`` and their levels ``known(doc_id, __level)`` -> the model, or None where there aren't two levels."""
    n = known.count()
    # ids are chosen before their texts are read
    chosen = known if n <= max_graded else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int((1 << 32) * max_graded / n))
    graded = documents.where("text is not null").join(small(chosen), "doc_id").select("doc_id", "text", F.col("__level").alias("level"))
    rows = graded.mapInArrow(lambda b: _features(b, features), "doc_id long, level int, x binary").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    if rows.empty or rows["level"].nunique() < 2:
        return None
    return OrdinalModel(np.stack([np.frombuffer(x, np.float32) for x in rows["x"]]).astype(float), rows["level"].to_numpy(int))


def _score(batches: Iterator[pa.RecordBatch], features: Features, model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        at, x = features.of(part["text"])
        if len(at):
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].take(pa.array(at)), "level": model.predict(x).astype(np.int32)})


def estimate_levels(documents: DataFrame, labels: DataFrame, wanted, max_graded: int = MAX_GRADED, graded_where=None, connectives: tuple[tuple[str, ...], tuple[str, ...]] = CONNECTIVES) -> DataFrame:
    """``doc_id, level`` of each document that has no label and satisfies the condition ``wanted``.

    ``documents(doc_id, text, ...)``, ``labels(doc_id, level)``; ``graded_where`` says which labelled documents the model may learn from.
    """
    known = labels.where(F.col("level").between(1, LEVELS)).groupBy("doc_id").agg(F.min("level").alias("__level"))
    known = small(settled(known))
    # the conditions are taken where the documents still have all their columns
    flags = documents.select("doc_id", "text", wanted.alias("__wanted"), (F.lit(True) if graded_where is None else F.coalesce(graded_where, F.lit(False))).alias("__may_teach"))
    marked = flags.join(known, "doc_id", "left")
    counts = word_counts(marked.select("text", F.when(F.col("__may_teach"), F.coalesce("__level", F.lit(0))).otherwise(0).alias("level")))
    features = Features(counts, connectives)
    model = fit(flags.where("__may_teach"), known, features, max_graded)
    schema = "doc_id long, level int"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    left = marked.where("__level is null and text is not null and __wanted").select("doc_id", "text")
    return left.mapInArrow(lambda b: _score(b, features, model), schema).dropDuplicates(["doc_id"])
