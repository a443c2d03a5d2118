"""Problem 8: items into containers of a fixed capacity with little room left over.

Configuration linear program: minimise the number of containers over all fillings (multisets of lengths of at most the capacity) that hold every item of
the length histogram.  It is solved by multiplicative weights: lengths get prices, the filling of most worth is found by a knapsack dynamic program,
the prices of what it holds fall, and the fillings' average is a near-optimal fractional solution.  Rounded down, it leaves few items, which are filled in by
the same pricing until nothing is left.

Only the histogram (at most as many numbers as the capacity) reaches the driver.  Which item goes into which container is decided where the items are: items
of one length are numbered by counts per salted group, and a length's number range is cut over the fillings.

Defined results: null and empty items have no tokens and no place; an item above the capacity is cut into pieces of the capacity and a rest, no other item is
cut; every token has exactly one place; a repeated id is placed as often as it occurs.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.runtime import settled

CAPACITY = 2048
#: Folder of public tokenizer vocabularies and the vocabulary used; both are parameters.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Lengths of one class are treated alike, as the longest of them.
CLASS_WIDTH = 4
ROUNDS = 600
#: Items one group of equal lengths has on average when they are numbered.
ITEMS_PER_GROUP = 100_000
_ENCODERS: dict[str, object] = {}


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """A function from texts to token counts; the vocabulary is read once a process."""
    path = str(Path(folder) / vocabulary)
    if path not in _ENCODERS:
        if vocabulary.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _ENCODERS[path] = _by_word(lambda t: len(coder.encode_ordinary(t)))
        elif vocabulary.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _ENCODERS[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(path)
            coder.encode_special_tokens = True
            _ENCODERS[path] = lambda texts: [len(e) for e in coder.encode_batch(texts, add_special_tokens=False)]
    return _ENCODERS[path]


# Fixed value: the public vocabulary's rule that cuts a text before its pieces are looked up.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_MIXED_SPACE = re.compile(r"[^\S ] | [^\S ]|  ")


def _by_word(count):
    """Token counts from the counts of a text's parts between blanks, each distinct part counted once a process (the memory is emptied when it grows).

    The vocabulary's rule never joins what a single blank parts, and gives the blank to what follows; texts in which a blank stands next to other
    white space are counted as a whole.
    """

    class Known(dict):
        def __missing__(self, part: str) -> int:
            if len(self) > 300_000:
                self.clear()
            n = self[part] = count(" " + part)
            return n

    known = Known()

    def of(text: str) -> int:
        if not text:
            return 0
        if _MIXED_SPACE.search(text) or text[-1] == " ":
            return count(text)
        head, *parts = text.split(" ")
        return (count(head) if head else 0) + sum(map(known.__getitem__, parts))

    return lambda texts: [of(t) for t in texts]


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id`` (+ ``keep``), ``n_tokens`` of each row; null texts have 0."""
    rows = documents.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))
    schema = rows.drop("text").schema.add("n_tokens", T.IntegerType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = encoder(folder, vocabulary)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            yield batch.drop(columns="text").assign(n_tokens=np.array(count(texts), np.int32))

    return rows.mapInPandas(run, schema)


def best_filling(sizes: np.ndarray, worth: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each class the filling of most worth holds: knapsack by dynamic programming, then no more of a class than is left.

    ``sizes`` are ascending; the room that the bound frees is filled up with the largest classes that fit.
    """
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes[0]), capacity + 1):
        fit = int(np.searchsorted(sizes, room, "right"))
        tried = value[room - sizes[:fit]] + worth[:fit]
        k = int(tried.argmax())
        if tried[k] > value[room - 1]:
            value[room], last[room] = tried[k], k
        else:
            value[room] = value[room - 1]
    filling, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        k = int(last[room])
        if k < 0 or filling[k] >= left[k]:
            room -= 1
            continue
        filling[k] += 1
        room -= int(sizes[k])
    room = capacity - int(filling @ sizes)
    k = len(sizes) - 1
    while room >= sizes[0] and k >= 0:
        k = min(k, int(np.searchsorted(sizes, room, "right")) - 1)
        if k >= 0 and (more := min(room // int(sizes[k]), int(left[k] - filling[k]))) > 0:
            filling[k] += more
            room -= more * int(sizes[k])
        k -= 1
    return filling


def configuration_lp(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, step: float = 0.12) -> list[tuple[np.ndarray, float]]:
    """Fillings and how often each is used, fractionally; no class is used more often than it has items.

    Covering by multiplicative weights: each round takes the filling that is worth most at the current prices and as much of it as its scarcest class
    allows; a class's weight, at first its share of all tokens, falls by the share of its items that the round has taken.
    """
    log_weight = np.log(sizes * counts)
    used: dict[bytes, list] = {}
    covered = np.zeros(len(sizes))
    for _ in range(rounds):
        worth = np.exp(log_weight - log_weight.max()) / counts
        filling = best_filling(sizes, worth, counts, capacity)
        held = filling > 0
        if not held.any():
            break
        share = np.where(held, filling / counts, 0.0)
        entry = used.setdefault(filling.tobytes(), [filling, 0.0])
        entry[1] += 1 / share.max()
        covered += share / share.max()
        log_weight -= step * share / share.max()
    most = max(1.0, float(covered.max(initial=1.0)))
    return [(f, x / most) for f, x in used.values()]


def fillings(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> list[tuple[np.ndarray, int]]:
    """Whole fillings with their numbers, together holding every item exactly once."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []

    def use(filling: np.ndarray, times: int) -> None:
        nonlocal left
        out.append((filling, times))
        left = left - filling * times

    for filling, x in sorted(configuration_lp(sizes, counts, capacity, rounds), key=lambda fx: -int(fx[0] @ sizes)):
        held = filling > 0
        if (times := min(math.floor(x), int((left[held] // filling[held]).min()))) > 0:
            use(filling, times)
    # what rounding down left over is priced by its size: the largest class first, the rest of the room by the same knapsack
    while left.any():
        alive = np.flatnonzero(left)
        filling = np.zeros(len(sizes), np.int64)
        first = int(alive[-1])
        filling[first] = 1
        room = capacity - int(sizes[first])
        rest = left - filling
        small = np.flatnonzero((rest > 0) & (sizes <= room))
        if len(small):
            filling[small] += best_filling(sizes[small], sizes[small].astype(float), rest[small], room)
        held = filling > 0
        use(filling, int((left[held] // filling[held]).min()))
    return out


def numbered(items: DataFrame, count: int) -> DataFrame:
    """Items with ``number``: 0, 1, 2, ... within their class.  A class's items are numbered in salted groups whose first numbers come from their counts."""
    groups = max(1, -(-count // ITEMS_PER_GROUP))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("class", "salt").orderBy("id", "piece_no")
    return salted.withColumn("rank", F.row_number().over(own) - 1).join(firsts, ["class", "salt"]).withColumn("number", F.col("first") + F.col("rank")).drop("salt", "rank", "first")


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, width: int = CLASS_WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """``container_id, id, piece_no, first_token, n_tokens``: one row per item or piece of an oversized item."""
    spark = documents.sparkSession
    sizes = token_counts(documents, id_col, text_col, folder=folder, vocabulary=vocabulary).where("n_tokens > 0")
    pieces = sizes.select("id", F.posexplode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(capacity))).alias("k", "first_token"), F.col("n_tokens").alias("all"))
    items = pieces.select("id", (F.col("k") + 1).alias("piece_no"), "first_token", F.least(F.lit(capacity), F.col("all") - F.col("first_token")).cast("int").alias("n_tokens"))
    items = settled(items.withColumn("class", F.least(F.ceil(F.col("n_tokens") / width) * width, F.lit(capacity)).cast("int")))
    histogram = items.groupBy("class").count().orderBy("class").collect()  # at most capacity / width rows
    schema = "container_id long, id long, piece_no int, first_token int, n_tokens int"
    if not histogram:
        return spark.createDataFrame([], schema)
    sizes, counts = np.array([r["class"] for r in histogram]), np.array([r["count"] for r in histogram])
    units = -(-sizes // width)  # room in classes; a capacity that is no multiple is rounded down, but a full item always fits
    room = capacity // width if capacity % width == 0 else max(int(units.max()), capacity // width)
    if capacity % width:
        units = np.where(sizes == capacity, room, units)
    plan = fillings(units, counts, room, rounds)
    # per class: where each filling's share of its numbers begins, how many of it a container holds, and the containers' first id
    taken, base = np.zeros(len(sizes), np.int64), 0
    begins: dict[int, list] = {int(n): [] for n in sizes}
    for filling, times in plan:
        for k in np.flatnonzero(filling):
            begins[int(sizes[k])].append((int(taken[k]), int(filling[k]), base))
            taken[k] += int(filling[k]) * times
        base += times
    lookup = {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in begins.items() if rows}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, size = batch["number"].to_numpy(np.int64), batch["class"].to_numpy(np.int64)
            container = np.empty(len(batch), np.int64)
            for n in np.unique(size):
                starts, held, first = lookup[int(n)]
                at = np.flatnonzero(size == n)
                k = np.searchsorted(starts, number[at], "right") - 1
                container[at] = first[k] + (number[at] - starts[k]) // held[k]
            yield batch.assign(container_id=container)[["container_id", "id", "piece_no", "first_token", "n_tokens"]]

    return numbered(items, int(counts.sum())).mapInPandas(place, schema)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """How full the containers are: by tenths of the capacity, containers and tokens."""
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return full.groupBy(F.least(F.floor(F.col("tokens") * 10 / capacity), F.lit(9)).cast("int").alias("tenth")).agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.sum("items").alias("n_items"), F.max("tokens").alias("most"))
