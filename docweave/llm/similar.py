"""Problem 4: the k most similar vectors of every vector.

Multiprobe p-stable hashing: directions are hashed by several tables of quantised Gaussian projections; a vector's own bucket and the perturbed buckets next
to it, in the order of their estimated chance of success, are probed in each table.  Inside a bucket candidates are compared by 8-bit copies of the vectors,
with a proven error, so that no candidate that could be among the k best is left out; what the tables found is merged and reranked by exact cosine.

Vectors that are equal number for number are one node of the index; their records come back at the end, so a third of all rows with the same vector costs one
row.  A bucket of more than ``BLOCK_ROWS`` vectors or probes is cut into blocks, every two of which meet once.

The index grows with the collection as the theory asks: one more projection a doubling keeps the candidates of a probe few, and the number of tables follows
from the chance that a pair of cosine HASHED is met.  Below that similarity hashing would lose neighbours, the more the larger the collection; who asks for
less gets an exact search instead: the vectors are cut into blocks, every two blocks meet once, and each vector keeps its best of every block.

Defined results: null vectors, vectors of another size, with NaN or infinite numbers, or all zero take no part; a repeated record counts once and is never its own
neighbour; equal similarities are ranked by id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.runtime import settled, small, tasks_for

#: Width of a projection's cells, for directions of length 1.
WIDTH = 2.0
#: Perturbed buckets probed in each table besides the own one.
PROBES = 6
#: Projections at BASE_ROWS vectors, and the chance that one table then brings a pair of cosine 0.9 together (measured; it shrinks by DECAY a projection).
BASE_ROWS, BASE_PROJECTIONS, BASE_CHANCE, DECAY = 50_000, 10, 0.6, 0.897
#: Share of such pairs that no table may bring together.
MISS = 0.005
#: The least similarity that the tables are planned for; below it the search is exact.
HASHED = 0.9
BLOCK_ROWS = 20_000
#: Vectors in a block of the exact search: at most MEET_ROWS, so that two blocks fit a task; up to MEET_BLOCKS blocks of MEET_LEAST, so that all cores have work.
MEET_ROWS, MEET_BLOCKS, MEET_LEAST = 40_000, 8, 1000
#: Places to which exact similarities are rounded, so that equal ones tie.
PLACES = 12
SEED = 20240229


def usable(vector: str, size: int):
    v = F.col(vector)
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == size) & ~broken & F.exists(v, lambda x: x != 0)


def plan(rows: int) -> tuple[int, int]:
    """(projections, tables) for a collection of so many vectors."""
    projections = max(4, min(30, BASE_PROJECTIONS + round(math.log2(max(rows, 1) / BASE_ROWS))))
    chance = min(0.95, BASE_CHANCE * DECAY ** (projections - BASE_PROJECTIONS))
    return projections, max(2, math.ceil(math.log(MISS) / math.log(1 - chance)))


def probe_template(projections: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks (1 = nearest cell wall) in the order of their expected score, the squared distances to the walls that are crossed."""
    m, walls = projections, 2 * projections
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (walls + 1 - j) / (m + 1) + (walls + 1 - j) * (walls + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, walls + 1)]
    found: list[tuple[int, ...]] = []
    heap = [(expected[0], (1,))]
    while heap and len(found) < probes:
        _, ranks = heapq.heappop(heap)
        if all(walls + 1 - j not in ranks for j in ranks):  # a cell has only one of its two neighbours
            found.append(ranks)
        if ranks[-1] < walls:
            for grown in ((*ranks[:-1], ranks[-1] + 1), (*ranks, ranks[-1] + 1)):
                heapq.heappush(heap, (sum(expected[j - 1] for j in grown), grown))
    return found


def _directions(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hash(batches: Iterator[pd.DataFrame], size: int, projections: int, tables: int, probes: int) -> Iterator[pd.DataFrame]:
    rng = np.random.default_rng(SEED)
    planes = rng.normal(size=(tables, size, projections))
    shifts = rng.uniform(0, WIDTH, (tables, projections))
    mixers = rng.integers(1, 2**62, (tables, projections), dtype=np.int64) | 1
    template = probe_template(projections, probes)
    for batch in batches:
        for a in range(0, len(batch), 2000):
            part = batch.iloc[a : a + 2000]
            x = _directions(part["vector"])
            n, lane = len(part), np.arange(len(part))
            ids = part["id"].to_numpy(np.int64)
            scale = 127.0 / np.abs(x).max(1)
            codes = np.rint(x * scale[:, None]).astype(np.int8)
            packed = np.array([c.tobytes() for c in codes], object)
            for t in range(tables):
                place = (x @ planes[t] + shifts[t]) / WIDTH
                cell = np.floor(place).astype(np.int64)
                rest = place - cell
                walls = np.concatenate([rest**2, (1 - rest) ** 2], 1)
                order = np.argsort(walls, 1)
                buckets = [cell]
                for ranks in template:
                    moved = cell.copy()
                    for j in ranks:
                        w = order[:, j - 1]
                        moved[lane, w % projections] += np.where(w < projections, -1, 1)
                    buckets.append(moved)
                for k, cells in enumerate(buckets):
                    with np.errstate(over="ignore"):
                        key = (cells * mixers[t]).sum(1) + t * np.int64(0x1E3779B97F4A7C15)
                    yield pd.DataFrame({"bucket": key, "probe": np.full(n, k > 0), "id": ids, "scale": (1 / scale).astype(np.float32), "code": packed})


#: What a row is in a cell of a bucket: an own vector that also meets the cell's other own ones, an own vector that doesn't, or one that meets the own ones.
BOTH, OWN, PROBE = 0, 1, 2


def _compare(batches: Iterator[pd.DataFrame], size: int, k: int, least: float) -> Iterator[pd.DataFrame]:
    """The pairs of all cells (``_pairs``), in frames of some size."""
    held, n = [], 0
    for pair in _pairs(batches, size, k, least):
        held.append(pair)
        n += len(pair[0])
        if n > 100_000:
            yield pd.DataFrame({"a": np.concatenate([p[0] for p in held]), "b": np.concatenate([p[1] for p in held])}).drop_duplicates()
            held, n = [], 0
    if held:
        yield pd.DataFrame({"a": np.concatenate([p[0] for p in held]), "b": np.concatenate([p[1] for p in held])}).drop_duplicates()


def _pairs(batches: Iterator[pd.DataFrame], size: int, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by (bucket, block, against, role): a cell's own vectors come first and are compared among themselves if they are to be, then with each probe."""
    # each component is off by at most half a step of scale on either side, so a product of unit vectors by at most:
    half = 0.5 * math.sqrt(size)
    here, own_ids, own, own_err, among = None, None, None, None, False
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def floor(sure: np.ndarray) -> np.ndarray:
        """What the (k+1)-th best of each row, which may hold the row itself, is surely as good as."""
        at = sure.shape[1] - k - 1
        return np.partition(sure, at, 1)[:, at] if at > 0 else np.full(len(sure), -np.inf, np.float32)

    def meet(ids: np.ndarray, m: np.ndarray, err: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(ids), 1024):
            rows = slice(a, a + 1024)
            for b in range(0, len(own_ids), 8192):
                columns = slice(b, b + 8192)
                near = m[rows] @ own[columns].T
                slack = err[rows][:, None] + own_err[columns][None, :] + 1e-3
                best = near + slack
                mask = best >= least
                if np.count_nonzero(mask) > 8 * (k + 1) * len(near):  # many: only who may be among the k best of either
                    sure = near - slack
                    mask &= (best >= floor(sure)[:, None]) | (best >= floor(np.ascontiguousarray(sure.T))[None, :])
                i, j = np.nonzero(mask)
                left, right = ids[rows][i], own_ids[columns][j]
                keep = left != right
                if keep.any():
                    yield np.minimum(left, right)[keep], np.maximum(left, right)[keep]

    def load() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal own_ids, own, own_err
        own_ids, own, own_err = (np.concatenate([h[c] for h in held]) for c in range(3)) if held else (np.empty(0, np.int64), np.empty((0, size), np.float32), np.empty(0, np.float32))
        held.clear()
        if among and len(own_ids) > 1:
            yield from meet(own_ids, own, own_err)

    for batch in batches:
        if not len(batch):
            continue
        codes = [batch[c].to_numpy() for c in ("bucket", "block", "against", "role")]
        new_cell = np.any([c[1:] != c[:-1] for c in codes[:3]], 0)
        change = np.flatnonzero(new_cell | (codes[3][1:] != codes[3][:-1])) + 1
        ids, scale = batch["id"].to_numpy(np.int64), batch["scale"].to_numpy(np.float32)
        vectors = np.frombuffer(b"".join(batch["code"]), np.int8).reshape(len(batch), size) * scale[:, None]
        err = (half * scale).astype(np.float32)
        starts, stops, roles = [0, *change.tolist()], [*change.tolist(), len(batch)], codes[3].tolist()
        for lo, hi in zip(starts, stops, strict=True):
            role = roles[lo]
            if lo == 0 or new_cell[lo - 1]:
                place = (codes[0][lo], codes[1][lo], codes[2][lo])
                if place != here:
                    if held:  # a cell that is over and had no probe
                        yield from load()
                    here, own_ids = place, None
            part = ids[lo:hi], vectors[lo:hi], err[lo:hi]
            if role != PROBE:
                held.append(part)
                among = role == BOTH
                continue
            if own_ids is None:
                if not held:  # a bucket that is only asked
                    continue
                yield from load()
            if len(own_ids):
                yield from meet(*part)
    if held:
        yield from load()


def _cells(entries: DataFrame) -> DataFrame:
    """The rows of each bucket in the cells in which they meet: ``block, against, role``.

    A bucket of up to BLOCK_ROWS own vectors and BLOCK_ROWS probes is one cell.  A larger one is cut: its own vectors into blocks, every two of which meet in one cell, and its
    probes into slots, each of which meets every block in one cell.  So no pair is looked at twice, and no cell is larger than two blocks.
    """
    n_own, n_probe = F.count_if(~F.col("probe")), F.count_if(F.col("probe"))
    sizes = entries.groupBy("bucket").agg(n_own.alias("n_own"), n_probe.alias("n_probe")).where((F.col("n_own") > 0) & (F.greatest("n_own", "n_probe") > BLOCK_ROWS))
    big = sizes.select(F.col("bucket").alias("hot"), F.ceil(F.col("n_own") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("n_probe") / BLOCK_ROWS).cast("int").alias("slots"))
    rows = entries.join(small(settled(big)), F.col("bucket") == F.col("hot"), "left")
    cell = lambda block, against, role: F.struct(block.cast("int").alias("block"), against.cast("int").alias("against"), role.cast("int").alias("role"))
    every = lambda n: F.filter(F.sequence(F.lit(0), n), lambda j: j < n)
    block, slot = F.pmod(F.xxhash64("id"), F.col("blocks")), F.pmod(F.xxhash64("id"), F.col("slots"))
    meets = F.transform(every(F.col("blocks")), lambda j: cell(F.least(block, j), F.greatest(block, j), F.when(j == block, BOTH).when(j > block, OWN).otherwise(PROBE)))
    asked = F.transform(every(F.col("slots")), lambda j: cell(block, F.col("blocks") + j, F.lit(OWN)))
    asks = F.transform(every(F.col("blocks")), lambda j: cell(j, F.col("blocks") + slot, F.lit(PROBE)))
    alone = F.array(cell(F.lit(0), F.lit(0), F.when(F.col("probe"), PROBE).otherwise(BOTH)))
    cells = F.when(F.col("hot").isNull(), alone).when(F.col("probe"), asks).otherwise(F.concat(meets, asked))
    return rows.select("bucket", F.inline(cells), "id", "scale", "code")


def _best(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, k: int, least: float) -> Iterator[pd.DataFrame]:
    """The k best of ``y`` for each row of ``x``, by id where they are equal; ``y`` is ``x`` where a block meets itself."""
    for a in range(0, len(ids), 256):
        cosine = x[a : a + 256] @ y.T
        if x is y:
            lane = np.arange(len(cosine))
            cosine[lane, a + lane] = -np.inf
        bound = np.full(len(cosine), least)
        if len(other_ids) > k:
            bound = np.maximum(bound, np.partition(cosine, len(other_ids) - k, 1)[:, len(other_ids) - k])
        i, j = np.nonzero(cosine >= bound[:, None] - 2 * 10.0**-PLACES)
        part = pd.DataFrame({"node": ids[a + i], "near": other_ids[j], "similarity": np.round(cosine[i, j], PLACES)})
        part = part[part["similarity"] >= least].sort_values(["node", "similarity", "near"], ascending=[True, False, True])
        yield part[part.groupby("node").cumcount() < k]


def _every(nodes: DataFrame, count: int, k: int, least: float) -> DataFrame:
    """``node, near, similarity``: each vector's k best of every block, over all pairs."""
    blocks = max(-(-count // MEET_ROWS), min(MEET_BLOCKS, -(-count // MEET_LEAST)))
    placed = nodes.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select((F.least("block", "other") * blocks + F.greatest("block", "other")).alias("cell"), "block", "id", "vector")

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        ids, x, block = cell["id"].to_numpy(np.int64), _directions(cell["vector"]), cell["block"].to_numpy()
        sides = [(ids[block == b], x[block == b]) for b in np.unique(block)]
        found = [pd.DataFrame({"node": [], "near": [], "similarity": []})]
        if len(sides) == 2:
            found = [*_best(*sides[0], *sides[1], k, least), *_best(*sides[1], *sides[0], k, least)]
        elif cell["cell"].iloc[0] == block[0] * (blocks + 1):  # else the other block is empty
            found = [*_best(*sides[0], *sides[0], k, least)]
        return pd.concat(found)

    return met.repartition(blocks * (blocks + 1) // 2, "cell").groupBy("cell").applyInPandas(run, "node long, near long, similarity double")


def _hashed(nodes: DataFrame, count: int, size: int, k: int, least: float) -> DataFrame:
    """``node, near, similarity``, both ways, of what the tables bring together, with the exact cosine."""
    spark = nodes.sparkSession
    schema = "a long, b long"
    if count > 1:
        projections, tables = plan(count)
        entries = nodes.select("id", "vector").mapInPandas(lambda b: _hash(b, size, projections, tables, PROBES), "bucket long, probe boolean, id long, scale float, code binary")
        entries = settled(entries)
        buckets = tasks_for(spark, count * tables * (PROBES + 1), 1_000_000)
        found = _cells(entries).repartition(buckets, "bucket", "block", "against").sortWithinPartitions("bucket", "block", "against", "role").mapInPandas(lambda b: _compare(b, size, k, least), schema)
        pairs = found.distinct()
    else:
        pairs = spark.createDataFrame([], schema)
    # exact cosine of what was found
    unit = nodes.select("id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    unit = unit.select("id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
    both = pairs.join(unit.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na")), "a").join(unit.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb")), "b")
    cosine = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (F.col("na") * F.col("nb"))
    exact = both.select("a", "b", cosine.alias("similarity")).where(F.col("similarity") >= least)
    return exact.select(F.col("a").alias("node"), F.col("b").alias("near"), "similarity").unionByName(exact.select(F.col("b").alias("node"), F.col("a").alias("near"), "similarity"))


def most_similar(vectors: DataFrame, id_col: str, vector_col: str, size: int, k: int = 5, min_similarity: float = -1.0) -> DataFrame:
    """``id, other, similarity, rank``: the up to ``k`` most similar other records of each record, of at least ``min_similarity``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & usable("vector", size))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.hash("vector"))
    nodes = settled(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("vector").alias("vector"), F.min("id").alias("lo"), F.max("id").alias("hi")))
    count = nodes.count()
    if count > 1 and min_similarity < HASHED:
        each = _every(nodes, count, k, min_similarity)
    else:
        each = _hashed(nodes, count, size, k, min_similarity)
    best = Window.partitionBy("node").orderBy(F.desc("similarity"), "near")
    near = each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
    # records of equal vectors: at most the k + 1 smallest ids of a node can be among anyone's k best
    record = rows.select("h1", "h2", F.col("id").alias("record")).distinct().join(nodes.where("lo <> hi").select("h1", "h2", F.col("id").alias("node")), ["h1", "h2"])
    record = settled(record.select("node", "record"))
    first = Window.partitionBy("node").orderBy("record")
    heads = record.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).groupBy("node").agg(F.collect_list("record").alias("records"))
    lists = near.join(heads.withColumnRenamed("node", "near"), "near", "left").select("node", F.explode(F.coalesce("records", F.array("near"))).alias("other"), "similarity")
    lists = lists.unionByName(heads.select("node", F.explode("records").alias("other"), F.lit(1.0).alias("similarity")))
    asked = lists.join(record, "node", "left").select(F.coalesce("record", "node").alias("id"), "other", "similarity").where("id <> other")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return asked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "other", "similarity", "rank")
