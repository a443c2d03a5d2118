"""Vector retrieval and reranking.

``nearest`` is exact: the batch of query vectors is compared with every row that passes the filter.  Queries are broadcast as one block only while they are
counted to be few; beyond that blocks of queries meet blocks of rows by a shuffle on the block pair, so neither side has to fit anywhere as a whole.  Each
block keeps the k best per query, so what is merged is k rows per query and block.

Defined results: rows with a null vector, another length, NaN or infinity aren't found; a vector of length 0 has no cosine and isn't found under it; ties
are ranked by id; distances are rounded to 6 places before they are ranked; a threshold applies after the k best are chosen, so fewer rows can come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.paths import ancestors, base_id

#: Query vectors that are handed to every task, at most; 2000 vectors of 1024 doubles are 16 MB.
BROADCAST_QUERIES = 2_000
#: Rows and queries of a block beyond that.
BLOCK = 4_000
METRICS = ("cosine", "l2", "ip")
#: Section types searched where no filter is given.
LEAVES = ("dieu", "khoan", "diem", "phu_luc_phan")


def condition(where: dict | None) -> Column | None:
    """V2: a filter from a mapping: lists are ``in``, other values ``=``, several are and-ed, none is none."""
    out = None
    for name, value in (where or {}).items():
        one = F.col(name).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(name) == value
        out = one if out is None else out & one
    return out


def usable(vector: str, size: int) -> Column:
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return 1 - queries @ rows.T
    if metric == "l2":
        return np.maximum(0, (queries**2).sum(1)[:, None] - 2 * queries @ rows.T + (rows**2).sum(1)[None, :])
    a, b = np.sqrt((queries**2).sum(1)), np.sqrt((rows**2).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - (queries @ rows.T) / (a[:, None] * b[None, :])


def _best(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, metric: str, k: int) -> pd.DataFrame:
    d = np.round(_distances(queries, rows, metric), 6) + 0.0  # no negative zeros
    d[~np.isfinite(d)] = np.inf
    out_q, out_i, out_d = [], [], []
    keep = min(k, d.shape[1])
    for j in range(len(qids)):
        row = d[j]
        bound = np.partition(row, keep - 1)[keep - 1]
        near = np.flatnonzero((row <= bound) & np.isfinite(row))
        near = near[np.lexsort((ids[near], row[near]))][:keep]
        out_q.append(np.repeat(qids[j], len(near)))
        out_i.append(ids[near])
        out_d.append(row[near])
    return pd.DataFrame({"qid": np.concatenate(out_q), "id": np.concatenate(out_i), "distance": np.concatenate(out_d)})


def nearest(queries: DataFrame, rows: DataFrame, qid: str, query_vector: str, key: str, vector: str, size: int, k: int = 5, metric: str = "cosine", where: dict | None = None, threshold: float | None = None) -> DataFrame:
    """V1-V4: ``qid, id, distance, rank``.  Keys are longs; the filter is applied to the scan, before any distance."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    if (only := condition(where)) is not None:
        rows = rows.where(only)
    rows = rows.where(usable(vector, size)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.where(usable(query_vector, size)).select(F.col(qid).cast("long").alias("qid"), F.col(query_vector).alias("v"))
    schema = "qid long, id long, distance double"
    few = asked.limit(BROADCAST_QUERIES + 1).toPandas()  # bounded: it only decides how to go on
    if len(few) <= BROADCAST_QUERIES:
        if few.empty:
            return queries.sparkSession.createDataFrame([], schema + ", rank int")
        qids, block = few["qid"].to_numpy(), np.stack(few["v"].to_numpy()).astype(np.float64)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield _best(qids, block, batch["id"].to_numpy(), np.stack(batch["v"].to_numpy()).astype(np.float64), metric, k)

        found = rows.mapInPandas(scan, schema)
    else:
        n_rows, n_asked = rows.count(), asked.count()
        a, b = -(-n_asked // BLOCK), max(1, -(-n_rows // BLOCK))
        left = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(a)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
        right = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))

        def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if q.empty or r.empty:
                return pd.DataFrame({"qid": [], "id": [], "distance": []}).astype({"qid": "int64", "id": "int64", "distance": float})
            return _best(q["qid"].to_numpy(), np.stack(q["v"].to_numpy()).astype(np.float64), r["id"].to_numpy(), np.stack(r["v"].to_numpy()).astype(np.float64), metric, k)

        found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, schema)
    order = Window.partitionBy("qid").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked if threshold is None else ranked.where(F.col("distance") <= threshold)


def rerank(candidates: DataFrame, score: Column, k: int, qid: str = "qid", key: str = "id") -> DataFrame:
    """V7, V8: the candidates by a scorer's descending score, the k best of each query; k is at least 1."""
    order = Window.partitionBy(qid).orderBy(F.desc("score"), key)
    return candidates.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k))


def without_descendants(results: DataFrame, chunk: str, group: list[str]) -> DataFrame:
    """V9: drop a chunk if one of its dotted ancestors is among the results of its group; repeats (``__dup_N``) count as their base id."""
    own = results.withColumn("__base", base_id(F.col(chunk)))
    held = own.select(*group, F.col("__base").alias("__held")).distinct()
    above = own.select(*group, "__base", F.explode(ancestors(F.col("__base"))).alias("__held")).distinct()
    covered = above.join(held, [*group, "__held"], "left_semi").select(*group, "__base").distinct()
    return own.join(covered, [*group, "__base"], "left_anti").drop("__base").select(*results.columns)


# ---- vectors as columns --------------------------------------------------------------------------------------------------------------


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Length 1; a zero vector stays."""
    return F.transform(v, lambda x: F.when(l2_norm(v) > 0, x.cast("double") / l2_norm(v)).otherwise(x.cast("double")))


def fitted(v: Column, size: int) -> Column:
    """Cut or padded with zeros to ``size``."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), size)), F.lit(1), F.lit(size))


def mean_vector(rows: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """Mean of a group's vectors, combined map-side one number a place."""
    sums = rows.where(usable(vector, size)).groupBy(group).agg(*(F.avg(F.col(vector)[j].cast("double")).alias(f"v{j}") for j in range(size)))
    return sums.select(group, F.array(*(F.round(f"v{j}", 6) for j in range(size))).alias("mean"))


def pooled(tokens: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """Token vectors (n, steps, size) to one vector each: ``mean`` over the mask, ``cls`` the first, ``none`` as they are."""
    if how == "none" or tokens.ndim == 2:
        return tokens
    if how == "cls":
        return tokens[:, 0]
    weight = mask[:, :, None].astype(tokens.dtype)
    return (tokens * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)


def embed(rows: DataFrame, text: str, encode, size: int, batch: int = 64, unit: bool = True) -> DataFrame:
    """``vector`` by a plugged-in encoder.  ``encode()`` is called once a task and gives a function from a list of texts to an (n, size) array."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encode()
        for part in parts:
            texts = ["" if t is None else t for t in part]
            x = np.concatenate([np.asarray(model(texts[a : a + batch]), np.float32).reshape(-1, size) for a in range(0, len(texts), batch)]) if texts else np.zeros((0, size), np.float32)
            if unit:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(x), index=part.index)

    return rows.withColumn("vector", run(F.col(text)))


def hashing_encoder(size: int):
    """A deterministic encoder that needs no model: signed feature hashing of words."""

    def load():
        import re
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), np.float32)
            for k, t in enumerate(texts):
                for w in re.findall(r"\w+", t.lower()):
                    h = zlib.crc32(w.encode("utf-8", "replace"))
                    out[k, h % size] += 1 if h & 0x80000000 else -1
            return out

        return encode

    return load


# ---- store ---------------------------------------------------------------------------------------------------------------------------


def upsert(store: DataFrame, changes: DataFrame, key: str, newest: list[Column]) -> DataFrame:
    """Changed keys replace stored ones; of several changes of a key the last by ``newest`` wins.  The result is for a new version's folder."""
    order = Window.partitionBy(key).orderBy(*newest)
    last = changes.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")
    return store.join(last.select(key), key, "left_anti").unionByName(last.select(*store.columns))


def merge_shards(master: DataFrame, shards: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key the master lacks, of each shard; earlier shards go before later ones."""
    numbered = None
    for n, shard in enumerate(shards):
        one = shard.withColumn("__shard", F.lit(n))
        numbered = one if numbered is None else numbered.unionByName(one)
    if numbered is None:
        return master
    first = Window.partitionBy(key).orderBy("__shard")
    fresh = numbered.join(master.select(key), key, "left_anti").withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place", "__shard")
    return master.unionByName(fresh.select(*master.columns))


def by_ids(store: DataFrame, requests: DataFrame, key: str, qid: str, ids: str) -> DataFrame:
    """The stored rows of each request's id list, in its order; unknown ids are left out."""
    wanted = requests.select(F.col(qid), F.posexplode(ids).alias("pos", key))
    return wanted.join(store, key)


def by_metadata(store: DataFrame, where: dict | None, key: str, limit: int = 10) -> DataFrame:
    """Rows by exact filters alone, in the order of the key."""
    only = condition(where)
    return (store if only is None else store.where(only)).orderBy(key).limit(limit)


def chunk_rows(embeddings: DataFrame) -> DataFrame:
    """``chunk_id, text, vector, metadata`` for the store; a row without a chunk_id is an error, chunk_index goes into the metadata unless it is there."""
    given = F.coalesce(F.nullif(F.trim("metadata"), F.lit("")), F.lit("{}"))
    lacks = F.col("chunk_index").isNotNull() & F.get_json_object(given, "$.chunk_index").isNull()
    entry = F.concat(F.lit('"chunk_index": '), F.col("chunk_index").cast("string"), F.lit("}"))
    grown = F.when(F.rlike(given, F.lit(r"^\s*\{\s*\}\s*$")), F.concat(F.lit("{"), entry)).otherwise(F.concat(F.regexp_replace(given, r"\s*\}\s*$", ", "), entry))
    key = F.coalesce(F.nullif(F.trim("chunk_id"), F.lit("")), F.raise_error(F.lit("an embedding has no chunk_id")).cast("string"))
    return embeddings.select(key.alias("chunk_id"), "text", "vector", F.when(lacks, grown).otherwise(given).alias("metadata"))


def scored_by_text(pairs: DataFrame, results: DataFrame, order: list[Column]) -> DataFrame:
    """``pairs(qid, text)`` with a score from ``results(qid, text, score)``: of several results of a text the last by ``order`` counts, a text without one has 0."""
    last = Window.partitionBy("qid", "text").orderBy(*order)
    one = results.withColumn("__p", F.row_number().over(last)).where("__p = 1").select("qid", "text", "score")
    return pairs.join(one, ["qid", "text"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def scored_by_index(candidates: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """V8: a scorer's results ``(qid, index, score)`` on ``candidates(qid, index, id)``; indexes beyond the candidates are left out, an index counts once by its best score."""
    best = results.groupBy("qid", "index").agg(F.max("score").alias("score"))
    return rerank(candidates.join(best, ["qid", "index"]), F.col("score"), k)
