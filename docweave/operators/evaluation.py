"""Ranking and answer evaluation.

A run is ``qid, doc_id, rank`` (rank from 1), qrels are ``qid, doc_id``.  Repeated qrels count once.  Only queries with a qrel are evaluated; a query without
results counts with zeros.  Metrics are per query first, then averaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 20)


def judged(run: DataFrame, qrels: DataFrame, qid: str = "qid", doc: str = "doc_id") -> DataFrame:
    """Per evaluated query: its results with ``hit``, and ``n_rel``; a query without results has one row with a null rank."""
    rel = qrels.select(qid, doc).where(f"{qid} is not null and {doc} is not null").distinct()
    sizes = rel.groupBy(qid).agg(F.count("*").alias("n_rel"))
    marked = run.select(qid, doc, "rank").join(rel.withColumn("hit", F.lit(1)), [qid, doc], "left").select(qid, "rank", F.coalesce("hit", F.lit(0)).alias("hit"))
    return sizes.join(marked, qid, "left").select(qid, "n_rel", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))


def _hits(k: int | None) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)) if k else F.sum("hit")


def ranking_metrics(run: DataFrame, qrels: DataFrame, cuts=CUTS, qid: str = "qid", doc: str = "doc_id") -> DataFrame:
    """G1: per query recall@k, reciprocal rank within k and nDCG@k (binary gains, log2(rank + 1))."""
    rows = judged(run, qrels, qid, doc)
    gain = F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    out = []
    for k in cuts:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out += [
            (_hits(k) / F.first("n_rel")).alias(f"recall_{k}"),
            F.coalesce(F.max(F.when((F.col("hit") == 1) & (F.col("rank") <= k), 1 / F.col("rank"))), F.lit(0.0)).alias(f"rr_{k}"),
            (F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)) / F.first(ideal)).alias(f"ndcg_{k}"),
        ]
    return rows.groupBy(qid).agg(*out)


def set_metrics(run: DataFrame, qrels: DataFrame, cuts=CUTS, qid: str = "qid", doc: str = "doc_id") -> DataFrame:
    """Per query precision@k (by k), recall@k, hit@k, and average precision at the last cut (by the number of relevant documents)."""
    rows = judged(run, qrels, qid, doc)
    running = Window.partitionBy(qid).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("so_far", F.sum("hit").over(running))
    out = []
    for k in cuts:
        out += [(_hits(k) / k).alias(f"precision_{k}"), (_hits(k) / F.first("n_rel")).alias(f"recall_{k}"), F.when(_hits(k) > 0, 1).otherwise(0).alias(f"hit_{k}")]
    top = cuts[-1]
    at = F.when((F.col("hit") == 1) & (F.col("rank") <= top), F.col("so_far") / F.col("rank")).otherwise(0.0)
    return rows.groupBy(qid).agg(*out, (F.sum(at) / F.first("n_rel")).alias(f"ap_{top}"))


def reciprocal_ranks(run: DataFrame, qrels: DataFrame, qid: str = "qid", doc: str = "doc_id") -> DataFrame:
    """Over the whole list."""
    return judged(run, qrels, qid, doc).groupBy(qid).agg(F.coalesce(F.max(F.when(F.col("hit") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"))


def macro(metrics: DataFrame, qid: str = "qid") -> DataFrame:
    """Mean of each metric over the evaluated queries, rounded to 6 places, and their number."""
    return metrics.agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c != qid))


def latency(samples: DataFrame, value: str, order: str | None = None, warm_up: int = 0) -> DataFrame:
    """Mean, p50/p90/p95 by linear interpolation, and nearest-rank p50/p95, without the first ``warm_up`` samples by ``order``."""
    rows = samples.where(F.col(value).isNotNull())
    if warm_up and order:
        first = rows.orderBy(order).limit(warm_up).agg(F.max(order).alias("__last"))
        rows = rows.crossJoin(F.broadcast(first)).where(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).drop("__last")
    v = F.col(value).cast("double")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), *(F.round(F.percentile(v, F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95)), *(F.round(F.expr(f"percentile_disc({p}) within group (order by cast({value} as double))"), 6).alias(f"nearest_p{int(p * 100)}") for p in (0.5, 0.95)))


def accuracy(pairs: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Share of right answers, exact and without case and blanks; rows without a prediction don't count."""
    given = pairs.where(F.col(predicted).isNotNull() & (F.trim(predicted) != ""))
    same = F.col(predicted) == F.col(truth)
    loose = F.upper(F.trim(predicted)) == F.upper(F.trim(truth))
    return given.agg(F.count("*").alias("n"), F.round(F.avg(same.cast("double")), 6).alias("accuracy"), F.round(F.avg(loose.cast("double")), 6).alias("loose_accuracy"))


def confusion(pairs: DataFrame, predicted: str, truth: str) -> DataFrame:
    """``truth, predicted, n, share`` of each true label's rows."""
    return pairs.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("truth")), 6))


def top_errors(pairs: DataFrame, predicted: str, truth: str, k: int = 10) -> DataFrame:
    wrong = pairs.where(F.col(predicted) != F.col(truth)).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "truth", "predicted").limit(k)


def with_default(rows: DataFrame, truth: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """The truth of each row, or the default."""
    return rows.join(truth.groupBy(key).agg(F.min(value).alias(value)), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def failed_among_wrong(wrong: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """``n_wrong, n_failed, share``: how many of the wrong answers ask about a document that couldn't be indexed."""
    both = wrong.select(key).join(failed.select(key).distinct().withColumn("__failed", F.lit(1)), key, "left")
    return both.agg(F.count("*").alias("n_wrong"), F.count("__failed").alias("n_failed"), F.round(F.count("__failed") / F.nullif(F.count("*"), F.lit(0)), 6).alias("share"))
