"""Evaluation of the BM25 run of lexical_queries: a document is relevant to a title if it is about the same official number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import evaluation as E
from docweave.plans import lexical_queries as L
from docweave.runtime import settled, table


def _qrels(spark: SparkSession, folder: str) -> DataFrame:
    meta = table(spark, folder, "document_metadata").where("id % 20 = 0").select(F.col("id").alias("qid"), "so_hieu")
    return meta.join(table(spark, folder, "documents").select("doc_id", "so_hieu"), "so_hieu").select("qid", "doc_id").distinct()


def _judged(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The run and the qrels; a question without a qrel isn't evaluated, so it isn't searched for either."""
    qrels = settled(_qrels(spark, folder))
    return L.bm25_wand(spark, folder, qrels.select("qid")), qrels


def eval_qrels(spark, folder):
    return _qrels(spark, folder)


def eval_recall_rr_ndcg(spark, folder):
    return E.macro(E.ranking_metrics(*_judged(spark, folder)))


def eval_p_r_map_hit(spark, folder):
    return E.macro(E.set_metrics(*_judged(spark, folder)))


def eval_mrr(spark, folder):
    return E.macro(E.reciprocal_ranks(*_judged(spark, folder)))


def latency_percentiles(spark, folder):
    return E.latency(table(spark, folder, "events"), "value", "event_id", warm_up=5)


def _answers(spark, folder):
    """Event types: what a user did, and what the same user did next, as a prediction."""
    from pyspark.sql import Window

    after = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("event_id", F.col("event_type").alias("truth"), F.lead("event_type").over(after).alias("predicted"))


def accuracy_overall(spark, folder):
    return E.accuracy(_answers(spark, folder), "predicted", "truth")


def accuracy_by_label(spark, folder):
    rows = _answers(spark, folder).where("predicted is not null")
    return rows.groupBy("truth").agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


def confusion_matrix(spark, folder):
    return E.confusion(_answers(spark, folder).where("predicted is not null"), "predicted", "truth")


def top_error_pairs(spark, folder):
    return E.top_errors(_answers(spark, folder), "predicted", "truth", 5)


def truth_with_default(spark, folder):
    labels = table(spark, folder, "reading_label").select("doc_id", F.col("level").cast("string").alias("level"))
    return E.with_default(table(spark, folder, "documents").select("doc_id"), labels, "doc_id", "level", "?")


_NAMES = "eval_qrels eval_recall_rr_ndcg eval_p_r_map_hit eval_mrr latency_percentiles accuracy_overall accuracy_by_label confusion_matrix top_error_pairs truth_with_default"
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_RUN = L.SQL["bm25_wand"].replace(", s AS (", ", s AS (", 1)
_RUN = _RUN[: _RUN.rindex("SELECT qid, doc_id, score, row_number()")] + ", run AS (" + _RUN[_RUN.rindex("SELECT qid, doc_id, score, row_number()") :] + ")"
_QRELS = "SELECT DISTINCT m.id AS qid, d.doc_id FROM document_metadata m JOIN documents d ON d.so_hieu = m.so_hieu WHERE m.id % 20 = 0"
_JUDGED = _RUN + f""", rel AS ({_QRELS}), nrel AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY qid)
, j AS (SELECT n.qid, n_rel, rank, CASE WHEN rel.doc_id IS NOT NULL THEN 1 ELSE 0 END AS hit FROM nrel n LEFT JOIN run r ON r.qid = n.qid LEFT JOIN rel ON rel.qid = n.qid AND rel.doc_id = r.doc_id)
, j2 AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS so_far FROM j)
"""


def _rank_metrics() -> str:
    per = []
    for k in E.CUTS:
        per += [f"sum(hit) FILTER (rank <= {k}) / any_value(n_rel) AS recall_{k}", f"coalesce(max(1.0 / rank) FILTER (hit = 1 AND rank <= {k}), 0) AS rr_{k}", f"coalesce(sum(1 / log2(rank + 1)) FILTER (hit = 1 AND rank <= {k}), 0) / list_sum(list_transform(range(1, least(any_value(n_rel), {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}"]
    names = [f"{m}_{k}" for k in E.CUTS for m in ("recall", "rr", "ndcg")]
    return f", q AS (SELECT qid, {', '.join(per)} FROM j GROUP BY qid) SELECT count(*) AS n_queries, {', '.join(f'round(avg(coalesce({n}, 0)), 6) AS {n}' for n in names)} FROM q"


def _set_metrics() -> str:
    per = []
    for k in E.CUTS:
        per += [f"coalesce(sum(hit) FILTER (rank <= {k}), 0) / {k} AS precision_{k}", f"coalesce(sum(hit) FILTER (rank <= {k}), 0) / any_value(n_rel) AS recall_{k}", f"CASE WHEN coalesce(sum(hit) FILTER (rank <= {k}), 0) > 0 THEN 1 ELSE 0 END AS hit_{k}"]
    names = [f"{m}_{k}" for k in E.CUTS for m in ("precision", "recall", "hit")] + ["ap_20"]
    return f", q AS (SELECT qid, {', '.join(per)}, coalesce(sum(so_far / rank) FILTER (hit = 1 AND rank <= 20), 0) / any_value(n_rel) AS ap_20 FROM j2 GROUP BY qid) SELECT count(*) AS n_queries, {', '.join(f'round(avg({n}), 6) AS {n}' for n in names)} FROM q"


_ANSWERS = "WITH a AS (SELECT event_type AS truth, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS predicted FROM events) "
SQL = {
    "eval_qrels": _QRELS,
    "eval_recall_rr_ndcg": _JUDGED + _rank_metrics(),
    "eval_p_r_map_hit": _JUDGED + _set_metrics(),
    "eval_mrr": _JUDGED + ", q AS (SELECT qid, coalesce(max(1.0 / rank) FILTER (hit = 1), 0) AS rr FROM j GROUP BY qid) SELECT count(*) AS n_queries, round(avg(rr), 6) AS rr FROM q",
    "latency_percentiles": "WITH v AS (SELECT value::DOUBLE AS v FROM events WHERE value IS NOT NULL ORDER BY event_id OFFSET 5) SELECT count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_disc(v, 0.5), 6) AS nearest_p50, round(quantile_disc(v, 0.95), 6) AS nearest_p95 FROM v",
    "accuracy_overall": _ANSWERS + "SELECT count(*) AS n, round(avg((predicted = truth)::INT), 6) AS accuracy, round(avg((upper(trim(predicted)) = upper(trim(truth)))::INT), 6) AS loose_accuracy FROM a WHERE predicted IS NOT NULL AND trim(predicted) <> ''",
    "accuracy_by_label": _ANSWERS + "SELECT truth, count(*) AS n, round(avg((truth = predicted)::INT), 6) AS accuracy FROM a WHERE predicted IS NOT NULL GROUP BY truth",
    "confusion_matrix": _ANSWERS + "SELECT truth, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM a WHERE predicted IS NOT NULL GROUP BY truth, predicted",
    "top_error_pairs": _ANSWERS + "SELECT truth, predicted, count(*) AS n FROM a WHERE predicted <> truth GROUP BY ALL ORDER BY n DESC, truth, predicted LIMIT 5",
    "truth_with_default": "SELECT d.doc_id, coalesce(l.level, '?') AS level FROM documents d LEFT JOIN (SELECT doc_id, min(level::VARCHAR) AS level FROM reading_label GROUP BY doc_id) l USING (doc_id)",
}
