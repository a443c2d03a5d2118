"""Batches of questions: the same results as the plain operators, and no row for each pair of a question and a document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from docweave.operators import batch_search as S
from docweave.operators import evaluation as E
from docweave.operators import lexical as L
from tests.test_retrieval import corpus


def rows_of(df):
    return {tuple(r) for r in df.select(sorted(df.columns)).collect()}


def shuffled(spark):
    """Rows shuffled by this session so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """1000 documents and 400 titles that all share two words: 400,000 pairs."""
    folder = tmp_path_factory.mktemp("alike")
    spark.range(1, 1001).select(F.col("id").alias("doc_id"), F.format_string("luật đất %d %s", F.col("id") % 7, F.repeat(F.lit("x "), (F.col("id") % 5).cast("int"))).alias("text"), F.format_string("%d_x", "id").alias("so_hieu")).write.parquet(f"{folder}/documents.parquet")
    spark.range(1, 401).select((F.col("id") * 20).alias("id"), F.format_string("Luật đất %d", "id").alias("ten_van_ban"), F.format_string("%d_x", "id").alias("so_hieu")).write.parquet(f"{folder}/document_metadata.parquet")
    return str(folder)


def test_search_is_the_plain_search(spark):
    docs, asked = corpus(spark, 200)
    terms, plain = L.query_terms(asked, "id", "title"), L.bm25_index(docs).postings
    rows = S.counted(docs, wanted=terms)
    for k, most in ((3, 7), (5, 1000), (500, 40)):
        assert rows_of(S.search(rows, terms, S.bm25_weighing(rows), k, most)) == rows_of(L.search(terms, plain, k))


def test_search_edges(spark):
    docs = spark.createDataFrame([("b", "a"), ("a", "a"), ("c", None)], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "a"), ("q2", "unknown"), ("q3", None), ("q4", "a")], "id string, title string")
    terms = L.query_terms(asked, "id", "title")
    rows = S.counted(docs, wanted=terms)
    assert [(r["qid"], r["doc_id"], r["rank"]) for r in S.search(rows, terms, S.bm25_weighing(rows), 5).orderBy("qid", "rank").collect()] == [("q", "a", 1), ("q", "b", 2), ("q4", "a", 1), ("q4", "b", 2)]
    empty = S.counted(docs.limit(0), wanted=terms)
    assert rows_of(S.search(empty, terms, S.bm25_weighing(empty), 5)) == set()


@pytest.mark.parametrize("name", ["bm25_search_full", "bm25_wand", "tfidf_forward_search", "tfidf_inverted_search", "bm25_wand_evaluated", "eval_mrr", "eval_p_r_map_hit", "eval_recall_rr_ndcg"])
def test_pairs_are_not_shuffled(spark, alike, name):
    before = shuffled(spark)
    assert queries()[name](spark, alike).count()
    assert shuffled(spark) - before < 80_000


def test_pruned_search_is_the_plain_one(spark):
    docs, asked = corpus(spark, 200)
    terms, plain = L.query_terms(asked, "id", "title"), L.bm25_index(docs).postings
    rows = S.counted(docs, wanted=terms)
    for k, size, most in ((3, 1, 7), (5, 50, 1000)):
        best, evaluated = S.pruned_search(rows, terms, S.bm25_weighing(rows), k, size, most)
        assert rows_of(best) == rows_of(L.search(terms, plain, k))
        assert rows_of(evaluated) == rows_of(L.pruned_search(terms, plain, k, size)[1])


def test_scores_below_the_bound_leave_no_task(spark):
    docs, asked = corpus(spark, 200)
    terms = L.query_terms(asked, "id", "title")
    rows = S.counted(docs, wanted=terms)
    weighing = S.bm25_weighing(rows)
    posed = S.questions(terms, weighing)
    bounds, essential = S._essential(rows, posed, weighing, 3, 50, 7)
    left = S._answers(rows, posed, weighing, 3, (bounds, essential), 7)[0].toArrow()
    assert (bounds > 0).all() and (left["score"].to_numpy() >= bounds[left["no"].to_numpy()] - 2e-5).all()
    assert len(left) < len(S._answers(rows, posed, weighing, 3, None, 7)[0].toArrow())


def test_few_holding(spark):
    docs = spark.createDataFrame([(k, "a b" if k == 7 else "a") for k in range(40)], "doc_id long, text string")
    terms = spark.createDataFrame([("q", "a"), ("q", "b")], "qid string, term string")
    rows = S.counted(docs, wanted=terms)
    weighing = S.bm25_weighing(rows)
    (block,) = S._blocks(iter(rows.toArrow().to_batches()), weighing, np.ones(2, bool))
    assert block.few_holding([1]).tolist() == [7] and block.few_holding([]).tolist() == []
    assert block.few_holding([0]) is None and block.few_holding([0, 1]) is None


@pytest.mark.parametrize("name", ["eval_mrr", "eval_p_r_map_hit", "eval_recall_rr_ndcg"])
def test_only_evaluated_questions_are_searched(spark, alike, tmp_path, name):
    """400 questions of which 8 have a relevant document: the rest takes no part, and the figures are those of the whole run."""
    meta = spark.read.parquet(f"{alike}/document_metadata.parquet")
    meta.withColumn("so_hieu", F.when(F.col("id") % 1000 == 0, F.col("so_hieu")).otherwise("none")).write.parquet(f"{tmp_path}/document_metadata.parquet")
    spark.read.parquet(f"{alike}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled(spark)
    got = queries()[name](spark, str(tmp_path)).first()
    assert shuffled(spark) - before < 4_000
    measure = {"eval_mrr": E.reciprocal_ranks, "eval_p_r_map_hit": E.set_metrics, "eval_recall_rr_ndcg": E.ranking_metrics}[name]
    assert got == E.macro(measure(queries()["bm25_wand"](spark, str(tmp_path)), queries()["eval_qrels"](spark, str(tmp_path)))).first()
    assert got["n_queries"] == 8


def test_no_question_evaluated(spark, alike, tmp_path):
    spark.read.parquet(f"{alike}/document_metadata.parquet").write.parquet(f"{tmp_path}/document_metadata.parquet")
    spark.read.parquet(f"{alike}/documents.parquet").withColumn("so_hieu", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries()["eval_mrr"](spark, str(tmp_path)).first().asDict() == {"n_queries": 0, "rr": None}
