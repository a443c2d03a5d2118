import random

import numpy as np
from pyspark.sql import functions as F

from docweave.operators import evaluation as E
from docweave.operators import lexical as L
from docweave.operators import vector as V


def corpus(spark, n=60, seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(25)]
    rows = [(k, " ".join(rng.choices(words, weights=range(1, 26), k=rng.randint(0, 30)))) for k in range(n)] + [(n, None), (n + 1, "")]
    asked = [(k, " ".join(rng.choices([*words, "unknown"], k=4))) for k in range(15)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "id long, title string")


def test_pruned_search_is_exact(spark):
    docs, asked = corpus(spark)
    index, terms = L.bm25_index(docs), L.query_terms(asked, "id", "title")
    full = {tuple(r) for r in L.search(terms, index.postings, 5).collect()}
    for size in (1, 3, 50):
        pruned, evaluated = L.pruned_search(terms, index.postings, 5, size)
        assert {tuple(r) for r in pruned.collect()} == full
        assert all(r["n_evaluated"] <= 60 for r in evaluated.collect())


def test_index_edges(spark):
    empty = L.bm25_index(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.postings.count() == 0 and empty.docs.count() == 0
    docs = spark.createDataFrame([(1, "a a b"), (2, None)], "doc_id long, text string")
    row = L.totals(docs, "doc_id", "text").first()
    assert (row["n_docs"], row["avgdl"]) == (2, 1.5)


def test_index_round_trip(spark, tmp_path):
    docs, asked = corpus(spark)
    L.bm25_index(docs).save(str(tmp_path / "i"))
    again = L.Index.load(spark, str(tmp_path / "i"))
    terms = L.query_terms(asked, "id", "title")
    assert {tuple(r) for r in L.search(terms, again.postings, 3).collect()} == {tuple(r) for r in L.search(terms, L.bm25_index(docs).postings, 3).collect()}


def test_forward_ranks_zeros_last(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a c")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "a"), (8, "zz")], "id long, title string")
    tf = L.term_frequencies(docs, "doc_id", "text")
    idf = L.tfidf_idf(tf, docs.selectExpr("count(*) as n_docs"))
    weights = L.tfidf_weights(tf, idf)
    vectors, norms = L.query_vectors(asked, "id", "title", idf), L.norms(weights)
    got = {(r["qid"], r["rank"]): r["doc_id"] for r in L.forward_search(asked, "id", vectors, weights, norms, docs, 3).collect()}
    assert got == {(9, 1): 1, (9, 2): 4, (9, 3): 2, (8, 1): 1, (8, 2): 2, (8, 3): 3}
    positive = {tuple(r) for r in L.inverted_search(vectors, weights, norms, 3).collect()}
    assert {(r[0], r[1]) for r in positive} == {(9, 1), (9, 4)}


def vectors(spark, n=80, size=4):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=size).round(2)], "a" if k % 3 else "b") for k in range(n)] + [(900, [0.0] * size, "a"), (901, None, "a"), (902, [1.0], "a"), (903, [float("nan")] * size, "a")]
    return spark.createDataFrame(rows, "id long, v array<float>, kind string")


def test_blocks_and_broadcast_agree(spark, monkeypatch):
    rows = vectors(spark)
    asked = rows.where("id % 5 = 0").selectExpr("id as qid", "v as qv")
    for metric in V.METRICS:
        options = dict(k=4, metric=metric, where={"kind": ["a"]}, threshold=5.0)
        small = {tuple(r) for r in V.nearest(asked, rows, "qid", "qv", "id", "v", 4, **options).collect()}
        with monkeypatch.context() as m:
            m.setattr(V, "BROADCAST_QUERIES", 3)
            m.setattr(V, "BLOCK", 7)
            assert {tuple(r) for r in V.nearest(asked, rows, "qid", "qv", "id", "v", 4, **options).collect()} == small
        assert small and all(r[1] not in (901, 902, 903) for r in small)
    cosine = V.nearest(asked, rows, "qid", "qv", "id", "v", 4, k=200).collect()
    assert all(r["id"] != 900 for r in cosine)


def test_descendants_are_dropped(spark):
    cases = {1: (["law.art_1", "law.art_1.clause_1"], ["law.art_1"]), 2: (["law.art_2", "law.art_2.clause_1.point_a"], ["law.art_2"]), 3: (["law.art_3__dup_0", "law.art_3.clause_1"], ["law.art_3__dup_0"]),
             4: (["law.art_4.clause_1", "law.art_5.clause_1"], ["law.art_4.clause_1", "law.art_5.clause_1"]), 5: (["doc_1.sec_1", "doc_1.sec_1.sub_1", "doc_1.sec_2.sub_2", "doc_1.sec_2.sub_2.p_a"], ["doc_1.sec_1", "doc_1.sec_2.sub_2"])}
    rows = spark.createDataFrame([(q, c) for q, (given, _) in cases.items() for c in given], "q int, chunk string")
    kept = V.without_descendants(rows, "chunk", ["q"])
    assert {tuple(r) for r in kept.collect()} == {(q, c) for q, (_, want) in cases.items() for c in want}
    assert {tuple(r) for r in V.without_descendants(kept, "chunk", ["q"]).collect()} == {tuple(r) for r in kept.collect()}


def test_store(spark):
    store = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    changes = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    from pyspark.sql import functions as F

    once = V.upsert(store, changes, "k", [F.desc("v")])
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 3), ("c", 1)}
    assert {tuple(r) for r in V.upsert(once, changes, "k", [F.desc("v")]).collect()} == {tuple(r) for r in once.collect()}
    assert {tuple(r) for r in V.merge_shards(store, [changes.where("v = 2"), changes], "k").collect()} == {("a", 1), ("b", 1), ("c", 1)}


def test_encoder(spark):
    rows = spark.createDataFrame([("điều một",), ("",), (None,)], "t string")
    got = [r["vector"] for r in V.embed(rows, "t", V.hashing_encoder(8), 8).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-5 and got[1] == got[2] == [0.0] * 8


def test_ranking_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1), (4, 1, 1)], "qid long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 11), (1, 11), (1, 12), (1, 99), (2, 21), (3, 5)], "qid long, doc_id long")
    rows = {r["qid"]: r for r in E.set_metrics(run, qrels, (1, 2, 20)).collect()}
    assert set(rows) == {1, 2, 3} and rows[1]["precision_2"] == 0.5 and abs(rows[1]["recall_20"] - 2 / 3) < 1e-12 and abs(rows[1]["ap_20"] - (1 / 2 + 2 / 3) / 3) < 1e-12 and rows[3]["hit_20"] == 0
    ranked = {r["qid"]: r for r in E.ranking_metrics(run, qrels, (1, 5)).collect()}
    ideal = 1 + 1 / np.log2(3) + 1 / np.log2(4)
    assert ranked[1]["rr_5"] == 0.5 and abs(ranked[1]["ndcg_5"] - (1 / np.log2(3) + 1 / np.log2(4)) / ideal) < 1e-12 and ranked[2]["recall_5"] == 0
    per = E.set_metrics(run, qrels, (1, 2, 3, 20)).collect()
    assert all(r["recall_1"] <= r["recall_2"] <= r["recall_3"] <= r["recall_20"] for r in per)


def test_store_rows_and_scores(spark):
    import pytest

    rows = spark.createDataFrame([("a", 3, "x", [1.0], '{"k": 1}'), ("b", 2, "x", [1.0], None), ("c", 5, "x", [1.0], '{"chunk_index": 9}'), ("d", None, "x", [1.0], "{ }")], "chunk_id string, chunk_index int, text string, vector array<float>, metadata string")
    got = {r["chunk_id"]: r["metadata"] for r in V.chunk_rows(rows).collect()}
    assert got == {"a": '{"k": 1, "chunk_index": 3}', "b": '{"chunk_index": 2}', "c": '{"chunk_index": 9}', "d": "{ }"}
    with pytest.raises(Exception, match="no chunk_id"):
        V.chunk_rows(rows.withColumn("chunk_id", F.lit(" "))).collect()
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x")], "qid int, text string")
    results = spark.createDataFrame([(1, "x", 0.2, 1), (1, "x", 0.7, 2)], "qid int, text string, score double, n int")
    assert sorted((r["text"], r["score"]) for r in V.scored_by_text(pairs, results, [F.desc("n")]).collect()) == [("x", 0.7), ("x", 0.7), ("y", 0.0)]
    candidates = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (1, 2, 12)], "qid int, index int, id int")
    told = spark.createDataFrame([(1, 2, 0.9), (1, 0, 0.1), (1, 7, 5.0), (1, -1, 5.0)], "qid int, index int, score double")
    assert [(r["id"], r["rank"]) for r in V.scored_by_index(candidates, told, 5).orderBy("rank").collect()] == [(12, 1), (10, 2)]
