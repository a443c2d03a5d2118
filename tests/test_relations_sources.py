import json

import pytest
from pyspark.sql import functions as F

from docweave.operators import agent as A
from docweave.operators import relations as R
from docweave.sources import readers, writers


def test_relations(spark):
    stored = spark.createDataFrame([("a", "b", "can_cu"), (None, "b", "can_cu")], "entity_start string, entity_end string, relation_type string")
    new = spark.createDataFrame([("a", "b", "can_cu"), (None, "b", "can_cu"), ("c", None, "bai_bo"), ("c", None, "bai_bo")], stored.schema)
    once = R.save_relations(stored, new)
    assert once.count() == 3 and R.save_relations(once, new).count() == 3
    assert R.delete_triple(once, None, "b", "can_cu").count() == 2
    assert {r["relation_type"]: r["n"] for r in R.zero_filled(once, "relation_type", R.RELATION_TYPES).collect()}["thay_the"] == 0


def test_folders(spark):
    rows = spark.createDataFrame([("nghi_dinh",), ("Thông tư",), ("2. thong_tu 2020",), ("",), ("luat",)], "n string")
    assert [r["k"] for r in rows.select(R.folder_type(F.col("n")).alias("k")).collect()] == ["nghi_dinh", "other", "thong_tu", "other", "luat"]
    docs = spark.createDataFrame([("d1", "nghi_dinh"), ("d2", "other"), ("l1", "luat"), ("l2", "luat")], "so_hieu string, folder string")
    sides = R.build_relations(docs)
    pairs = R.expanded(sides, docs)
    assert {tuple(r) for r in pairs.select("entity_start", "entity_end", "relation_type").collect()} == {("d1", "l1", "huong_dan_thi_hanh"), ("d1", "l2", "huong_dan_thi_hanh")}


def test_replace(spark):
    docs = spark.createDataFrame([("old", 1, 1), ("other", 1, None)], "so_hieu string, created_at int, trang_thai int")
    new = spark.createDataFrame([("new", 2, 1)], docs.schema)
    edges = spark.createDataFrame([("new", "old")], "new_so_hieu string, so_hieu string")
    none = spark.createDataFrame([], "entity_start string, entity_end string, relation_type string")
    after, chunks, relations = R.replace_document(docs, spark.createDataFrame([("old", "c1"), ("other", "c2")], "so_hieu string, chunk string"), none, new, edges)
    assert {(r["so_hieu"], r["trang_thai"]) for r in after.collect()} == {("old", 0), ("other", 1), ("new", 1)}
    assert {(r["chunk"], r["trang_thai"]) for r in chunks.collect()} == {("c1", 0), ("c2", 1)}
    assert [tuple(r) for r in relations.collect()] == [("new", "old", "thay_the")]


def test_readers(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"_id": "1", "title": "t", "text": "x"}\n\n{"doc_id": "2", "content": "y"}\n{"id": "3", "tokens": ["a", " ", "b"]}\n', encoding="utf-8")
    rows = readers.corpus(spark, str(path), strict=False).collect()
    assert [(r["doc_id"], r["title"], r["content"]) for r in rows] == [("1", "t", "x"), ("2", None, "y"), (None, None, None)]
    with pytest.raises(Exception, match="has no id"):
        readers.corpus(spark, str(path)).collect()
    assert readers.tokenized_corpus(spark, str(path)).where("doc_id = '3'").first()["tokens"] == ["a", "b"]
    asked = tmp_path / "q.jsonl"
    asked.write_text('{"query-id": "q1", "corpus-id": "1"}\n{"qid": "q1", "doc_id": "1"}\n{"_id": "q2", "corpusId": "2", "text": "hỏi"}\n', encoding="utf-8")
    assert {tuple(r) for r in readers.qrels(spark, str(asked)).collect()} == {("q1", "1"), ("q2", "2")}
    assert {r["qid"]: r["text"] for r in readers.qrels(spark, str(asked), readers.queries(spark, str(asked)).where("text is not null")).collect()} == {"q1": "", "q2": "hỏi"}
    names = tmp_path / "n.csv"
    names.write_text("co_quan,count\n Bộ A ,12\nBộ B,x\n", encoding="utf-8")
    assert [tuple(r) for r in readers.counted_names(spark, str(names)).collect()] == [("bộ a", 12)]
    parts = [readers.share(spark.range(100), "id", 3, k) for k in range(3)]
    assert sum(p.count() for p in parts) == 100


def test_files_and_writers(spark, tmp_path):
    (tmp_path / "thong_tu").mkdir()
    (tmp_path / "thong_tu" / "a.txt").write_text("văn bản", encoding="utf-8")
    (tmp_path / "thong_tu" / "b.pdf").write_bytes(b"%PDF")
    rows = {r["path"][-5:]: r for r in readers.files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["text"] == "văn bản" and rows["a.txt"]["kind"] == "thong_tu" and rows["b.pdf"]["error"] == "no reader for .pdf"
    out = writers.new_version(spark.range(3), str(tmp_path / "store"), 1)
    assert spark.read.parquet(out).count() == 3
    nodes = spark.createDataFrame([("d", k, f"n{k}") for k in range(5)], "so_hieu string, position int, id string")
    writers.chunk_export(nodes, spark.createDataFrame([("d", "tên")], "so_hieu string, ten string"), str(tmp_path / "x"), most=2)
    lines = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "x")).collect()]
    assert sorted(len(x["chunks"]) for x in lines) == [1, 2, 2] and lines[0]["metadata"]["ten"] == "tên"


def test_agent(spark):
    good = '```json\n{"sub_questions": [{"query": "12/2021", "intent": "legal_query"}, {"query": "chào", "intent": "chitchat"}]}\n```'
    rows = spark.createDataFrame([(1, "hỏi", good), (2, "hỏng", "không"), (3, "lạ", '{"sub_questions": [{"query": "x", "intent": "??"}]}')], "qid int, question string, answer string")
    subs = A.analysed(rows, F.col("answer"))
    assert {tuple(r) for r in subs.collect()} == {(1, 0, "12/2021", "legal_query"), (1, 1, "chào", "chitchat"), (2, 0, "hỏng", "chitchat"), (3, 0, "lạ", "chitchat")}
    legal = lambda part: part.select("qid", "sub", F.lit("d.dieu_1").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit("nội dung").alias("text"))
    contexts = A.merged(subs, A.routed(subs, {"legal_query": legal}))
    told = {(r["qid"], r["sub"]): r["context"] for r in contexts.collect()}
    assert told[1, 0] == "[1] d\nnội dung" and told[2, 0] == A.NOTHING
    assert {r["qid"]: r["answer"] for r in A.answered(contexts).collect()}[1] == f"12/2021\n[1] d\nnội dung\n\nchào\n{A.NOTHING}"


def test_streaming(spark, tmp_path):
    from docweave.streaming.ingest import content_stream, ingest

    spark.createDataFrame([(1, "<p>Điều 1. A</p><p>1. x</p>"), (2, None)], "id long, content_html string").write.parquet(str(tmp_path / "in"))
    ingest(content_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    ids = {r["id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert ids == {"1.dieu_1", "1.dieu_1.khoan_1"}


def test_find_documents_scores_all_names(spark, monkeypatch):
    """Against brute force, over names of short and unaccented words and more than 200 that share the commonest ones."""
    import difflib
    import random

    from docweave.functions.text import fold

    monkeypatch.setattr(R, "NAMES_A_TASK", 150)
    rng = random.Random(3)
    words = "luật về tài sản công của bộ y tế xã hồ sơ đê thu phí quỹ đất rừng".split()
    docs = [(f"{k % 380}_x", " ".join(rng.choices(words, k=rng.randint(3, 7))).title()) for k in range(400)] + [("z_1", "Luật Quản lý hồ sơ và tài sản công"), ("z_2", "Y tế xã"), (None, "Y tế xã"), ("z_3", None), ("z_4", "--")]
    asked = [("a", "luat quan ly ho so va tai san cong"), ("b", "y te xa"), ("c", "thu phí quỹ đất"), ("d", "BO Y TE"), ("e", "qqqq"), ("f", "y tế xã"), ("g", "")]
    got = R.find_documents(spark.createDataFrame(docs, "so_hieu string, ten_van_ban string"), spark.createDataFrame([*((q, None, n) for q, n in asked), ("n", "Z/2", None)], "qid string, number string, name string")).collect()
    want = {("n", "z_2", 1.0)}
    for q, n in asked:
        best: dict = {}
        for number, name in docs:
            if number and name and fold(n) and fold(name) and (score := round(difflib.SequenceMatcher(None, fold(n), fold(name)).ratio(), 6)) >= 0.5:
                best[number] = max(score, best.get(number, 0))
        want |= {(q, number, score) for number, score in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ("a", "z_1", 1.0) in want and ("b", "z_2", 1.0) in want


def test_search_name_of_many_texts(spark):
    """Against brute force, without a nested loop for texts that have a piece to join on."""
    import random

    rng = random.Random(4)
    words = "Luật về Tài sản công của Bộ Y tế 50% a_b".split()
    docs = [(None if k == 7 else f"{k % 90}_x", " ".join(rng.choices(words, k=rng.randint(1, 6)))) for k in range(120)] + [("n_1", None), ("n_2", "")]
    asked = [(k, n) for k, (_, n) in enumerate(docs[::4])] + [(90, "TÀI SẢN"), (91, "y"), (92, "50%"), (93, "không có tên này"), (94, None), (90, "y tế")]
    found = R.search_name(spark.createDataFrame(docs, "so_hieu string, ten_van_ban string"), spark.createDataFrame(asked, "qid int, name string"), 10)
    want: dict = {}
    for q, n in asked:
        for number, name in docs:
            if n is not None and name is not None and n.lower() in name.lower():
                want.setdefault(q, set()).add(number)
    want = {(q, number) for q, numbers in want.items() for number in sorted(numbers, key=lambda x: (x is not None, x or ""))[:10]}
    assert {tuple(r) for r in found.collect()} == want


def test_searches_ask_every_twentieth_row(spark, tmp_path):
    from docweave.plans.relational_queries import QUERIES

    rows = [(k, f"{k}_x", f"Quy định thứ {chr(97 + k % 26)}{k}") for k in range(1, 101)]
    spark.createDataFrame(rows, "id long, so_hieu string, ten_van_ban string").write.parquet(str(tmp_path / "document_metadata.parquet"))
    for name in ("name_search_titles", "number_search", "metadata_fuzzy_search"):
        got = {(r["qid"], r["so_hieu"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert {(k, f"{k}_x") for k in (20, 40, 60, 80, 100)} <= got


def test_branches(spark):
    documents = spark.createDataFrame([("1_2020_l", "Luật Thủy lợi"), ("2_2021_nđ", "Nghị định về đê điều"), ("3_2022_l", "Chương trình khuyến công")], "so_hieu string, ten_van_ban string")
    nodes = spark.createDataFrame([("1_2020_l.dieu_2", "1_2020_l", "kênh mương nội đồng"), ("1_2020_l.dieu_1", "1_2020_l", "phạm vi kênh"), ("2_2021_nđ.dieu_1", "2_2021_nđ", "đê")], "chunk_id string, so_hieu string, text string")
    relations = spark.createDataFrame([("2_2021_nđ", "1_2020_l", "huong_dan_thi_hanh"), ("3_2022_l", "2_2021_nđ", "lien_quan")], "entity_start string, entity_end string, relation_type string")
    subs = spark.createDataFrame([(1, 0, "kênh mương theo 1/2020/L"), (1, 1, "Điều 1 của 1/2020/L"), (2, 0, "luat thuy loi"), (3, 0, "không có")], "qid int, sub int, query string")
    found = {}
    for r in A.legal_branch(nodes, documents)(subs).orderBy("qid", "sub", F.desc("score")).collect():
        found.setdefault((r["qid"], r["sub"]), []).append(r["chunk_id"])
    assert found == {(1, 0): ["1_2020_l.dieu_2", "1_2020_l.dieu_1"], (1, 1): ["1_2020_l.dieu_1"], (2, 0): ["1_2020_l.dieu_1", "1_2020_l.dieu_2"]}
    lines = {(r["qid"], r["text"]) for r in A.relation_branch(documents, relations)(subs.where("qid = 2")).collect()}
    assert lines == {(2, "<- [huong_dan_thi_hanh] 2_2021_nđ (Nghị định về đê điều)")}
    search = lambda asked: asked.select("qid", F.lit("c").alias("chunk_id"), F.lit(1.0).alias("score"), F.col("query").alias("text"))
    assert {tuple(r) for r in A.general_branch(search)(subs).collect()} == {(q, s, "c", 1.0, t) for q, s, t in subs.collect()}
