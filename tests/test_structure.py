from pyspark.sql import functions as F

from docweave.operators import citations as C
from docweave.operators import metadata as M
from docweave.operators import references as N
from docweave.operators import structure as S

LAW = """QUỐC HỘI
Căn cứ Hiến pháp
Phần thứ nhất
QUY ĐỊNH CHUNG
Chương I
PHẠM VI
Điều 1. Phạm vi
Luật này quy định về Điều 2.
Điều 2. Đối tượng
1. Cá nhân
a) Người dân;
i) Khác
2. Tổ chức
tiếp theo
Chương 2
Mục 1. CHUNG
Điều 3. Hiệu lực
Điều 3. Hiệu lực
Nơi nhận:
như trên
PHỤ LỤC
Biểu mẫu
"""


def test_tree():
    rows = {r["id"]: r for r in S.parse("1_2020_l", LAW)}
    assert list(rows) == [
        "1_2020_l.modau_1", "1_2020_l.phan_1", "1_2020_l.phan_1.chuong_i", "1_2020_l.phan_1.chuong_i.dieu_1", "1_2020_l.phan_1.chuong_i.dieu_2", "1_2020_l.phan_1.chuong_i.dieu_2.khoan_1",
        "1_2020_l.phan_1.chuong_i.dieu_2.khoan_1.diem_a", "1_2020_l.phan_1.chuong_i.dieu_2.khoan_1.diem_i", "1_2020_l.phan_1.chuong_i.dieu_2.khoan_2", "1_2020_l.phan_1.chuong_2", "1_2020_l.phan_1.chuong_2.muc_1",
        "1_2020_l.phan_1.chuong_2.muc_1.dieu_3__dup_0", "1_2020_l.phan_1.chuong_2.muc_1.dieu_3__dup_1", "1_2020_l.phu_luc_1",
    ]
    assert rows["1_2020_l.phan_1"]["title"] == "Phần thứ nhất : QUY ĐỊNH CHUNG"
    assert rows["1_2020_l.phan_1.chuong_i.dieu_2.khoan_2"]["content"] == "2. Tổ chức. tiếp theo"
    assert rows["1_2020_l.phan_1.chuong_i.dieu_2.khoan_1"]["full_text"] == "1. Cá nhân. a) Người dân;. i) Khác"
    assert rows["1_2020_l.phan_1.chuong_i.dieu_2.khoan_1"]["parent_context"].split("\n") == ["Phần thứ nhất : QUY ĐỊNH CHUNG", "Chương I : PHẠM VI", "Điều 2. Đối tượng"]
    assert rows["1_2020_l.phu_luc_1"]["content"] == "Biểu mẫu"
    assert S.parse("d", "") == [] and S.parse("d", None) == []


def test_clause_marks_are_locked():
    rows = S.parse("d", "Điều 1. A\nKhoản 1. x\n2. y\nKhoản 2. z")
    assert [(r["id"], r["content"]) for r in rows[1:]] == [("d.dieu_1.khoan_1", "Khoản 1. x. 2. y"), ("d.dieu_1.khoan_2", "Khoản 2. z")]


def test_headings_agree_with_expressions(spark):
    lines = ["Phần thứ hai", "PHẦN IV", "Chương XII. X", "Mục 3", "Điều 5a.", "Khoản 1", "1.2.3 x", "1.2 x", "1. x", "a) x", "IV. x", "Phụ lục", "Nơi nhận:", "thường", "Điều kiện", "đ) x"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    kind, index = S.heading_columns(F.col("line"))
    for r in rows.select("line", kind.alias("k"), index.alias("i")).collect():
        want = S.heading(r["line"])
        assert (r["k"] is None) == (want is None) and (want is None or r["k"] == want[0]), r


def test_pieces(spark):
    assert S.pack_sentences("a b. c d. e f", 4) == ["a b. c d", "e f"]
    rows = spark.createDataFrame([("x" * 2500,), ("",), ("ab",)], "t string")
    got = [r["w"] for r in rows.select(S.windows(F.col("t")).alias("w")).collect()]
    assert [len(p["piece"]) for p in got[0]] == [1200, 1200, 500] and got[1] == [] and [p["piece"] for p in got[2]] == ["ab"]
    long = spark.createDataFrame([(" ".join(map(str, range(25))),)], "t string").select(S.word_windows(F.col("t"), 20, 10, 2).alias("w")).first()["w"]
    assert [p.split()[0] for p in long] == ["0", "8", "16"] and long[-1].split()[-1] == "24"


def test_references():
    f = N.find_references
    assert f("Khoản 1 Điều 31 Luật số 28/2023/QH15 về tài nguyên nước") == ["28_2023_qh15.dieu_31.khoan_1"]
    assert f("Theo Điều 100 Luật Đất đai, mọi người") == ["luat_dat_dai.dieu_100"]
    own = {"luat": "1_2020_l", "dieu": "1_2020_l.dieu_1", "khoan": "1_2020_l.dieu_1.khoan_2"}
    assert f("điểm a, b khoản 2 Điều 5 của Luật này", own) == ["1_2020_l.dieu_5.khoan_2.diem_a", "1_2020_l.dieu_5.khoan_2.diem_b"]
    assert f("theo khoản 3 và khoản này", own) == ["1_2020_l.dieu_1.khoan_3"]
    assert f("từ Điều 7 đến Điều 9", own)[:3] == ["1_2020_l.dieu_7", "1_2020_l.dieu_8", "1_2020_l.dieu_9"]
    assert f("một phần này", {**own, "phan": "1_2020_l.phan_1"}) == [] and f(None) == [] and f("") == []
    assert f("Mục 2 Chương IV và từ khoản 2 đến khoản 4 Điều 9 của Nghị định số 5/2019/NĐ-CP") == [f"5_2019_nd-cp.{x}" for x in ("chuong_iv.muc_2", "chuong_iv", "dieu_9.khoan_2", "dieu_9.khoan_3", "dieu_9.khoan_4")]
    assert f("Luật Đất đai quy định. Điều 3 thì khác") == ["luat_dat_dai_quy_dinh.dieu_3"] and f("theo Luật Thủy lợi năm 2017 của nước ta, khoản 1 Điều 8") == ["luat_thuy_loi_2017.dieu_8.khoan_1"]
    assert f("điểm này và điểm đi", {**own, "diem": "1_2020_l.dieu_1.diem_c"}) == ["1_2020_l.dieu_1.diem_c"]
    assert f("Khoản 1. " + "x " * 200 + "Điều 4") == ["dieu_4"]  # more than 300 characters before
    assert N.listed("khoan", "các khoản 1, 2 và 3") == ["1", "2", "3"]


def test_reference_choice(spark):
    store = spark.createDataFrame([("law.dieu_1",), ("law.dieu_2",), ("law.dieu_3",), ("law.dieu_5",), ("law.dieu_5.khoan_1",)], "id string")
    main = spark.createDataFrame([("law.dieu_5", ["law.dieu_1", "law.dieu_2", "law.dieu_3", "law.dieu_99", "law.dieu_5.khoan_1", " law.dieu_1 "])], "id string, reference array<string>")
    refs = C.stored_references(main, store)
    assert {r["ref"] for r in refs.collect()} == {"law.dieu_1", "law.dieu_2", "law.dieu_3"}
    score = F.when(F.col("ref") == "law.dieu_1", 9.0).when(F.col("ref") == "law.dieu_2", 4.0).otherwise(7.5)
    assert [r["ref"] for r in C.chosen_references(refs.withColumn("score", score), most=2).orderBy("rank").collect()] == ["law.dieu_1", "law.dieu_3"]
    assert C.chosen_references(refs.withColumn("score", F.lit(None).cast("double"))).count() == 0


def test_relevance(spark):
    chunks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "qid int, chunk_id string")
    verdicts = spark.createDataFrame([(1, "a", True)], "qid int, chunk_id string, relevant boolean")
    assert {tuple(r) for r in C.relevant(chunks, verdicts).collect()} == {(1, "a"), (2, "c")}


HEADS = (
    (1, "QUỐC HỘI\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nLuật số: 12/2021/QH15\nLUẬT\nTÀI SẢN CÔNG\nCăn cứ Hiến pháp;\nĐiều 1. Phạm vi\nĐiều 2. Hiệu lực thi hành\nLuật này có hiệu lực thi hành từ ngày 1 tháng 7 năm 2022.\nLuật này được thông qua ngày 5 tháng 11 năm 2021."),
    (2, "BỘ Y TẾ\nSố: 5/2018/TT-BYT\nHà Nội, ngày 3 tháng 2 năm 2018\nTHÔNG TƯ\nQuy định về kho dược liệu\nĐiều 1. Phạm vi\n1. Kho.\nĐiều 2. Tổ chức thực hiện\nThông tư này có hiệu lực kể từ ngày ký."),
    (3, "Số 7/VBHN-VPQH\nBỘ LUẬT\nLAO TÁC\nPHẦN THỨ NHẤT\nĐiều 1. Chung"),
    (4, "không có gì ở đây"),
    (5, None),
)


def test_metadata(spark):
    rows = {r["id"]: r for r in M.extract(spark.createDataFrame(HEADS, "id int, text string"), "text").collect()}
    a, b, c, d, e = (rows[k] for k in range(1, 6))
    assert (a["loai"], a["so_hieu"], a["ten_van_ban"], a["co_quan_ban_hanh"], a["ngay_ban_hanh"], a["ngay_co_hieu_luc"], a["so_dieu"]) == ("luat", "12_2021_qh15", "LUẬT TÀI SẢN CÔNG", "Quốc Hội", "01/07/2022", "01/07/2022", 2)  # any word may stand for the place, so the first date wins
    assert (b["loai"], b["so_hieu"], b["co_quan_ban_hanh"], b["ngay_ban_hanh"], b["ngay_co_hieu_luc"]) == ("thong_tu", "5_2018_tt-byt", "Bộ Y Tế", "03/02/2018", "03/02/2018")
    assert (c["loai"], c["so_hieu"], c["ten_van_ban"]) == ("bo_luat", "7_vbhn-vpqh", "BỘ LUẬT LAO TÁC")
    assert (d["loai"], d["so_hieu"], d["so_dieu"]) == ("unknown", "", 0) and e["loai"] is None


def test_every_long_text_is_named(spark):
    rows = [(f"a.{k}", "từ " * (5 + k % 2), "a") for k in range(70)] + [("b.1", "một hai", "b"), ("c.1", " x  y\nz u v w ", "c"), ("n", "1 2 3 4 5 6", None)]
    got = S.too_long(spark.createDataFrame(rows, "id string, content string, doc string"), "content", "id", "doc", 5).collect()
    assert {tuple(r) for r in got} == {*(("a", f"a.{k}", 6, 35) for k in range(1, 70, 2)), ("c", "c.1", 6, 1), (None, "n", 6, 1)} and len(got) == 37


def test_nearest_places(spark):
    import random

    rng = random.Random(2)
    asked = [(k % 5, rng.randint(0, 300)) for k in range(200)]
    places = sorted({(k % 4, rng.randint(0, 300)) for k in range(40)})
    got = N.nearest_places(spark.createDataFrame(asked, "doc int, at int"), spark.createDataFrame(places, "doc int, place int"), "doc").collect()
    want = [(d, at, min((abs(p - at), p) for e, p in places if e == d)[1] if d < 4 else None) for d, at in asked]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    row = spark.createDataFrame([("Luật A, luật b; LUẬT",), ("không",), ("",), (None,)], "t string")
    assert [r["p"] for r in row.select(N.positions(F.col("t"), "luật").alias("p")).collect()] == [[0, 8, 16], [], [], None]


def test_recursive_pieces(spark):
    import random

    import pytest

    rng = random.Random(4)
    text = "".join(rng.choice(("một ", "hai, ", "ba. ", "bốn\n", "năm\n\n", "sáu; ", "x" * 30 + " ")) for _ in range(400))
    pieces = S.recursive_pieces(text, 100, 20)
    assert max(map(len, pieces)) <= 100 and "".join(text.split()) in "".join("".join(S.recursive_pieces(text, 100, 0)).split())
    at = 0
    for p in pieces:  # in order, each beginning no later than where the one before ended
        found = text.index(p, max(0, at - 25 - len(p)))
        at = found + len(p)
    assert S.recursive_pieces("a" * 25, 10, 3) == ["a" * 10, "a" * 10, "a" * 10, "aaaa"] and S.recursive_pieces("  ", 10, 3) == [] and S.recursive_pieces("", 10, 0) == []
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError, match="size"):
            S.recursive_pieces("a", size, overlap)
    rows = spark.createDataFrame([(1, "câu một. câu hai"), (2, None), (3, " ")], "id long, t string")
    assert [(r["id"], r["content"]) for r in S.chunked(rows, "id", "t", " Fixed_Size ", size=10, overlap=0).orderBy("id").collect()] == [("1.chunk_0", "câu một"), ("1.chunk_1", ". câu hai")]
    with pytest.raises(ValueError, match="strategy"):
        S.chunked(rows, "id", "t", "other")
