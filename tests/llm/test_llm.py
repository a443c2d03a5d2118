"""The llm operators against brute force, round trips and their defined cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import canonical, confusables, markup, mixture, packing, reading, similar, splitting

# ---- 1 -------------------------------------------------------------------------------------------------------------------------------

LIST = [
    (1, "co_quan_ban_hanh", "Bộ Thủy lợi và Hải đảo", "BTLHĐ", "Bộ Thủy nông"), (2, "co_quan_ban_hanh", "Ủy ban nhân dân tỉnh Lam Khê", "UBND-LK", None), (3, "co_quan_ban_hanh", "Hội đồng nhân dân tỉnh Lam Khê", "HĐND-LK", None),
    (4, "loai", "Thông tư", "TT", None), (5, "loai", "Luật", "L", None),
]
REFERENCE = "ref_id long, field string, ref_name string, short_code string, former_name string"


def test_distance_is_a_metric():
    rng = random.Random(0)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(40)]
    d = {(a, b): canonical.distance(a, b) for a in words for b in words}
    assert canonical.distance("ca", "abc") == 2 and canonical.distance("ab", "ba") == 1
    for a, b, c in itertools.product(words[:15], repeat=3):
        assert d[a, c] <= d[a, b] + d[b, c] and d[a, b] == d[b, a] and (d[a, b] == 0) == (a == b)
    batch = canonical.Batch(words)
    for a in words:
        assert batch.distances(a, np.arange(len(words))).tolist() == [d[a, b] for b in words]


def test_tree_finds_all_within_their_thresholds():
    rng = random.Random(1)
    entries = [("".join(rng.choices("abcd", k=rng.randint(2, 9))), k, rng.randint(0, 3)) for k in range(60)]
    asked = ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(80)]
    found = canonical.BKTree(entries).within(asked)
    for a, hits in zip(asked, found, strict=True):
        assert sorted(hits) == sorted((ref, canonical.distance(w, a)) for w, ref, limit in entries if canonical.distance(w, a) <= limit)


@pytest.mark.parametrize("shard_entries", [20_000, 2])
def test_mapping(spark, shard_entries):
    b, l = "co_quan_ban_hanh", "loai"  # noqa: E741
    given = {
        (1, b, "Bộ Thủy lợi và Hải đảo"): [], (2, b, "BO THUY LOI & HAI DAO"): [1], (3, b, "b. thủy lợi, hải đảo"): [1], (4, b, "Thủy lợi - Hải đảo (Bộ)"): [1], (5, b, "btlhd"): [1], (6, b, "Bộ Thủy nông"): [1],
        (7, b, "UBND T. Lam Khê"): [2], (8, b, "Ủy ban nhân dân huyện Tân Lam Khê"): [-1], (9, b, "Sở Thủy lợi tỉnh Lam Khê"): [-1], (10, b, "Uy ban nhan dan tinh Lam Khe\nHội đồng nhân dân tỉnh Lam Khê"): [2, 3],
        (11, b, "Ủy bna nhân dân tỉnh Lam Kê"): [2], (12, b, "  "): [], (13, b, None): [], (14, b, "-"): [-1], (15, l, "thông ưt"): [4], (16, l, "TT (đã ký)"): [4], (17, l, "Luậtt"): [5], (18, l, "Biên bản"): [-1], (19, None, "x"): [],
        (20, b, "Hội\u2009đồng nh\u200bân dân tỉnh Lаm Khê"): [3],
    }
    values = spark.createDataFrame([*given, (2, b, "BO THUY LOI & HAI DAO")], "id long, field string, value string").withColumn("ref_id", F.lit(99))
    got: dict = {}
    for r in canonical.map_to_canonical(values, spark.createDataFrame(LIST, REFERENCE), shard_entries).collect():
        got.setdefault(r["id"], []).append(r["ref_id"])
    assert {k: sorted(v) for k, v in got.items()} == {k[0]: v for k, v in given.items() if v}


def test_long_values_reach_no_table(monkeypatch):
    tree = canonical.BKTree([("abcdef", 1, 1), ("uvw", 2, 1)])
    assert tree.within(["x" * 20_000, "abcdeg", "", "a" * 8]) == [[], [(1, 1)], [], []]
    monkeypatch.setattr(canonical, "TABLE_CELLS", 100)
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(50)]
    assert canonical.Batch(words).distances("abca", np.arange(50)).tolist() == [canonical.distance("abca", w) for w in words]
    assert canonical.distance("a" * 10, "a" * 12) == 2


def test_mapping_without_a_vocabulary(spark):
    values = spark.createDataFrame([(1, "loai", "Thông  tu"), (2, "loai", "TT"), (3, "co_quan_ban_hanh", "UBND tỉnh Lam Khê")], "id long, field string, value string")
    got = {r["id"]: r["ref_id"] for r in canonical.map_to_canonical(values, spark.createDataFrame(LIST, REFERENCE), known=canonical.NOTHING_KNOWN).collect()}
    assert got == {1: 4, 2: 4, 3: -1}


def test_mapping_to_nothing(spark):
    values = spark.createDataFrame([(1, "loai", "Luật")], "id long, field string, value string")
    empty = spark.createDataFrame([], REFERENCE)
    assert [r["ref_id"] for r in canonical.map_to_canonical(values, empty).collect()] == [-1]
    assert canonical.map_to_canonical(values.where("false"), spark.createDataFrame(LIST, REFERENCE)).count() == 0


# ---- 2 -------------------------------------------------------------------------------------------------------------------------------


def kinds(text):
    leaves = markup.segment(text)
    out: dict = {}
    for c in markup.label([leaves])[0] if leaves else []:
        if c:
            out[markup.CLASSES[c]] = out.get(markup.CLASSES[c], 0) + 1
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<h2 class='a'\n id=b>Một</h2><ul><li>a<li>b</ul><table><tr><th>x</th></tr><tr><td>1</td></tr></table><pre><code>&lt;li&gt;</code></pre><p><math><mi>T</mi></math></p>", {("html", "heading"): 1, ("html", "list_item"): 2, ("html", "table_row"): 2, ("html", "code_block"): 1, ("html", "formula"): 1}),
        ("&lt;h1&gt;Một&lt;/h1&gt;&lt;p&gt;hai&lt;/p&gt;", {("html", "heading"): 1}),
        ("<p>a</p><!-- <li>x</li> --><script>'<h2>'</script><p align=center><b>Chương I</b></p>", {}),
        ("# Một\n\n**đậm** và [nối](/a)\n\n- a\n- b\n\nHai\n====\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```sql\n# không\n```\n\n1. số\n\nCó $M = a$ và `$x$`.\n", {("markdown", "heading"): 2, ("markdown", "list_item"): 2, ("markdown", "table_row"): 2, ("markdown", "code_block"): 1, ("markdown", "formula"): 1}),
        ("== Một ==\n\n'''đậm''' [[a|b]]\n\n* a\n** b\n# c\n\n{| class=\"x\"\n! a !! b\n|-\n| 1\n| 2\n|}\n\n{{Hộp\n| số = 1\n}}\n<source lang=\"xml\">\n<li>\n</source>\n<math>a^2</math> <nowiki>== x ==</nowiki>", {("wiki", "heading"): 1, ("wiki", "list_item"): 3, ("wiki", "table_row"): 2, ("wiki", "code_block"): 1, ("wiki", "formula"): 1}),
        ("\\section{Một}\n% \\section{không}\n\\begin{itemize}\n  \\item a\n  \\item[(2)] b\n\\end{itemize}\n\\begin{tabular}{ll}\n\\hline\na & b \\\\\nc & d \\\\\n\\hline\n\\end{tabular}\n\\begin{verbatim}\n\\section{x}\n\\end{verbatim}\n\\begin{equation}\na\n\\end{equation}\nMức \\$5 -- \\$6.", {("latex", "heading"): 1, ("latex", "list_item"): 2, ("latex", "table_row"): 2, ("latex", "code_block"): 1, ("latex", "formula"): 1}),
        ("- Nơi nhận: A\n- Lưu: VT.\n1. một\nGiá 5 $ * 3 = 15 $.", {}),
        ("", {}), ("   \n", {}), ("<p", {}), ("<!-- nie", {}),
    ],
)
def test_elements(text, want):
    assert kinds(text) == want


def test_elements_of_a_table(spark):
    rows = spark.createDataFrame([(1, "<li>a<li>b", "x"), (1, "<li>a<li>b", "x"), (2, None, "y"), (3, " ", "z"), (None, "<li>", "w")], "id long, content_html string, markup string")
    assert {tuple(r) for r in markup.elements(rows).collect()} == {(1, "html", "list_item", 1), (1, "html", "list_item", 2)}
    assert markup.elements(rows.where("false")).count() == 0
    assert [tuple(r) for r in markup.clean_texts(rows).collect()] == [(1, "- a\n- b")]


def test_labeller_on_documents_of_known_structure():
    """Fresh generated documents: true labels, the network by itself and after the check of paths; every word of a leaf is read."""
    from docweave.llm import generate_markup, train_markup

    data = train_markup.training_set(400, seed=99)
    alone, whole, checked = train_markup.accuracy(markup.network().w, data)
    assert alone > 0.995 and checked > 0.995 and whole > 0.97 and train_markup.admission_only(data) < 0.97
    net = markup.network()
    flat = {**net.w, "out": net.w["out"].copy()}
    flat["out"][: 2 * net.h] = 0
    assert train_markup.accuracy(flat, data)[0] < 0.97  # the recurrent part decides
    text, truth = generate_markup.document(random.Random(3))
    assert truth and set(generate_markup.classes(markup.segment(text), truth)) <= set(range(len(markup.CLASSES)))
    a, b = (markup.vectors([markup.Leaf(0, ("line", "text"), "x " * 300 + last)]) for last in ("một", "hai"))
    assert (a != b).any()


def test_html_beside_latex():
    assert kinds("<h2>Một</h2>\n<ul><li>a</li></ul>\n\n\\section{Hai}\nCho $x = 1 + y$ thì") == {("html", "heading"): 1, ("html", "list_item"): 1, ("latex", "heading"): 1, ("latex", "formula"): 1}


# ---- 4 -------------------------------------------------------------------------------------------------------------------------------


def exact_pairs(rows, k, least):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = set()
    for a in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-s[a, j], ids[j]))[:k]
        out |= {(min(ids[a], ids[j]), max(ids[a], ids[j])) for j in order if s[a, j] >= least}
    return out


def test_similar_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    rows = {k: (centres[k % 60] + rng.normal(size=16) * 0.18).tolist() for k in range(400)}
    df = spark.createDataFrame(list(rows.items()), "emb_id long, vector array<float>")
    got = {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in similar.most_similar(df, "emb_id", "vector", 16, 5, 0.9).collect()}
    want = exact_pairs(rows, 5, 0.9)
    assert len(got & want) / len(want) > 0.95 and len(got - want) <= 0.02 * len(want)


@pytest.mark.parametrize("least", [-1.0, 0.3, 0.7])
def test_similar_below_the_tables(spark, monkeypatch, least):
    """Every record gets its k best, however far they are."""
    monkeypatch.setattr(similar, "MEET_LEAST", 60)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[250:280] = np.rint(x[250:280])  # some equal similarities
    x[280:] = x[:20] + rng.normal(size=(20, 16)) * 0.4
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)] + [(300, x[7].astype(np.float32).tolist())]
    u = np.array([v for _, v in rows], np.float32).astype(np.float64)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    cosine = np.round(u @ u.T, 12)
    want = {(i, j) for i in range(301) for j in sorted((j for j in range(301) if j != i and cosine[i, j] >= least), key=lambda j: (-cosine[i, j], j))[:5]}
    got = similar.most_similar(spark.createDataFrame(rows, "emb_id long, vector array<float>"), "emb_id", "vector", 16, 5, least).collect()
    assert {(r["id"], r["other"]) for r in got} == want and len(got) == len(want)
    assert all(abs(r["similarity"] - cosine[r["id"], r["other"]]) < 1e-9 for r in got)


def test_neighbours_are_five_each(spark, tmp_path):
    from docweave.llm.queries import p4_neighbours

    x = np.random.default_rng(7).normal(size=(40, 64))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "emb_id long, vector array<float>").write.parquet(str(tmp_path / "embedding_result.parquet"))
    assert {r["count"] for r in p4_neighbours(spark, str(tmp_path)).groupBy("id").count().collect()} == {5}


@pytest.mark.parametrize(("n_own", "n_probe", "block_rows"), [(30, 20, 7), (30, 2, 7), (3, 40, 7), (30, 20, 100), (0, 40, 7)])
def test_pairs_of_a_hot_bucket_come_once(spark, monkeypatch, n_own, n_probe, block_rows):
    monkeypatch.setattr(similar, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(8)
    rows = [(7, k >= n_own, k, 0.01, rng.integers(-100, 100, 4).astype(np.int8).tobytes()) for k in range(n_own + n_probe)] + [(8, False, 0, 0.01, bytes(4)), (9, True, 1, 0.01, bytes(4))]
    cells = similar._cells(spark.createDataFrame(rows, "bucket long, probe boolean, id long, scale float, code binary"))
    assert cells.groupBy("bucket", "block", "against").count().agg(F.max("count")).first()[0] <= 2 * block_rows + 8 + 30  # a hash deals unevenly
    sorted_cells = cells.coalesce(1).sortWithinPartitions("bucket", "block", "against", "role")
    rows = sorted_cells.toPandas()
    each = [similar._compare(iter([cell]), 4, 1000, -10.0) for _, cell in rows.groupby(["bucket", "block", "against"])]
    got = [(int(a), int(b)) for found in each for frame in found for a, b in zip(frame["a"], frame["b"], strict=True)]
    together = list(similar._compare(iter([rows.iloc[:11], rows.iloc[11:]]), 4, 1000, -10.0))
    assert {(a, b) for frame in together for a, b in zip(frame["a"], frame["b"], strict=True)} == set(got)
    own, probes = range(n_own), range(n_own, n_own + n_probe)
    want = [*itertools.combinations(own, 2), *itertools.product(own, probes)]
    assert sorted(got) == sorted(want)


def test_similar_cases(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_ROWS", 4)
    base = [[1.0, 0, 0, 0], [0.99, 0.1, 0, 0], [0, 1.0, 0, 0]]
    rows = [(k, base[0]) for k in range(9)] + [(20, base[1]), (21, base[2]), (22, [2.0, 0, 0, 0]), (30, [0.0] * 4), (31, [float("nan"), 1, 1, 1]), (32, None), (33, [1.0]), (34, [1.0, None, 0, 0]), (5, base[0]), (None, base[0])]
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], "t") for i, v in rows], "emb_id long, vector array<float>, id string")
    got = similar.most_similar(df, "emb_id", "vector", 4, 5, 0.9).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["rank"], r["other"]))
    assert [o for _, o in sorted(by[0])] == [1, 2, 3, 4, 5] and [o for _, o in sorted(by[22])] == [0, 1, 2, 3, 4] and len(by[20]) == 5 and 21 not in by and not {30, 31, 32, 33, 34} & set(by)
    assert similar.most_similar(df.where("false"), "emb_id", "vector", 4).count() == 0
    assert similar.most_similar(df.where("emb_id = 20"), "emb_id", "vector", 4).count() == 0


# ---- 5 -------------------------------------------------------------------------------------------------------------------------------


def test_skeletons():
    s = confusables.skeleton
    for a, b in (("Đường", "Ðườ\u200bng"), ("số　1", "ѕố 1"), ("ＡＢ", "АВ"), ("a\u00adb", "ab"), ("e\u0323\u0302", "ệ"), ("à", "а̀"), ("Ⅱ", "II"), ("x‑y", "x-y"), ("ո", "n")):
        assert s(a) == s(b), (a, b)
    for a, b in (("a", "A"), ("l", "1"), ("O", "0"), ("đ", "d"), ("a b", "a  b"), ("m²", "m2"), ("á", "a"), ("a.", "a")):
        assert s(a) != s(b), (a, b)
    assert s("\u200b\u2060") == "" and s(s("Ðа̀")) == s("Ðа̀")


def test_alike(spark, monkeypatch):
    rows = [(1, "Luật a"), (2, "Luật а"), (3, "Luật a"), (4, "luật a"), (5, None), (6, ""), (7, "\u200b"), (2, "Luật а"), (None, "Luật a")]
    df = spark.createDataFrame([(i, t, "z", "q") for i, t in rows], "id long, text string, class_id string, form string")
    assert {tuple(r) for r in confusables.alike_pairs(df, "id", "text").collect()} == {(1, 2), (2, 3), (6, 7)}
    classes = {r["id"]: r for r in confusables.printed_classes(df, "id", "text").collect()}
    assert classes[1]["class_id"] == classes[2]["class_id"] != classes[4]["class_id"] and classes[1]["n_forms"] == 2
    assert confusables.alike_pairs(df.where("false"), "id", "text").count() == 0
    monkeypatch.setattr(confusables, "ROWS_A_SLOT", 1)
    assert {tuple(r) for r in confusables.alike_pairs(df, "id", "text").collect()} == {(1, 2), (2, 3), (6, 7)}
    more = confusables.read_confusables(["\ufeff# confusables", "0414 ; 0041 ; MA # Д", "006D ; 0072 006E ; MA"])
    assert more == {0x414: "A", 0x6D: "rn"} and confusables.Skeletons(more).of("Дm x") == "Arn x"


# ---- 7 -------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("limit", "overlap"), [(1200, 200), (50, 10), (7, 3), (1, 0), (30, 0)])
def test_pieces_lose_nothing(limit, overlap):
    rng = random.Random(limit)
    for n in (0, 1, limit, limit + 1, 333, 5000):
        text = "".join(rng.choices(["a", "ọ", "bc", " ", ". ", "\n\n", "x" * 40, "e\u0323"], k=n))[: max(n, 1) * 3]
        spans = splitting.split_spans(text, limit, overlap)
        assert "".join(text[core:end] for _, core, end in spans) == text
        assert all(end - start <= limit and core - start <= overlap for start, core, end in spans)
        assert all(b[1] == a[2] and b[0] >= a[1] for a, b in itertools.pairwise(spans))


def test_natural_cuts():
    text = ("Một câu dài. " * 60).strip() + "\n\n" + ("Câu khác. " * 60).strip()
    spans = splitting.split_spans(text)
    assert len(spans) == 2 and text[spans[1][1] - 2 : spans[1][1]] == "\n\n" and text[spans[1][0] :].startswith("Một câu")
    for bad in ((0, 0), (10, 10), (5, -1)):
        with pytest.raises(ValueError, match="limit"):
            splitting.split_spans("x", *bad)


def test_split_table(spark):
    rows = [("a", "f", "x" * 2500), ("a", "f", "x" * 2500), ("b", "f", None), ("c", "f", ""), (None, "f", "y")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "id string, field string, text string, piece_no int, piece string")
    got = splitting.split_items(df, with_text=True).distinct().collect()
    assert sorted((r["id"], r["piece_no"], len(r["piece"])) for r in got if r["id"] == "a") == [("a", 1, 625), ("a", 2, 825), ("a", 3, 825), ("a", 4, 825)]
    assert {(r["id"], r["n_pieces"]) for r in got if r["id"] != "a"} == {("c", 1), (None, 1)}


# ---- 8, 9 ----------------------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library():
    import tiktoken

    with open(f"{packing.TOKENIZERS}/{packing.VOCABULARY}", "rb") as file:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    texts = ["", " ", "  a", "a  b ", "a\n b\t c", "x\xa0 y", "it's 'll"] + ["".join(rng.choices(["một", " ", "  ", "\n", ".", "1", "'s", "Đ"], k=30)) for _ in range(200)]
    assert packing.encoder()(texts) == [len(plain.encode_ordinary(t)) for t in texts]


def test_fillings_hold_every_item_once():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 60, 500), np.array([64] * 5), np.array([1]), np.array([33] * 7)):
        n, c = np.unique(sizes, return_counts=True)
        plan = packing.fillings(n, c, 64, 200)
        assert (sum(f * t for f, t in plan) == c).all() and all(f @ n <= 64 and t > 0 for f, t in plan)
        bins = sum(t for _, t in plan)
        assert bins <= max(-(-int(sizes.sum()) // 64) * 1.08 + 2, len(sizes[sizes > 32]))


def test_pack(spark):
    rows = [(k, "từ " * (37 * k % 300)) for k in range(80)] + [(100, "chữ " * 3000), (101, None), (102, ""), (103, "một"), (103, "một")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = packing.pack(df, capacity=256, rounds=100).collect()
    count = packing.encoder()
    want: dict = {}
    for i, t in rows:
        if t and count([t])[0]:
            want[i] = want.get(i, 0) + count([t])[0]
    have: dict = {}
    fill: dict = {}
    for r in got:
        have[r["id"]] = have.get(r["id"], 0) + r["n_tokens"]
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
    assert have == want and max(fill.values()) <= 256
    assert all(len([r for r in got if r["id"] == i]) == 1 for i in want if want[i] <= 256 and i != 103)
    assert len(fill) <= sum(want.values()) / 256 * 1.1 + 2
    assert packing.pack(df.where("false")).count() == 0


def test_mixture(spark):
    rows = [(k, "một hai ba", "Tin-Tuc" if k % 2 else " tin_tuc") for k in range(600)] + [(1000 + k, "bốn năm sáu", "luat") for k in range(60)] + [(2000, "x", None), (2001, "x", "khac"), (2002, None, "luat"), (2003, "", "luat")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, id int")
    goal = spark.createDataFrame([("tin_tuc", 0.6, 1), ("luat", 0.3, 3), ("trong", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, report = mixture.mix(docs, goal)
    copies: dict = {}
    for r in uses.collect():
        copies[r["id"]] = copies.get(r["id"], 0) + 1
    told = {r["source"]: r for r in report.collect()}
    assert max(v for k, v in copies.items() if k < 1000) == 1 and all(copies[1000 + k] == 3 for k in range(60)) and not {2000, 2001} & set(copies)
    assert told["trong"]["reached_share"] == 0 and abs(told["luat"]["reached_share"] - 1 / 3) < 0.04 and abs(sum(r["reached_share"] for r in told.values()) - 1) < 1e-6
    assert {tuple(r) for r in mixture.mix(docs, goal)[0].collect()} == {tuple(r) for r in uses.collect()}
    assert mixture.mix(docs.where("false"), goal)[0].count() == 0 and mixture.mix(docs, goal.where("false"))[0].count() == 0
    assert mixture.repetition_rates({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 4)}) == {"a": 0.4, "b": 4.0}


# ---- 10 ------------------------------------------------------------------------------------------------------------------------------


def test_levels_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "n_chars").withColumn("level", F.lit(9))
    labels = spark.read.parquet(f"{folder}/reading_label.parquet").where("level is not null")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    vi = F.col("lang") == "vi"
    got = reading.estimate_levels(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), labels.where(~held), vi & (F.col("n_chars") >= 300), graded_where=vi)
    both = got.join(labels.where(held).select("doc_id", F.col("level").alias("truth")).distinct(), "doc_id").collect()
    assert len(both) > 150 and np.mean([r["level"] == r["truth"] for r in both]) > 0.84 and np.mean([abs(r["level"] - r["truth"]) <= 1 for r in both]) > 0.97


def test_level_cases(spark):
    docs = spark.createDataFrame([(1, "Bạn xin giấy. Bạn ký."), (2, "Căn cứ quy định, tổ chức phải thực hiện."), (3, None), (4, ""), (5, "Bạn ký giấy."), (5, "Bạn ký giấy.")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 5), (9, 3), (3, None)], "doc_id long, level int")
    assert [tuple(r) for r in reading.estimate_levels(docs, labels, F.lit(True)).select("doc_id").collect()] == [(5,)]
    assert reading.estimate_levels(docs, labels.where("level = 1"), F.lit(True)).count() == 0
    assert reading.estimate_levels(docs.where("false"), labels, F.lit(True)).count() == 0
