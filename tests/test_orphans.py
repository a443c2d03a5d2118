import datetime as dt
import random

from pyspark.sql import functions as F

from docweave.operators import orphans as O

DAY = dt.datetime(2024, 5, 1)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O, "REFS_PER_SLOT", 20)
    rng = random.Random(3)
    at = lambda: DAY + dt.timedelta(days=rng.randint(0, 60))
    held = {f"k{n}": (at(), rng.random() < 0.2) for n in range(60)}
    refs = [("t", f"r{n}", "f", "k0" if rng.random() < 0.4 else f"k{rng.randint(0, 90)}", at()) for n in range(400)]
    parents = spark.createDataFrame([("s", k, t, d) for k, (t, d) in held.items()], "space string, key string, time timestamp, deleted boolean")
    asked = spark.createDataFrame([("s", k, t, a, b, c) for a, b, c, k, t in refs], "space string, key string, time timestamp, source_table string, source_key string, field string")
    want = set()
    for a, b, c, k, t in refs:
        state = "missing" if k not in held else "deleted" if held[k][1] else "late" if held[k][0] > t else None
        if state:
            want.add((a, b, c, k, state, t.strftime("%Y-%m")))
    assert {tuple(r) for r in O.orphan_references(parents, asked).collect()} == want


def test_document_tables(spark):
    meta = spark.createDataFrame([("9_2016_l-hnqg", DAY, None), ("x_1", DAY, DAY), ("x_1", DAY, None), ("gone_1", DAY, DAY), (None, None, None)], "so_hieu string, created_at timestamp, deleted_at timestamp")
    rel = spark.createDataFrame(
        [(1, " 9 / 2016 / L-HNQG ", "X_1", DAY), (2, "gone/1", None, DAY), (3, "  ", "no/where", None), (3, "  ", "no/where", None), (4, "9_2016_l-hnqg", "x_1", DAY - dt.timedelta(days=1))],
        "id long, entity_start string, entity_end string, created_at timestamp",
    )
    nodes = spark.createDataFrame([("a", ["b", "", None, "zz"], DAY), ("a", ["b"], DAY + dt.timedelta(days=9)), ("b", None, DAY + dt.timedelta(days=40)), ("b", [], DAY + dt.timedelta(days=50)), (None, ["q"], None)], "id string, reference array<string>, loaded_at timestamp")
    got = {tuple(r) for r in O.document_references(meta, rel, nodes).collect()}
    assert got == {
        ("document_relation", "2", "entity_start", "gone_1", "deleted", "2024-05"), ("document_relation", "3", "entity_end", "no_where", "missing", None),
        ("document_relation", "4", "entity_start", "9_2016_l-hnqg", "late", "2024-04"), ("document_relation", "4", "entity_end", "x_1", "late", "2024-04"),
        ("document_node", "a", "reference", "b", "late", "2024-05"), ("document_node", "a", "reference", "zz", "missing", "2024-05"),
    }


def test_empty_parents_and_references(spark):
    parents = spark.createDataFrame([], "space string, key string, time timestamp, deleted boolean")
    asked = spark.createDataFrame([("s", "k", DAY, "t", "1", "f")], "space string, key string, time timestamp, source_table string, source_key string, field string")
    assert [r["state"] for r in O.orphan_references(parents, asked).collect()] == ["missing"]
    assert O.orphan_references(parents, asked.where(F.lit(False))).count() == 0


def test_equal_digests_are_told_apart(spark):
    import pandas as pd

    rows = [(0, 0, 5, "a", 1.0, False, None, None, None, None), (0, 0, 5, "b", 9.0, False, None, None, None, None)]
    rows += [(0, 1, 5, k, 3.0, False, "t", k, "f", "2024-05") for k in ("a", "b", "c")]
    batch = pd.DataFrame(rows, columns=["slot", "is_ref", "h", "key", "ms", "gone", "source_table", "source_key", "field", "period"])
    out = pd.concat(list(O._probe(iter([batch]))))
    assert set(zip(out["source_key"], out["state"], strict=True)) == {("b", "late"), ("c", "missing")}
