import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]


@pytest.mark.parametrize("name", ["p3_found", "p6_found", "bm25_search_full", "knn_cosine", "relations_by_entity", "structure_tree"])
def test_matches_the_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.select(sorted(got.columns)).collect()]
    if name in entry.oracle_sql():
        want = con.execute(f"select {', '.join(sorted(got.columns))} from ({entry.oracle_sql()[name]})").fetchall()
        key = lambda r: tuple(map(str, r))
        assert sorted(rows, key=key) == sorted(want, key=key)
