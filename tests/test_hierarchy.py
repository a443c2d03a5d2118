import random

import pytest

from docweave.operators import hierarchy as H


def brute(parent: dict) -> dict:
    out = {}
    for start in parent:
        way, x = [], start
        while x in parent and parent[x] in parent and x not in way:
            way.append(x)
            x = parent[x]
        if x in way:
            out[start] = (min(way[way.index(x) :]), -1, None)
        else:
            out[start] = (x, len(way), [*reversed([*way, x])])
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "id string, parent_id string")
    return {r["id"]: tuple(r)[1:] for r in H.hierarchy(df, **options).collect()}


@pytest.mark.parametrize(("seed", "last"), [(0, 3), (1, 3), (2, 100_000)])
def test_random_forests_with_loops(spark, monkeypatch, seed, last):
    """A tiny limit of the last level forces several levels of boundary links, loops across them included."""
    monkeypatch.setattr(H, "LAST_LEVEL_ROWS", last)
    rng = random.Random(seed)
    ids = [f"n{k:03d}" for k in range(90)]
    parent = {i: rng.choice([*ids, None, "gone", " "]) if rng.random() < 0.9 else None for i in ids}
    want = brute(parent)
    got = run(spark, list(parent.items()), with_paths=True)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert {k: v[2] for k, v in got.items()} == {k: v[2] for k, v in want.items()}


def test_long_chain_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(H, "LAST_LEVEL_ROWS", 5)
    rng = random.Random(1)
    ids = [f"{rng.random():.12f}" for _ in range(300)]
    rows = [(ids[0], None), *((ids[k], ids[k - 1]) for k in range(1, 300))]
    got = run(spark, rows)
    assert [got[i] for i in ids] == [(ids[0], k) for k in range(300)]


def test_defined_cases(spark):
    rows = [("a", "a"), ("b", "a"), ("c", None), ("c", None), ("d", "c"), ("d", None), (None, "c"), ("e", ""), ("f", "\t "), ("g", "nowhere")]
    got = run(spark, rows)
    assert got == {"a": ("a", -1), "b": ("a", -1), "c": ("c", 0), "d": ("c", 1), "e": ("e", 0), "f": ("f", 0), "g": ("g", 0)}


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([("x", None, "r", 7)], "key string, up string, root string, depth int")
    assert [tuple(r) for r in H.hierarchy(df, "key", "up").collect()] == [("x", "x", 0)]


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("l", "l")], "id string, parent_id string")
    assert {tuple(r) for r in H.descendants(df).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    assert {tuple(r) for r in H.descendant_counts(df).collect()} == {("a", 3, 2), ("b", 1, 1)}


def test_smallest_of_a_loop_by_code_points(spark):
    got = run(spark, [("đ", "z"), ("z", "Z"), ("Z", "đ"), ("y", "đ")])
    assert set(got.values()) == {("Z", -1)}


def test_ways_by_doubling_beside_a_loop(spark, monkeypatch):
    """Links that don't halve by ranges, some of them on or below a loop: the ways of the others are whole, and nobody's grows round the loop."""
    import random

    from docweave.operators import hierarchy as H

    monkeypatch.setattr(H, "LAST_LEVEL_ROWS", 10)
    monkeypatch.setattr(H, "ROWS_PER_TASK", 40)
    rng = random.Random(3)
    names = [f"{rng.getrandbits(48):012x}" for _ in range(600)]
    parent = {names[0]: None}
    for k in range(1, 400):
        parent[names[k]] = names[rng.randrange(max(0, k - 3), k)]
    for k in range(400, 600):
        parent[names[k]] = names[400 + (k - 399) % 200] if k < 500 else names[rng.randrange(400, k)]
    parent[names[499]] = names[400]
    got = {r["id"]: (r["depth"], r["path"]) for r in H.hierarchy(spark.createDataFrame(list(parent.items()), "id string, parent_id string"), with_paths=True).collect()}
    for name in names[:400]:
        way = [name]
        while parent[way[-1]]:
            way.append(parent[way[-1]])
        assert got[name] == (len(way) - 1, way[::-1])
    assert all(got[name] == (-1, None) for name in names[400:])
