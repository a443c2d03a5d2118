"""Likeness of many texts to many names: the bounds hold, and few names are compared in full."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from docweave.operators import relations as R
from docweave.operators.likeness import Names

WORDS = "quy dinh muc thu phi luat dat dai ho so cu tru le hoi cap xa vung bien gioi nam so khoang san nho".split()


def texts(n, seed, most=12):
    draw = random.Random(seed)
    return [" ".join(draw.choices(WORDS, k=draw.randint(1, most))) + f" {draw.randint(1, 99)}/{draw.randint(2000, 2024)}" for _ in range(n)]


#: Long ones, for which frequent characters don't start a match; more characters than have a place; none at all.
ODD = ["", "a", "aaaa" * 100, "x " * 130 + "luat dat dai", "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "".join(map(chr, range(0x4F00, 0x4F00 + 90))), "\U0001f600 luat", *texts(5, 9, 60)]


@pytest.mark.parametrize("held", [ODD + texts(60, 1), texts(300, 2, 4), [""]])
def test_bounds_hold(held):
    names = Names(held)
    for q in ODD + texts(10, 3):
        loose, close = names.by_letters(q), names.by_subsequence(q, np.arange(len(held)))
        true = np.array([SequenceMatcher(None, q, h).ratio() if q and h else 0.0 for h in held])
        assert (loose + 1e-9 >= close).all() and (close + 1e-9 >= true).all()


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


def test_closer_bound_is_the_common_subsequence():
    held = texts(40, 4) + ["luat" * 60]
    names = Names(held)
    for q in texts(5, 5) + ["dat luat " * 20]:
        assert names.by_subsequence(q, np.arange(len(held))).tolist() == [2 * longest_common(q, h) / (len(q) + len(h)) for h in held]


@pytest.mark.parametrize("threshold", [0.0, 0.5])
def test_likest_are_those_of_all_pairs(monkeypatch, threshold):
    monkeypatch.setattr(R, "FIRST_NAMES", 8)
    monkeypatch.setattr(R, "NAMES_A_STEP", 16)
    held = list(dict.fromkeys(ODD + texts(250, 6)))
    numbers = [[f"{k % 90}_a", f"{k}_b"] for k in range(len(held))]
    asked = pd.DataFrame({"q": list(dict.fromkeys(ODD + texts(15, 7)))})
    got = R._likest(asked, pd.DataFrame({"plain": held, "numbers": numbers}), threshold, 10)
    rows = []
    for q in asked["q"]:
        best = {}
        for h, own in zip(held, numbers, strict=True):
            score = round(SequenceMatcher(None, q, h).ratio(), 6) if q and h else 0.0
            for number in own:
                if score >= threshold:
                    best[number] = max(score, best.get(number, 0.0))
        rows += [(q, *x) for x in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10]]
    assert list(got.itertuples(index=False, name=None)) == rows


def test_few_names_are_compared_in_full(monkeypatch):
    """3000 names of like letters: in the order of letters alone, some hundred names of each text were compared in full."""
    compared = []
    monkeypatch.setattr(R, "SequenceMatcher", lambda *args: compared.append(1) or SequenceMatcher(*args))
    held = list(dict.fromkeys(texts(3000, 8)))
    asked = pd.DataFrame({"q": texts(20, 10)})
    assert len(R._likest(asked, pd.DataFrame({"plain": held, "numbers": [[f"{k}_x"] for k in range(len(held))]}), 0.5, 10)) == 200
    assert len(compared) < 100 * len(asked)
