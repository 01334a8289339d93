"""Nearest-neighbour mutual information against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cohortlens.operators import information


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute(pairs, k):
    """Ross's estimator from all distances; a neighbour at the distance itself does not count as within it."""
    sizes = {y: sum(b == y for _, b in pairs) for _, y in pairs}
    pairs = [p for p in pairs if sizes[p[1]] > 1]
    total = 0.0
    for i, (x, y) in enumerate(pairs):
        own = min(k, sizes[y] - 1)
        d = sorted(abs(a - x) for j, (a, b) in enumerate(pairs) if b == y and j != i)[own - 1]
        m = sum(a == x if d == 0 else abs(a - x) < d for a, _ in pairs)
        total += digamma(own) - digamma(sizes[y]) - digamma(m)
    return max(0.0, digamma(len(pairs)) + total / len(pairs))


@pytest.mark.parametrize("block", [5, 8192])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(information, "BLOCK", block)
    source = random.Random(block)
    rows = []
    for i in range(240):
        y = i % 3 if i else 9  # class 9 has one row
        a = float(source.randint(0, 40) + 3 * y)  # ties
        b = source.randint(-2000, 2000) / 64 + (y == 1) * 20.0
        c = None if source.random() < 0.3 else (7.0 if source.random() < 0.4 else float(source.randint(0, 9)))
        rows.append((i, y, a, b, c, None))
    df = spark.createDataFrame(rows, "id bigint, y int, a double, b double, c double, e double").repartition(5)
    for k in (1, 3):
        got = {r["feature"]: (r["rows"], r["mutual_information"]) for r in information.nearest_information(df, ["a", "b", "c", "e"], "y", k).collect()}
        assert set(got) == {"a", "b", "c"}
        for j, name in ((2, "a"), (3, "b"), (4, "c")):
            pairs = [(r[j], r[1]) for r in rows if r[j] is not None]
            lone = {y for _, y in pairs if sum(b == y for _, b in pairs) == 1}
            assert got[name][0] == sum(y not in lone for _, y in pairs)
            assert got[name][1] == pytest.approx(brute(pairs, k), abs=1e-9)


def test_reach_of_blocks():
    low, high, same = information.reach(np.array([1.0, 2.0, 4.0, 8.0]), np.array([1, 1, 3, 1]), 2)
    assert low.tolist() == [-2.0, 0.0, 4.0, 4.0] and high.tolist() == [4.0, 4.0, 4.0, 12.0] and same.tolist() == [False, False, True, False]


def test_empty_table(spark):
    assert information.nearest_information(spark.createDataFrame([], "y int, a double"), ["a"], "y").count() == 0
    assert math.isclose(digamma(5), spark.range(1).select(information.digamma(information.F.lit(5.0))).first()[0], abs_tol=1e-12)
