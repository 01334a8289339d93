"""Nearest neighbours, fills and resampling against brute force on a small fixture."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import neighbours, resampling
from cohortlens.session import materialize

COLUMNS = ["a", "b", "c"]


def fixture(n=160, missing=True, seed=7):
    """A third of all rows are copies of one row; some values are missing."""
    source = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            row = [5.0, 2.0, 1.0]
        else:
            row = [source.uniform(0, 100), float(source.randint(0, 5)), float(source.randint(0, 1))]
            if missing:
                row = [None if source.random() < 0.15 else v for v in row]
        rows.append((i, int(source.random() < 0.3), *row))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, y int, a double, b double, c double")


def distance(x, y):
    pairs = [(p, q) for p, q in zip(x, y) if p is not None and q is not None]
    if not pairs:
        return math.inf
    return math.sqrt(sum((p - q) ** 2 for p, q in pairs) * len(x) / len(pairs))


def brute_fill(rows, k):
    out = {}
    for i, _, *x in rows:
        filled = list(x)
        for j, v in enumerate(x):
            if v is None:
                near = sorted(
                    (distance(x, z), other, z[j]) for other, _, *z in rows if z[j] is not None
                )
                near = [t for t in near if t[0] < math.inf][:k]
                known = [z[j] for _, _, *z in rows if z[j] is not None]
                values = [t[2] for t in near] or known
                filled[j] = sum(values) / len(values)
        out[i] = filled
    return out


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_knn_impute_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(neighbours, "VIEWS", 2 if block_rows == 7 else 8)
    rows = fixture()
    got = neighbours.knn_impute(frame(spark, rows), "id", COLUMNS, 5, block_rows).collect()
    want = brute_fill(rows, 5)
    assert len(got) == len(rows)
    for row in got:
        assert [row[c] for c in COLUMNS] == pytest.approx(want[row["id"]])


def test_empty_column_becomes_zero(spark):
    rows = [(i, 0, float(i), None, None if i % 2 else 1.0) for i in range(6)]
    got = neighbours.knn_impute(frame(spark, rows), "id", COLUMNS, 2).collect()
    assert {r["b"] for r in got} == {0.0} and {r["c"] for r in got} == {1.0}


@pytest.mark.parametrize("block_rows", [5, 2048])
def test_row_neighbours_equal_brute_force(spark, block_rows):
    rows = fixture(missing=False)
    got = neighbours.row_neighbours(frame(spark, rows), "id", COLUMNS, 4, block_rows).collect()
    points = {i: x for i, _, *x in rows}
    for row in got:
        want = sorted((distance(points[row["id"]], z), i) for i, z in points.items() if i != row["id"])[:4]
        assert [n["id"] for n in row["neighbours"]] == [i for _, i in want]


def test_tomek_links_equal_brute_force(spark):
    rows = fixture(90, missing=False, seed=3)
    points, label = {r[0]: r[2:] for r in rows}, {r[0]: r[1] for r in rows}
    near = {
        i: min((distance(x, z), j) for j, z in points.items() if j != i)[1] for i, x in points.items()
    }
    want = {(i, j) for i, j in near.items() if i < j and near[j] == i and label[i] != label[j]}
    links = resampling.tomek_links(frame(spark, rows), "id", COLUMNS, "y")
    assert {(r["low"], r["high"]) for r in links.collect()} == want
    left = resampling.remove_links(frame(spark, rows), "id", links).count()
    assert left == len(rows) - 2 * len(want)


@pytest.mark.parametrize("strategy", [0.7, 1.0])
def test_smote_reaches_the_ratio_between_minority_rows(spark, strategy):
    rows = fixture(120, missing=False)
    got = resampling.smote(frame(spark, rows), "id", COLUMNS, "y", strategy).collect()
    ones = sum(r["y"] for r in got)
    zeros = len(got) - ones
    assert ones == max(sum(r[1] for r in rows), round(strategy * zeros))
    assert len({r["id"] for r in got}) == len(got)
    real = [r for r in rows if r[1] == 1]
    for j, c in enumerate(COLUMNS):
        low, high = min(r[2 + j] for r in real), max(r[2 + j] for r in real)
        assert all(low - 1e-9 <= r[c] <= high + 1e-9 for r in got if r["synthetic"])
    again = resampling.smote(frame(spark, rows), "id", COLUMNS, "y", strategy).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_smote_tomek_leaves_no_link(spark):
    rows = fixture(90, missing=False)
    out = resampling.smote_tomek(frame(spark, rows), "id", COLUMNS, "y", 0.8)
    assert out.count() > 0 and out.filter("synthetic = 1").count() > 0


def spread(n, seed, holes):
    source = random.Random(seed)
    values = [[source.uniform(0, 100), source.uniform(0, 60), source.uniform(0, 30)] for _ in range(n)]
    return [(i, 0, *[None if source.random() < holes else v for v in row]) for i, row in enumerate(values)]


def compared(spark, rows, k, per_column):
    """Pairs of vectors that the search compares."""
    points = materialize(neighbours.vectors(frame(spark, rows), "id", COLUMNS, k))
    queries = points.filter("a IS NULL OR b IS NULL OR c IS NULL") if per_column else points
    cells = neighbours.Cells(points, COLUMNS, 32, neighbours.frequent_kinds(queries, COLUMNS) if per_column else ())
    assert neighbours.nearest(queries, points, COLUMNS, k, per_column, cells=cells).count() > 0
    return cells.compared


@pytest.mark.parametrize("holes", [0.0, 0.1])
def test_comparisons_grow_with_the_rows(spark, holes):
    """Four times the rows need less than six times the comparisons, with and without missing values."""
    small, large = (compared(spark, spread(n, 5, holes), 5, holes > 0) for n in (2000, 8000))
    assert large < 6 * small and large < 8000 * 8000 * (0.27 if holes else 1) / 4


def test_knn_impute_with_many_patterns_equals_brute_force(spark):
    rows = spread(400, 9, 0.3)
    got = neighbours.knn_impute(frame(spark, rows), "id", COLUMNS, 3, 16).collect()
    want = brute_fill(rows, 3)
    for row in got:
        assert [row[c] for c in COLUMNS] == pytest.approx(want[row["id"]])


def test_trees_cover_every_vector(spark):
    """Constant columns, heavy ties and a sample that misses a pattern still put every vector in one cell."""
    rows = np.array([[1.0, 2.0]] * 500 + [[1.0, float(i % 3)] for i in range(500)] + [[np.nan, 5.0]] * 3)
    tree = neighbours.Tree(rows[:1000], np.array([True, True]), 8, 0)
    leaves = tree.place(rows[:1000])
    assert leaves.min() >= 0 and leaves.max() < tree.next
    empty = neighbours.Tree(rows[:0], np.array([True, False]), 5, 7)
    assert (empty.place(rows[:4]) == 7).all() and empty.next == 8


def test_smote_with_half_of_the_minority_equal(spark):
    """Equal rows are partners by value: nothing is joined to a partner, and every synthetic row lies between minority rows."""
    source = random.Random(4)
    rows = [(i, 1, *([5.0, 2.0, 1.0] if i % 2 else [source.uniform(0, 9) for _ in range(3)])) for i in range(120)]
    rows += [(1000 + i, 0, *[source.uniform(0, 9) for _ in range(3)]) for i in range(400)]
    made = resampling.smote(frame(spark, rows), "id", COLUMNS, "y", 1.0)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "other#" not in "".join(line for line in plan.splitlines() if "Join" in line)
    new = made.filter("synthetic = 1").collect()
    assert len(new) == 280 and len({r["id"] for r in new}) == 280
    same = sum((r["a"], r["b"], r["c"]) == (5.0, 2.0, 1.0) for r in new)
    assert 0.3 * 280 < same < 0.7 * 280  # an equal row's neighbours are its copies
    with pytest.raises(ValueError):
        resampling.smote(frame(spark, [(-1, 1, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0)] + rows[-9:]), "id", COLUMNS, "y", 1.0)
    assert resampling.smote(frame(spark, rows[:0]), "id", COLUMNS, "y").count() == 0


def test_cells_are_chosen_in_as_many_tasks_as_a_shuffle_has(spark):
    points = materialize(neighbours.vectors(frame(spark, spread(200, 5, 0)), "id", COLUMNS, 2))
    cells = neighbours.Cells(points, COLUMNS, 32)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 37)
        assert cells.near(points.select("qid", *COLUMNS), 2, False).rdd.getNumPartitions() == 37
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_beyond_the_reach_leaves_a_comparison():
    rows = pd.DataFrame({"a": [0.0, 0.0, 0.0], "b": [0.0, 0.0, np.nan], "qid": [1, 2, 3], "reach": [2.0, np.nan, np.nan]})
    givers = pd.DataFrame({"a": [1.0, 2.0, 9.0], "b": [0.0, 3.0, 9.0], "qid": [4, 5, 6], "ids": [[4, 7], [5], [6]]})
    got = neighbours._compare(["a", "b"], 3, False)(rows, givers)
    found = {q: sorted(g["neighbour"].tolist()) for q, g in got.groupby("qid")}
    assert found == {1: [4, 7], 2: [4, 5, 7], 3: [4, 5, 7]}


def test_missing_patterns_share_cells(spark):
    """Vectors that miss different narrow columns lie in common cells, so that a query is compared with few cells, not with one of each pattern."""
    source = random.Random(3)
    narrow = ["b", "c", "d", "e"]
    rows = [(i, source.uniform(0, 1000), *[None if source.random() < 0.3 else float(source.randint(0, 5)) for _ in narrow]) for i in range(600)]
    columns = ["a", *narrow]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, e double")
    points = materialize(neighbours.vectors(df, "id", columns, 3))
    cells = neighbours.Cells(points, columns, 200, neighbours.frequent_kinds(points, columns))
    assert len(cells.patterns) == 16 and len(cells.bucket) == 3
    got = neighbours.knn_impute(df, "id", columns, 3, 200).collect()
    want = brute_fill([(r[0], 0, *r[1:]) for r in rows], 3)
    for row in got:
        assert [row[c] for c in columns] == pytest.approx(want[row["id"]])


def test_a_rarely_known_column_is_filled_exactly(spark):
    source = random.Random(8)
    rows = [(i, 0, source.uniform(0, 100), source.uniform(0, 60), source.uniform(0, 9) if i % 40 == 0 else None) for i in range(400)]
    got = neighbours.knn_impute(frame(spark, rows), "id", COLUMNS, 3, 32).collect()
    want = brute_fill(rows, 3)
    for row in got:
        assert [row[c] for c in COLUMNS] == pytest.approx(want[row["id"]])


@pytest.mark.parametrize("large", [1.0, 1e8, 1e200, math.inf])
def test_comparison_in_leaves_equals_all_pairs(large):
    """Mixed missing patterns, ties and values far from zero or without bound; far fewer pairs than all are looked at."""
    source = np.random.default_rng(2)
    y = source.integers(0, 40, (3000, 3)).astype(float)
    y[source.random(y.shape) < 0.1] = np.nan
    y[0] = [large, 1.0, 2.0]
    if large == 1e8:
        y += large
    x = np.where(source.random((200, 3)) < 0.2, np.nan, y[200:400])
    donors = pd.DataFrame(y, columns=COLUMNS).assign(qid=range(3000), ids=[[i] for i in range(3000)])
    queries = pd.DataFrame(x, columns=COLUMNS).assign(qid=range(200), reach=np.nan)
    far = neighbours._distances(x, y)
    for per_column in (False, True):
        got = neighbours._compare(COLUMNS, 4, per_column)(queries, donors)
        found = {key: g.sort_values(["distance", "neighbour"])["neighbour"].tolist() for key, g in got.groupby(["qid", "target"])}
        want = {}
        for i in range(200):
            for target in np.flatnonzero(np.isnan(x[i])).tolist() if per_column else [-1]:
                fit = np.isfinite(far[i]) & (~np.isnan(y[:, target]) if per_column else True)
                best = sorted((far[i, j], j) for j in np.flatnonzero(fit).tolist())[:4]
                if best:
                    want[i, target] = [j for _, j in best]
        assert found == want
    if large == 1.0:
        full = x[~np.isnan(x).any(axis=1)]
        looked = sum(len(row) for row, *_ in neighbours.Leaves(y).near(full, np.full(len(full), np.inf), [np.ones(3000, dtype=bool)], 4))
        assert looked < len(full) * 3000 / 20
