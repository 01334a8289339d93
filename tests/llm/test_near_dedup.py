import random

import numpy as np

from cohortlens.llm import graph, near_dedup
from tests.llm.conftest import sentence


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, threshold=0.8):
    sets = [shingles(t, width) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 100 * threshold * len(a | b):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None) for (i, _), s in zip(rows, sets)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def families(seed, width):
    """Edited copies of a few texts at many distances, exact copies, texts with a shared passage."""
    rng, rows = random.Random(seed), []
    passage = sentence(rng, 12)
    for base in range(6):
        words = sentence(rng, 40 + 30 * base).split()
        for copy in range(25):
            own = list(words)
            for _ in range(rng.randrange(0, 12)):
                own[rng.randrange(len(own))] = sentence(rng, 1)
            rows.append((len(rows), " ".join(own)))
        rows.append((len(rows), rows[-1][1].upper()))
    for _ in range(30):
        rows.append((len(rows), passage + " " + sentence(rng, rng.randrange(2, 30))))
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    for seed, width in ((1, 4), (2, 5)):
        rows = families(seed, width)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        assert result(near_dedup.near_duplicates(df, 0.8, width)) == brute(rows, width)


def test_odd_rows(spark, odd_docs, no_docs):
    out = near_dedup.near_duplicates(odd_docs, 0.8, 4)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(out) == brute(rows, 4)
    kept = {(r["doc_id"], r["kept"]) for r in out.collect()}
    assert (8, False) in kept and (7, True) in kept and (None, True) in kept
    assert near_dedup.near_duplicates(no_docs, 0.8, 4).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    for same in (200, 216, 228):  # of 240 samples
        a = rng.integers(0, 2**63, (50, 240)).astype(np.uint64)
        b = a.copy()
        b[:, same:] = rng.integers(0, 2**63, (50, 240 - same)).astype(np.uint64)
        x = near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b)
        differing = np.array([sum(bin(int(v) & (2**64 - 1)).count("1") for v in row) for row in x])
        estimate = 1 + 1024 / (4 * 240) * np.log(1 - 2 * differing / 1024)
        assert abs(estimate.mean() - same / 240) < 0.02
        assert (differing <= near_dedup.max_difference(0.8, 240)).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
