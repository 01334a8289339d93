import random
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np

from cohortlens.llm import runs
from tests.llm.conftest import sentence


def brute(words, least=24, times=3):
    """Every run by trying all periods, straight from the definition."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, times * q):
                stretch = words[start : start + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found[start, q] = (start, length, q)
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def some_text(rng):
    letters = [b"a", b"b", b"c", b"d"][: rng.randrange(1, 5)]
    out = []
    for _ in range(rng.randrange(1, 7)):
        piece = [rng.choice(letters) for _ in range(rng.randrange(1, 14))]
        out += piece * rng.choice([1, 1, 2, 3, 4, 9, 30])
        out += [rng.choice(letters) for _ in range(rng.randrange(3))]
    return out


def test_equals_brute_force():
    rng = random.Random(11)
    for least, times in ((24, 3), (24, 2), (5, 3), (2, 2), (7, 4), (40, 3)):
        texts = [some_text(rng) for _ in range(150)] + [[], [b"a"] * 300, [b"a", b"b"] * 100, [b"a"] * 24, [b"a"] * 23]
        codes = [np.array([ord(w) for w in t], dtype=np.int64) for t in texts]
        got = runs.runs_of(codes, least, times)
        assert got == [brute(t, least, times) for t in texts], (least, times)


def test_long_texts():
    rng = random.Random(3)
    one = [rng.randrange(5000) for _ in range(5000)]
    texts = [[7] * 60_000, one * 12, [1, 2, 3] * 20_000 + [9] + [4, 5] * 20_000, [rng.randrange(3) for _ in range(50_000)]]
    got = runs.runs_of([np.array(t, dtype=np.int64) for t in texts])
    assert got[0] == [(0, 60_000, 1)] and got[1] == [(0, 60_000, 5000)]
    assert got[2] == [(0, 60_000, 3), (60_001, 40_000, 2)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def rows_of(df):
    return sorted(((r["doc_id"], tuple(r)[1:]) for r in runs.digested(df).collect()), key=str)


def test_query_equals_brute_force(spark, rng):
    rows = [(i, " ".join(w.decode() for w in some_text(random.Random(i)))) for i in range(120)]
    rows += [(1000 + i, sentence(rng, rng.randrange(0, 200))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(runs.periodic_runs(docs, plant=True)) == sorted(((i, expected(i, t)) for i, t in rows), key=str)
    assert any(crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    small = odd_docs.filter("length(text) < 1000 OR text IS NULL")
    want = sorted(((r["doc_id"], expected(r["doc_id"], r["text"])) for r in small.select("doc_id", "text").collect()), key=str)
    assert rows_of(runs.periodic_runs(small, plant=True)) == want
    assert runs.periodic_runs(odd_docs).count() == odd_docs.count() and runs.periodic_runs(no_docs).count() == 0
    long = runs.periodic_runs(odd_docs).filter("doc_id = 4").first()
    assert [tuple(r) for r in long["runs"]] == [(0, 60_000, 5000)] and len(long["collapsed"].split()) == 5000
    spaced = spark.createDataFrame([(1, "a b  c\x0b\x0cd\x1ce ")], "doc_id int, text string")
    assert runs.periodic_runs(spaced).first()["collapsed"] == "a b c d\x1ce"
