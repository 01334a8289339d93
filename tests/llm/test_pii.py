import random
import re
from hashlib import sha256

import numpy as np

from cohortlens.llm import pii
from tests.llm.conftest import sentence


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    pieces = ["a@b.c", "@", "x.y@z", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111111111111112", "+1 (314) 555-6532", "+49-30", "é٣", " ", "-", "q@r.s.t..u", "7"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(1, 9)))
        assert sorted(pii.base_spans(text)) == brute(text), text


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    accuracy = (0.95, 0.9, 0.5, 0.85)
    votes = np.stack([np.where(rng.random(4000) < 0.2, 1, np.where((rng.random(4000) < a) == truth, 2, 0)) for a in accuracy], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, tables = pii.reliabilities(patterns, counts.astype(float))
    assert np.mean((posterior[inverse.ravel()] > 0.5) == truth) > 0.95
    right = [(tables[j, 1, 2] + tables[j, 0, 0]) / 2 / 0.8 for j in range(4)]
    assert np.allclose(right, accuracy, atol=0.05)


def test_classifier_adds_likely_spans_only(spark, rng):
    rows = []
    for i in range(300):
        filler = sentence(rng, 20)
        spans = [f"mail {sentence(rng, 1)}.{i}@mail.example.com", f"server 10.{i % 200}.3.{i % 99}", f"card 4111 1111 1111 1111", f"phone +1 (314) 555-{1000 + i}"]
        rows.append((i, f"{filler} {spans[i % 4]} {filler}"))
    rows += [(1000, "write to jo.doe (at) example (dot) com today"), (1001, "card 4111.1111.1111.1111 is it"), (1002, "order 4111.1111.1111.1112 of x"), (1003, "build 9999999.8888888.12"), (1004, "plain words only")]
    out = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    for i, text in rows:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute(text))
        assert out[i]["base_sha256"] == sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(out[i]["spans"].split(","))
    assert out[1000]["spans"] == "email:9:38" and out[1001]["spans"] == "card:5:24"
    assert out[1002]["spans"] == out[1003]["spans"] == out[1004]["spans"] == ""


def test_odd_rows(odd_docs, no_docs):
    out = pii.find_personal_data(odd_docs).collect()
    assert len(out) == odd_docs.count() and {r["spans"] for r in out} == {""}
    assert {r["base_sha256"] for r in out} == {sha256(b"").hexdigest()}
    assert pii.find_personal_data(no_docs).count() == 0


def test_long_digit_runs_and_many_spans(spark):
    """Numbers beyond what int() takes, and as many spans as a text may hold, in time that grows in proportion."""
    zeros, nines = "0" * 10_000, "9" * 10_000
    assert pii.base_spans(f"x {zeros}1.2.3.{zeros}255 y") == [(1, 2, 2 + 10_001 + 5 + 10_003)]
    assert pii.base_spans(f"x {nines}.2.3.4 +{nines}7 y") == [] and pii.base_spans(f"{zeros}.0.0.{zeros}")[0][0] == 1
    many = "mail a@b.com and 4111.1111.1111.1111 or 00" + "49 30 1234567 "
    text = many * 3000
    base = pii.base_spans(text)
    loose = pii.candidates(text, base)
    assert len(base) >= 3000 and len(loose) >= 3000
    assert not any(a < end and start < b for (_, a, b), (_, start, end) in zip(loose[:50], base[:50]))
    docs = spark.createDataFrame([(1, f"{zeros}1.2.3.4"), (2, text)], "doc_id int, text string")
    out = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert out[1]["n_ip"] == 1 and out[2]["n_email"] == 3000
