import itertools
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from cohortlens.llm import divergence, quality_crf
from cohortlens.llm.charclass import CLASSES, bounded_class_counts, class_counts
from tests.llm.conftest import sentence


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force(spark, odd_docs, no_docs, rng):
    texts = [sentence(rng, rng.randrange(1, 60), 9) for _ in range(40)]
    texts += [t + "\n" + t + "\n\n \n" + t[:40] + " #|<> \x1c\x85 é" for t in texts[:20]]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    for docs in (df, odd_docs):
        for r, text in zip_rows(divergence.quality_rules(docs), docs):
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            assert got == brute_counts(text)
            assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
            assert not (r["kept"] and r["base_failed"])
    assert divergence.quality_rules(no_docs).count() == 0


def zip_rows(out, docs):
    """Result rows with the text of an equal input row; texts that share a doc_id are told apart by length."""
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for r in out.collect():
        own = texts[r["doc_id"]]
        text = next(t for t in own if len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) == r["n_words"])
        own.remove(text)
        yield r, text


def test_distance_and_guards():
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0.5, 0.5])
    assert divergence.js_distance(p, p) == 0 and abs(divergence.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) - 1) < 1e-12
    m = (p + q) / 2
    brute = sum(0.5 * v * np.log2(v / w) for a in (p, q) for v, w in zip(a, m) if v)
    assert abs(divergence.js_distance(p, q) ** 2 - brute) < 1e-12
    reference = {"classes": np.ones(len(CLASSES)) / len(CLASSES), "words": {b"the": 0.1}}
    far = np.eye(len(CLASSES))[0]
    assert divergence.distances(far, 199, [b"x"] * 59, reference) == (None, None)
    assert all(d > 0.2 for d in divergence.distances(far, 200, [b"x"] * 60, reference))
    assert divergence.distances(far, 500, [b"x"] * 99, None) == (None, None)


def test_junk_is_far_and_prose_is_near(spark, rng):
    good = [(i, "Some words of the usual prose, and the rest. " + sentence(rng, 120), "en") for i in range(60)]
    junk = [(100, "!!!! #### $$$$ %%%% " * 40 + sentence(rng, 30), "en"), (101, (sentence(rng, 90)).upper(), "en")]
    df = spark.createDataFrame(good + junk, "doc_id bigint, text string, lang string").repartition(4)
    kept = {r["doc_id"] for r in divergence.quality_rules(df).filter("kept").collect()}
    assert kept == set(range(60))


def test_rare_languages_have_their_own_reference(spark, rng):
    """However many documents others have; below the least number, and without a language, nothing is judged."""
    latin = [(i, sentence(rng, 90), f"l{i % 20}") for i in range(400)]
    greek = [(10_000 + i, " ".join("".join(chr(ord(c) + 848) for c in w) for w in sentence(rng, 90).split()), "el" if i < 22 else "few" if i < 25 else None) for i in range(28)]
    junk = [(20_000, "!!!! #### $$$$ %%%% " * 40 + sentence(rng, 30), "el")]
    df = spark.createDataFrame(latin + greek + junk, "doc_id bigint, text string, lang string").repartition(4)
    df = df.unionByName(spark.range(25_000).selectExpr("id - 30000 AS doc_id", "repeat('some words and others ', 20) AS text", "'en' AS lang"))
    rows = {r["doc_id"]: r for r in divergence.quality_rules(df).filter("doc_id >= 10000").collect()}
    assert all(rows[i]["kept"] for i in rows if i < 20_000) and not rows[20_000]["kept"]
    assert all((rows[i]["class_distance"] is None) == (i >= 10_022) for i in rows if i < 20_000)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    counts, steps = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    evidence = rng.normal(size=8)
    f, b, place = quality_crf.forward_backward(evidence, counts, steps)
    got, at = quality_crf._sigmoid(f + b)[place], 0
    for n in counts:
        e, total, mass = evidence[at : at + n], 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(np.dot(e, y) + sum(steps[a, c] for a, c in zip(y, y[1:])))
            total, mass = total + w, mass + w * np.array(y)
        assert np.allclose(got[at : at + n], mass / total)
        at += n


def test_class_counts():
    assert class_counts(["aB1 .!#|@一", ""]).tolist() == [[1.0] * 10, [0.0] * 10]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r["doc_id"]: r for r in quality_crf.classify(docs, labels, per_class=150).collect()}
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in out.items())
    truth = [(out[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in out]
    held = [(r["predicted"], q) for r, q in truth if r["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert np.mean([p == q for p, q in held if q == 1]) > 0.98


def test_classifier_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (9, 0), (3, None), (8, 7), (None, 1), (4, 1)], "doc_id bigint, quality int")
    out = quality_crf.classify(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in out)
    none = labels.limit(0)
    assert {r["score"] for r in quality_crf.classify(odd_docs, none).collect()} == {0.5}
    assert quality_crf.classify(no_docs, labels).count() == 0
    kept = quality_crf.scored(odd_docs, quality_crf.train(odd_docs, none), "q")
    assert kept.columns == [*odd_docs.columns, "q"] and kept.filter("score = 'score'").count() == odd_docs.count()


def _model(rng):
    own = quality_crf.OWN
    return {"mean": rng.normal(size=own), "scale": rng.uniform(0.5, 2, own), "weights": rng.normal(size=3 * own + 3) / 5, "steps": rng.normal(size=(2, 2))}


def test_blocks_and_long_chains_change_nothing(rng, monkeypatch):
    """Evidence, messages and qualities in blocks equal those from whole arrays, long texts beside short ones."""
    texts = [sentence(rng, 3) for _ in range(30)] + ["\n".join(sentence(rng, rng.randrange(4)) for _ in range(n)) for n in (2, 7, 900, 2_500)] + [""]
    model = _model(np.random.default_rng(5))
    own, sizes, counts = quality_crf.line_features(texts)
    evidence = quality_crf.with_neighbours((own - model["mean"]) / model["scale"], counts) @ model["weights"]
    f, b, place = quality_crf.forward_backward(evidence, counts, model["steps"])
    marginals = quality_crf._sigmoid(f + b)[place]
    for name, value in (("BLOCK", 100), ("CELLS", 1_000), ("LONG", 800)):
        monkeypatch.setattr(quality_crf, name, value)
    quality, lines = quality_crf.text_qualities(texts, model)
    assert np.allclose(lines, marginals, atol=1e-9)
    weights, starts = sizes + 1, np.cumsum(counts) - counts
    assert np.allclose(quality, np.add.reduceat(marginals * weights, starts) / np.add.reduceat(weights, starts), atol=1e-9)
    assert len(np.concatenate(list(quality_crf._parts(counts)))) == len(texts)


def test_class_counts_in_steps(rng):
    pieces = ["", "aB 1.", "x" * 25, sentence(rng, 9), "", "é|#" * 11]
    assert np.array_equal(bounded_class_counts(pieces, 10), class_counts(pieces))
    assert bounded_class_counts([]).shape == (0, len(CLASSES))


def test_memory_follows_the_text_not_the_longest_one(rng):
    """Two million lines beside a hundred short texts, and one line of ten million characters."""
    model = _model(np.random.default_rng(6))
    texts = [sentence(rng, 8) for _ in range(100)] + ["a b\n" * 2_000_000, "word " * 2_000_000]
    tracemalloc.start()
    quality, lines = quality_crf.text_qualities(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(lines) == 2_000_102 and np.isfinite(quality).all() and peak < 600 << 20


def test_training_takes_few_lines_of_a_text(spark, rng):
    docs = [(i, "\n".join(sentence(rng, 5) if i % 2 else "## $$ !!" for _ in range(5_000 if i < 4 else 3))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id bigint, quality int")
    assert all(0 < (s := quality_crf._stretch(t)).stop - s.start <= quality_crf.LINES and s.stop <= t.count("\n") + 1 for _, t in docs)
    out = quality_crf.classify(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in out)
