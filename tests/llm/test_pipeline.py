import zlib

import numpy as np

import corpus_pipeline
from cohortlens.llm import quality_crf
from cohortlens.llm.catalogue import QUERIES, SQL
from tests.llm.conftest import sentence
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_tokens import ids_of, tokenizer  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    kept = stages["quality_classifier"](spark, docs, SF)
    scores = {r["doc_id"]: r["predicted"] for r in quality_crf.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert kept.columns == columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, p in scores.items() if p)

    kept = spark.createDataFrame(kept.collect(), kept.schema)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    left = stages["near_dedup"](spark, kept, SF)
    assert left.columns == columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _, c in groups(rows, 5) if i == c)

    left = spark.createDataFrame(left.collect(), left.schema)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    clean = stages["decontamination"](spark, left, SF)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in contaminated(rows, items) if not r[5])

    clean = spark.createDataFrame(clean.collect(), clean.schema)
    out = stages["mixing"](spark, clean, SF)
    want = mixed([(r["doc_id"], r["text"], r["source"]) for r in clean.collect()], 0.95, 4.0)
    assert out.columns == columns and sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _ in want)

    out = spark.createDataFrame(out.collect(), out.schema)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in stages["token_output"](spark, out, SF).collect())
    start = 0
    for r, row in zip(got, sorted(out.collect(), key=lambda r: r["doc_id"])):
        ids = ids_of(tokenizer, row["text"])
        assert r == (start, row["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == out.count()


def test_rows_that_share_an_id_are_told_apart(spark, rng):
    """Of one id, copies and contaminated rows go and clean ones stay, the same ones in every run."""
    words = [sentence(rng, 60) for _ in range(6)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("size(split(text, ' ')) > 20").first()["text"]
    rows = [
        (1, words[0], "a"), (2, words[0], "a"), (2, words[1], "a"), (3, words[2], "a"), (3, words[3], "a"), (3, words[3], "b"), (3, words[3], "b"),
        (None, words[4], "a"), (None, words[4], "a"), (4, item, "a"), (4, words[5], "a"), (None, item + " x", "a"), (None, "", "a"), (5, "", "a"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, pipeline_row string")
    for parts in (1, 5):
        left = corpus_pipeline.near_dedup(spark, docs.repartition(parts), SF)
        assert left.columns == docs.columns
        kept = sorted(((r["doc_id"], r["text"], r["source"]) for r in left.collect()), key=str)
        gone = [(2, words[0], "a"), (3, words[3], "b"), (3, words[3], "b"), (None, words[4], "a")]
        near = groups([(0, item), (1, item + " x")], 5)[1][2] == 0  # then the row without an id comes first
        want = sorted(rows, key=str)
        for r in gone + [(4, item, "a")] * near:
            want.remove(r)
        assert kept == want
        clean = corpus_pipeline.decontamination(spark, docs.repartition(parts), SF)
        assert sorted(((r["doc_id"], r["text"], r["source"]) for r in clean.collect()), key=str) == sorted((r for r in rows if item not in r[1]), key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), odd_docs, no_docs):
        here = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, here, SF)
            assert out.columns == docs.columns
            here = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.token_output(spark, here, SF).count() == here.count()


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
