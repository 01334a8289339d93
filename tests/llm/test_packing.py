import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortlens.llm import packing
from cohortlens.llm.byte_encoder import LONG, ByteEncoder
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer()[0])


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_equal_the_tokenizers_library(tokenizer):
    rng = random.Random(4)
    parts = ["a", "b", " ", "\n", "'s", "1", "é", "\t", "!", " x", "\n\n", "\xa0", "\x1d", "日", "\x85", "²", "́", "\U0001f600", "퟿", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)]
    texts += ["x <|endoftext|> y", "<|endoftext|>", "", " " * LONG, "\n" * LONG, " " * 3 * LONG + "x", "ab" * LONG, sentence(rng, 500)]
    encoder = ByteEncoder(*packing.default_tokenizer(), 1)
    assert [encoder.encode(t).tolist() for t in texts] == [ids_of(tokenizer, t) for t in texts]


def check(spark, rows, out, tokenizer, window):
    """Every id in exactly one piece, windows gapless and full but for the last, checksums of the right ids."""
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append(ids_of(tokenizer, text))
    total = sum(len(i) for own in want.values() for i in own)
    windows, documents = defaultdict(list), defaultdict(list)
    for r in out:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append(r)
        assert any(len(i) == r["doc_tokens"] and crc(i[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for i in want[r["doc_id"]])
    assert sorted(windows) == list(range(-(-total // window)))
    for sequence, places in windows.items():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end == min(window, total - sequence * window)
    for doc_id, own in documents.items():
        assert sum(r["length"] for r in own) == sum(map(len, want[doc_id]))
        starts = sum(r["start"] == 0 for r in own)
        assert starts == len(want[doc_id])


def test_equals_brute_force(spark, tokenizer, rng):
    rows = [(i * 7 % 101, sentence(rng, rng.choice([0, 1, 5, 40, 900]), 5)) for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    for window in (64, packing.WINDOW):
        path = packing.pack(docs, window=window)
        check(spark, rows, packing.read_pieces(spark, path, window).collect(), tokenizer, window)
        again = packing.read_windows(spark, path, window).collect()
        assert all(len(r["ids"]) == r["width"] * r["length"] for r in again)
        assert sum(r["length"] < window for r in again) <= 1


def test_odd_rows(spark, tokenizer, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    for docs in (odd_docs, odd_docs.withColumn("doc_id", odd_docs.doc_id.cast("int"))):
        check(spark, rows, packing.read_pieces(spark, packing.pack(docs)).collect(), tokenizer, packing.WINDOW)
    assert packing.read_pieces(spark, packing.pack(no_docs)).count() == 0
    one = spark.createDataFrame([(5, "")], "doc_id int, text string")
    (piece,) = packing.read_pieces(spark, packing.pack(one)).collect()
    assert piece["doc_tokens"] == piece["length"] == 1 and piece["offset"] == piece["sequence_id"] == 0
