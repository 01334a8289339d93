import zlib

import numpy as np
import pytest

from cohortlens.llm import repair, token_output
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_output.default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [token_output.END_ID]


def test_words_encode_like_texts(tokenizer, rng):
    texts = [sentence(rng, 50) for _ in range(20)]
    texts += ["", " ", "x <|endoftext|> <|ENDOFTEXT|> y", "İSTANBUL ΑΣ it's'll\x0b,,\x85 Á\n\nÁ ́b", "ﬁ ½ \U0001f600!! 12345", "\"!\"  　x"]
    ids, sizes = token_output.Encoder(token_output.default_tokenizer(), 1).ids(texts)
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [ids_of(tokenizer, t) for t in texts]


def test_grammar_round_trip():
    rng = np.random.default_rng(2)
    for seed in range(4):
        phrases = [rng.integers(0, 50, rng.integers(2, 9)) for _ in range(20)]
        docs = [np.concatenate([phrases[i] for i in rng.integers(0, 20, n)]) if n else np.zeros(0, int) for n in rng.integers(0, 60, 80)]
        docs += [np.full(500, 3), np.array([7])]
        ids, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        symbols, counts, grammar = repair.compress(ids, sizes, 60, 4 if seed else 10**6)
        assert (grammar.expand(symbols) == ids).all() and counts.sum() == len(symbols)
        if seed:
            assert len(symbols) < 0.6 * len(ids) and (grammar.lengths >= 2).all()
        ends = np.cumsum(counts)
        for i, doc in enumerate(docs):
            own = symbols[ends[i] - counts[i] : ends[i]]
            assert (grammar.expand(own) == doc).all()
            assert (grammar.part(own, 3, 17) == doc[3:17]).all() and (grammar.part(own, 0, 10**9) == doc).all()
    symbols, counts, grammar = repair.compress(np.zeros(0, int), np.zeros(0, int), 60)
    assert len(symbols) == len(counts) == len(grammar.left) == 0


def pairs_left(symbols, counts):
    """Non-overlapping occurrences of each pair inside documents."""
    found, ends = {}, np.cumsum(counts)
    for end, n in zip(ends, counts):
        at = {}
        own = symbols[end - n : end].tolist()
        for i, pair in enumerate(zip(own[:-1], own[1:])):
            if at.get(pair, -2) < i - 1:
                found[pair], at[pair] = found.get(pair, 0) + 1, i
    return found


def test_grammar_goes_on_to_its_end():
    """With production parameters no frequent pair is left, whatever the size of the shard; runs of one id end too."""
    rng = np.random.default_rng(5)
    text = rng.zipf(1.4, 200_000) % 3000
    for ids, sizes in (
        (text[:3000], [3000]), (text[:20_000], [15_000, 0, 5000]), (text, [50_000] * 4), (np.zeros(5000, int), [4990, 10]),
        (np.tile([1, 2], 4000), [8000]), (np.array([7]), [1]), (np.array([7, 7]), [1, 1]), (np.tile(np.arange(500), 6), [500] * 6),
    ):
        symbols, counts, grammar = repair.compress(ids, np.array(sizes), 3000)
        assert (grammar.expand(symbols) == ids).all() and (grammar.unfold(symbols) == ids).all()
        assert max(pairs_left(symbols, counts).values(), default=0) < repair.LEAST
        assert len(ids) < 100 or len(symbols) < 0.8 * len(ids)
        bits = (3000 + len(grammar.left)).bit_length()
        data = repair.packed(symbols, bits)
        assert len(data) == -(-len(symbols) * bits // 8) and (repair.unpacked(data, bits, 0, len(symbols)) == symbols).all()
        assert (repair.unpacked(data, bits, len(symbols) // 3, len(symbols) // 2) == symbols[len(symbols) // 3 : len(symbols) // 2]).all()


def test_words_of_the_given_table_encode_like_texts(tokenizer):
    """The faster library gives the same ids on real texts, which hold words of every kind that it takes."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    encoder = token_output.Encoder(token_output.default_tokenizer(), 1)
    assert encoder.fast is not None
    ids, sizes = encoder.ids(texts)
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [ids_of(tokenizer, t) for t in texts]


def test_files_round_trip(spark, tokenizer, odd_docs, no_docs, rng):
    rows = [(i * 7 % 101, sentence(rng, rng.randrange(1, 300), 5)) for i in range(101)]
    for docs in (spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), odd_docs):
        path = token_output.write_ids(docs, shard_tokens=3000)
        want = sorted(((r["doc_id"], ids_of(tokenizer, r["text"])) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        got = sorted(token_output.read_digests(spark, path).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == [d for d, _ in want]
        start = 0
        for r in got:
            assert r["start"] == start
            start += r["n_tokens"]
        digest = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
        assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d or -1, len(i), digest(i)) for d, i in want)
        shard = next(r.asDict() for r in token_output.read_files(spark, path).collect() if r["n_tokens"])
        known = {}
        for d, i in want:
            known.setdefault(d, []).append(i)
        for at in range(min(3, len(shard["doc_ids"]))):
            ids = token_output.decode(shard, at).tolist()
            assert ids in known[shard["doc_ids"][at]]
            assert token_output.decode(shard, at, 1, 4).tolist() == ids[1:4]
    assert token_output.read_digests(spark, token_output.write_ids(no_docs)).count() == 0


def test_a_grammar_is_found_in_few_bytes_a_token():
    """Four arrays of four bytes and two marks; a shard is one fourth of a million ids."""
    row = repair._Sequence(np.arange(10_000, dtype="<u4"), np.full(10, 1000))
    assert sum(a.nbytes for a in vars(row).values()) < 20 * 10_000
    assert token_output.SHARD_TOKENS <= 250_000


def test_lengths_and_expansions_are_worked_out_by_rounds(rng, monkeypatch):
    ids = np.array([rng.randrange(6) for _ in range(4000)] + [3] * 3000 + list(range(5)) * 400)
    sizes, given = np.array([4000, 3000, 2000]), []

    class Watched(repair.Grammar):
        def __init__(self, base, left, right, lengths=None):
            given.append(lengths)
            super().__init__(base, left, right, lengths)

    monkeypatch.setattr(repair, "Grammar", Watched)
    symbols, _, grammar = repair.compress(ids, sizes, 10)
    assert given[0] is not None and (given[0] == repair.Grammar(10, grammar.left, grammar.right).lengths).all()
    assert (grammar.expand(symbols) == ids).all() and (grammar.unfold(symbols) == ids).all()
    for k in range(len(grammar.left)):
        assert (grammar.expand(np.array([10 + k])) == grammar.unfold(np.array([10 + k]))).all()
    none = repair.Grammar(10, ids[:0], ids[:0])
    assert none.expand(ids[:5]).tolist() == ids[:5].tolist() and len(none.expand(ids[:0])) == 0


def test_columns_are_encoded_by_distinct_words(tokenizer, rng, monkeypatch):
    """Batches are put together to blocks, NULL and empty words among them, and a block encodes each of its words once."""
    import pyarrow as pa

    texts = [sentence(rng, 40) for _ in range(30)] + [None, "", "\n  ", " a  b\n\nA", "Ä ñandú 'tis x\0y", "<| a"] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7], pa.string())], ["text"]) for i in range(0, len(texts), 7)]
    blocks = list(token_output._blocks(iter(batches), 2 * batches[0].nbytes))
    assert 1 < len(blocks) < len(batches) and [t for b in blocks for t in b.column("text").to_pylist()] == texts
    encoder, seen = token_output.Encoder(token_output.default_tokenizer(), 1), []
    monkeypatch.setattr(encoder, "_encoded", lambda words: seen.append(words) or token_output.Encoder._encoded(encoder, words))
    for block in [*blocks, blocks[-1].slice(3), blocks[0].slice(2, 0)]:
        ids, sizes = encoder.ids(block.column("text"))
        ends, own = np.cumsum(sizes), block.column("text").to_pylist()
        assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [ids_of(tokenizer, t) for t in own]
        split = [w for t in own for w in (t or "").replace("\n", " ").split(" ")]
        assert len(seen[-1]) == len(set(seen[-1])) <= len(set(split)) and {w.lower() for w in seen[-1]} == {w.lower() for w in split}


def test_a_round_goes_on_with_frequent_pairs_only(monkeypatch):
    """Of 10,000 places with rare pairs none is counted again; in a run every other pair is replaced."""
    rare, counted, frequent = np.arange(100, 10_100), [], repair._frequent
    ids = np.concatenate([rare, np.tile([1, 2, 3], 50), np.full(101, 7)])
    monkeypatch.setattr(repair, "_frequent", lambda codes, least: counted.append(len(codes)) or frequent(codes, least))
    symbols, _, grammar = repair.compress(ids, np.array([10_000, 150, 101]), 11_000)
    assert (grammar.expand(symbols) == ids).all() and len(counted) > 2 and counted[0] > 10_000 > 500 > max(counted[1:])
    row = repair._Sequence(np.full(9, 7), np.array([4, 5]))
    assert row.chosen(np.array([0, 1, 2, 4, 5, 6, 7]), np.zeros(7, np.int32)).tolist() == [0, 2, 3, 5]


def test_a_worker_holds_little_of_its_task(rng, monkeypatch):
    """Of 16 MB of texts a worker holds a few at once, and still fewer while it finds grammars; the files have all ids."""
    import pyarrow as pa

    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(700)) for _ in range(200)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(at, at + 200)), "text": texts}) for at in range(0, 3200, 200)]
    assert sum(b.nbytes for b in batches) > 15_000_000
    monkeypatch.setattr(token_output, "TaskContext", type("Task", (), {"get": lambda: type("Own", (), {"partitionId": lambda: 0})}))
    known, pool, while_packing, compress = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool()), [], repair.compress
    monkeypatch.setattr(repair, "compress", lambda *a: while_packing.append(pool.bytes_allocated()) or compress(*a))
    given = list(token_output.Encoder(token_output.default_tokenizer(), 1).ids(texts)[1]) * 16
    pa.set_memory_pool(pool)
    try:
        shards = [s.to_pylist()[0] for s in token_output._writer(token_output.default_tokenizer(), 1, 250_000)(iter(batches))]
    finally:
        pa.set_memory_pool(known)
    assert [n for s in shards for n in s["n_tokens"]] == given and [d for s in shards for d in s["doc_ids"]] == list(range(3200))
    assert pool.max_memory() < 40_000_000 and max(while_packing) < 20_000_000
    assert list(token_output._blocks(iter([]), 10)) == []
