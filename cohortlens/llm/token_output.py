"""Token-id output: texts as ids of a public tokenizer, in Re-Pair compressed shards.

Documents are put in range partitions of ascending doc_id, tokenized there, cut into shards of about
``shard_tokens`` ids and compressed shard by shard with their own grammar (``repair``). The files are
Parquet in the shared folder, one row per shard, committed by Spark's writer, so a lost task is simply run again:

    part, shard     place in the order; shards of a part follow each other
    before          ids of the part ahead of the shard
    doc_ids         ids of its documents, in order
    n_tokens        ids per document, with the end id
    symbol_ends     where the symbols of each document end
    n_rules, base   symbols below base are ids; base + k stands for rule k
    rules           left symbols of all rules, then right ones, ``bits`` bits each, lowest bit first
    lengths         expansion length of each rule, little-endian unsigned 32-bit
    symbols         the symbols of all documents, as the rules

Any document, or range of one, decodes from its own symbols, the lengths and the rules these use (``decode``).
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import repair
from cohortlens.llm.common import give_back, mapped
from cohortlens.sources.files import new_folder

END_ID = 1
SHARD_TOKENS = 250_000  # arrays of a shard stay in a core's cache while its grammar is found
TEXTS = 256  # texts that a shard grows by
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # fixed value: the tokenizer's own pattern
MARK, LATIN = "\0", "\u0250"
BLOCK = 4_000_000  # bytes of texts whose words are told apart together; a worker holds some ten times as many while it encodes them

_SHARD = (
    "part int, shard int, before bigint, doc_ids array<bigint>, n_tokens array<bigint>, symbol_ends array<bigint>, "
    "n_rules int, base int, bits int, rules binary, lengths binary, symbols binary"
)
_workers: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts. The tokenizer drops white space, so the ids of a text are those of its
    pieces between blanks and line breaks, and each distinct piece of the texts given together is encoded once. Its
    lower-casing makes pieces that differ in A-Z only the same."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.base = max(self.tokenizer.get_vocab_size(True), max(self.tokenizer.get_vocab().values()) + 1, end_id + 1)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.bytes_of = np.zeros(self.base, dtype=np.int64)
        for token, code in self.tokenizer.get_vocab().items():  # one character of a token is one byte of text
            self.bytes_of[code] = len(token.removesuffix("</w>"))
        self.fast = _fast(self.tokenizer)

    def ids(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by the end id; ids per text); NULL is the empty text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else upper case decides what is a special token
            texts = pc.ascii_lower(texts)
        texts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ends = np.cumsum(pc.list_value_length(texts).to_numpy())
        found = texts.flatten().dictionary_encode()
        del texts  # the words stand in the dictionary now
        codes, place = self._encoded(_listed(found.dictionary))
        order = np.insert(place[found.indices.to_numpy()], ends, len(codes))  # the end id behind each text's words
        del found
        coded = pa.concat_arrays([codes, pa.array([self.end], pa.large_binary())]).take(pa.array(order))
        del order
        stops = np.frombuffer(coded.buffers()[1], np.int64, len(coded) + 1, 8 * coded.offset)[1:][ends + np.arange(len(ends))] // 4
        return np.frombuffer(coded.buffers()[2], "<u4", int(stops[-1]) if len(stops) else 0), np.diff(stops, prepend=0)

    def _encoded(self, words: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(ids of the words in some order, place of each word there). Words of lower-case Latin letters, digits and signs go to ``tiktoken``,
        where each piece carries its end mark (a word of letters is one piece); the others, and all words of a tokenizer that is not of
        this kind, to ``tokenizers``."""
        simple = [
            self.fast is not None and w.isprintable() and (w.isascii() or max(w) < LATIN) and w == w.lower() and "<|" not in w for w in words
        ]
        kinds = np.array([int(not w.isalpha()) if s else 2 for w, s in zip(words, simple)])
        out, place = [pa.array([], pa.large_binary())], np.empty(len(words), np.int32)
        place[np.argsort(kinds, kind="stable")] = np.arange(len(words))
        for kind, encode in enumerate((self._letters, self._marked, self._plain)):
            own = list(compress(words, kinds == kind))
            for at in range(0, len(own), 2000):
                part = own[at : at + 2000]
                out.append(self._split(part, encode(part)))
        return pa.concat_arrays(out), place

    def _letters(self, pieces: list[str]) -> np.ndarray:
        return self.fast.encode_to_numpy(MARK.join(pieces) + MARK, disallowed_special=())

    def _marked(self, words: list[str]) -> np.ndarray:
        return self._letters(PIECES.findall(" ".join(words)))

    def _plain(self, words: list[str]) -> list[int]:
        return self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids

    def _split(self, words: list[str], codes: np.ndarray | list[int]) -> pa.Array:
        """Many words go as one text, which is faster; the bytes that tokens stand for tell where each word ends, and if they don't
        add up, the words are encoded one by one."""
        ids, text = np.asarray(codes, dtype="<u4"), " ".join(words)
        plain = np.frombuffer(unicodedata.normalize("NFC", text).lower().encode() + b" ", np.uint8)
        ends = np.flatnonzero(plain == 32)
        ends, covered = ends - np.arange(len(ends)), np.append(0, np.cumsum(self.bytes_of[ids]))
        if len(ends) == len(words) and ends[-1] == covered[-1] and "<|" not in text:
            stops = np.searchsorted(covered, ends)
            if (covered[stops] == ends).all():
                cuts = pa.py_buffer(np.append(0, 4 * stops).astype(np.int64))
                return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, cuts, pa.py_buffer(ids)])
        alone = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return pa.array([np.array(code.ids, dtype="<u4").tobytes() for code in alone], pa.large_binary())


def _listed(words: pa.Array) -> list[str]:
    """The words as Python strings, by way of one string, which is faster; none holds a blank."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ") if len(words) else []


def _fast(tokenizer):
    """The tokenizer's vocabulary for ``tiktoken``, with a zero byte as end-of-word mark, if it splits words at ``PIECES``; else None."""
    import json

    import tiktoken

    parts = json.loads(tokenizer.to_str())
    splits = [p["pattern"]["Regex"] for p in parts["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
    if splits != [PIECES.pattern] or parts["model"].get("end_of_word_suffix") != "</w>":
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {}
    for token, rank in tokenizer.get_vocab().items():
        if token not in special:
            word = token.removesuffix("</w>")
            ranks[bytes(byte_of[c] for c in word) + MARK.encode() * (word != token)] = rank
    return tiktoken.Encoding("marked", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})


def _encoder(path: str, end_id: int) -> Encoder:
    key = (path, end_id)
    if key not in _workers:
        _workers[key] = Encoder(path, end_id)
        give_back()  # reading the vocabulary takes more than it leaves
    return _workers[key]


def _shard(part: int, shard: int, before: int, doc_ids: list, ids: np.ndarray, sizes: np.ndarray, base: int) -> pa.RecordBatch:
    symbols, counts, grammar = repair.compress(ids, sizes, base)
    bits = (base + len(grammar.left)).bit_length()
    row = {
        "part": part, "shard": shard, "before": before, "doc_ids": doc_ids, "n_tokens": sizes.tolist(), "symbol_ends": np.cumsum(counts).tolist(),
        "n_rules": len(grammar.left), "base": base, "bits": bits,
        "rules": repair.packed(np.concatenate([grammar.left, grammar.right]), bits),
        "lengths": grammar.lengths.astype("<u4").tobytes(), "symbols": repair.packed(symbols, bits),
    }
    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.int32()] * 3, *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))


def _blocks(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about as many bytes as wanted, or as they come where one alone has more."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > wanted:
            yield _joined(held)
            size = 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The batches as one; the list is emptied, so that they are not kept while the block is worked on."""
    block = pa.concat_batches(held)
    held.clear()
    return block


def _writer(path: str, end_id: int, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path, end_id), TaskContext.get().partitionId()
        doc_ids, held, sizes, size, shard, before = [], [], [], 0, 0, 0

        def close():
            return _shard(part, shard, before, doc_ids, np.concatenate(held), np.concatenate(sizes), encoder.base)

        for block in _blocks(batches, BLOCK):
            names = block.column("doc_id").to_pylist()
            ids, counts = encoder.ids(block.column("text"))
            del block
            give_back()  # else the grammars come on top of what the encoding has left
            ends = np.cumsum(counts)
            for at in range(0, len(names), TEXTS):
                own = slice(at, at + TEXTS)
                doc_ids += names[own]
                held.append(ids[ends[at] - counts[at] : ends[own][-1]])
                sizes.append(counts[own])
                size += len(held[-1])
                if size >= shard_tokens:
                    yield close()
                    before, shard = before + size, shard + 1
                    doc_ids, held, sizes, size = [], [], [], 0
        if doc_ids:
            yield close()

    return write


def write_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, path: str | None = None) -> str:
    """Write the ids of ``docs`` (doc_id, text) and return the folder.

    ``tokenizer`` is the file of a tokenizer that drops white space between words. Documents go in ascending doc_id, NULL
    ids first; rows of one doc_id go by a hash of the text, equal rows in any order. NULL is the
    empty text: its end id only. An empty table gives files without shards.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "llm-tokens")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # the partition a row was read in tells equal rows apart, so that they need not share a task
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("origin", F.spark_partition_id())
    order = ["doc_id", "tie", "origin"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    mapped(rows, _writer(tokenizer or default_tokenizer(), end_id, shard_tokens), _SHARD).write.parquet(path)
    return path


def read_files(spark, path: str) -> DataFrame:
    """The shards with ``start``: the ids of all documents before each. Parts are range partitions,
    as few as shuffle partitions, so their totals are small."""
    files = spark.read.schema(_SHARD).parquet(path)
    sums = files.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    offsets, total = [], 0
    for row in sums.orderBy("part").collect():
        offsets.append((row["part"], total))
        total += row["n"]
    starts = spark.createDataFrame(offsets, "part int, offset bigint")
    return files.join(F.broadcast(starts), "part").withColumn("start", F.col("offset") + F.col("before")).drop("offset")


def grammar_of(row: dict) -> repair.Grammar:
    n = row["n_rules"]
    rules = repair.unpacked(row["rules"], row["bits"], 0, 2 * n)
    return repair.Grammar(row["base"], rules[:n], rules[n:], np.frombuffer(row["lengths"], "<u4").astype(np.int64))


def decode(row: dict, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids of one document of a shard, or a range of them."""
    ends = row["symbol_ends"]
    symbols = repair.unpacked(row["symbols"], row["bits"], ends[document - 1] if document else 0, ends[document])
    return grammar_of(row).part(symbols, start, row["n_tokens"][document] if stop is None else stop)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            symbols = repair.unpacked(row["symbols"], row["bits"], 0, row["symbol_ends"][-1])
            ids = grammar_of(row).expand(symbols).astype("<u4")
            sizes = np.array(row["n_tokens"], dtype=np.int64)
            ends = np.cumsum(sizes)
            crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, all from the decoded ids."""
    shards = read_files(spark, path).drop("part", "shard", "before")
    return mapped(shards, _digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
