"""Packing by concatenate and cut: all documents as one stream of ids, cut into windows of equal size.

Pass one encodes each document where it is read and writes its ids with the partition it was read in and the ids ahead of
it there. The partitions' totals, one row each, are summed up in order, which gives every document its place in the whole
stream without any sort or shuffle. Pass two cuts at multiples of the window. A window inside a partition is whole at once; one
that reaches over a border leaves boundary records on both sides, at most two a task, and only these are
shuffled and joined. Nothing but the last window is shorter than the others.

Files below the folder, Parquet, committed by Spark's writer:

    ids       one row per document: part, before, doc_id, n_tokens, ids; removed when the windows are written
    windows   sequence_id, at, length, pieces, ids; rows shorter than a window are boundary records
    joined    the same, one row per window that has boundary records

``pieces`` are (doc_id, start, length, doc_tokens, offset): ids start to start + length of that document lie at offset of the
window. ids are little-endian unsigned, ``width`` bytes each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.byte_encoder import ByteEncoder
from cohortlens.llm.common import chunks, mapped
from cohortlens.sources.files import new_folder, remove_folder

END_ID = 1
WINDOW = 2048
OUT_BYTES = 4_000_000  # ids put into one Arrow batch

_DOC = "part int, before bigint, doc_id bigint, n_tokens bigint, width int, ids binary"
_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())]
_PIECES = "pieces array<struct<doc_id: bigint, start: bigint, length: bigint, doc_tokens: bigint, offset: bigint>>"
_WINDOW = f"sequence_id bigint, at bigint, length bigint, width int, {_PIECES}, ids binary"
_workers: dict = {}


def default_tokenizer() -> tuple[str, str]:
    """(file for ``tokenizers``, the same vocabulary for ``tiktoken``)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(*key) -> ByteEncoder:
    if key not in _workers:
        _workers[key] = ByteEncoder(*key)
    return _workers[key]


def _encode(files: tuple[str, str], end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(*files, end_id), TaskContext.get().partitionId(), 0
        for batch, texts in chunks(batches, "text"):
            ids = [encoder.encode(t) for t in texts]
            sizes = np.array([len(i) for i in ids], dtype=np.int64)
            ahead = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(ahead), batch.column("doc_id"), pa.array(sizes),
                 pa.array([encoder.width] * n, pa.int32()), pa.array([i.tobytes() for i in ids], pa.binary())],
                ["part", "before", "doc_id", "n_tokens", "width", "ids"],
            )

    return encode


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    piece = pa.list_(pa.struct(_PIECE))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), piece, pa.binary()]
    names = ["sequence_id", "at", "length", "width", "pieces", "ids"]
    named = [(*r[:4], [dict(zip((n for n, _ in _PIECE), p)) for p in r[4]], r[5]) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*named), types)], names)


def _cut(starts: dict[int, int], window: int):
    """Windows and boundary records of documents in any order; those that follow each other share windows."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, pieces, ids, place, width = [], 0, [], [], None, 2

        def close():
            nonlocal pieces, ids, held
            data = b"".join(ids)
            if data:
                n = len(data) // width
                rows.append((sequence := (place - 1) // window, place - n - sequence * window, n, width, pieces, data))
                held += len(data)
            pieces, ids = [], []

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "before", "doc_id", "n_tokens", "width", "ids")]
            for part, before, doc_id, size, own_width, data in zip(*columns):
                here = starts[part] + before
                if here != place:
                    close()
                place, width = here, own_width
                done = 0
                while done < size:
                    take = min(size - done, window - place % window)
                    pieces.append((doc_id, done, take, size, place % window))
                    ids.append(data[done * width : (done + take) * width])
                    done, place = done + take, place + take
                    if place % window == 0:
                        close()
                if held > OUT_BYTES:
                    yield _windows(rows)
                    rows, held = [], 0
        close()
        if rows:
            yield _windows(rows)

    return cut


def pack(docs: DataFrame, tokenizer: tuple[str, str] | None = None, end_id: int = END_ID, window: int = WINDOW, path: str | None = None) -> str:
    """Write the ids of ``docs`` (doc_id, text) as windows of ``window`` ids and return the folder.

    Documents follow each other as they are read; each is closed by ``end_id``. NULL and empty texts are their end id only. Every row
    is packed: equal rows and NULL ids each on their own. Extra columns are ignored; an empty table gives no windows.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "llm-packed")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    encoded = mapped(rows, _encode(tokenizer or default_tokenizer(), end_id), _DOC)
    encoded.write.option("compression", "zstd").parquet(f"{path}/ids")
    encoded = spark.read.schema(_DOC).parquet(f"{path}/ids")
    totals = encoded.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n")).orderBy("part")
    starts, total = {}, 0
    for row in totals.collect():  # one row per partition read
        starts[row["part"]] = total
        total += row["n"]
    mapped(encoded, _cut(starts, window), _WINDOW).write.option("compression", "zstd").parquet(f"{path}/windows")
    remove_folder(spark, f"{path}/ids")
    parts = F.sort_array(F.collect_list(F.struct("at", "length", "width", "pieces", "ids")))  # at most ``window`` records
    joined = spark.read.schema(_WINDOW).parquet(f"{path}/windows").filter(F.col("length") < window).groupBy("sequence_id").agg(parts.alias("p"))
    joined = joined.select(
        "sequence_id",
        F.lit(0).cast("bigint").alias("at"),
        F.aggregate("p.length", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("length"),
        F.col("p")[0]["width"].alias("width"),
        F.flatten("p.pieces").alias("pieces"),
        F.unhex(F.array_join(F.transform("p.ids", F.hex), "")).alias("ids"),
    )
    joined.write.option("compression", "zstd").parquet(f"{path}/joined")
    return path


def read_windows(spark: SparkSession, path: str, window: int = WINDOW) -> DataFrame:
    """sequence_id, length, pieces, width, ids of every window."""
    columns = ["sequence_id", "length", "pieces", "width", "ids"]
    whole = spark.read.schema(_WINDOW).parquet(f"{path}/windows").filter(F.col("length") == window)
    return whole.select(columns).unionByName(spark.read.schema(_WINDOW).parquet(f"{path}/joined").select(columns))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        rows = []
        for sequence, pieces, width, data in zip(*[batch.column(c).to_pylist() for c in ("sequence_id", "pieces", "width", "ids")]):
            ids = np.frombuffer(data, f"<u{width}").astype("<u4")
            for p in pieces:
                crc = zlib.crc32(ids[p["offset"] : p["offset"] + p["length"]])
                rows.append((p["doc_id"], p["start"], p["length"], crc, p["doc_tokens"], sequence, p["offset"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def read_pieces(spark: SparkSession, path: str, window: int = WINDOW) -> DataFrame:
    """Per piece of the windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; the checksum is of the ids in the file."""
    return mapped(
        read_windows(spark, path, window),
        _digests,
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
