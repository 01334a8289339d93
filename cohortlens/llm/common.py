"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import materialize, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read on from there.

    The written table outlives lost executors, is read column by column, and cuts the lineage. It is removed when the driver ends, or by
    ``session.release``.
    """
    return materialize(df, f"llm-{label}")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than that."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows, else leave it to a shuffled join."""
    return F.broadcast(df) if fits(df, rows) else df


BATCHES = (  # setting, Spark's default, ours; a value of the session's own stays
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16m"),
)


def give_back() -> None:
    """Hand memory that was freed back to the system; a reused Python worker would else keep the peak of every step it has run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def _tidy(function):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors and batches that long texts don't blow up."""
    spark = ship(df.sparkSession)
    for name, default, wanted in BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, wanted)
    return df.mapInArrow(_tidy(function), schema)


def row_key(*columns: str):
    """128 bits that name a row by content; NULL and empty differ, equal rows share it."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts))


def chunks(batches: Iterator[pa.RecordBatch], column: str, chars: int = 2_000_000) -> Iterator[tuple]:
    """Slices of Arrow batches holding about ``chars`` bytes of text: (batch slice, list of texts).

    Bounds the memory of vectorized work whatever the number of rows in a batch; a text is
    never cut, and NULL becomes the empty text.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for i, own in enumerate(sizes):
            size += own
            if size >= chars or i + 1 == len(sizes):
                part = batch.slice(start, i + 1 - start)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                start, size = i + 1, 0


def lists(rows: np.ndarray) -> pa.ListArray:
    """A 2-d array as one list per row."""
    n, width = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1)))


def ragged(flat: np.ndarray, sizes) -> pa.ListArray:
    """Consecutive pieces of ``flat`` of the given sizes as one list per row."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
