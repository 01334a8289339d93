"""Places and rolling hashes in a global order, without a window over all rows or over a whole group.

Rows are range-partitioned and sorted by group and order, so that a group of any size lies in neighbouring slices. Each slice
is numbered and hashed on its own and written; one row per slice, with its first and last group, tells what the slices
ahead have counted, and a second pass adds that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import mapped, stored

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)  # odd multipliers of the rolling hashes
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2 ** 64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2 ** 64, bit by bit."""
    out, left, square = np.ones(len(exponents), np.uint64), exponents.astype(np.uint64), np.uint64(base)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        square = np.uint64(int(square) * int(square) & _MASK)
        left = left >> np.uint64(1)
    return out


def _local(group: str, rolled: tuple[str, ...]):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, count, sums = TaskContext.get().partitionId(), 0, None, 0, [0] * len(rolled)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = np.asarray(batch.column(group))
            fresh = np.append(names[0] != last, names[1:] != names[:-1])
            if last is None:
                fresh[0] = True
            head = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))  # -1: goes on from the batch before
            nth = np.arange(n) - head + np.where(head < 0, count, 1)
            nth[head < 0] = np.arange(1, int((head < 0).sum()) + 1) + count
            columns = {"slice": pa.array(np.full(n, part, np.int32)), "seq": pa.array(seen + np.arange(n)), "nth": pa.array(nth)}
            for k, name in enumerate(rolled):
                values = np.asarray(batch.column(name)).astype(np.int64).view(np.uint64)
                total = np.cumsum(values * _power(BASES[k], nth), dtype=np.uint64)
                ahead = np.where(head > 0, total[np.maximum(head - 1, 0)], 0).astype(np.uint64)
                upto = total - ahead + np.where(head < 0, sums[k], 0).astype(np.uint64)
                sums[k] = np.uint64(upto[-1])
                columns[f"{name}_upto"] = pa.array(upto.view(np.int64))
            last, count, seen = names[-1], int(nth[-1]), seen + n
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])

    return number


def _joined(group: str, rolled: tuple[str, ...], carries: dict[int, tuple]):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices, inverse = np.unique(np.asarray(batch.column("slice")), return_inverse=True)
            known = [carries[s] for s in slices.tolist()]
            before = np.array([c[0] for c in known], dtype=np.int64)[inverse]
            first = np.array([c[1] for c in known], dtype=np.int64)[inverse]
            on = np.asarray(batch.column(group)) == first
            extra = np.where(on, np.array([c[2] for c in known], dtype=np.int64)[inverse], 0)
            nth = np.asarray(batch.column("nth"))
            out = {"at": pa.array(np.asarray(batch.column("seq")) + before), "nth": pa.array(nth + extra)}
            for k, name in enumerate(rolled):
                own = np.asarray(batch.column(f"{name}_upto")).view(np.uint64)
                ahead = np.where(on, np.array([c[3][k] for c in known], dtype=np.uint64)[inverse], np.uint64(0))
                upto = ahead + own * _power(BASES[k], extra)
                values = np.asarray(batch.column(name)).astype(np.int64).view(np.uint64)
                out[f"{name}_upto"] = pa.array(upto.view(np.int64))
                out[f"{name}_before"] = pa.array((upto - values * _power(BASES[k], nth + extra)).view(np.int64))
            left = [n for n in batch.schema.names if n not in out and n not in ("slice", "seq")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in left], *out.values()], [*left, *out])

    return join


def numbered(df: DataFrame, group: str, order: list[str], rolled: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``at``, its place from 0 in the order of ``group`` (bigint, not NULL) and ``order``, and ``nth``, that in its group from 1.

    For each bigint column of ``rolled`` also ``*_upto`` and ``*_before``: the polynomial hash modulo 2 ** 64 of the group's
    values up to the row, with and without it. Equal sequences have equal hashes. Rows that tie get any order. ``df`` must not have
    columns of these names, nor slice, seq or origin.
    """
    ranged = df.withColumn("origin", F.spark_partition_id())  # tells equal rows apart, so that they need not share a task
    keys = [group, *order, "origin"]
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("origin")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    more = "".join(f", {c}_upto bigint" for c in rolled)
    local = stored(mapped(ranged, _local(group, rolled), f"{fields}, slice int, seq bigint, nth bigint{more}"), "numbered")
    end = F.struct("seq", "nth", group, *[f"{c}_upto" for c in rolled])
    edges = local.groupBy("slice").agg(F.min(F.struct("seq", group))[group].alias("first"), F.max(end).alias("end")).orderBy("slice").collect()
    carries, before, last, count, sums = {}, 0, None, 0, [0] * len(rolled)
    for row in edges:  # one row per slice
        if row["first"] != last:
            count, sums = 0, [0] * len(rolled)
        carries[row["slice"]] = (before, row["first"], count, tuple(sums))
        tail = row["end"]
        alone = row["first"] == tail[group]  # then what came ahead counts for the next slice too
        before += tail["seq"] + 1
        grown = [(s if alone else 0) + tail[f"{c}_upto"] * (pow(BASES[k], count, 1 << 64) if alone else 1) for k, (c, s) in enumerate(zip(rolled, sums))]
        sums = [g & _MASK for g in grown]
        last, count = tail[group], tail["nth"] + (count if alone else 0)
    more = "".join(f", {c}_upto bigint, {c}_before bigint" for c in rolled)
    return mapped(local, _joined(group, rolled, carries), f"{fields}, at bigint, nth bigint{more}")
