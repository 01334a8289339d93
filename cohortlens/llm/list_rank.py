"""Distributed list ranking: the place of every arc of a linked list.

Arcs are first contracted in blocks of neighbouring ids: the stretches of the list that stay within a block become one segment each. If
too many segments are left for one task, rounds of coin tosses take every fourth or so out of the list, each put behind the one
ahead of it. What is left, at most ``LIMIT`` segments, is ranked by pointer doubling; the segments taken out and the arcs inside
segments follow by their offsets. Every step is a join on unique ids or work on a block of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import mapped, small, stored
from cohortlens.session import ship

BLOCK = 1 << 16
LIMIT = 500_000
BROADCAST_HEADS = 1_000_000


def _found(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted id lies in sorted ids, -1 for none."""
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


def contract(arcs: np.ndarray, following: np.ndarray) -> dict[str, np.ndarray]:
    """Per arc, sorted: its head and offset in a segment; for heads also the segment's size and the arc behind it (-1: none)."""
    order = np.argsort(arcs)
    arcs, following = arcs[order], following[order]
    n = len(arcs)
    to = _found(arcs, following)
    pointer, distance = np.arange(n), np.zeros(n, dtype=np.int64)
    pointer[to[to >= 0]] = np.flatnonzero(to >= 0)  # the arc ahead
    distance[to[to >= 0]] = 1
    while (pointer[pointer] != pointer).any():
        distance, pointer = distance + distance[pointer], pointer[pointer]
    size, behind = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    tails = np.flatnonzero(to < 0)
    size[pointer[tails]], behind[pointer[tails]] = distance[tails] + 1, following[tails]
    return {"arc": arcs, "head": arcs[pointer], "offset": distance, "size": size, "behind": behind}


def _contract(table: pa.Table) -> pa.Table:
    found = contract(table.column("arc").to_numpy(), table.column("following").to_numpy())
    return pa.table({k: pa.array(v) for k, v in found.items()})


def weighted_ranks(arcs: np.ndarray, following: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How much lies ahead of each arc of one list."""
    order = np.argsort(arcs)
    to = np.empty(len(arcs), dtype=np.int64)
    to[order] = _found(arcs[order], following[order])
    to = np.where(to < 0, len(arcs), np.append(order, 0)[to])
    pointer, rest = np.append(to, len(arcs)), np.append(sizes, 0)
    while (pointer != len(arcs)).any():
        rest, pointer = rest + rest[pointer], pointer[pointer]
    return rest.max() - rest[:-1]


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        arcs, following, sizes = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("arc", "behind", "size"))
        yield pa.RecordBatch.from_arrays([pa.array(arcs), pa.array(weighted_ranks(arcs, following, sizes))], ["arc", "start"])


def _heads_up(arc, salt: int) -> F.Column:
    return F.xxhash64(arc, F.lit(salt)) % 2 == 0


def _tossed(now: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(the shorter list, what was taken out: arc, into, offset)."""
    ahead = now.select(F.col("arc").alias("into"), F.col("size").alias("offset"), F.col("behind").alias("arc")).filter("arc >= 0")
    gone = now.join(ahead, "arc").filter(_heads_up(F.col("into"), salt) & ~_heads_up(F.col("arc"), salt))
    gone = stored(gone.select("arc", "into", "offset", "size", "behind"), "tossed")
    grown = gone.select(F.col("into").alias("arc"), F.col("size").alias("more"), F.col("behind").alias("jump"))
    left = now.join(gone.select("arc"), "arc", "left_anti").join(grown, "arc", "left")
    left = left.select("arc", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.coalesce("jump", "behind").alias("behind"))
    return stored(left, "tossed"), gone


def list_rank(arcs: DataFrame, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """(arc, position) from 0 for ``arcs`` (arc, following), bigint, one list whose last arc has following -1.

    Ids need not be dense. An empty table gives no rows.
    """
    ship(arcs.sparkSession)
    blocks = arcs.select("arc", "following", F.floor(F.col("arc") / block).alias("block")).groupBy("block")
    segments = stored(blocks.applyInArrow(_contract, "arc bigint, head bigint, offset bigint, size bigint, behind bigint"), "segments")
    now, out = segments.filter("size >= 0").select("arc", "size", "behind"), []
    while now.count() > limit:
        now, gone = _tossed(now, len(out))
        out.append(gone)
    starts = stored(mapped(now.repartition(1), _ranked, "arc bigint, start bigint"), "starts")
    for gone in reversed(out):
        behind = gone.join(starts.withColumnRenamed("arc", "into"), "into").select("arc", (F.col("start") + F.col("offset")).alias("start"))
        starts = stored(starts.unionByName(behind), "starts")
    heads = small(starts.withColumnRenamed("arc", "head"), BROADCAST_HEADS)
    return segments.join(heads, "head").select("arc", (F.col("start") + F.col("offset")).alias("position"))
