"""Periodic runs of words by descending LCP, in the manner of Kruskal's algorithm.

The suffixes of a text form classes: at level l, all that begin with the same l words. Going down from the longest common
prefix (LCP), a union-find unites the classes of neighbouring suffixes, and every class keeps the ordered set of the positions it
holds; the smaller set goes into the larger. When two positions i < j become neighbours of a set at level l and j - i <= l, the
words from i on repeat with period j - i for j - i + l words and with no shorter one, and every run of words shows up
so, at the level of its length less its period. What also goes on to neither side is a run.

A run of at least ``least`` words and ``times`` periods has an LCP of at least ``_floor`` words, so only positions whose
first words return in the same text take part. They are found by doubling ranks (Manber and Myers,
1993; groups that stay are sorted on, as Larsson and Sadakane do), for all texts of a chunk at once; LCPs follow from the ranks
of each length. Memory is some 4 bytes a word for each doubling of the longest repeated passage.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import chunks, mapped

LEAST, TIMES = 24, 3
CACHE = 400_000  # word codes kept by a task; a full cache is emptied, with no effect on results


def planted(words: list[bytes], doc_id: int) -> list[bytes]:
    """The test texts of the periodic-run query: one text in ten, by its id, ends in copies of a passage."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _floor(least: int, times: int) -> int:
    """The smallest length less period of a run that counts."""
    q = least // times
    return min(least - q, (times - 1) * (q + 1)) if q else (times - 1)


class Ranks:
    """Ranks of all positions by their first 1, 2, 4, ... symbols; equal symbols share a rank, a symbol that returns nowhere ends a text."""

    def __init__(self, symbols: np.ndarray, base: int):
        """``active`` are the positions whose first ``base`` symbols, a power of two, return elsewhere."""
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        held = symbols[order]
        rank[order] = _group_starts(np.flatnonzero(np.append(True, held[1:] != held[:-1])), n)
        active = _shared(order, rank)
        self.levels, self.active, width = [(1, rank.copy())], active, 1
        while len(active):
            if width == base:
                self.active = active
            key = rank[active] * (n + 1) + rank[active + width]
            order = np.argsort(key, kind="stable")
            active, key = active[order], key[order]
            old = rank[active]
            groups = _group_starts(np.flatnonzero(np.append(True, old[1:] != old[:-1])), len(old))
            fresh = _group_starts(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            rank[active] = old + fresh - groups
            active = _shared(active, rank)
            width *= 2
            self.levels.append((width, rank.copy()))
        if width <= base:
            self.active = active
        self.rank = rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b share."""
        shared = np.zeros(len(a), dtype=np.int64)
        for width, rank in reversed(self.levels):
            shared += width * (rank[a + shared] == rank[b + shared])
        return shared


def _group_starts(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(starts, np.diff(np.append(starts, n)))


def _shared(ordered: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of positions in rank order, those that share their rank."""
    held = rank[ordered]
    same = held[1:] == held[:-1]
    return ordered[np.append(same, False) | np.append(False, same)]


def neighbours_by_level(places: list[int], lcps: list[int], edges: list[int]) -> Iterator[tuple[int, int, int]]:
    """(level, i, j) for positions that become neighbours of a class, ``edges`` by descending LCP.

    ``places`` are positions in suffix order, ``lcps[t]`` is that of places t and t + 1. A pair may come again at a lower level.
    """
    parent, sets = list(range(len(places))), [[p] for p in places]

    def find(t: int) -> int:
        while parent[t] != t:
            parent[t] = parent[parent[t]]
            t = parent[t]
        return t

    after: dict[int, int] = {}
    level = None
    for t in edges:
        if lcps[t] != level:
            for i, j in after.items():
                yield level, i, j
            after, level = {}, lcps[t]
        a, b = find(t), find(t + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        into = sets[a]
        for p in sets[b]:
            k = bisect(into, p)
            into.insert(k, p)
            if k:
                after[into[k - 1]] = p
            if k + 1 < len(into):
                after[p] = into[k + 1]
        parent[b], sets[b] = a, []
    for i, j in after.items():
        yield level, i, j


def runs_of(codes: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, given as word codes; sorted by start, then period."""
    floor = _floor(least, times)
    base = 1 << (floor.bit_length() - 1)
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes  # one separator ahead of each text, one behind the last
    top = 1 + max((int(c.max()) for c in codes if len(c)), default=0)
    total = int(sizes.sum()) + len(codes) + 1
    symbols = np.empty(total, dtype=np.int64)
    symbols[np.append(starts - 1, total - 1)] = np.arange(len(codes) + 1) * (top + 1) + top
    for i, (c, s) in enumerate(zip(codes, starts.tolist())):
        symbols[s : s + len(c)] = c + i * (top + 1)
    found: list[list[tuple[int, int, int]]] = [[] for _ in codes]
    ranks = Ranks(symbols, base)
    if not len(ranks.active):
        return found
    places = ranks.active[np.argsort(ranks.rank[ranks.active])]
    lcps = ranks.common(places[:-1], places[1:])
    edges = np.flatnonzero(lcps >= floor)
    edges = edges[np.lexsort((np.maximum(places[edges], places[edges + 1]), -lcps[edges]))]
    seeds = [
        (i, j, level)
        for level, i, j in neighbours_by_level(places.tolist(), lcps.tolist(), edges.tolist())
        if (times - 1) * (j - i) <= level and j - i + level >= least
    ]
    if not seeds:
        return found
    i, j, level = np.array(sorted(seeds), dtype=np.int64).T
    whole = (symbols[i - 1] != symbols[j - 1]) & (symbols[i + level] != symbols[j + level])
    owner = np.searchsorted(starts, i, "right") - 1
    for text, a, b, n in zip(owner[whole].tolist(), (i - starts[owner])[whole].tolist(), (j - starts[owner])[whole].tolist(), level[whole].tolist()):
        found[text].append((a, b - a + n, b - a))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple:
    """start, length, period, exponent_milli of the run with the most periods; of equal ones the first, then the shortest period."""
    if not runs:
        return None, None, None, None
    start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return start, length, period, 1000 * length // period


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, start bigint, length bigint, period bigint, exponent_milli bigint, collapsed string"


def _finder(least: int, times: int, plant: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch, texts in chunks(batches, "text"):
            if len(known) > CACHE:
                known.clear()
            words = [t.encode().split() for t in texts]  # bytes are split at \x20 and \x09-\x0D only
            if plant:
                names = batch.column("doc_id").to_pylist()
                words = [w if d is None else planted(w, d) for w, d in zip(words, names)]
            for own in words:
                for word in set(own).difference(known):
                    known[word] = len(known)
            codes = [np.fromiter(map(known.__getitem__, own), np.int64, len(own)) for own in words]
            runs = runs_of(codes, least, times)
            best = list(zip(*map(strongest, runs)))
            kept = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)]
            named = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(named, pa.list_(_RUN)), *[pa.array(b, pa.int64()) for b in best], pa.array(kept, pa.string())],
                ["doc_id", "runs", "start", "length", "period", "exponent_milli", "collapsed"],
            )

    return find


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, plant: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, runs, the strongest run's start, length, period and exponent_milli, collapsed.

    A run is a stretch of at least ``least`` words and ``times`` of its smallest period (at least 2) that no neighbouring word
    extends. ``collapsed`` are the words that no run holds behind its first period, joined by one blank. NULL and empty
    texts have no words: no runs, NULL for the strongest, an empty collapsed text. Every row has its own result: equal rows, NULL ids;
    extra columns are ignored; an empty table gives no rows. ``plant`` first makes the texts of ``planted``, none for a NULL id.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return mapped(rows, _finder(least, times, plant), _OUT)


def digested(found: DataFrame) -> DataFrame:
    """``periodic_runs`` with the runs and the collapsed text as SHA-256."""
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
