"""Exact k nearest neighbours without pairing everything with everything.

Rows with equal values are first combined to one vector. Vectors lie in the leaves of k-d trees, fitted on a bounded sample: cells of a bounded
number of vectors, each with the box of the columns that all its vectors know. Vectors that miss different columns share a tree as long as it
does not cut along those. Queries that miss the same columns have trees of their own, cut along the columns they know, if they are one of the
``VIEWS`` most frequent kinds and the common trees cut along a column they miss; the others share the common ones. The distance to a box,
scaled by the columns that any vector of the cell can have, is a lower bound for all its vectors. A first visit to the cell a query would lie in
bounds how far a second visit has to look, and only cells whose boxes reach into that bound are visited. Cells and groups of queries have a
bounded size each, and one task compares one with the other by numpy: the cell's vectors in leaves of a small tree, queries that lie together
against the leaves within their reach. Only the k best per query and cell leave the task.

Distances leave out columns that are missing on either side and are scaled up by
(all columns / compared columns).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.project import with_exprs
from cohortlens.operators.lookup import attach
from cohortlens.session import materialize

BLOCK_ROWS = 8_192
LEAF, GROUP = 64, 32  # vectors of a leaf and queries compared together inside a task
PAIRS = 65_536  # distances worked out at a time, so that they stay in a core's cache
LARGE = 1e100  # values whose squares can be added up
KEPT = 1 << 20  # pairs of a task that wait for their exact distance
BATCH, NEAR = 262_144, 256  # queries a task chooses cells for at a time, and those among them that lie together
MAX_CELLS = 20_000  # boxes of this many cells travel to every task: 16 bytes a column each
RARE = 16  # a column that fewer than one in so many vectors know has trees of its own
VIEWS = 8  # kinds of queries with trees of their own, each a copy of the donors
SAMPLE = 200_000  # vectors that the trees are fitted on; they decide how even the cells are, not what is found
FOUND = "qid bigint, target int, distance double, neighbour bigint, value double, vector array<double>"
NUMBER = "nullif(double(`{0}`), double('NaN'))"


def vectors(df: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """Distinct vectors with their k smallest row keys (``ids``), the first of them as ``qid``.

    Only k rows per vector and task reach the window's exchange, however many copies exist.
    """
    doubles = with_exprs(df.select(key, *columns), {c: NUMBER.format(c) for c in columns})
    order = Window.partitionBy(*columns).orderBy(key)
    few = doubles.withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= k)
    grouped = few.groupBy(*columns).agg(F.array_sort(F.collect_list(F.col(key).cast("bigint"))).alias("ids"))
    return grouped.withColumn("qid", F.col("ids")[0])


def _spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are partitions in a shuffle; its rows are small in bytes but dear to compute, and by size they
    would be left to one or two tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("qid"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(y)))
    seen = np.zeros((len(x), len(y)), dtype=np.int32)
    for j in range(x.shape[1]):
        gap = x[:, j, None] - y[None, :, j]
        known = ~np.isnan(gap)
        total += np.where(known, gap * gap, 0.0)
        seen += known
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(seen > 0, np.sqrt(total * (x.shape[1] / seen)), np.inf)


def _k_best(row: np.ndarray, place: np.ndarray, distance: np.ndarray, flat: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, place, distance, id) of the k nearest ids per row; ties go to the smaller id.

    The ids of a place are those of ``flat`` from its start to the next one.
    """
    copies = (starts[1:] - starts[:-1])[place]
    row, place, distance = (np.repeat(a, copies) for a in (row, place, distance))
    within = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    own = flat[starts[place] + within]
    order = np.lexsort((own, distance, row))
    row, place, distance, own = row[order], place[order], distance[order], own[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], place[kept], distance[kept], own[kept]


def _kinds(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    patterns = _pattern(rows)
    for pattern in np.unique(patterns).tolist():
        yield pattern, np.flatnonzero(patterns == pattern)


def _compare(columns: list[str], k: int, per_column: bool):
    """Group function: the k best donor rows per query (and per missing column).

    Queries that miss the same columns are compared together: they ask for the same targets, so that one comparison serves all of them.
    """

    def compare(queries: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []  # query, target, distance, neighbour, place of the donor
        if len(queries) and len(donors):
            x, y = queries[columns].to_numpy(float), donors[columns].to_numpy(float)
            qids, ids = queries["qid"].to_numpy(), donors["ids"].tolist()
            reach = np.nan_to_num(queries["reach"].to_numpy(float), nan=np.inf) * (1 + 1e-9)
            flat, starts = np.concatenate([np.asarray(i) for i in ids]), np.cumsum([0, *map(len, ids)])
            leaves = Leaves(y)
            for wanted, asking in _kinds(x):
                targets = [j for j in range(len(columns)) if not wanted >> j & 1] if per_column else [-1]
                serving = {t: ~np.isnan(y[:, t]) if per_column else np.ones(len(y), dtype=bool) for t in targets}
                serving = {t: has for t, has in serving.items() if has.any()}
                if not wanted or not serving:
                    continue
                for row, place, distance in leaves.near(x[asking], reach[asking], list(serving.values()), k):
                    for target, has in serving.items():
                        fit = has[place]
                        best = _k_best(row[fit], place[fit], distance[fit], flat, starts, k)
                        if len(best[0]):
                            found.append((asking[best[0]], np.full(len(best[0]), target), best[2], best[3], best[1]))
        if not found:
            return pd.DataFrame({"qid": [], "target": [], "distance": [], "neighbour": [], "value": [], "vector": pd.Series([], dtype=object)})
        query, target, distance, own, place = map(np.concatenate, zip(*found))
        return pd.DataFrame(
            {
                "qid": qids[query], "target": target, "distance": distance, "neighbour": own, "value": y[place, target],
                "vector": None if per_column else list(y[place]),
            }
        )

    return compare


class Tree:
    """Cuts of one missing pattern's vectors into leaves, numbered from ``first``."""

    def __init__(self, rows: np.ndarray, known: np.ndarray, leaves: int, first: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # column, value, node at most the value, node above; leaves are -1 - number
        self.first = self.next = first
        self.root = self._grow(rows, np.flatnonzero(known), leaves)

    def _grow(self, rows: np.ndarray, known: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(rows) > 1 and len(known):
            inside = rows[:, known]
            has = ~np.isnan(inside)
            if has.all():
                spread = inside.var(axis=0)
            else:  # of a column that some miss, as far as it is known
                n = has.sum(axis=0)
                off = np.where(has, inside - np.nansum(inside, axis=0) / np.maximum(n, 1), 0.0)
                spread = (off * off).sum(axis=0) / len(rows)
            best = np.argmax(spread)
            column, values, n = known[best], np.sort(inside[:, best]), has[:, best].sum()  # missing ones come last, and lie above a cut
            cut = values[min(n - 1, len(values) * (leaves // 2) // leaves)]
            low = rows[:, column] < cut
            if low.any() and not low.all():
                at = len(self.cuts)
                self.cuts.append((int(column), float(cut), 0, 0))
                below = self._grow(rows[low], known, leaves // 2)
                above = self._grow(rows[~low], known, leaves - leaves // 2)
                self.cuts[at] = (int(column), float(cut), below, above)
                return at
        self.next += 1
        return -self.next

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.full(len(rows), self.root)
        if not self.cuts:
            return -1 - node
        column, value, below, above = (np.array(c) for c in zip(*self.cuts))
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            node[inner] = np.where(rows[inner, column[at]] < value[at], below[at], above[at])
        return -1 - node


class Leaves:
    """Vectors in the leaves of a small tree, to be compared inside a task."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.has = rows, ~np.isnan(rows)
        largest = np.abs(rows[self.has]).max(initial=0.0)
        self.plain = bool(largest < LARGE)  # else infinite, or too large for a square
        if not self.plain:
            return
        self.tree = Tree(rows, np.ones(rows.shape[1], dtype=bool), math.ceil(len(rows) / LEAF), 0)
        leaf = self.tree.place(rows)
        self.order = np.argsort(leaf, kind="stable")
        _, self.first, self.leaf, self.sizes = np.unique(leaf[self.order], return_index=True, return_inverse=True, return_counts=True)
        n = self.has.sum(axis=0)
        self.middle = np.where(self.has, rows, 0.0).sum(axis=0) / np.maximum(n, 1)  # subtracted, so that squares are small and with them what rounding loses
        self.sorted = rows[self.order] - self.middle
        # A column that some vector of a leaf misses has no edges there.
        self.low, self.high = (f.reduceat(self.sorted, self.first) for f in (np.minimum, np.maximum))

    def near(self, x: np.ndarray, reach: np.ndarray, serving: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, place, distance), some rows at a time: for each row of ``x``, which know the same columns, all vectors that can be among its k
        nearest ones that are ``serving``, for each of these masks, within its ``reach``, ties included."""
        known = np.flatnonzero(~np.isnan(x[0]))
        seen = self.has[:, known].sum(axis=1)
        with np.errstate(divide="ignore"):
            scale = x.shape[1] / seen
        if not self.plain or not np.abs(x[:, known]).max() < LARGE:
            step = max(1, PAIRS // len(self.rows))
            for at in range(0, len(x), step):
                far = _distances(x[at : at + step], self.rows)
                row, place = np.nonzero((far <= reach[at : at + step, None]) & np.isfinite(far))
                yield row + at, place, far[row, place]
            return
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for pair in chain(self._pairs(x, known, scale, reach, [s[self.order] for s in serving], k), [None]):
            if pair is not None:
                waiting.append(pair)
            if waiting and (pair is None or len(waiting) % 16 == 0 and sum(len(w[0]) for w in waiting) > KEPT):
                row, place = map(np.concatenate, zip(*waiting))
                waiting.clear()
                row, place = row[seen[place] > 0], place[seen[place] > 0]
                total = np.zeros(len(row))
                for j in known:
                    gap = x[row, j] - self.rows[place, j]
                    total += np.where(np.isnan(gap), 0.0, gap * gap)
                far = np.sqrt(total * scale[place])
                inside = far <= reach[row]
                yield row[inside], place[inside], far[inside]

    def _pairs(self, x: np.ndarray, known: np.ndarray, scale: np.ndarray, reach: np.ndarray, serving: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, place): what ``near`` has to look at. Rows that lie together are compared with the leaves in their reach by one product of
        matrices, whose rounding the limit allows for."""
        has, scale = self.has[np.ix_(self.order, known)], scale[self.order]
        scale = np.where(np.isfinite(scale), scale, 0.0)
        low, high, first, sizes = self.low[:, known], self.high[:, known], self.first, self.sizes
        asking = np.argsort(self.tree.place(x), kind="stable")
        wide = math.sqrt(x.shape[1] / len(known))  # the least scale there is
        x, reach = x[np.ix_(asking, known)] - self.middle[known], reach[asking]
        starts = np.arange(0, len(x), GROUP)
        least, most = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        y = np.where(has, self.sorted[:, known], 0.0)
        squares = y * y
        x2, serving = x * x, [s & (scale > 0) for s in serving]
        fine = 1e-14 * self.rows.shape[1] * len(known) * (x2.sum(axis=1).max() + squares.sum(axis=1).max())
        coarse = 1e-14 * self.rows.shape[1] * max(np.abs(x).max(), np.abs(y).max())
        # scaled squares of distances: (x, x squared, 1) times these
        factors = np.vstack([-2 * y.T, has.T, squares.sum(axis=1)]) * scale
        x = np.hstack([x, x2, np.ones((len(x), 1))])
        for at, start in enumerate(starts.tolist()):
            some = slice(start, start + GROUP)
            gap = np.maximum(np.nan_to_num(np.maximum(low - most[at], least[at] - high)), 0.0)
            apart = np.sqrt((gap * gap).sum(axis=1)) * wide
            limit = reach[some]
            if not np.isfinite(limit).all() and len(y) > k:
                away = np.nan_to_num(low + high - (least[at] + most[at]))
                nearest = np.lexsort(((away * away).sum(axis=1), apart))
                few = nearest[: np.searchsorted(np.cumsum(sizes[nearest]), max(4 * k, 16 * LEAF)) + 1]
                there = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in few])
                far, best = x[some] @ factors[:, there], np.zeros(len(limit))
                for mask in serving:
                    fit = np.flatnonzero(mask[there])
                    here = far[:, fit] if len(fit) >= k else x[some] @ factors[:, mask]
                    best = np.maximum(best, np.partition(here, k - 1, axis=1)[:, k - 1] if here.shape[1] >= k else np.inf)
                limit = np.minimum(limit, np.sqrt(best + fine))
            limit = limit * (1 + 1e-12) + coarse
            there = np.flatnonzero((apart <= limit.max())[self.leaf])
            row, place = np.nonzero(x[some] @ factors[:, there] <= (limit * limit + fine)[:, None])
            yield asking[start + row], self.order[there[place]]


def _bits(columns: list[str]):
    return sum((F.when(F.col(c).isNull(), 0).otherwise(1 << i) for i, c in enumerate(columns)), F.lit(0)).cast("bigint")


def _pattern(rows: np.ndarray) -> np.ndarray:
    """The known columns of each row as bits."""
    return (~np.isnan(rows)) @ (1 << np.arange(rows.shape[1], dtype=np.int64))


class View(NamedTuple):
    """Trees for one kind of queries, by what their vectors know of the columns in ``cut``; rows of each, and the first bucket of all."""

    kind: int
    cut: int
    trees: dict[int, Tree]
    rows: dict[int, int]
    first: int


class Cells:
    """Donor vectors in cells, and the cells that a query has to be compared with.

    ``kinds`` are the known columns, as bits, of queries that get trees of their own.
    """

    def __init__(self, donors: DataFrame, columns: list[str], block_rows: int, kinds: tuple[int, ...] = ()):
        self.columns, self.block_rows, self.compared = columns, block_rows, 0
        everything = (1 << len(columns)) - 1
        sizes = dict(donors.groupBy(_bits(columns)).agg(F.count(F.lit(1))).collect())  # one row per missing pattern
        total = sum(sizes.values())
        kinds = tuple(q for q in kinds if q != everything)
        wide = max(block_rows, math.ceil((len(kinds) + 1) * total / max(1, MAX_CELLS - len(sizes) * (len(kinds) + 1))))
        share = F.pmod(F.xxhash64("qid"), F.lit(max(1, math.ceil(total / SAMPLE)))) == 0
        sample = np.array(donors.filter(share).select(*columns).collect(), dtype=float).reshape(-1, len(columns))
        own, first = _pattern(sample), 0
        counts = {j: sum(n for p, n in sizes.items() if p >> j & 1) for j in range(len(columns))}
        rare = sum(1 << j for j, n in counts.items() if n * RARE < total)

        def serves(patterns, kind: int):
            """Whether vectors share a column with a kind of queries, and have one that it misses."""
            return (patterns & kind != 0) & ((patterns & ~kind != 0) | (kind == everything))

        def grow(kind: int) -> View:
            """Vectors share a tree if they know the same of the columns that are cut, and of those that few vectors know."""
            nonlocal first
            cut, usual = rare, first
            while True:
                first, trees, rows = usual, {}, {}
                for pattern, n in sorted(sizes.items()):
                    if serves(pattern, kind):
                        rows[pattern & cut] = rows.get(pattern & cut, 0) + n
                mine = serves(own, kind)
                for group, n in sorted(rows.items()):
                    known = np.array([kind >> j & 1 == 1 and (not cut >> j & 1 or group >> j & 1 == 1) for j in range(len(columns))])
                    trees[group] = Tree(sample[mine & (own & cut == group)], known, math.ceil(n / wide), first)
                    first = trees[group].next
                more = cut
                for tree in trees.values():
                    for column, *_ in tree.cuts:
                        more |= 0 if all(p >> column & 1 for p in sizes if serves(p, kind)) else 1 << column
                if more == cut:
                    return View(kind, cut, trees, rows, usual)
                cut = more

        views = [grow(everything)]
        for kind in kinds:
            # Trees of its own would be the common ones again, unless those cut along a column that it misses.
            if any(not kind >> column & 1 for tree in views[0].trees.values() for column, *_ in tree.cuts):
                views.append(grow(kind))
        self.views, self.patterns = views, sizes

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = batch[columns].to_numpy(float)
                patterns = _pattern(rows)
                for view in views:
                    fit, groups = serves(patterns, view.kind), patterns & view.cut
                    for group in np.unique(groups[fit]).tolist():
                        mine = fit & (groups == group)
                        yield batch[mine].assign(bucket=view.trees[group].place(rows[mine]).astype(np.int32))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in donors.schema)
        placed = materialize(_spread(donors).mapInPandas(put, f"{schema}, bucket int"))
        edges = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max), ("known", F.count))]
        self.sizes = materialize(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("vectors"), *edges))
        rows = self.sizes.orderBy("bucket").collect()  # MAX_CELLS rows at most
        boxes = np.array(rows, dtype=float).reshape(-1, 2 + 3 * len(columns))
        self.bucket, self.vectors, self.known = boxes[:, 0].astype(np.int64), boxes[:, 1], boxes[:, 4::3]
        # A column that some vector of a cell misses has no edges there.
        always = self.known == self.vectors[:, None]
        self.low, self.high = (np.where(always, boxes[:, at::3], np.nan) for at in (2, 3))
        self.sizes = self.sizes.select("bucket", "vectors", F.ceil(F.col("vectors") / (2 * block_rows)).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")
        self.placed = placed.join(F.broadcast(self.sizes), "bucket").withColumn("part", part).drop("parts", "vectors")

    def near(self, queries: DataFrame, k: int, per_column: bool) -> DataFrame:
        """(qid, reach, columns, bucket): per query the cell it would lie in, for each missing column one that has it if ``per_column``."""
        return self._chosen(queries, k, per_column, False)

    def within(self, queries: DataFrame, k: int, per_column: bool) -> DataFrame:
        """The same for all other cells that reach within ``reach`` of the query; NULL is without bound."""
        return self._chosen(queries, k, per_column, True)

    def _solid(self, k: int) -> np.ndarray:
        """For each cell the next one in number, of the same tree, that holds k vectors for every column its tree has; itself if none does."""
        out = np.arange(len(self.bucket))
        for view in self.views:
            for tree in view.trees.values():
                mine = np.arange(*np.searchsorted(self.bucket, [tree.first, tree.next]))
                known = self.known[mine]
                full = mine[(self.vectors[mine] >= k) & ((known >= k) | (known.sum(axis=0) == 0)).all(axis=1)]
                if len(full):
                    after = np.minimum(np.searchsorted(full, mine), len(full) - 1)
                    out[mine] = full[after]
        return out

    def _chosen(self, queries: DataFrame, k: int, per_column: bool, second: bool) -> DataFrame:
        columns, views = self.columns, self.views
        kinds = [v.kind for v in views]
        stops = np.searchsorted(self.bucket, [*[v.first for v in views], np.iinfo(np.int32).max])
        bucket, low, high, has, solid = self.bucket, self.low, self.high, self.known > 0, self._solid(k)

        def homes(rows: np.ndarray, view: View, pattern: int) -> list[np.ndarray]:
            """The cells of the first visit: for each target the leaf of a row in the largest tree that serves it. No leaf is empty."""
            found = {}
            for target in [1 << j for j in range(len(columns)) if not pattern >> j & 1] if per_column else [0]:
                serving = [g for g in view.trees if (g & pattern or pattern & ~view.cut) and g & target == target & view.cut]
                if serving and (best := max(serving, key=lambda g: (view.rows[g], -g))) not in found:
                    found[best] = solid[np.searchsorted(bucket, view.trees[best].place(rows))]
            return list(found.values())

        def wanted(rows: np.ndarray, pattern: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(row, cell), for rows that know the columns of ``pattern``."""
            view = kinds.index(pattern) if pattern in kinds else 0
            cells = np.arange(stops[view], stops[view + 1])
            first = homes(rows, views[view], pattern)
            if not second:
                return np.tile(np.arange(len(rows)), len(first)), np.concatenate([np.empty(0, dtype=np.int64), *first])
            known = (pattern >> np.arange(len(columns))) & 1 == 1
            useful = has[cells][:, known].any(axis=1) & (has[cells][:, ~known].any(axis=1) if per_column else True)
            cells = cells[useful]
            order = np.argsort(first[0], kind="stable") if first else np.arange(len(rows))
            found = []
            for at in range(0, len(rows) if len(cells) else 0, NEAR):
                some = order[at : at + NEAR]
                part, bound = rows[some], reach[some]
                # a box around all these rows leaves out most cells for all of them
                least, most = part.min(axis=0), part.max(axis=0)
                near = cells[_apart_boxes(least, most, low[cells], high[cells], has[cells]) <= bound.max()]
                for step in range(0, len(near), MAX_CELLS):
                    few = near[step : step + MAX_CELLS]
                    bounds = _bounds(part, low[few], high[few], has[few])
                    row, cell = np.nonzero(np.isfinite(bounds) & (bounds <= bound[:, None]))
                    row, cell = some[row], few[cell]
                    new = np.ones(len(row), dtype=bool)
                    for home in first:
                        new &= home[row] != cell
                    found.append((row[new], cell[new]))
            return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, dtype=np.int64),) * 2

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in _gathered(batches, BATCH):
                rows, reach = batch[columns].to_numpy(float), batch["reach"].to_numpy(float)
                reach = np.where(np.isnan(reach), np.inf, reach * (1 + 1e-9))
                for pattern, mine in _kinds(rows):
                    row, cell = wanted(rows[mine], pattern, reach[mine])
                    for at in range(0, len(row), BATCH):
                        some = mine[row[at : at + BATCH]]
                        yield batch.iloc[some][["qid", "reach", *columns]].assign(bucket=bucket[cell[at : at + BATCH]].astype(np.int32))

        schema = "qid bigint, reach double, " + ", ".join(f"`{c}` double" for c in columns) + ", bucket int"
        asking = queries if second else queries.withColumn("reach", F.lit(None).cast("double"))
        return _spread(asking).mapInPandas(choose, schema)

    def visit(self, queries: DataFrame, k: int, per_column: bool) -> DataFrame:
        """Compare (qid, reach, columns, bucket) with the vectors of that cell; what lies beyond ``reach`` is left out."""
        asked = materialize(queries.groupBy("bucket").agg(F.count(F.lit(1)).alias("queries")))
        slots = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Few queries are cut into smaller groups, each with a copy of its cell, so that there is work for all tasks.
        chunk_rows = min(self.block_rows, max(1, self.block_rows // 8, (asked.agg(F.sum("queries")).first()[0] or 0) // (2 * slots)))
        plan = materialize(
            self.sizes.join(asked, "bucket").select(
                "bucket", "parts", F.ceil(F.col("queries") / chunk_rows).cast("int").alias("chunks"),
                (F.col("queries") * F.col("vectors")).alias("pairs"),
            )
        )
        groups, pairs = plan.agg(F.sum(F.col("parts") * F.col("chunks")), F.sum("pairs")).first()
        groups, self.compared = groups or 1, self.compared + (pairs or 0)
        plan = plan.drop("pairs")
        chunk = F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int")
        left = queries.join(F.broadcast(plan), "bucket").withColumn("chunk", chunk)
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = self.placed.join(F.broadcast(plan), "bucket")
        right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        group = ["bucket", "part", "chunk"]
        asking = [*group, "qid", "reach", *self.columns]
        giving = [*group, "qid", "ids", *self.columns]
        # The groups are small in bytes but dear to compute: a stated number of tasks keeps
        # them from being merged into few tasks by size.
        tasks = min(4 * slots, groups)
        # toDF gives new column ids: both sides may come from one table.
        left = left.select(*asking).toDF(*asking).repartition(tasks, *group)
        right = right.select(*giving).repartition(tasks, *group)
        return (
            left.groupBy(*group)
            .cogroup(right.groupBy(*group))
            .applyInPandas(_compare(self.columns, k, per_column), FOUND)
        )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid", "target").orderBy("distance", "neighbour")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _bounds(rows: np.ndarray, low: np.ndarray, high: np.ndarray, has: np.ndarray) -> np.ndarray:
    """For each row and box the least distance of the row to anything in the box; inf where they share no column.

    Only columns that all vectors of the box know (those with edges) count; the scale is that of all columns that any of them ``has``.
    """
    total = np.zeros((len(rows), len(low)))
    seen = (~np.isnan(rows)).astype(float) @ has.T.astype(float)
    for j in range(rows.shape[1]):
        x = rows[:, j, None]
        gap = np.maximum(np.maximum(low[None, :, j] - x, x - high[None, :, j]), 0.0)
        total += np.where(np.isnan(gap), 0.0, gap * gap)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(seen > 0, np.sqrt(total * (rows.shape[1] / seen)), np.inf)


def _apart_boxes(least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray, has: np.ndarray) -> np.ndarray:
    """``_bounds`` for all rows between ``least`` and ``most``, which know the same columns."""
    total = np.zeros(len(low))
    seen = has.astype(float) @ (~np.isnan(least)).astype(float)
    for j in range(len(least)):
        gap = np.maximum(np.maximum(low[:, j] - most[j], least[j] - high[:, j]), 0.0)
        total += np.where(np.isnan(gap), 0.0, gap * gap)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(seen > 0, np.sqrt(total * (len(least) / seen)), np.inf)


def _gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they have ``rows`` rows."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= rows:
            yield pd.concat(waiting, ignore_index=True)
            waiting.clear()
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def frequent_kinds(queries: DataFrame, columns: list[str]) -> tuple[int, ...]:
    """The known columns of the most frequent kinds of queries, as bits."""
    counts = queries.groupBy(_bits(columns).alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")
    return tuple(r["kind"] for r in counts.limit(VIEWS).collect())


def nearest(
    queries: DataFrame, donors: DataFrame, columns: list[str], k: int, per_column: bool = False,
    block_rows: int = BLOCK_ROWS, cells: Cells | None = None,
) -> DataFrame:
    """(qid, target, distance, neighbour, value, place) for query vectors among donor vectors.

    With ``per_column`` each missing column of a query is a target of its own and only
    donors that have the column count. The result is exact: the second visit covers every
    cell that could hold a nearer row than the first visit found.
    """
    cells = cells or Cells(donors, columns, block_rows, frequent_kinds(queries, columns) if per_column else ())
    asked = queries.select("qid", *columns)
    first = materialize(_best(cells.visit(materialize(cells.near(asked, k, per_column)), k, per_column), k).drop("place"))

    missing = " + ".join(f"int({c} IS NULL)" for c in columns)
    wanted = F.expr(missing) if per_column else F.lit(1)
    per_target = first.groupBy("qid", "target").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    bound = per_target.filter(F.col("n") >= k).groupBy("qid").agg(
        F.count(F.lit(1)).alias("full"), F.max("far").alias("reach")
    )
    bounded = asked.join(bound, "qid", "left").withColumn(
        "reach", F.when(F.col("full") >= wanted, F.col("reach"))
    )
    second = cells.visit(materialize(cells.within(bounded.select("qid", *columns, "reach"), k, per_column)), k, per_column)
    return _best(first.unionByName(second), k)


def _keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    return with_exprs(df, {"vector": f"array({', '.join(NUMBER.format(c) for c in columns)})"})


def knn_impute(
    df: DataFrame, key: str, columns: list[str], k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fill each missing value with the mean over the k nearest rows that have the column.

    A column without any value becomes 0; a row that shares no column with any donor gets
    the column mean.
    """
    found = df.agg(*[F.expr(f"avg({NUMBER.format(c)})").alias(c) for c in columns]).first()
    empty = [c for c in columns if found[c] is None]
    data = with_exprs(df, {c: "0D" if c in empty else NUMBER.format(c) for c in columns})
    donors = materialize(vectors(data, key, columns, k))
    holes = " OR ".join(f"`{c}` IS NULL" for c in columns)
    queries = donors.filter(holes)
    filled = nearest(queries, donors, columns, k, True, block_rows)
    means = filled.groupBy("qid").agg(
        *[F.avg(F.when(F.col("target") == j, F.col("value"))).alias(f"fill_{c}") for j, c in enumerate(columns)]
    )
    table = _keyed(queries, columns).select("qid", "vector").join(means, "qid").drop("qid")
    # Only rows with holes look anything up; the others stay where they are.
    joined = attach(_keyed(data.filter(holes), columns), table, "vector")
    joined = joined.unionByName(data.filter(f"NOT ({holes})"), allowMissingColumns=True)
    return with_exprs(
        joined, {c: f"coalesce(`{c}`, `fill_{c}`, {float(found[c] or 0.0)!r}D)" for c in columns}
    ).select(*df.columns)


def row_neighbours(
    df: DataFrame, key: str, columns: list[str], k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every row with ``neighbours``: distance, id and vector of its k nearest other rows."""
    points = materialize(vectors(df, key, columns, k + 1))
    found = nearest(points, points, columns, k + 1, False, block_rows)
    listed = found.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("distance", F.col("neighbour").alias("id"), "vector"))).alias("near")
    )
    table = _keyed(points, columns).select("qid", "vector").join(listed, "qid").drop("qid")
    joined = attach(_keyed(df, columns), table, "vector")
    others = F.filter("near", lambda n: n["id"] != F.col(key))
    return joined.withColumn("neighbours", F.slice(others, 1, k)).select(*df.columns, "neighbours")
