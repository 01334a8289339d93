"""Re-Pair grammar compression of token ids (Larsson and Moffat, 1999), in batched rounds.

Each round counts all adjacent pairs and replaces the frequent ones by new symbols, the more frequent first where
they overlap; a pair never spans two documents. The last round leaves no pair that is frequent. A rule keeps its two symbols and its
expansion length, so any document, or any range of its tokens, decodes without the others.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

LEAST = 4  # occurrences that make a pair frequent: a rule takes the place of some three symbols
HASH_BITS = 20


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size, one after the other."""
    places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    places += np.arange(len(places))
    return places


class Grammar:
    """``left`` and ``right`` per rule; symbol ``base + k`` stands for rule k, lower ones are ids. ``lengths`` are the rules' expansion
    lengths, worked out unless given."""

    def __init__(self, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray | None = None):
        self.base, self.left, self.right = base, left, right
        if lengths is None:
            found: list[int] = []
            for a, b in zip(left.tolist(), right.tolist()):  # a rule's symbols come before it
                found.append((found[a - base] if a >= base else 1) + (found[b - base] if b >= base else 1))
            lengths = np.array(found, dtype=np.int64)
        self.lengths = lengths

    @cached_property
    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All expansions one after the other, those of the ids first, and where each symbol's starts."""
        size = np.concatenate([np.ones(self.base, dtype=np.int64), self.lengths])
        starts = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), dtype=np.int64)
        flat[: self.base] = np.arange(self.base)
        known, rest = np.arange(len(size)) < self.base, np.arange(len(self.left))
        while len(rest):  # a layer: all rules whose two symbols are expanded
            ready = known[self.left[rest]] & known[self.right[rest]]
            layer, rest = rest[ready], rest[~ready]
            rules, left, right = self.base + layer, self.left[layer], self.right[layer]
            for symbols, places in ((left, starts[rules]), (right, starts[rules] + size[left])):
                flat[_spread(places, size[symbols])] = flat[_spread(starts[symbols], size[symbols])]
            known[rules] = True
        return flat, starts

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Expansion length of each symbol."""
        return np.where(symbols < self.base, 1, np.append(self.lengths, 1)[np.minimum(np.maximum(symbols - self.base, 0), len(self.lengths))])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of many symbols, by way of the expansions of all rules."""
        flat, starts = self._expansions
        return flat[_spread(starts[symbols], self.sizes(symbols))]

    def unfold(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of few symbols, by the rules that these use only."""
        while len(rules := np.flatnonzero(symbols >= self.base)):
            own = symbols[rules] - self.base
            out = np.repeat(symbols, np.where(symbols >= self.base, 2, 1))
            at = rules + np.arange(len(rules))
            out[at], out[at + 1] = self.left[own], self.right[own]
            symbols = out
        return symbols

    def part(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop of a document; lengths tell which symbols hold them, and only these are unfolded."""
        ends = np.cumsum(self.sizes(symbols))
        stop = min(stop, int(ends[-1]) if len(ends) else 0)
        if start >= stop:
            return np.zeros(0, dtype=np.int64)
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        before = int(ends[first - 1]) if first else 0
        return self.unfold(symbols[first : last + 1])[start - before : stop - before]


def _hashed(codes: np.ndarray, bits: int) -> np.ndarray:
    hashed = codes * np.uint64(0x9E3779B97F4A7C15)
    hashed >>= np.uint64(64 - bits)
    return hashed.view(np.int64)


def _frequent(likely: np.ndarray, least: int) -> np.ndarray:
    """The codes that occur at least ``least`` times, the most frequent first."""
    likely = np.sort(likely)
    edges = np.flatnonzero(np.append(True, likely[1:] != likely[:-1]))
    counts = np.diff(np.append(edges, len(likely)))
    often = np.flatnonzero(counts >= least)
    return likely[edges[often[np.argsort(-counts[often], kind="stable")]]]


class _Sequence:
    """The symbols as a doubly linked list over the places of the ids; a replaced pair stays at its left place."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        n = len(ids)
        place = np.int32 if n < (1 << 31) - 2 else np.int64  # half the memory, and half of what goes through the cache
        self.symbol = ids.astype(np.uint32)
        self.next, self.before = np.arange(1, n + 1, dtype=place), np.arange(-1, n - 1, dtype=place)
        self.last = np.zeros(n + 1, dtype=bool)  # of its document; no pair begins there
        self.last[np.cumsum(sizes)[sizes > 0] - 1] = True
        self.alive = np.ones(n + 1, dtype=bool)
        self.alive[n] = False
        self.rank = np.full(n + 2, n + 2, dtype=place)  # of the pair at a place; n + 2: not to be replaced now

    def chosen(self, places: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of sorted places those whose pairs are replaced: no two overlap.

        A pair goes if its rank is lower than that of the pairs it overlaps; in a run of one pair every other one goes.
        """
        self.rank[places] = rank
        before = self.before[places]
        ahead, behind = self.rank[before], self.rank[self.next[places]]
        taken = (rank <= ahead) & (rank <= behind)
        same = np.flatnonzero((before[1:] == places[:-1]) & (ahead[1:] == rank[1:])) + 1  # all but the first of each run
        first = np.append(True, same[1:] != same[:-1] + 1)[: len(same)]
        taken[same[(same - same[first][np.cumsum(first) - 1]) % 2 == 0]] = False
        self.rank[places] = len(self.rank)
        return np.flatnonzero(taken)

    def replace(self, places: np.ndarray, symbols: np.ndarray) -> None:
        right = self.next[places]
        self.symbol[places] = symbols
        self.last[places] = self.last[right]
        self.alive[right] = False
        behind = self.next[right]
        self.next[places] = behind
        inside = behind < len(self.before)
        self.before[behind[inside]] = places[inside]


def compress(ids: np.ndarray, sizes: np.ndarray, base: int, least: int = LEAST):
    """(symbols, symbols per document, Grammar) of consecutive documents of the given sizes.

    ``base`` is above all ids. Ends when no pair occurs ``least`` times (2 at least). Empty input gives no rules. A pair that is not
    frequent can never become so, hence a round looks at the pairs that were likely to be in the one before and at those
    with a new symbol.
    """
    n, lefts, rights, known = len(ids), [], [], 0
    lengths = np.ones(base + n, dtype=np.int64)  # of every symbol's expansion
    row = _Sequence(ids, sizes)
    width = np.uint64(base + n + 1)  # there are fewer rules than ids
    places = np.flatnonzero(~row.last[:n])
    while len(places):
        codes = row.symbol[places] * width  # 64 bits, as width is
        codes += row.symbol[row.next[places]]
        pairs = _frequent(codes, least)
        if not len(pairs):
            break
        bits = min(HASH_BITS, len(pairs).bit_length() + 6)
        table = np.full(1 << bits, -1, dtype=np.int32)
        table[_hashed(pairs, bits)[::-1]] = np.arange(len(pairs))[::-1]  # of two in one bucket the rarer waits for the next round
        guess = table[_hashed(codes, bits)]
        likely = np.flatnonzero(guess >= 0)
        places, codes, guess = places[likely], codes[likely], guess[likely]
        sure = pairs[guess] == codes
        spots, rank = places[sure], guess[sure]
        taken = row.chosen(spots, rank)
        pair = rank[taken]
        worth = np.bincount(pair, minlength=len(pairs)) >= 2
        worth[0] = True  # the most frequent one, so that every round replaces something
        taken = taken[worth[pair]]
        spots, pair = spots[taken], rank[taken]
        used = np.bincount(pair, minlength=len(pairs)) > 0
        lefts.append((pairs[used] // width).astype(np.int64))
        rights.append((pairs[used] % width).astype(np.int64))
        row.replace(spots, (base + known + np.cumsum(used) - 1)[pair].astype(np.uint32))
        lengths[base + known : base + known + len(lefts[-1])] = lengths[lefts[-1]] + lengths[rights[-1]]
        known += len(lefts[-1])
        fresh = np.concatenate([spots, row.before[spots]])  # -1 is the spare place at the end
        if 16 * (len(places) + len(fresh)) < n:
            places = np.sort(np.concatenate([places, fresh]))
            places = places[np.append(True, places[1:] != places[:-1])]
            places = places[(places >= 0) & row.alive[places] & ~row.last[places]]
        else:
            again = np.zeros(n + 1, dtype=bool)
            again[places] = again[fresh] = True
            places = np.flatnonzero(again & row.alive & ~row.last)
    empty = np.zeros(0, dtype=np.int64)
    grammar = Grammar(base, np.concatenate([empty, *lefts]), np.concatenate([empty, *rights]), lengths[base : base + known])
    ends = np.append(0, np.cumsum(row.alive[:n]))[np.cumsum(sizes)] if len(sizes) else empty
    return row.symbol[row.alive[:n]].astype(np.int64), np.diff(np.append(0, ends)), grammar


def packed(symbols: np.ndarray, bits: int) -> bytes:
    """The symbols one after the other, ``bits`` bits each (32 at most), lowest bit first."""
    planes = np.unpackbits(symbols.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpacked(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Symbols start to stop of ``packed`` data, reading only the bytes that hold them."""
    first = start * bits // 8
    held = np.frombuffer(data, np.uint8, (stop * bits + 7) // 8 - first, first)
    flat = np.unpackbits(held, bitorder="little")[start * bits - 8 * first :][: (stop - start) * bits]
    planes = np.zeros((stop - start, 32), np.uint8)
    planes[:, :bits] = flat.reshape(stop - start, bits)
    return np.packbits(planes.reshape(-1), bitorder="little").view("<u4").astype(np.int64)
