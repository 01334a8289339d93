"""Near-duplicate components: banded MinHash candidates, odd-sketch estimates, exact confirmation.

A document is the set of its distinct word n-grams. MinHash samples serve twice: bands of them
name the buckets in which candidates meet, and all of them are folded into an odd sketch (Mitzenmacher,
Pagh and Pham, 2014), a bitmap in which each sample toggles one bit. The population count of the XOR
of two sketches estimates a high similarity closely, so nearly all false candidates fall
before any full set is fetched. What remains is confirmed on the full sets.

No bucket is expanded into all pairs. First each member meets the bucket's smallest document only
(a star); the confirmed links give components. Then only members that lie outside the largest
component of their bucket meet the rest of that bucket, so no link between different texts is lost to the star.
That join holds the length bound, the estimate of a larger sketch, and an exact bound from lone shingles, those no other document still
in question has: they are never shared, which rules out most pairs of a large family of edited copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import chunks, lists, mapped, ragged, small, stored
from cohortlens.llm.graph import components

BANDS, ROWS, BITS = 40, 6, 1024
FINE_SAMPLES, FINE_BITS = 1536, 4096  # of the second look at the documents still in question
SPREAD = 6.0  # standard deviations of the estimate below the limit that are still confirmed
CACHE = 200_000  # word hashes kept by a task; a full cache is emptied, with no effect on results
BROADCAST_IDS = 2_000_000  # document ids (16 MB) that may be broadcast; more are shuffled


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(count: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(texts: list[str], width: int, cache: dict) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    A-Z are lower-cased and words are runs without ASCII white space, which is what ``bytes``
    methods do to UTF-8. A text of fewer words than ``width`` has one shingle of all its words.
    """
    if len(cache) > CACHE:
        cache.clear()
    factors, found = _factors(width, 7), []
    for text in texts:
        words = text.encode().lower().split()
        for word in set(words).difference(cache):
            cache[word] = xxhash.xxh3_64_intdigest(word)
        codes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = min(width, len(words))
        size = len(words) - n + 1 if n else 0
        total = np.full(size, n, np.uint64)
        for i in range(n):
            total = _mix(total + codes[i : i + size] * factors[i])
        found.append(np.unique(total))
    return found


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps, as rows of 64-bit words: sample i of a row toggles the bit its hash names."""
    n, k = samples.shape
    places = _mix(samples ^ _factors(k, 99)[None, :]) % np.uint64(bits)
    flat = (places + np.arange(n, dtype=np.uint64)[:, None] * np.uint64(bits)).astype(np.int64).ravel()
    odd = (np.bincount(flat, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def max_difference(threshold: float, samples: int, bits: int = BITS, spread: float = SPREAD) -> int:
    """The most differing sketch bits of a pair that may still reach ``threshold``.

    From the estimate J = 1 + bits / (4 samples) * ln(1 - 2 x / bits), at ``spread`` standard
    deviations of the sample below the threshold.
    """
    least = threshold - spread * math.sqrt(threshold * (1 - threshold) / samples)
    return math.ceil(bits / 2 * (1 - math.exp(-(1 - least) * 4 * samples / bits)))


def _samples(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """MinHash samples, one row per set; zeros for an empty one."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sets), len(factors)), np.uint64)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for i, factor in enumerate(factors):
            out[full, i] = np.minimum.reduceat(flat * factor, starts)
    return out


def _band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(samples), bands), np.uint64)
    for i in range(rows):
        keys = _mix(keys + samples[:, i::rows])
    return _mix(keys + _factors(bands, 3)[None, :]).view(np.int64)


def _signer(width: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        factors = _factors(bands * rows, 1)
        for batch, texts in chunks(batches, "text"):
            sets = shingle_sets(texts, width, cache)
            samples = _samples(sets, factors)
            keys = _band_keys(samples, bands, rows)
            digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists(keys), lists(odd_sketch(samples))],
                ["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    return sign


def _setter(width: int, bands: int, rows: int):
    """Full sets; with ``bands`` also the band keys and the larger sketch."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        factors, coarse = _factors(FINE_SAMPLES, 5), _factors(bands * rows, 1)
        for batch, texts in chunks(batches, "text"):
            found = shingle_sets(texts, width, cache)
            columns = {"id": batch.column("doc_id"), "items": ragged(np.concatenate(found).view(np.int64), [len(s) for s in found])}
            if bands:
                columns["bands"] = lists(_band_keys(_samples(found, coarse), bands, rows))
                columns["sketch"] = lists(odd_sketch(_samples(found, factors), FINE_BITS))
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return sets


def _close(a: str, b: str, threshold: float, samples: int, bits: int):
    """Length bound and sketch estimate of two rows with n_shingles and sketch."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    x, y = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    differing = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(bits // 64)), F.lit(0))
    return (100 * F.least(na, nb) >= round(100 * threshold) * F.greatest(na, nb)) & (
        differing <= max_difference(threshold, samples, bits)
    )


def confirm(docs: DataFrame, pairs: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    pairs = stored(pairs, "candidates")
    ends = [pairs.select(F.col(c).alias("doc_id")).distinct() for c in ("a", "b")]
    sets = _full_sets(docs, stored(ends[0].union(ends[1]).distinct(), "ids"), width)
    one, two = sets.toDF("a", "items_a"), sets.toDF("b", "items_b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - shared
    limit = round(100 * threshold)
    return pairs.join(one, "a").join(two, "b").filter(100 * shared >= limit * union).select("a", "b")


def _full_sets(docs: DataFrame, ids: DataFrame, width: int, bands: int = 0, rows: int = 0) -> DataFrame:
    texts = docs.join(small(ids, BROADCAST_IDS), "doc_id", "left_semi").select("doc_id", "text")
    return mapped(texts, _setter(width, bands, rows), "id bigint, items array<bigint>" + ", bands array<bigint>, sketch array<bigint>" * bool(bands))


def with_lone(sets: DataFrame) -> DataFrame:
    """doc_id, n_shingles, bands, sketch and lone: the shingles that no other row has, 0 where a doc_id has several rows."""
    owned = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    lone = owned.filter("n = 1").groupBy("id").agg(F.count("*").alias("lone"))
    single = sets.groupBy("id").count().filter("count = 1").select("id")
    rows = sets.select("id", F.size("items").cast("bigint").alias("n_shingles"), "bands", "sketch")
    return rows.join(lone.join(single, "id"), "id", "left").fillna(0, "lone").withColumnRenamed("id", "doc_id")


def _possible(a: str, b: str, threshold: float):
    """Lone shingles widen the union and are never shared."""
    both = [(F.col(f"{t}.lone"), F.col(f"{t}.n_shingles") - F.col(f"{t}.lone")) for t in (a, b)]
    lone = both[0][0] + both[1][0]
    return 100 * F.least(both[0][1], both[1][1]) >= round(100 * threshold) * (F.greatest(both[0][1], both[1][1]) + lone)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of at least ``threshold`` Jaccard
    similarity of word ``width``-grams (a whole shorter text is one), kept is doc_id = component_id.
    A text without words, or NULL, has 0 shingles and no links. Rows that share a doc_id are one
    node; a row with a NULL doc_id has no links, a NULL component_id and is kept. Equal texts are
    one node from the start. Extra columns are ignored; an empty table gives no rows. At similarity
    0.8 the 40 bands of 6 miss a link with probability 5e-6, above it with less.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = stored(
        mapped(
            docs,
            _signer(width, bands, rows),
            "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>",
        ),
        "signed",
    )
    named = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "classes")
    heads = stored(
        named.join(classes.select("digest", "doc_id"), ["digest", "doc_id"], "left_semi").select("doc_id", "n_shingles", "bands", "sketch"),
        "heads",
    )
    entries = heads.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).filter("pivot < last")
    members = stored(entries.join(shared.drop("last"), "bucket"), "members")

    facts = heads.select("doc_id", "n_shingles", "sketch")
    one = facts.select(F.col("doc_id").alias("a"), F.struct("n_shingles", "sketch").alias("x"))
    two = facts.select(F.col("doc_id").alias("b"), F.struct("n_shingles", "sketch").alias("y"))
    tried = members.filter("doc_id != pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = tried.join(one, "a").join(two, "b").filter(_close("x", "y", threshold, bands * rows, BITS)).select("a", "b")
    links = stored(confirm(docs, star, threshold, width), "links")
    found = stored(components(links), "components")

    label = found.select(F.col("node").alias("doc_id"), "component")
    placed = stored(
        members.join(label, "doc_id", "left").select("band", "bucket", "doc_id", "pivot", F.coalesce("component", "doc_id").alias("component")), "placed"
    )
    parts = placed.groupBy("bucket", "component").count()
    mixed = parts.groupBy("bucket").agg(
        F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("parts")
    ).filter("parts > 1")
    open_rows = stored(placed.join(mixed.select("bucket", "main"), "bucket"), "open")
    in_question = stored(open_rows.select("doc_id").distinct(), "ids")
    sets = stored(_full_sets(docs, in_question, width, bands, rows), "sets")
    open_rows = stored(open_rows.join(with_lone(sets), "doc_id"), "open")
    p = open_rows.filter("component != main").alias("p")
    q = open_rows.alias("q")
    other = F.expr("p.component != q.component AND (q.component = q.main OR p.doc_id < q.doc_id)")
    fresh = F.expr("NOT (p.doc_id = p.pivot OR q.doc_id = q.pivot)")  # the star tried those
    first = sum((F.expr(f"int(p.band > {i} AND p.bands[{i}] = q.bands[{i}])") for i in range(bands - 1)), F.lit(0)) == 0  # of their buckets
    rest = p.join(q, (F.col("p.bucket") == F.col("q.bucket")) & other & fresh & first & _possible("p", "q", threshold) & _close("p", "q", threshold, FINE_SAMPLES, FINE_BITS))
    rest = rest.select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b")).distinct()
    more = stored(confirm(docs, rest, threshold, width), "links")
    if more.limit(1).count():
        found = stored(components(links.unionByName(more)), "components")

    heads_of = found.select(F.col("node").alias("head"), "component")
    by_digest = classes.select("digest", F.col("doc_id").alias("head")).join(heads_of, "head", "left")
    by_digest = by_digest.select("digest", F.coalesce("component", "head").alias("component"))
    result = signed.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 AND doc_id IS NOT NULL"), F.col("digest")).alias("digest"))
    result = result.join(by_digest, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
