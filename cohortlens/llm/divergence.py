"""Quality rules: plain counts, and the distance of a document from its language's usual histograms.

References are learned from the corpus: per language, the mean share of each character class and of each
common word over all documents. Two passes over the text: one adds the shares up (grouped by
language and word), one compares. A text is rejected if its Jensen-Shannon distance to the reference of its language is
too large in either histogram; a histogram of too few characters or words is not judged, nor is one without a reference.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.charclass import CLASSES, class_counts
from cohortlens.llm.common import chunks, mapped, small, stored

LEAST_WORDS, REPEATED_PERCENT = 20, 30  # base rules
COMMON_SHARE = 0.002  # of a language's words: makes a common word; hence at most 500 a language
LEAST_TEXTS = 20  # judged texts that make a reference; documents of a language with fewer are not compared
MIN_CHARS, MIN_WORDS = 200, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.5
BROADCAST_TEXTS = 200_000
HELD = 200_000  # partial sums a task holds before it passes them on

UNIT = 1_000_000  # shares are added as whole millionths, so sums don't depend on their order
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
EDGES = b".,;:!?\"'()[]{}-#*$%&|<>"
_SPACE = CLASSES.index("space")


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
        total ^= total >> np.uint64(29)
    _, inverse, counts = np.unique(total, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, found = set(), 0
    if "\n" not in text:
        return 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            found += line in seen
            seen.add(line)
    return found


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    in_words = len(text) - sum(text.count(c) for c in WHITE)
    return len(words), in_words, sum(text.count(c) for c in SYMBOLS), repeated_lines(text), repeated_words(words)


def common_form(words: list[bytes]) -> list[bytes]:
    """Words as they are looked up: lower-cased A-Z, without marks at their ends."""
    return [w.strip(EDGES) for w in b" ".join(words).lower().split(b" ")] if words else []


def _class_shares(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes other than white space, and the number of characters they are of."""
    counts = class_counts(texts)
    counts[:, _SPACE] = 0
    sizes = counts.sum(1)
    return counts / np.maximum(sizes, 1)[:, None], sizes


def _summing():
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = defaultdict(int)

        def passed_on():
            keys = list(sums)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                       pa.array([k[2] for k in keys], pa.binary()), pa.array(list(sums.values()), pa.int64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, ["language", "kind", "name", "amount"])

        for batch, texts in chunks(batches, "text"):
            shares, sizes = _class_shares(texts)
            for i, (text, lang) in enumerate(zip(texts, batch.column("lang").to_pylist())):
                if lang is None:
                    continue
                if sizes[i] >= MIN_CHARS:
                    for name, share in zip(CLASSES, shares[i]):
                        if share:
                            sums[lang, "class", name.encode()] += round(share * UNIT)
                    sums[lang, "class texts", b""] += 1
                words = common_form(text.encode().split())
                if len(words) >= MIN_WORDS:
                    counted: dict = defaultdict(int)
                    for word in words:
                        counted[word] += 1
                    for word, n in counted.items():
                        sums[lang, "word", word] += n * UNIT // len(words)
                    sums[lang, "word texts", b""] += 1
            if len(sums) > HELD:
                yield passed_on()
        yield passed_on()

    return add_up


def references(docs: DataFrame) -> dict:
    """Per language with enough judged texts, its class shares and common words with shares.

    At most 1 / COMMON_SHARE words a language reach the driver.
    """
    summed = mapped(docs.select("text", "lang"), _summing(), "language string, kind string, name binary, amount bigint")
    summed = stored(summed.groupBy("language", "kind", "name").agg(F.sum("amount").alias("amount")), "shares")
    texts = summed.filter("kind IN ('class texts', 'word texts')").filter(F.col("amount") >= LEAST_TEXTS)
    texts = stored(texts.select("language", F.split_part("kind", F.lit(" "), F.lit(1)).alias("kind"), F.col("amount").alias("texts")), "texts")
    common = F.expr("kind = 'class'") | (F.col("amount") >= COMMON_SHARE * UNIT * F.col("texts"))
    usual = summed.join(small(texts, BROADCAST_TEXTS), ["language", "kind"]).filter(common).collect()
    found: dict = {}
    for r in sorted(usual, key=lambda r: (r["language"], r["kind"], r["name"])):
        place = found.setdefault(r["language"], {"classes": np.zeros(len(CLASSES)), "words": {}})
        if r["kind"] == "class":
            place["classes"][CLASSES.index(r["name"].decode())] = r["amount"]
        elif r["name"]:
            place["words"][bytes(r["name"])] = r["amount"] / (UNIT * r["texts"])
    for place in found.values():
        place["classes"] /= max(place["classes"].sum(), 1)
    return found


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits: 0 for equal, 1 for disjoint histograms."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(p > 0, p * np.log2(p / m), 0).sum()
        two = np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (one + two) / 2)))


def distances(text_classes: np.ndarray, size: float, words: list[bytes], reference: dict | None) -> tuple[float | None, float | None]:
    """Distance of the class histogram and of the common-word histogram; None where too short or unknown."""
    by_class = by_word = None
    if reference and size >= MIN_CHARS and reference["classes"].any():
        by_class = js_distance(text_classes, reference["classes"])
    if reference and len(words) >= MIN_WORDS and reference["words"]:
        usual = reference["words"]
        own = dict.fromkeys(usual, 0)
        for word in words:
            if word in own:
                own[word] += 1
        p = np.fromiter(own.values(), float, len(own)) / len(words)
        q = np.fromiter(usual.values(), float, len(usual))
        by_word = js_distance(np.append(p, 1 - p.sum()), np.append(q, max(0.0, 1 - q.sum())))
    return by_class, by_word


def _judge(found: dict):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            shares, sizes = _class_shares(texts)
            rows = []
            for i, (text, lang) in enumerate(zip(texts, batch.column("lang").to_pylist())):
                words = text.encode().split()
                n, *others = base_counts(text, words)
                reference = found.get(lang)
                by_class, by_word = distances(shares[i], sizes[i], common_form(words), reference)
                failed = n < LEAST_WORDS or 100 * others[-1] > REPEATED_PERCENT * n
                fits = (by_class or 0) <= MAX_CLASS_DISTANCE and (by_word or 0) <= MAX_WORD_DISTANCE
                rows.append((n, *others, failed, not failed and fits, by_class, by_word))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], [f.split()[0] for f in _SCHEMA.split(", ")])

    return judge


_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, class_distance double, word_distance double"
)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): the base counts, base_failed, kept and both distances.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated 8-word windows. kept: not
    base_failed, and no distance above its limit; a distance is NULL, and passes, for fewer than 200
    characters or 60 words, a NULL lang, and a language with fewer than 20 texts of that size. NULL is the empty text, which fails.
    Every row has its own result: equal rows, NULL ids; extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return mapped(docs, _judge(references(docs)), _SCHEMA)
