"""Language of web pages by Bayesian fusion of text, markup, address and host.

Text: character trigrams, hashed to ``BUCKETS``, with per-language frequencies counted over all
labelled documents. Markup: the declared language, whose reliability is a table of declared against
text-based languages. Address: the language code in the path and the suffix of the host, likewise. Host: what
the texts of the host's other pages say, smoothed towards its domain, that towards its suffix, that towards all
pages (Dirichlet smoothing at each level). All of these are grouped aggregations of soft counts, in whole millionths, so
that sums do not depend on their order; a page's own text does not count in its host's prior.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import chunks, lists, mapped, small, stored

BUCKETS = 1 << 14
LEAST_GRAMS = 1000  # trigrams of labelled text, about a page, that make a language, however many others have
HELD = 100  # languages whose counts a task holds before it passes them on
STRENGTH = 8.0  # pages that the parent of a host, domain or suffix counts as
TEXT_WEIGHT = 0.2  # of the text's log-likelihood: its trigrams overlap, so they are no independent evidence
BROADCAST_HOSTS = 200_000
UNIT = 1_000_000

_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})\b|<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_ADDRESS = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)[^/?#]*(?:/([a-z]{2,3})(?=[/?#.-]|$))?")


def visible(page: str) -> str:
    """Text of a page without scripts, styles, comments and tags."""
    return markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def trigram_counts(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS) counts of hashed trigrams of lower-cased letters; other characters are one blank."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int32)
    for row, text in zip(out, texts):
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
        letters = ((codes >= 97) & (codes <= 122)) | ((codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ((codes < 0x2000) | (codes > 0x206F)))
        codes = np.where(letters, codes, 32).astype(np.uint64)
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        if len(codes) > 2:
            mixed = (codes[:-2] * np.uint64(0x10001) + codes[1:-1]) * np.uint64(0x10001) + codes[2:]
            places = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
            row += np.bincount(places.astype(np.int64), minlength=BUCKETS).astype(np.int32)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}

    def passed_on():
        for name, counts in sums.items():
            bucket = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bucket), pa.string()), pa.array(bucket), pa.array(counts[bucket])], ["language", "bucket", "n"])
        sums.clear()

    for batch, texts in chunks(batches, "text", 500_000):
        own: dict = {}
        for text, name in zip(texts, batch.column("lang").to_pylist()):
            own.setdefault(name, []).append(text)
        for name, said in own.items():
            sums[name] = sums.get(name, 0) + trigram_counts(["  ".join(said)])[0].astype(np.int64)
            if len(sums) >= HELD:
                yield from passed_on()
    yield from passed_on()


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probability per language and bucket) from all documents (text, lang).

    A language takes BUCKETS numbers (128 KiB) here and in each Python worker.
    """
    rows = mapped(docs.filter("lang IS NOT NULL").select("text", "lang"), _count, "language string, bucket bigint, n bigint")
    rows = stored(rows.groupBy("language", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    each = rows.groupBy("language").agg(F.sum("n").alias("grams"), F.collect_list(F.struct("bucket", "n")).alias("counts"))
    each = each.filter(F.col("grams") >= LEAST_GRAMS).select("language", F.col("counts.bucket").alias("bucket"), F.col("counts.n").alias("n"))
    found = {}
    for r in each.toLocalIterator():
        counts = np.full(BUCKETS, 0.5)
        counts[np.array(r["bucket"])] += np.array(r["n"])
        found[r["language"]] = np.log(counts / counts.sum())
    languages = sorted(found)
    return languages, np.array([found[name] for name in languages]).reshape(len(languages), BUCKETS)


def parts_of(page: str, url: str) -> tuple[str, str, str, str, str]:
    """Declared language, path language, host, domain and suffix; empty where there is none."""
    declared = _DECLARED.search(page)
    address = _ADDRESS.match(url)
    host = (address[1] or "").lower().rstrip(".") if address else ""
    labels = host.split(".")
    return (
        (declared[1] or declared[2] or "").lower() if declared else "",
        (address[2] or "").lower() if address else "",
        host, ".".join(labels[-2:]), labels[-1],
    )


def posteriors(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return scores / scores.sum(1, keepdims=True)


def _reading(languages: list[str], model: np.ndarray):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in chunks(batches, "html", 300_000):
            counts = trigram_counts([visible(p) for p in pages])
            text = posteriors(TEXT_WEIGHT * (counts @ model.T))
            rows = [parts_of(p, u or "") for p, u in zip(pages, batch.column("url").to_pylist())]
            known = set(languages)
            columns = [list(c) for c in zip(*rows)]
            columns[0] = [c if c in known else "other" if c else "" for c in columns[0]]
            columns[1] = [c if c in known else "" for c in columns[1]]
            arrays = [pa.array(c, pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *arrays, pa.array(counts.sum(1), pa.int64()), lists(np.round(text * UNIT).astype(np.int64))],
                ["page_id", "declared", "path", "host", "domain", "suffix", "n_grams", "says"],
            )

    return read


_READ = "page_id bigint, declared string, path string, host string, domain string, suffix string, n_grams bigint, says array<bigint>"


def _sums(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Soft counts per key as an array, and their total. Only the languages that a page may have are added up."""
    said = rows.select(*keys, F.posexplode("says").alias("i", "amount")).filter("amount > 0")
    one = said.groupBy(*keys, "i").agg(F.sum("amount").alias("amount"))
    known = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "amount"))).alias("known"))
    places = F.sequence(F.lit(0), F.lit(n - 1))
    said = F.transform(places, lambda i: F.coalesce(F.try_element_at("known", i), F.lit(0)) / F.lit(float(UNIT)))
    return known.select(*keys, said.alias("said")).withColumn("all", F.aggregate("said", F.lit(0.0), lambda a, x: a + x))


def _smoothed(said, total, parent):
    return F.zip_with(said, parent, lambda s, p: (s + STRENGTH * p) / (total + STRENGTH))


def host_priors(rows: DataFrame, n: int) -> DataFrame:
    """(host, said, all, parent): soft counts of each host and the smoothed prior of its domain."""
    even = F.array_repeat(F.lit(1.0 / n), n)
    every = _sums(rows, n).select(_smoothed(F.col("said"), F.col("all"), even).alias("root")).first()
    root = F.array(*[F.lit(p) for p in (every["root"] if every and every["root"] else [1.0 / n] * n)])
    suffixes = _sums(rows, n, "suffix").select("suffix", _smoothed(F.col("said"), F.col("all"), root).alias("up"))
    domains = _sums(rows, n, "suffix", "domain").join(small(suffixes, BROADCAST_HOSTS), "suffix")
    domains = stored(domains.select("domain", _smoothed(F.col("said"), F.col("all"), F.col("up")).alias("parent")), "domains")
    hosts = _sums(rows, n, "domain", "host").join(small(domains, BROADCAST_HOSTS), "domain")
    return stored(hosts.select("host", "said", "all", "parent"), "hosts")


def reliability(rows: DataFrame, column: str, languages: list[str]) -> DataFrame:
    """(column, weight per language): log P(value | language) for its values, from soft counts; at most languages + 2 values."""
    n = len(languages)
    found = {r[column]: np.array(r["said"]) for r in _sums(rows, n, column).collect()}
    values = sorted({*found, *languages, "", "other"})
    table = np.array([found.get(v, np.zeros(n)) for v in values])
    prior = np.array([[2.0 if v == name else 0.5 if v == "" else 0.1 for name in languages] for v in values])
    table = np.log((table + prior) / (table + prior).sum(0))
    return rows.sparkSession.createDataFrame(list(zip(values, table.tolist())), f"{column} string, {column}_says array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, lang, confidence, text_lang, declared, path, host, n_grams.

    lang has the highest posterior (the alphabetically first of equal ones), confidence is its value; text_lang is what the
    text alone says. NULL url or html is empty and leaves the other evidence; without any, the prior of all pages
    decides. declared is "other" for languages without a model: those with fewer than LEAST_GRAMS labelled trigrams. Every row has its own result: equal
    rows, NULL ids; extra columns are ignored. Without labelled documents lang is NULL; no pages give no rows.
    """
    languages, model = text_model(docs)
    n = len(languages)
    if not n:
        empty = [F.lit(None).cast("string").alias(c) for c in ("lang", "text_lang", "declared", "path", "host")]
        return pages.select("page_id", *empty, F.lit(None).cast("double").alias("confidence"), F.lit(0).cast("bigint").alias("n_grams"))
    read = mapped(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), _reading(languages, model), _READ)
    rows = stored(read, "pages")
    hosts = host_priors(rows, n)
    out = rows.join(small(hosts, BROADCAST_HOSTS), "host")
    for column in ("declared", "path"):
        out = out.join(F.broadcast(reliability(rows, column, languages)), column)

    def score(i):
        own = F.get("says", i) / F.lit(float(UNIT))
        prior = (F.get("said", i) - own + STRENGTH * F.get("parent", i)) / (F.col("all") - 1 + STRENGTH)
        text = F.log(F.greatest(own, F.lit(1e-6))) + F.log(F.greatest(prior, F.lit(1e-9)))
        return text + F.get("declared_says", i) + F.get("path_says", i)

    names = F.array(*[F.lit(name) for name in languages])
    out = out.withColumn("scores", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), score)).withColumn("best", F.array_max("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return out.select(
        "page_id",
        F.get(names, (F.array_position("scores", F.col("best")) - 1).cast("int")).alias("lang"),
        (1 / total).alias("confidence"),
        F.get(names, (F.array_position("says", F.array_max("says")) - 1).cast("int")).alias("text_lang"),
        "declared", "path", "host", "n_grams",
    )
