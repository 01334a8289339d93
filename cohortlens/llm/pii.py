"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Strict patterns give the base spans, which always stay. Looser patterns add candidates (written-out
addresses, national phone numbers, other separators). On every candidate five labelers vote for, against, or not at all:
pattern, gazetteer, context words, shape and checksum. Expectation-maximisation over the counts of vote patterns
(Dawid and Skene, 1979) estimates how reliable each labeler is, per kind, without any labelled data; its
posteriors are the soft targets of a logistic span classifier over votes and surroundings, whose
verdict adds candidates to the base spans.

One pass over whole texts finds the candidates and is written; they are few. What reaches the driver are
counts per combination of votes and binned surroundings, whose number is bounded by the bins
(``COMBINATIONS``), whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import chunks, mapped, stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape", "checksum")
BINS = (4, *[3] * len(LABELERS), 4, 4, 4)  # kind, votes, character before, character after, length
COMBINATIONS = int(np.prod(BINS))

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov int io co info biz eu de fr es it uk us ca au nl be ch at se no dk fi pl pt br in jp cn ru".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
                 "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90",
                 "91", "92", "93", "94", "95", "98", "212", "213", "216", "234", "254", "351", "352", "353", "354", "358", "359", "370",
                 "371", "372", "380", "385", "386", "420", "421", "852", "886", "966", "971", "972")
CARD_PREFIX = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6(?:011|5|4[4-9])|35(?:2[89]|[3-8])|3(?:0[0-5]|[68])")
CUES = (
    re.compile(r"mail|contact|write|reach|kontakt|correo|courriel|schreib", re.I),
    re.compile(r"\bip\b|address|server|host|login|client|adresse|direcci", re.I),
    re.compile(r"card|visa|master|amex|payment|karte|tarjeta|carte|credit", re.I),
    re.compile(r"phone|\btel|call|fax|mobil|cell|whatsapp|anruf|llam|appel", re.I),
)
AGAINST = re.compile(r"version|isbn|issn|\bdoi\b|order|invoice|serial|sha|hash|token|build|figure|table|page|chapter|ticket|\bno\.|\bid\b", re.I)

_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]+\s?[\(\[\{]\s?at\s?[\)\]\}]\s?[A-Za-z0-9-]+(?:\s?(?:[\(\[\{]\s?dot\s?[\)\]\}]|\.)\s?[A-Za-z0-9-]+)+", re.I)
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20./_ ‑–-]?[0-9]){12,18}(?![0-9])")
_LOOSE_PHONE = re.compile(
    r"(?<![0-9+.])(?:00[1-9][0-9\x20().-]{7,18}[0-9]|\(?[0-9]{3,5}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4})(?![0-9])")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of name@domain, found from the @ outwards."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _NAME.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _digits(piece: str) -> str:
    return "".join(c for c in piece if "0" <= c <= "9")


def _octets(piece: str) -> bool:
    """Whether all dotted numbers are at most 255, whatever their leading zeros; int() refuses long runs of digits."""
    parts = [p.lstrip("0") for p in piece.split(".")]
    return all(len(p) < 4 and int(p or 0) < 256 for p in parts)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), sorted; matches that fail their check are dropped without a retry."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def candidates(text: str, base: list) -> list[tuple[int, int, int]]:
    """Spans of the looser patterns that overlap no base span."""
    found = []
    if any(c in text for c in "([{"):
        found += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    if text.count(":") > 6:
        found += [(1, *m.span()) for m in _LONG_IP.finditer(text)]
    if _DIGIT.search(text):
        found += [(2, *m.span()) for m in _LOOSE_CARD.finditer(text)]
        found += [(3, *m.span()) for m in _LOOSE_PHONE.finditer(text)]
    if not base or not found:
        return found
    taken = np.array(sorted((a, b) for _, a, b in base))
    ends = np.maximum.accumulate(taken[:, 1])
    before = np.searchsorted(taken[:, 0], [b for _, _, b in found]) - 1  # the last base span that starts ahead of the end
    return [(kind, a, b) for (kind, a, b), i in zip(found, before.tolist()) if i < 0 or ends[i] <= a]


def _gazetteer(kind: int, piece: str) -> int:
    if kind == 0:
        return 1 if re.split(r"[^A-Za-z0-9-]+", piece.rstrip(" )]}"))[-1].lower() in TOP_DOMAINS else -1
    if kind == 1:
        return -1 if piece.startswith(("0.", "255.", "127.")) else 0
    digits = _digits(piece)
    if kind == 2:
        return 1 if CARD_PREFIX.match(digits) else -1
    codes = digits if piece.startswith("+") else digits[2:] if digits.startswith("00") else ""
    return 1 if codes.startswith(CALLING_CODES) else 0


def _checksum(kind: int, piece: str) -> int:
    if kind == 0:
        return 1 if len(piece) <= 254 and ".." not in piece else -1
    if kind == 1:
        parts = piece.split(".") if "." in piece else []
        return -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
    if kind == 2:
        return 1 if luhn(_digits(piece)) else -1
    return 1 if 9 <= len(_digits(piece)) <= 15 else -1


def _side(char: str) -> int:
    return 0 if not char or char.isspace() else 1 if char.isalnum() else 2 if char in ".,;:!?)(\"'" else 3


def combination(text: str, kind: int, a: int, b: int, strict: bool) -> int:
    """The votes and binned surroundings of a span as one number below ``COMBINATIONS``."""
    piece, near = text[a:b], text[max(0, a - 48) : a]
    before, after = _side(text[a - 1 : a]), _side(text[b : b + 1])
    cue, against = CUES[kind].search(near), AGAINST.search(near)
    votes = (
        1 if strict else 0,
        _gazetteer(kind, piece),
        1 if cue and not against else -1 if against and not cue else 0,
        -1 if before == 1 or after == 1 else 1 if before != 3 and after != 3 else 0,
        _checksum(kind, piece),
    )
    code = 0
    for size, value in zip(BINS, (kind, *(v + 1 for v in votes), before, after, min(3, (b - a) // 10))):
        code = code * size + value
    return code


def unpacked(code: np.ndarray) -> np.ndarray:
    """The bins of combination numbers, one row each."""
    return np.stack(np.unravel_index(np.asarray(code, dtype=np.int64), BINS), axis=1)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern and P(vote | truth) per labeler: EM with a light prior.

    ``votes`` are 0 (against), 1 (none), 2 (for). Starts from the share of votes for; the prior
    says that a labeler is right more often than wrong, which also settles which class is which.
    """
    posterior = ((votes == 2).sum(1) + 0.5) / ((votes != 1).sum(1) + 1)
    prior = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # truth no, yes
    for _ in range(rounds):
        tables = np.empty((votes.shape[1], 2, 3))
        for j in range(votes.shape[1]):
            for truth, weight in enumerate((1 - posterior, posterior)):
                row = np.bincount(votes[:, j], weights=counts * weight, minlength=3) + prior[truth]
                tables[j, truth] = row / row.sum()
        share = (counts @ posterior + 1) / (counts.sum() + 2)
        odds = np.log(share) - np.log(1 - share)
        odds = odds + sum(np.log(tables[j, 1, votes[:, j]]) - np.log(tables[j, 0, votes[:, j]]) for j in range(votes.shape[1]))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, tables


def _features(bins: np.ndarray) -> np.ndarray:
    """One-hot votes and surroundings, and a constant."""
    parts = [np.eye(size)[bins[:, i + 1]] for i, size in enumerate(BINS[1:])]
    return np.column_stack([*parts, np.ones(len(bins))])


def classifier(codes: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """Probability of being personal data for each combination seen, by a logistic model per kind."""
    bins, out = unpacked(codes), {}
    for kind in range(len(KINDS)):
        own = np.flatnonzero(bins[:, 0] == kind)
        if not len(own):
            continue
        weight = counts[own] / counts[own].sum()
        target, _ = reliabilities(bins[own, 1 : 1 + len(LABELERS)], counts[own].astype(float))
        x = _features(bins[own])
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (weight * (target - p)) - 1e-3 * w
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w = w + np.clip(np.linalg.solve(bend, slope), -2, 2)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        out |= {int(codes[i]): float(v) for i, v in zip(own, p)}
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for kind, a, b in spans)


_FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, kinds array<int>, starts array<bigint>, ends array<bigint>, strict array<boolean>, codes array<bigint>"


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text"):
        rows = []
        for text in texts:
            base = base_spans(text)
            loose = candidates(text, base)
            every = sorted([(*s, True) for s in base] + [(*s, False) for s in loose])
            codes = [combination(text, *s) for s in every]
            columns = list(zip(*every)) or [(), (), (), ()]
            counts = [sum(s[0] == k for s in base) for k in range(4)]
            rows.append((*counts, sha256(joined(base).encode()).hexdigest(), *map(list, columns), codes))
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
        names = [f.split()[0] for f in _FOUND.split(", ")]
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and base_sha256 are of the base spans; ``spans`` lists all as kind:start:end (code points,
    end exclusive) by kind, then start. NULL is the empty text and has no spans. Every row has its own
    result: equal rows, NULL ids; extra columns are ignored; an empty table gives no rows.
    """
    found = stored(mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _finder, f"doc_id bigint, {_FOUND}"), "pii")
    seen = found.select(F.explode("codes").alias("code")).groupBy("code").count().collect()  # at most COMBINATIONS rows
    seen = sorted((r["code"], r["count"]) for r in seen)
    chances = classifier(np.array([c for c, _ in seen], dtype=np.int64), np.array([n for _, n in seen])) if seen else {}
    good = F.array(*[F.lit(c) for c, p in sorted(chances.items()) if p >= 0.5 and unpacked([c])[0, 1] < 2]).cast("array<bigint>")
    spans = F.arrays_zip("kinds", "starts", "ends", "strict", "codes")
    chosen = F.filter(spans, lambda s: s["strict"] | F.array_contains(good, s["codes"]))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("chosen", lambda s: F.concat_ws(":", F.get(names, s["kinds"]), s["starts"], s["ends"])), ",")
    out = found.withColumn("chosen", chosen)
    n_base = F.size(F.filter("strict", lambda s: s))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), (F.size("chosen") - n_base).cast("bigint").alias("n_added")
    )
