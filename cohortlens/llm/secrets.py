"""Secret scan with a worklist of decoded layers.

A text is layer 0. Every layer is scanned for secrets, then decoded further: percent escapes, Unicode
and hex escapes, base64 runs and compressed bytes each give a new layer, until nothing new appears. A
layer seen before in the same document is not opened again, so cycles end. Each layer
carries, per character, the part of the original text it came from; a secret found in it is reported
with that span. Spans of layer 0 are the base result and always stay.

One pass over whole texts, one row at a time, without a shuffle. Decoding may inflate: compressed bytes are inflated in
steps and scanned in overlapping pieces of ``PIECE`` bytes, depth first, so that the bound is on memory, not on what is
scanned. The row is flagged ``complete = false`` if one unbroken run is longer than what two pieces share.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlens.llm.common import chunks, mapped

KINDS = ("assign", "access", "hex")
PIECE, OVERLAP, STEP = 64 << 20, 1 << 20, 1 << 16  # bytes of inflated text held at once, shared by two pieces, read at once
DEPTH = 64  # of bytes compressed again and again; a file that holds itself ends there
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # maximal runs: the same as filtering AKIA[A-Z0-9]+ by length
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")  # of either alphabet; which one is told by what a run holds
_ONE_ALPHABET = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
_MARK = re.compile(r"[+/_-]")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_UNBROKEN = re.compile(rb"[!-~\r\n]+")
_HIGH = re.compile(r"%[89A-Fa-f][0-9A-Fa-f]|\\x[89A-Fa-f]|\\u00[89A-Fa-f]|&#")
_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\U000000([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,2});|&#([0-9]{1,3});|\\([abfnrtv\\'\"/0])")
_SHORT = dict(zip("abfnrtv\\'\"/0", "\a\b\f\n\r\t\v\\'\"/\0"))
_HEADER = re.compile(rb"\x1f\x8b\x08|[\x08\x18(8HXhx][\x00-\xff]", re.S)
_NARROW = re.compile(r"[\x00-\xff]{7,}")
_READABLE = bytes(range(32, 127)) + b"\t\r\n"


def secrets_in(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret written plainly in ``text``."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text and, for each of its characters, its span in the original one.

    Without maps a layer is the original text; ``whole`` is the span shared by all characters
    of bytes that were compressed.
    """

    def __init__(self, text: str, starts=None, ends=None, whole=None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def place(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.whole:
            return np.full(end - begin, self.whole[0]), np.full(end - begin, self.whole[1])
        if self.starts is None:
            return np.arange(begin, end), np.arange(begin + 1, end + 1)
        return self.starts[begin:end], self.ends[begin:end]


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of ``pattern`` replaced by ``decode(match)``.

    ``decode`` gives (text, start offset, end offset) pieces or None to leave the match as it is.
    """
    pieces, starts, ends, at = [], [], [], 0
    own_starts = own_ends = None
    for m in pattern.finditer(layer.text):
        parts = decode(m)
        if parts is None:
            continue
        if own_starts is None:
            own_starts, own_ends = layer.place(0, len(layer.text))
        pieces.append(layer.text[at : m.start()])
        starts.append(own_starts[at : m.start()])
        ends.append(own_ends[at : m.start()])
        pieces += [p[0] for p in parts]
        starts.append(own_starts[[m.start() + p[1] for p in parts]])
        ends.append(own_ends[[m.start() + p[2] - 1 for p in parts]])
        at = m.end()
    if own_starts is None:
        return None
    pieces.append(layer.text[at:])
    starts.append(own_starts[at:])
    ends.append(own_ends[at:])
    return Layer("".join(pieces), np.concatenate(starts), np.concatenate(ends))


def _percent(m: re.Match) -> list | None:
    """One piece per character of the escaped bytes; bytes that are no UTF-8 stand for themselves."""
    raw = bytes.fromhex(m.group().replace("%", ""))
    text = raw.decode("utf-8", "replace") if _is_text(raw) else raw.decode("latin-1")
    if len(text) == len(raw):
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(text)]
    parts, at = [], 0
    for c in text:
        size = len(c.encode())
        parts.append((c, 3 * at, 3 * (at + size)))
        at += size
    return parts


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _escape(m: re.Match) -> list | None:
    code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, m.end() - m.start())]


def _compressed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 6 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0)


class _Inflating:
    """Decompressed chunks of gzip members or zlib streams, one after the other; ``used`` bytes belong to those that ended.

    Ends at the first byte that belongs to none; what was inflated before an error is kept.
    """

    def __init__(self, chunks):
        self.chunks, self.ended, self.used = chunks, False, 0

    def __iter__(self) -> Iterator[bytes]:
        machine, fresh, read = zlib.decompressobj(47), True, 0
        for data in self.chunks:
            data = bytes(data)
            read += len(data)
            while data:
                if fresh and self.ended and not (data := data.lstrip(b"\0")):
                    break
                try:
                    out = machine.decompress(data, STEP)
                except zlib.error:
                    return
                fresh = False
                if out:
                    yield out
                data = machine.unconsumed_tail
                if machine.eof:
                    data = machine.unused_data
                    self.ended, self.used = True, read - len(data)
                    machine, fresh = zlib.decompressobj(47), True


def _chain(raw, depth: int) -> _Inflating:
    chunks = _Inflating(raw[i : i + STEP] for i in range(0, len(raw), STEP))
    for _ in range(depth - 1):
        chunks = _Inflating(chunks)
    return chunks


class _State:
    def __init__(self, room: int | None):
        self.room, self.complete = room, True


def _pieces(chunks: _Inflating, state: _State) -> Iterator[bytes]:
    """Overlapping pieces of inflated bytes, no more of them than ``state`` has room for."""
    held, size = [], 0
    for chunk in chunks:
        if state.room is not None:
            if len(chunk) > state.room:
                chunk, state.complete = chunk[: state.room], False
            state.room -= len(chunk)
        held.append(chunk)
        size += len(chunk)
        if size >= PIECE:
            piece = b"".join(held)
            yield piece
            held = [piece[-OVERLAP:]]
            size = len(held[0])
            state.complete &= not _UNBROKEN.fullmatch(held[0])
        if state.room == 0 and not state.complete:
            break
    if size:
        yield b"".join(held)


def _unpacked(raw, whole: tuple[int, int], state: _State) -> tuple[Iterator[Layer] | None, bool, int]:
    """Layers of compressed bytes, whether their stream ends, and its size. None: nothing inflates.

    Bytes may be compressed again; equal heads at two depths are a file that holds itself.
    """
    if not _compressed(raw):
        return None, False, 0
    depth, heads = 0, set()
    while head := next(iter(_chain(raw, depth + 1)), b""):
        depth += 1
        if depth == DEPTH:
            state.complete = False
        if depth == DEPTH or head in heads or not _compressed(head):
            break
        heads.add(head)
    if not depth:
        return None, False, 0
    outer = _chain(raw, 1)
    for chunk in outer:
        if state.room is not None and len(chunk) > state.room:
            outer.ended = True
            break
    pieces = _pieces(_chain(raw, depth), state)
    return (Layer(p.decode("utf-8", "replace"), whole=whole) for p in pieces), outer.ended, outer.used


def _readable(raw: bytes) -> bool:
    """UTF-8 of any script, else nearly all printable: a decoding of ordinary letters by chance is neither."""
    return _is_text(raw) or len(raw) - len(raw.translate(None, _READABLE)) >= 0.9 * len(raw)


def _candidates(text: str, settled: bytearray) -> Iterator[tuple[int, int]]:
    """Places of base64 inside a maximal run, the whole run first.

    A caller that could open a place marks it in ``settled`` and skips the later ones inside it. Those are what follows each mark of the alphabets,
    since paths and names are joined by the same marks, then the parts in one alphabet and those between marks.
    """
    yield 0, len(text)
    marks = [m.start() for m in _MARK.finditer(text)]
    if not marks:
        return
    for at in (-1, *marks):
        if not settled[at + 1 : at + 2].count(1) and (length := _promising(text, at + 1)):
            yield at + 1, at + 1 + length
    if "-" in text or "_" in text:
        for part in _ONE_ALPHABET:
            yield from (m.span() for m in part.finditer(text) if m.end() - m.start() < len(text))
    edges = [-1, *marks, len(text)]
    yield from ((a + 1, b) for a, b in zip(edges, edges[1:]) if b - a > 16)


def _promising(text: str, at: int) -> int:
    """Characters of base64 from a place on that are UTF-8, or all that follow a compressed header; 0 for neither.

    Reads in doubling steps, hence no more than twice what it finds.
    """
    size, left = 24, len(text) - at
    while left >= 16:
        raw = _from64(text[at : at + min(size, left // 4 * 4)].rstrip("=")) or b""
        if size == 24 and _compressed(raw):
            return left
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError as error:
            if error.end < len(raw) or error.reason != "unexpected end of data":
                return error.start // 3 * 4 if error.start >= 12 else 0
        if size >= left:
            return left
        size *= 2
    return 0


def _wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """Lines of one width, the last one not longer, that may be one base64 run; then without the last one."""
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"[^ \t\r\n]+", m.group())]
        at = 0
        while at + 1 < len(lines):
            width, stop = lines[at][1] - lines[at][0], at + 1
            while stop < len(lines) and lines[stop][1] - lines[stop][0] == width:
                stop += 1
            if stop < len(lines) and lines[stop][1] - lines[stop][0] < width:
                yield lines[at : stop + 1]
            if stop - at > 1:
                yield lines[at:stop]
            at = stop


def _opened(layer: Layer, state: _State) -> Iterator[Layer]:
    """Layers inside base64 runs, compressed or not, and inside escaped compressed bytes."""
    done = 0
    joined_runs = []
    for lines in _wrapped(layer.text):
        if lines[0][0] >= done:
            new, whole = _decoded(layer, np.concatenate([np.arange(*line) for line in lines]), state, joined=True)
            if whole:
                done = lines[-1][1]
                joined_runs.append((lines[0][0], done))
                yield from new
    skip = iter([*joined_runs, (len(layer.text) + 1, 0)])
    start_, stop_ = next(skip)
    for m in _BASE64.finditer(layer.text):
        while m.start() >= stop_ and stop_:
            start_, stop_ = next(skip)
        if m.start() >= start_:
            continue
        settled = bytearray(m.end() - m.start())
        for start, end in _candidates(m.group(), settled):
            if settled.find(0, start, end) < 0:
                continue
            new, whole = _decoded(layer, np.arange(m.start() + start, m.start() + end), state)
            yield from new
            if whole:
                settled[start:end] = b"\1" * (end - start)
                if end - start == len(settled):
                    break
    if _HIGH.search(layer.text):
        yield from _escaped(layer, state)


def _decoded(layer: Layer, at: np.ndarray, state: _State, joined: bool = False) -> tuple[Iterator[Layer], bool]:
    """Layers in the base64 at places, and whether they explain all of it. Joined lines must be UTF-8 or inflate to an end."""
    begin, end = int(at[0]), int(at[-1]) + 1
    run = layer.text[begin:end]
    run = ("".join(run.split()) if joined else run).rstrip("=")
    run = run[: len(run) - (len(run) % 4 == 1)]
    if not (raw := _from64(run)):
        return iter(()), False
    new, ended, _ = _unpacked(raw, layer.span(begin, end), state)
    if new is not None:
        return new, ended
    if not (_is_text(raw) if joined else _readable(raw)):
        return iter(()), False
    starts, ends = layer.place(begin, end)
    starts, ends = starts[at - begin], ends[at - begin]
    first = np.arange(len(raw)) * 8 // 6
    last = (np.arange(len(raw)) * 8 + 7) // 6
    text = raw.decode("utf-8", "replace")
    if len(text) != len(raw):  # one place per character, at its first and last byte
        raw_at = np.array([i for i, b in enumerate(raw) if b & 0xC0 != 0x80])
        if len(raw_at) != len(text):
            text, raw_at = raw.decode("latin-1"), np.arange(len(raw))
        stop = np.append(raw_at[1:], len(raw)) - 1
        first, last = first[raw_at], last[stop]
    return iter([Layer(text, starts[first], ends[last])]), True


def _byte(m: re.Match) -> list | None:
    if m[6]:
        return [(_SHORT[m[6]], 0, 2)]
    code = int(m[5]) if m[5] else int(next(g for g in m.groups()[:4] if g), 16)
    return [(chr(code), 0, m.end() - m.start())] if code < 256 else None


def _escaped(layer: Layer, state: _State) -> Iterator[Layer]:
    """Layers in compressed bytes of which all or some are written as escapes; the others stand for themselves."""
    views = []
    if "%" in layer.text:
        views.append(_rewritten(layer, _PERCENT, lambda m: [(chr(int(m.group()[i + 1 : i + 3], 16)), i, i + 3) for i in range(0, len(m.group()), 3)]))
        if "+" in layer.text:  # the form encoding writes blanks so
            plain = Layer(layer.text.replace("+", " "), *layer.place(0, len(layer.text)))
            views.append(_rewritten(plain, _PERCENT, lambda m: [(chr(int(m.group()[i + 1 : i + 3], 16)), i, i + 3) for i in range(0, len(m.group()), 3)]))
    if "\\" in layer.text or "&#" in layer.text:
        views.append(_rewritten(layer, _BYTE, _byte))
    for view in views:
        for m in _NARROW.finditer(view.text) if view else ():
            raw, at = memoryview(m.group().encode("latin-1")), 0
            while head := _HEADER.search(raw, at):
                at = head.start()
                if _compressed(bytes(raw[at : at + 7])):
                    start = m.start() + at
                    new, ended, used = _unpacked(raw[at:], view.span(start, m.end()), state)
                    if new is not None and not ended and len(head.group()) == 3:  # a gzip stream that is cut off
                        ended, used = True, len(raw) - at
                    if ended:
                        whole = view.span(start, start + used)
                        yield from (Layer(x.text, whole=whole) for x in new)
                        at += used
                        continue
                at += 1


def _from64(run: str) -> bytes | None:
    safe = run.translate({45: "+", 95: "/"})
    try:
        return base64.b64decode(safe + "=" * (-len(safe) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _name(layer: Layer) -> bytes:
    """Content and place: equal encodings at two places are both opened, the same one never twice."""
    content = blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16)
    content.update(repr(layer.span(0, 1) if layer.text else 0).encode())
    return content.digest()


def scan(text: str, budget: int | None = None) -> tuple[list, list, int, bool]:
    """(base spans, all spans, layers opened, complete); spans are (start, kind, end), sorted.

    With a ``budget``, compressed layers may hold so many bytes together; without, all of them are scanned.
    """
    base = secrets_in(text)
    spans, state = set(base), _State(budget)
    work = [iter([Layer(text)])]
    seen = set()
    opened = 0
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if (name := _name(layer)) in seen or (opened and not layer.text):
            continue
        seen.add(name)
        if opened:
            for start, kind, end in secrets_in(layer.text):
                first, last = layer.span(start, end)
                spans.add((first, kind, last))
        opened += 1
        work.append(_inner(layer, state))
    return base, sorted(spans), opened - 1, state.complete


def _inner(layer: Layer, state: _State) -> Iterator[Layer]:
    if "%" in layer.text and (new := _rewritten(layer, _PERCENT, _percent)):
        yield new
    if ("\\" in layer.text or "&#" in layer.text) and (new := _rewritten(layer, _UNICODE, _escape)):
        yield new
    yield from _opened(layer, state)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text"):
        rows = []
        for text in texts:
            base, spans, layers, complete = scan(text)
            counts = [sum(s[1] == k for s in base) for k in range(3)]
            rows.append((*counts, sha256(joined(base).encode()).hexdigest(), joined(spans), layers, complete))
        columns = list(zip(*rows))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "complete"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, complete.

    Counts and base_sha256 are of the base spans, ``spans`` lists all as kind:start:end (code
    points of the text, end exclusive) by start, then kind. NULL is the empty text and has no spans. Every row has its
    own result: equal rows, NULL ids; extra columns are ignored; an empty table gives no rows.
    """
    return mapped(
        docs.select("doc_id", "text"),
        _scanned,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, complete boolean",
    )
