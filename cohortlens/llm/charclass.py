"""Character classes of texts, counted with array operations."""

from __future__ import annotations

import numpy as np

CLASSES = ("lower", "upper", "digit", "space", "stop", "loud", "symbol", "bar", "mark", "other")
_TABLE = 0x250  # Latin letters with their extensions; beyond, every character is "other"


def _class_of(char: str) -> int:
    if char.islower():
        name = "lower"
    elif char.isupper():
        name = "upper"
    elif char.isdigit():
        name = "digit"
    elif char.isspace():
        name = "space"
    elif char in ".,;:?'\"-":
        name = "stop"
    elif char == "!":
        name = "loud"
    elif char in "#*$%&<>":
        name = "symbol"
    elif char == "|":
        name = "bar"
    elif char.isprintable() and ord(char) < 128:
        name = "mark"
    else:
        name = "other"
    return CLASSES.index(name)


_LOOKUP = np.array([_class_of(chr(i)) for i in range(_TABLE)] + [CLASSES.index("other")], dtype=np.int64)


def class_counts(pieces: list[str]) -> np.ndarray:
    """One row of counts per piece, one column per class."""
    n, width = len(pieces), len(CLASSES)
    if not n:
        return np.zeros((0, width))
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64) * width, [len(p) for p in pieces])
    places = owner + _LOOKUP[np.minimum(codes, _TABLE)]
    return np.bincount(places, minlength=n * width).reshape(n, width).astype(float)


def bounded_class_counts(pieces: list[str], chars: int = 1 << 20) -> np.ndarray:
    """The same in steps of about ``chars`` characters, a longer piece in several, so that memory follows the step."""
    out = np.zeros((len(pieces), len(CLASSES)))
    first = size = 0
    for i, piece in enumerate(pieces):
        size += len(piece)
        if size >= chars or i + 1 == len(pieces):
            if len(piece) < chars:
                out[first : i + 1] = class_counts(pieces[first : i + 1])
            else:
                out[first:i] = class_counts(pieces[first:i])
                out[i] = sum(class_counts([piece[at : at + chars]])[0] for at in range(0, len(piece), chars))
            first, size = i + 1, 0
    return out
