"""Whole texts to ids of a byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

LONG = 20_000  # characters; shorter texts hold no run of white space that is too long for the faster library
_BLANKS = re.compile(r"\s{1000}")


class ByteEncoder:
    """Ids as the ``tokenizers`` library gives them for ``path``, without special tokens added, closed by ``end_id``.

    ``ranks`` is the same vocabulary for ``tiktoken``, which gives the same ids several times faster. Texts that hold the string of
    a special token, or runs of white space it cannot take, go to ``tokenizers``.
    """

    def __init__(self, path: str, ranks: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as file:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.width = 2 if max(end_id, *self.plain.get_vocab(True).values()) < 1 << 16 else 4
        self.kind, self.end = f"<u{self.width}", end_id

    def encode(self, text: str) -> np.ndarray:
        """Little-endian ids of a text, ``width`` bytes each, the end id last."""
        if any(s in text for s in self.special) or len(text) > LONG and _BLANKS.search(text):
            ids = self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(self.end)
        return np.array(ids, dtype=self.kind)
