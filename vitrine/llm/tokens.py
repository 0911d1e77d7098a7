"""Token ids of whole texts by a public word-level BPE file, in a task.

The tokenizer drops white space and never joins across it, so a text is the
sequence of its words' ids. Words repeat: each is tokenized once per worker and
kept, and a text is the join of kept byte strings. Texts with characters
beyond Latin-1, or control characters on whose being white space the libraries
differ, go through the tokenizer whole; the others only need its merges.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

TOKENIZER = "word_bpe_49k.json"
_APART = re.compile("[\x1c-\x1f\x85\xa0\u0100-\U0010ffff]")
_SLICE = 1 << 20
# Fixed values of the file: its split pattern, for the letters and numbers of Latin-1.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ]+|[0-9²³¹¼-¾]|[^0-9²³¹¼-¾a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """``encode(text)``: ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer: str = TOKENIZER, kept: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer if os.sep in tokenizer else public_tokenizers.path(tokenizer))
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._pairs = self._tokenizer.model
        self._letters = _byte_letters()
        self._kept: dict[str, bytes] = {}
        self._limit = kept

    def _piece(self, piece: str) -> bytes:
        ids = self._kept.get(piece)
        if ids is None:
            found = self._pairs.tokenize("".join(map(self._letters.__getitem__, piece.encode())))
            ids = self._kept[piece] = b"".join(t.id.to_bytes(4, "little") for t in found)
        return ids

    def _words(self, part: str) -> bytes:
        words = part.lower().split()
        kept = self._kept
        try:
            return b"".join(map(kept.__getitem__, words))
        except KeyError:
            pass
        if len(kept) > self._limit:
            kept.clear()
        for word in set(words).difference(kept):
            kept[word] = b"".join(map(self._piece, _PIECE.findall(word)))
        return b"".join(map(kept.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _APART.search(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) <= _SLICE:
            return self._words(text)
        out, at = [], 0
        while at < len(text):  # a very long text goes in slices that end at white space
            end = at + _SLICE
            while end < len(text) and not text[end].isspace():
                end += 1
            out.append(self._words(text[at:end]))
            at = end
        return b"".join(out)


@lru_cache(maxsize=2)
def word_ids(tokenizer: str = TOKENIZER) -> WordIds:
    """The worker's tokenizer; its kept words last from task to task."""
    return WordIds(tokenizer)
