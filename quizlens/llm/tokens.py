"""Byte-level BPE in tasks, with a bounded cache of words."""

from __future__ import annotations

import json
import re

import numpy as np

#: Code points that some tokenizer or Python takes for white space (fixed values).
_SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
           "    　")
_ASCII_PAIRS = [c + " " for c in _SPACES if c.isascii()]
_OTHER_PAIRS = [c + " " for c in _SPACES if not c.isascii()]
_CUT = re.compile(rf"(?<=[^{re.escape(_SPACES)}])(?= )")
CACHE = 400_000     #: words in each of the two generations of the cache
_LONGEST = 48       #: longer words are not cached
_NO_TEXT = "<|no text|>"  # tiktoken looks for special tokens at every place if there are none; this one is never allowed


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for 256 onwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


class _Words(dict):
    """Word -> ids of space + word, as little-endian 32-bit integers."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead, self.old = encode, lead, {}

    def __missing__(self, w: str) -> bytes:
        ids = self.old.get(w)
        if ids is None:
            ids = np.array(self.encode(self.lead + w), dtype="<u4").tobytes()
        if len(w) <= _LONGEST:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[w] = ids
        return ids


class Encoder:
    """Ids of a byte-level BPE vocabulary in ``tokenizers`` JSON format.

    A place between a non-space and a space is a token boundary in any context,
    so a text is cut there and each word's ids are looked up; the merges run
    for words that the cache does not hold."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        stand = _bytes_of()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ranks = {bytes(stand[c] for c in t): i for t, i in model["vocab"].items() if all(c in stand for c in t)}
        core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_NO_TEXT: max(ranks.values()) + 1})
        self._first = core.encode_ordinary
        self._words = _Words(core.encode_ordinary, " ")
        self._array = core.encode_to_numpy

    def encode(self, text: str | None) -> bytes:
        """The ids, 4 little-endian bytes each; none for null or empty text."""
        if not text:
            return b""
        if any(p in text for p in _ASCII_PAIRS) or not text.isascii() and any(p in text for p in _OTHER_PAIRS):
            parts = _CUT.split(text)
            parts = [parts[0], *[p[1:] for p in parts[1:]]]
        else:
            parts = text.split(" ")
        if len(parts[0]) == 0:
            return b"".join(map(self._words.__getitem__, parts[1:]))
        return np.array(self._first(parts[0]), dtype="<u4").tobytes() + b"".join(map(self._words.__getitem__, parts[1:]))

    def encode_once(self, text: str | None) -> bytes:
        """``encode`` without the cache, in one call that makes no Python object of a
        word or an id: cheaper for whole texts with many words that are new."""
        return self._array(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False).tobytes() if text else b""


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
