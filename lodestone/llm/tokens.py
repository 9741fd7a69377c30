"""Token ids of a byte-level BPE with word ends, by the ``tokenizers`` library.

White space always parts tokens in such a vocabulary, so a text's ids are those of
its words in turn. Each worker keeps the ids of words seen before (a bounded
store); a new word goes through the library: plain Latin words straight to its BPE model,
any other word through its whole pipeline.
"""

from __future__ import annotations

import re

import numpy as np

#: Words that need no Unicode normalisation, and how the vocabulary's pre-tokeniser parts them.
_PLAIN = re.compile("[!-~À-ž]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ž]+|[0-9]|[^a-z0-9À-ÖØ-öø-ž]+")
_KEPT = 400_000


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_CHARS = _byte_characters()


class _Store(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= _KEPT:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordTokenizer:
    """Texts to ids, as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words = _Store(self._word)
        self.parts = _Store(self._part)

    def _part(self, part: str) -> bytes:
        shown = "".join([_CHARS[b] for b in part.encode()])
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            low = word.lower()
            if _PLAIN.fullmatch(low):
                return b"".join([self.parts[p] for p in _SPLIT.findall(low)])
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def release() -> None:
    """Let the worker's tokenizers and the words that they have seen go; the next use loads them again."""
    _loaded.clear()
