"""Offline stand-ins for hosted models: deterministic, and of no model quality."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np

# Runs of letters and digits; the same words that functions.text.words() finds.
_WORD = re.compile(r"[^\W_]+")

#: Words whose bucket an embedder remembers before it starts over.
_MEMORY = 1 << 18


class _Buckets(dict):
    """Hash bucket of each word, computed when first asked for."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        digest = hashlib.sha256(word.encode()).digest()
        bucket = self[word] = int.from_bytes(digest[:4], "big") % self.size
        return bucket


class HashingEmbedder:
    """Bag-of-words counts in ``size`` buckets; needs no service."""

    def __init__(self, size: int):
        self.size = size
        self._buckets = _Buckets(size)

    def embed(self, texts: Iterable[str]) -> list[np.ndarray]:
        return [self._counts(text or "") for text in texts]

    def _counts(self, text: str) -> np.ndarray:
        buckets = map(self._buckets.__getitem__, _WORD.findall(text.lower()))
        return np.bincount(np.fromiter(buckets, np.int64), minlength=self.size).astype(np.float32)
