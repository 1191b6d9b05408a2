"""Calling an embedder: which errors are worth another try, and a local embedder that needs no model."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable

import numpy as np

Embed = Callable[[list[str]], list[list[float]]]

# What is tried again, how often, and the first pause in seconds.
RETRIED = frozenset((429, 500, 502, 503, 504, 529))
RETRIED_WORDS = ("RESOURCE_EXHAUSTED", "429", "UNAVAILABLE")
TRIES, PAUSE = 6, 5.0


def worth_retrying(error: Exception) -> bool:
    status = getattr(error, "status_code", None) or getattr(error, "code", None)
    return status in RETRIED or any(w in str(error).upper() for w in RETRIED_WORDS)


class Retrying:
    """An embedder that tries again after passing errors, with pauses that double.

    A reply with another number of vectors than texts is an error, and not a passing one."""

    def __init__(self, embed: Embed, tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep):
        self.embed, self.tries, self.pause, self.sleep = embed, tries, pause, sleep

    def __call__(self, texts: list[str]) -> list[list[float]]:
        for left in reversed(range(self.tries)):
            try:
                vectors = self.embed(texts)
            except Exception as e:  # providers raise errors of their own kinds
                if not left or not worth_retrying(e):
                    raise
                self.sleep(self.pause * 2 ** (self.tries - 1 - left))
                continue
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            return vectors
        raise ValueError("tries must be positive")


class HashedWords:
    """Unit vectors of signed word counts, by hash: the same on every machine; a text without words gives zeros."""

    def __init__(self, size: int = 256):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.size)
        for w in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            v[h % self.size] += 1.0 if h >> 63 else -1.0
        norm = float(np.sqrt(v @ v))
        return (v / norm if norm else v).tolist()
