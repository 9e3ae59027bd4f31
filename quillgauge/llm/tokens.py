"""Words as numbers: tokens are hashed once per distinct word and task."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np

# The memory of one task for words it has seen; it is emptied when full.
CACHE_WORDS = 400_000


class WordIds(dict):
    """Numbers of words, made on first sight."""

    def __init__(self, number: Callable[[str], int]) -> None:
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = self.number(word)
        return value

    def of(self, words: list[str], kind: type = np.int64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), kind, len(words))


def bucket(word: str, buckets: int, seed: int = 0) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"), seed) % buckets


PIECES = re.compile(r"\w+|[^\w\s]+")
