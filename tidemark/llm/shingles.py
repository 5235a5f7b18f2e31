"""Word shingles of whole texts as 64-bit hashes, and MinHash over them.

Words are the lower-cased text split at white space. A shingle is five
consecutive words; a text of one to four words is one shingle of all its
words, and a text without words is one shingle of no word. A shingle's hash
is a sum of its words' 64-bit hashes, each times an odd number of its place,
finished by a mixing step. Long texts are taken apart in pieces that end at
white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

WORDS = 5
PIECE = 1 << 20
REMEMBERED = 100_000
WHITE = re.compile(r"\s")
PLACES = np.random.default_rng(11).integers(0, 2**63, WORDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 2**64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, ``n`` at least of each."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), 1 << 16)
        for name, base in (("up", BASE), ("down", UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_word_hash = _WordHashes()


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters, cut before white space; a word is never cut."""
    low = 0
    while len(text) - low > PIECE and (cut := WHITE.search(text, low + PIECE)):
        yield text[low : cut.start()]
        low = cut.start()
    yield text[low:] if low else text


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def in_order(text: str | None, n: int = WORDS) -> np.ndarray:
    """The hash of every shingle in the order of the text."""
    parts = []
    for piece in pieces(text or ""):
        found = words(piece)
        parts.append(np.fromiter(map(_word_hash.__getitem__, found), np.uint64, len(found)))
    each = parts[0] if len(parts) == 1 else np.concatenate(parts)
    width = min(n, len(each))
    total = np.full(max(1, len(each) - n + 1), width, np.uint64)
    for place in range(width):
        total += each[place : place + len(total)] * PLACES[place]
    return mix(total)


def distinct(text: str | None, n: int = WORDS) -> np.ndarray:
    """The set of shingle hashes, sorted."""
    return np.unique(in_order(text, n))


class MinHash:
    """``size`` minima of linear maps of the upper 32 bits of shingle hashes."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, size, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, size, dtype=np.uint32)[:, None]

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
        best = None
        for i in range(0, x.shape[1], 2048):
            now = (self.a * x[:, i : i + 2048] + self.b).min(axis=1)
            best = now if best is None else np.minimum(best, now)
        return best

    def short(self, hashes: np.ndarray) -> np.ndarray:
        """The minima reduced to 16 bits each: equal minima stay equal, others meet with probability 2**-16."""
        m = self.minima(hashes)
        return ((m * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")
