"""Byte-level word splitting and rolling hashes shared by the text operators.

The word classes of the contracts hold every code point from U+0080 on, so in UTF-8 every byte from
0x80 on is a word byte and splitting may work on bytes alone. Nothing here keeps more than one block
of a text (``BLOCK`` bytes, plus the word that crosses its end) besides the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20

#: A-Z to a-z; 0-9, a-z and bytes from 0x80 on stay; all else becomes a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def blocks(folded: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """Pieces of a text whose separators are spaces, cut at spaces only."""
    at = 0
    while len(folded) - at > size:
        cut = folded.find(b" ", at + size)
        if cut < 0:
            break
        yield folded[at:cut]
        at = cut + 1
    yield folded[at:] if at else folded


class Powers:
    """Powers of an odd number and of its inverse mod 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, x)))) for x in (_ODD, _ODD_INVERSE))
        return self.up, self.down


class Hashed:
    """Joined words of a block with a prefix hash, from which the hash of any run of words follows at once."""

    def __init__(self, words: list[bytes], powers: Powers) -> None:
        self.joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        up, self.down = powers.to(len(self.joined) + 1)
        self.prefix = np.zeros(len(self.joined) + 1, np.uint64)
        np.cumsum((np.frombuffer(self.joined, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(self.joined)], out=self.prefix[1:])

    def runs(self, n: int) -> np.ndarray:
        """Hash of every run of n words."""
        if len(self.starts) < n:
            return np.empty(0, np.uint64)
        first, last = self.starts[: len(self.starts) - n + 1], self.ends[n - 1 :]
        return (self.prefix[last] - self.prefix[first]) * self.down[first]

    def run(self, i: int, n: int) -> bytes:
        return self.joined[self.starts[i] : self.ends[i + n - 1]]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
