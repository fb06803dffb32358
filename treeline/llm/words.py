"""Words of many texts at once, as arrays of 64-bit hashes.

A block is the UTF-8 of several texts with a separator after each. The hash of a word is a polynomial in its bytes,
taken from one running sum over the block, so nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

P = 0x9E3779B97F4A7C15
Q = pow(P, -1, 1 << 64)
BLOCK = 1 << 18


class _Powers:
    up = down = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of P and of its inverse, modulo 2**64."""
    if len(_Powers.up) < n:
        n = max(n, BLOCK + BLOCK // 4)
        for name, x in (("up", P), ("down", Q)):
            setattr(_Powers, name, np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])))
    return _Powers.up[:n], _Powers.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Block:
    """Words of texts first .. first + count - 1 of a batch."""

    first: int
    count: int
    data: np.ndarray  # bytes, as folded
    text_at: np.ndarray  # count + 1 offsets into data
    start: np.ndarray  # of each word, into data
    stop: np.ndarray
    value: np.ndarray  # hash of each word
    word_at: np.ndarray  # count + 1 offsets into the words
    total: np.ndarray  # running sum that the hashes come from
    raw: np.ndarray  # bytes, as they came

    def owner(self) -> np.ndarray:
        """The text of each word, counted from ``first``."""
        return np.repeat(np.arange(self.count), np.diff(self.word_at))

    def head(self, n: int, which: np.ndarray) -> np.ndarray:
        """Hash of the first n bytes of those words, all of which have so many."""
        start = self.start[which]
        return mix((self.total[start + n] - self.total[start]) * powers(len(self.data) + 1)[1][start])


def blocks(texts: list[str | None], apart: np.ndarray = SPACE, fold: np.ndarray = LOWER, most: int = BLOCK) -> Iterator[Block]:
    """Blocks of at most about ``most`` bytes, or of one longer text. Null counts as empty."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            yield _block(held, first, apart, fold)
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield _block(held, first, apart, fold)


def _block(raw: list[bytes], first: int, apart: np.ndarray, fold: np.ndarray) -> Block:
    as_is = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    data = fold[as_is]
    text_at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])
    gap = apart[data]
    gap[text_at[1:] - 1] = True
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))  # the block ends in a gap, so starts and stops alternate
    start, stop = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    up = up[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    value = mix((total[stop] - total[start]) * down[start])
    return Block(first, len(raw), data, text_at, start, stop, value, np.searchsorted(start, text_at), total, as_is)


def joined(value: np.ndarray, word_at: np.ndarray, lags: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word tuples (i, i + lag, ...) that stay in one text, and the index of each one's first word."""
    reach = max(lags)
    n = len(value) - reach
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = value[:n] + np.uint64(salt)
    for lag in lags:
        out = mix(out) + value[lag : lag + n]
    inside = np.ones(len(value), bool)
    for end in range(1, reach + 1):
        late = word_at[1:] - end
        inside[late[late >= word_at[:-1]]] = False
    at = np.flatnonzero(inside[:n])
    return mix(out[at]), at
