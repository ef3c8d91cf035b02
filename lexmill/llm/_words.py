"""Words and their hashes for many texts at once, by whole-array operations on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Word separators: \x20 and \x09 to \x0d.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose result looks random in every bit."""
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


def join(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, a line feed after each, and where each begins (with the end as last)."""
    raw = [(t or "").encode() for t in texts]
    begins = np.zeros(len(raw) + 1, "i8")
    np.cumsum([len(r) + 1 for r in raw], out=begins[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), "u1"), begins


def slices(texts: list[str | None], rows: int = 500, chars: int = 500_000) -> Iterator[list[str | None]]:
    """texts in order, in lists of so many rows or code points at most (or one longer text): what is worked on at
    once takes some 50 bytes for each of theirs."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > first and (k - first == rows or held + n > chars):
            yield texts[first:k]
            first, held = k, 0
        held += n
    if first < len(texts):
        yield texts[first:]


class Words:
    """starts, ends, hashes of the words of joined texts; bounds[k]:bounds[k + 1] are those of text k."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, lower: bool, separators: np.ndarray = SPACES):
        gap = separators[data]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        # data ends with a separator unless it is empty, so edges come in pairs.
        self.starts, self.ends = edge[0::2], edge[1::2]
        own = (LOWER[data] if lower else data)[~gap]
        self.lengths = self.ends - self.starts
        at = np.zeros(len(self.lengths), "i8")
        np.cumsum(self.lengths[:-1], out=at[1:])
        within = np.arange(len(own)) - np.repeat(at, self.lengths)
        powers = _powers(int(self.lengths.max(initial=0)))
        self.hashes = mix(np.add.reduceat(_BYTE[own] * powers[within], at) + self.lengths.astype("u8")) if len(own) else np.zeros(0, "u8")
        self.bounds = np.searchsorted(self.starts, begins)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive values."""
    if len(hashes) < n:
        return np.zeros(0, "u8")
    powers, count = _powers(n + 1), len(hashes) - n + 1
    out = np.zeros(count, "u8")
    for k in range(n):
        out += hashes[k : k + count] * powers[k + 1]
    return mix(out)
