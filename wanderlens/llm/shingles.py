"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that are worked on together.
CHUNK = 1 << 20

_random = np.random.default_rng(20240101)
_BYTE = _random.integers(1, 2**63, 256, np.int64).astype(np.uint64)
_MIX = _random.integers(1, 2**63, WIDTH, np.int64).astype(np.uint64) | np.uint64(1)
_BASE = int(_random.integers(1, 2**62)) * 4 + 3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base % (1 << 64), np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _of_bytes(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    blank = _BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    # A word's hash is a polynomial in its bytes, taken from running sums modulo 2 ** 64.
    running = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    words = _mixed((running[ends] - running[starts]) * _powers(_BASE_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    edges = np.cumsum([1] + [len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, edges)
    count = max(0, len(words) - WIDTH + 1)
    windows = words[:count] * _MIX[0]
    for k in range(1, WIDTH):
        windows = (windows ^ (windows >> np.uint64(29))) * _MIX[k] + words[k : k + count]
    windows = _mixed(windows)
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= WIDTH:
            own = np.sort(windows[a : b - WIDTH + 1])
            found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.uint64(b - a)
            for word in words[a:b]:
                short = _mixed(np.array([short * _MIX[2] + word]))[0]
            found.append(np.array([short], np.uint64))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def parts(lengths: list[int], rows: int, size: int = 16 * CHUNK) -> Iterator[slice]:
    """Slices of at most ``rows`` texts and about ``size`` characters, one text at least."""
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if i > at and (i - at == rows or total + n > size):
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield slice(at, len(lengths))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, in order, the sorted hashes of its distinct shingles of five words, A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle, one without words has none.
    """
    held: list[bytes] = []
    size = 0
    with np.errstate(over="ignore"):
        for text in texts:
            held.append((text or "").encode("utf-8", "surrogatepass").lower())
            size += len(held[-1])
            if size >= CHUNK:
                yield from _of_bytes(held)
                held, size = [], 0
        if held:
            yield from _of_bytes(held)
