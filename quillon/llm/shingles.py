"""Vectorised word and shingle hashing over batches of UTF-8 text (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes hashed at once; a longer text is cut at white space and its word hashes are joined.
PIECE = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, PIECE + 64), base, U)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _hash_piece(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of blob."""
    raw = np.frombuffer(blob, np.uint8)
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = turn[::2], turn[1::2]
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTE[_LOWER[raw]] * _power(_BASE, len(raw)), out=sums[1:])
    return start, mix((sums[end] - sums[start]) * _power(_BACK, len(raw) + 1)[start] + (end - start).astype(U))


def _long(data: bytes) -> np.ndarray:
    """Word hashes of one long text, piece by piece."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        out.append(_hash_piece(data[at:to])[1])
        at = to
    _powers.clear()  # a text without white space may have made these long
    return np.concatenate(out) if out else np.zeros(0, U)


def word_hashes(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of consecutive texts: (words in each text, hashes of all their words). A-Z count as a-z."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(data):
        to, n = at, 0
        while to < len(data) and (to == at or n + len(data[to]) < PIECE):
            n += len(data[to]) + 1
            to += 1
        if to == at + 1 and n > PIECE:
            h = _long(data[at])
            yield np.array([len(h)]), h
        else:
            start, h = _hash_piece(b" ".join(data[at:to]))
            ends = np.cumsum([len(x) + 1 for x in data[at:to]])
            yield np.diff(np.searchsorted(start, ends), prepend=0), h
        at = to


def shingle_sets(texts: list[str | None], width: int = 3) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a shorter text is one shingle."""
    for counts, h in word_hashes(texts):
        whole = np.zeros(max(0, len(h) - width + 1), U)
        for k in range(width):
            whole = mix(whole + h[k : len(h) - width + 1 + k])
        at = 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(whole[at : at + n - width + 1])
            elif n:
                one = np.full(1, n, U)
                for k in range(n):
                    one = mix(one + h[at + k])
                yield mix(one + U(0x2545F4914F6CDD1D))
            else:
                yield np.zeros(0, U)
            at += n


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets whatever the order."""
    return int(mix(mix(s).sum(dtype=U, keepdims=True) + U(len(s))).astype(np.int64)[0]) if len(s) else 0
