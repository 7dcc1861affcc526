"""Stable 64-bit hashes of all words of a text at once, with numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
CHUNK = 1 << 20

#: Separators: ASCII white space; and every ASCII byte that is no letter or digit.
BLANKS = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the input changes every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, for i below n, modulo 2 ** 64."""
    if n in _POWERS:
        return _POWERS[n]
    both = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    if len(_POWERS) > 3:  # texts with very long words ask for other sizes
        _POWERS.clear()
    _POWERS[n] = both[0], both[1]
    return _POWERS[n]


def word_bounds(raw: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and the start and end of each word in them."""
    a = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~separators[a]
    step = np.diff(inside)
    return a, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hashes(raw: bytes, separators: np.ndarray) -> np.ndarray:
    a, start, end = word_bounds(raw, separators)
    if not len(start):
        return np.zeros(0, np.uint64)
    size = max(CHUNK + 1, 1 << len(a).bit_length())
    up, down = powers(size)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(raw: bytes, separators: np.ndarray) -> np.ndarray:
    """A hash for each word of raw, in order: equal for equal words. Long texts are taken in pieces, cut between words."""
    if len(raw) <= CHUNK:
        return _hashes(raw, separators)
    stops, parts, at = bytes(np.flatnonzero(separators).astype(np.uint8)), [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        if end < len(raw):
            cuts = [raw.rfind(bytes([s]), at, end) for s in stops]
            end = max(cuts) + 1 or min([k for s in stops if (k := raw.find(bytes([s]), end)) >= 0], default=len(raw))
        parts.append(_hashes(raw[at:end], separators))
        at = end
    return np.concatenate(parts)


def chain(*columns: np.ndarray) -> np.ndarray:
    """A hash for each row of equally long columns of hashes; their order counts."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = mix(out * np.uint64(BASE) + c)
        return out


def shingle_set(raw: bytes, k: int, separators: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of runs of k words; of fewer words the one run that they are; of none nothing."""
    h = word_hashes(raw, separators)
    if len(h) == 0:
        return h
    if len(h) < k:
        return chain(*[h[i : i + 1] for i in range(len(h))], np.array([len(h)], np.uint64))
    return np.unique(chain(*[h[i : len(h) - k + 1 + i] for i in range(k)]))
