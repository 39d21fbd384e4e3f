"""Word shingles of whole texts as sorted 64-bit hashes, computed with numpy over the text's bytes."""

from __future__ import annotations

import hashlib

import numpy as np

_WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE_INVERSE = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SEPARATOR = np.zeros(256, np.int8)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_PLACE = mix(np.arange(1001, 1033, dtype=np.uint64)) | np.uint64(1)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for base, name in ((_WORD_BASE, "_powers"), (_WORD_BASE_INVERSE, "_inverses")):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word ``[^\\x20\\x09-\\x0D]+``, A-Z taken as a-z, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    _grow(len(data) + 1)
    padded = np.ones(len(data) + 2, np.int8)
    padded[1:-1] = _SEPARATOR[data]
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width``: the whole sequence as one; no words: empty."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * _PLACE[k]
    return np.unique(mix(total))


def set_name(tokens: np.ndarray) -> bytes:
    """A 128-bit name of a set: equal sets have equal names."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
