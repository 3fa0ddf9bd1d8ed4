"""Hashes of all words of a text at once."""

from __future__ import annotations

import numpy as np

#: Bytes handled at once; a word that reaches over the end of a piece is not cut unless it is as long as a piece.
PIECE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            factors = np.full(PIECE + 1, base, np.uint64)
            factors[0] = 1
            _TABLES.append(np.cumprod(factors, dtype=np.uint64))
        word = np.zeros(256, bool)
        word[0x80:] = True
        for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            word[a : b + 1] = True
        _TABLES.append(word)
        lower = np.arange(256)
        lower[0x41:0x5B] += 32
        _TABLES.append(np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64)[lower])
    return _TABLES


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash per word, in order; words are runs of letters, digits and bytes from 0x80, A-Z as a-z."""
    up, down, is_word, values = _tables()
    out, at = [], 0
    while at < len(text):
        x = np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at)
        inside = is_word[x]
        if at + len(x) < len(text) and inside[-1]:
            gaps = np.flatnonzero(~inside)
            if len(gaps):
                x, inside = x[: gaps[-1] + 1], inside[: gaps[-1] + 1]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(values[x] * down[: len(x)], out=sums[1:])
        h = (sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> np.uint64(29)))
        at += len(x)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
