"""Hashed character n-grams of whole texts, in bounded runs of numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

N = 4
RUN = 1 << 19         # characters hashed at once
_P = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Boolean by code point: is it a letter?"""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def hashes(text: str, n: int = N) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of the lower-cased text, letters only; any other character reads as a blank.

    N-grams without a letter in their second place are left out, so runs of
    blanks say nothing.
    """
    if not text:
        return
    known = letters()
    text = " " + text.lower() + " "
    for k in range(0, len(text) - n + 1, RUN):
        codes = np.frombuffer(text[k:k + RUN + n - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = known[codes]
        codes = np.where(is_letter, codes, np.uint32(32)).astype(np.uint64)
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = codes[:m].copy()
        for i in range(1, n):
            h = h * _P + codes[i:i + m]
        h = h[is_letter[1:1 + m]]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        yield h


def runs(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, row of each hash) over many texts, a bounded number of hashes at a time."""
    held, rows, size = [], [], 0
    for i, t in enumerate(texts):
        for h in hashes(t):
            held.append(h)
            rows.append(np.full(len(h), i, dtype=np.int64))
            size += len(h)
            if size >= RUN:
                yield np.concatenate(held), np.concatenate(rows)
                held, rows, size = [], [], 0
    if size:
        yield np.concatenate(held), np.concatenate(rows)
