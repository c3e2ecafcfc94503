"""Hashed character n-gram counts of many texts at once."""

from __future__ import annotations

import sys

import numpy as np

SEPARATOR = "\0\0\0"
#: Odd multipliers of the rolling hash.
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def letter_table() -> np.ndarray:
    """Code point -> itself for letters, 0 for all else."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    return np.where([chr(p).isalpha() for p in range(sys.maxunicode + 1)], points, 0).astype(np.uint32)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts with separators around each, number of the text of each code point)."""
    joined = SEPARATOR.join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + len(SEPARATOR) for t in texts])
    sizes[-1] += len(SEPARATOR)
    return points, np.repeat(np.arange(len(texts), dtype=np.int64), sizes)


def gram_counts(texts: list[str], buckets: int, letters: np.ndarray | None = None) -> np.ndarray:
    """texts x buckets: counts of the hashed 3-grams; ``buckets`` is a power of two.

    With ``letters`` (``letter_table``), texts are lower-cased, everything but letters counts as
    a blank, and only grams whose middle is a letter count: letter pairs at word edges included.
    Without, grams of the characters as they are, none across two texts.
    """
    if not texts:
        return np.zeros((0, buckets), np.float32)
    points, owner = code_points([t.lower() for t in texts] if letters is not None else texts)
    if letters is not None:
        points = letters[points]
    a, b, c = points[:-2], points[1:-1], points[2:]
    with np.errstate(over="ignore"):
        h = a * MIX[0]
        h += b * MIX[1]
        h ^= h >> np.uint32(15)
        h += c * MIX[2]
        h *= MIX[1]
        h >>= np.uint32(32 - buckets.bit_length() + 1)
    use = b != 0 if letters is not None else (a != 0) & (b != 0) & (c != 0)
    cell = owner[1:-1][use] * buckets + h[use]
    return np.bincount(cell, minlength=len(texts) * buckets).reshape(len(texts), buckets).astype(np.float32)
