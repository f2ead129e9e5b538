"""Vectorised hashes of words and word shingles, for use inside tasks."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MULTIPLIER = np.uint64(0xD1342543DE82EF95)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(max(n, 1 << 20), base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, offset of each text's first word and the end): words as in ``common.WORD``.

    Hashes are of UTF-8 bytes, A-Z lowered: differences of one prefix sum of byte * base**place, shifted back.
    """
    parts = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    b = np.frombuffer(b"".join(parts), np.uint8)
    if lower:
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, int)
    return h, np.concatenate(([0], np.searchsorted(start, ends)))


def folded(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, one for each place that has n words ahead, over text borders too."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    x = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        x = (x ^ (x >> np.uint64(29))) * MULTIPLIER + h[j : len(h) - n + 1 + j]
    return mix(x)


def shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """Each text's hashes of n words in place order, 63 bits; with fewer words one of them all; without words none."""
    h, at = words(texts)
    runs = folded(h, n) >> np.uint64(1)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            out.append(runs[a : b - n + 1])
        else:
            out.append(folded(h[a:b], b - a) >> np.uint64(1) if b > a else np.zeros(0, np.uint64))
    return out


def blocks(texts: list[str], chars: int = 500_000):
    """(start, end) of runs of texts of so many characters in all, or of one longer text."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
