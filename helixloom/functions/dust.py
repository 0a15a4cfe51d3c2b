"""Low-complexity stretches by symmetric DUST scores (Morgulis et al. 2006): maximal perfect intervals within a sliding window."""

from __future__ import annotations

import numpy as np

#: A 0, C 1, G 2, T 3, any other byte 4.
CODES = np.full(256, 4, np.uint8)
CODES[[ord(c) for c in "ACGT"]] = range(4)


def mask(seq: str, threshold: int = 20, window: int = 64) -> list[tuple[int, int]]:
    """Half-open intervals. A stretch of n+1 triplets scores 10 * (sum of c(c-1)/2 over triplets) / n; it is perfect if that
    exceeds `threshold` and no part of it scores more. Masked are all perfect stretches of up to `window` bases."""
    raw = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
    code = CODES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (code < 4).astype(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    for lo, hi in edge.reshape(-1, 2).tolist():
        if hi - lo > 3:
            c = code[lo:hi]
            for a, b in _perfect(c[:-2] * 16 + c[1:-1] * 4 + c[2:], threshold, window - 2):
                if out and lo + a <= out[-1][1]:
                    out[-1] = out[-1][0], max(out[-1][1], lo + b + 3)
                else:
                    out.append((lo + a, lo + b + 3))
    return out


def _perfect(words: np.ndarray, threshold: int, most: int) -> list[tuple[int, int]]:
    """First and last triplet of stretches that cover what all perfect ones do, by begin; each begin with its longest.

    Step n has all stretches of n + 1 triplets at once: a stretch's equal pairs are those of the stretch without its first triplet and that
    triplet's own, and its best part is the best of the two stretches one shorter and of their parts.
    """
    size = len(words)
    own, pairs = np.zeros(size, np.int32), np.zeros(size, np.int32)
    score, inner, longest = np.zeros(size), np.zeros(size), np.zeros(size, np.int32)
    for n in range(1, min(most, size)):
        m = size - n
        own = own[:m] + (words[:m] == words[n:])
        pairs = pairs[1:] + own
        inner = np.maximum(np.maximum(inner[:-1], inner[1:]), np.maximum(score[:-1], score[1:]))
        score = pairs / n
        longest[:m][(10 * pairs > threshold * n) & (score >= inner)] = n
    at = np.flatnonzero(longest)
    return list(zip(at.tolist(), (at + longest[at]).tolist(), strict=True))


def covered(seq: str, threshold: int = 20, window: int = 64) -> float:
    """Share of a sequence that is masked."""
    return sum(b - a for a, b in mask(seq, threshold, window)) / len(seq) if seq else 0.0
