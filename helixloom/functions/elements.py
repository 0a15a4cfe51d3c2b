"""Target site duplication and poly-A or poly-T tail of a gap."""

from __future__ import annotations

from helixloom.config import Options


def duplication(gap: str, flank: str, most: int) -> int:
    """Length of the gap's begin that the reference repeats behind it; one difference is passed over, the last base agrees."""
    length = wrong = 0
    for k, (a, b) in enumerate(zip(gap, flank, strict=False)):
        if a == b:
            length = k + 1
        else:
            wrong += 1
            if wrong > 1:
                break
        if length > most:
            break
    return length


def tail(bases: str, base: str, o: Options, search: int = 20) -> int:
    """The longest begin of `bases` that is mostly `base` and ends in it; 0 if too short."""
    seen = best = 0
    for n, c in enumerate(bases, 1):
        if c == base:
            seen += 1
            if n >= o.polya_length and seen >= o.polya_ratio * n:
                best = n
        elif n > search:
            break
    return best


def insertion_marks(gap: str, flank: str, o: Options) -> tuple[int, int]:
    """(duplication length, tail length; negative for poly-T), or (0, 0) unless both are there."""
    n = duplication(gap, flank, o.tsd[1])
    if not o.tsd[0] <= n <= o.tsd[1]:
        return 0, 0
    a = tail(gap[::-1], "A", o)
    t = 0 if a else tail(gap[n:], "T", o)
    return (n, a or -t) if a or t else (0, 0)
