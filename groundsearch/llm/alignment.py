"""Banded alignment of word sequences, bit-parallel over the band."""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Sequence


def banded_distance(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int:
    """The edit distance of a and b where it is at most `most`, else most + 1.

    Each step moves the band one row and one column along the diagonal; vertical differences within it are
    bits of two integers (Hyyrö's form of Myers' algorithm).
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    head, end = 0, 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    while end < len(b) - head and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[head : len(a) - end], b[head : len(b) - end]
    if not b:
        return len(a)
    if len(a) - sum((Counter(a) & Counter(b)).values()) > most:  # a bound from below
        return most + 1
    most = min(most, len(a))
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    # A word's places in the band: the first of them, and bits from there on, so that memory follows the band and not the texts.
    first: dict[Hashable, int] = {}
    bits: dict[Hashable, int] = {}

    def enter(i: int) -> None:
        x = a[i]
        if x in bits:
            bits[x] |= 1 << (i - first[x])
        else:
            first[x], bits[x] = i, 1

    for i in range(most):
        enter(i)
    up, down = (full >> (width - most - 1)) << (width - most - 1), 0
    score, side = most, top >> 1
    start = most + 1 - width
    stop = 2 * most + len(b) - len(a)
    for j, x in enumerate(b):
        if j + most < len(a):
            enter(j + most)
        if start > 0:
            gone = a[start - 1]
            rest = bits[gone] >> 1
            if rest:
                step = (rest & -rest).bit_length()
                first[gone] += step
                bits[gone] = rest >> (step - 1)
            else:
                del bits[gone]
        seen = bits[x] << (first[x] - start) if x in bits else 0
        start += 1
        same = ((((seen & up) + up) ^ up) | seen | down) & full
        rise = down | (full & ~(same | up))
        fall = same & up
        if j < len(a) - most:
            score += not same & top
        else:
            score += bool(rise & side)
            score -= bool(fall & side)
            side >>= 1
        if score > stop:
            return most + 1
        up = fall | (full & ~((same >> 1) | rise))
        down = (same >> 1) & rise
    return score if score <= most else most + 1


def similar(a: Sequence[Hashable], b: Sequence[Hashable], least: float) -> bool:
    """Whether 1 - distance / longer length is at least `least`; two empty sequences are alike."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return banded_distance(a, b, most) <= most
