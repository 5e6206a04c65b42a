"""A run-length index of byte strings: Burrows-Wheeler runs, suffix samples at their ends, and matching statistics.

The suffixes of the strings, joined by a byte that text never has, are sorted; their preceding bytes
form the Burrows-Wheeler transform, kept as runs.  Only at run borders is the common prefix with the
neighbour compared byte by byte.  Everywhere else a suffix's longest match is its predecessor's less
one byte, so the statistics of a repetitive text stream from left to right out of 2 * runs samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Not in any UTF-8 text.
BORDER = 0xFF


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of a byte string's suffixes, by doubling; only suffixes not yet told apart are sorted again."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):  # 9 bits each: 256 symbols and the end
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    alone = new & np.concatenate([new[1:], [True]])
    left = np.flatnonzero(~alone)  # places in order
    step = 7
    while len(left):
        suffixes = order[left]
        a, b = rank[suffixes], rank[np.minimum(suffixes + step, n)]
        by = np.argsort((a << 32) | (b + 1))  # both are under 2 ** 31
        suffixes, a, b = suffixes[by], a[by], b[by]
        order[left] = suffixes
        start = np.concatenate([[True], a[1:] != a[:-1]])
        new = start | np.concatenate([[True], b[1:] != b[:-1]])
        at = np.arange(len(left))
        rank[suffixes] = a + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(start, at, 0))
        left = left[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    return order


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and at b."""
    n = len(text)
    bytes_ = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.zeros(n + 9, np.uint64)
    for i in range(8):
        words |= bytes_[i : i + n + 9].astype(np.uint64) << np.uint64(8 * i)
    out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(alive):
        x, y = a[alive] + out[alive], b[alive] + out[alive]
        room = n - np.maximum(x, y)
        differ = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        out[alive] += np.minimum(same, room)
        alive = alive[(same == 8) & (room > 8)]
    return out


@dataclass
class RunLengthIndex:
    """heads, tails: the suffixes at the first and last place of each run of the transform.  matches: the common prefix at the border before each run."""

    text: np.ndarray
    heads: np.ndarray
    tails: np.ndarray
    matches: np.ndarray

    @classmethod
    def build(cls, strings: list[bytes]) -> RunLengthIndex:
        text = np.frombuffer(bytes([BORDER]).join(strings) + bytes([BORDER]), np.uint8)
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], 256).astype(np.int16)  # the first suffix has a byte of its own before it
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        heads, tails = order[starts], order[np.concatenate([starts[1:], [len(order)]]) - 1]
        matches = np.zeros(len(starts), np.int64)
        matches[1:] = common_prefixes(text, tails[:-1], heads[1:])
        return cls(text, heads, tails, matches)

    def statistics(self) -> np.ndarray:
        """For each place of the joined text, the length of its longest match that starts at any other place and crosses no border."""
        n = len(self.text)
        at = np.arange(n)

        def streamed(places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            sampled = np.full(n, -1, np.int64)
            sampled[places] = lengths
            last = np.maximum.accumulate(np.where(sampled >= 0, at, 0))
            return sampled[last] - (at - last)

        longest = np.maximum(streamed(self.heads, self.matches), streamed(self.tails, np.concatenate([self.matches[1:], [0]])))
        borders = np.flatnonzero(self.text == BORDER)
        return np.minimum(longest, borders[np.searchsorted(borders, at)] - at)
