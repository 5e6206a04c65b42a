"""Character 4-gram models over a folded alphabet of 64 symbols: counted by Spark, smoothed by modified Kneser-Ney.

The alphabet bounds the model whatever the corpus: at most 64^4 = 16.8 million 4-grams (160 MB as
stored; natural text has some hundred thousand), so it may be collected and broadcast.  Counts
cover every byte of every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS, BITS, ORDER = 64, 6, 4
CONTEXTS = SYMBOLS ** (ORDER - 1)
GRAMS = SYMBOLS**ORDER
#: Codes that a worker holds before it counts them.
GATHER = 1 << 20
#: Codes looked up at once.
BLOCK = 1 << 20
_GAP = b"\0" * ORDER


def _fold_table() -> np.ndarray:
    """Byte to symbol: 0 border, 1-26 letters without case, 27 blank or control, 28 newline, 29 digit, 30 stop mark, 31 other ASCII, 32-63 the low five bits of the rest."""
    table = np.empty(256, np.int32)
    for b in range(256):
        c = chr(b)
        if b == 0:
            table[b] = 0
        elif b >= 128:
            table[b] = 32 + (b & 31)
        elif c.isalpha():
            table[b] = 1 + ord(c.lower()) - ord("a")
        elif c == "\n":
            table[b] = 28
        elif b <= 32 or b == 127:
            table[b] = 27
        elif c.isdigit():
            table[b] = 29
        else:
            table[b] = 30 if c in ".,;:!?" else 31
    return table


FOLD = _fold_table()


def codes(texts: list[bytes], fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first, last): the 4-gram code of each position; a text's own codes lie in [first, last), its end mark included."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = fold[np.frombuffer(_GAP[1:] + _GAP.join(texts) + b"\0", np.uint8)]
    first = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    grams = symbols[:-3] << 18
    grams |= symbols[1:-2] << 12
    grams |= symbols[2:-1] << 6
    grams |= symbols[3:]
    return grams, first, first + sizes + 1


def _own(grams: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The codes that lie in a text."""
    edge = np.zeros(len(grams) + 1, np.int8)
    edge[first] += 1
    edge[last] -= 1
    return grams[np.cumsum(edge[:-1], dtype=np.int8) > 0]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def counted(batches: Iterator[pa.RecordBatch], fold: np.ndarray = FOLD) -> Iterator[pa.RecordBatch]:
    """(label, code, n) of batches (text, label), one batch for each label at the end."""
    held: dict[int, list[np.ndarray]] = {}
    sizes: dict[int, int] = {}
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def gather(label: int) -> None:
        """Add what is held to the label's counts; memory follows the different codes seen, not the alphabet."""
        code, n = np.unique(np.concatenate(held.pop(label)), return_counts=True)
        sizes.pop(label)
        if label in known:
            have, m = known[label]
            both, at = np.unique(np.concatenate([have, code]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            total[at[: len(have)]] = m
            total[at[len(have) :]] += n
            code, n = both, total
        known[label] = code, n

    for batch in batches:
        texts, labels = as_bytes(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        for label in np.unique(labels):
            label = int(label)
            own = _own(*codes([t for t, x in zip(texts, labels, strict=True) if x == label], fold))
            held.setdefault(label, []).append(own)
            sizes[label] = sizes.get(label, 0) + len(own)
            if sizes[label] >= GATHER:
                gather(label)
    for label in list(held):
        gather(label)
    for label, (code, n) in known.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), label, np.int32)), pa.array(code.astype(np.int32)), pa.array(n)], ["label", "code", "n"])


def count_grams(df: DataFrame, text_col: str, label_col: str | None = None, fold: np.ndarray = FOLD) -> DataFrame:
    """(label int, code int, n long) over every row of df; label is 0, or the row's integer label."""
    take = df.select(F.col(text_col).alias("text"), (F.col(label_col).cast("int") if label_col else F.lit(0)).alias("label"))
    return take.mapInArrow(lambda batches: counted(batches, fold), "label int, code int, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))


def _mix(code: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit hash."""
    x = code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))])


@dataclass
class GramModel:
    """keys: sorted hashes of the 4-grams seen, grams: their codes; logp: log2 P(symbol | three before) of each; lower: log2 P by 3-gram; backoff: log2 of a context's mass for unseen symbols."""

    keys: np.ndarray
    grams: np.ndarray
    logp: np.ndarray
    lower: np.ndarray
    backoff: np.ndarray

    def lookup(self, code: np.ndarray) -> np.ndarray:
        """log2 P of each code, by search in the sorted hashes."""
        unseen = self.backoff[code >> BITS] + self.lower[code & (CONTEXTS - 1)]
        if not len(self.keys):
            return unseen
        at = np.minimum(np.searchsorted(self.keys, key := _mix(code)), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.logp[at], unseen)


def kneser_ney(code: np.ndarray, n: np.ndarray) -> GramModel:
    """The interpolated model of 4-gram counts; lower orders use continuation counts."""
    counts: list[tuple[np.ndarray, np.ndarray]] = [(code.astype(np.int64), n.astype(np.int64))]
    for order in range(ORDER - 1, 0, -1):
        seen = np.bincount(counts[0][0] & (SYMBOLS**order - 1), minlength=SYMBOLS**order)
        at = np.flatnonzero(seen)
        counts.insert(0, (at, seen[at]))
    lower, out = np.full(1, 1 / SYMBOLS), None
    for order, (at, c) in enumerate(counts, 1):
        d = _discounts(c)[np.minimum(c, 3)]
        contexts = SYMBOLS ** (order - 1)
        total = np.bincount(at >> BITS, c, contexts)
        mass = np.where(total > 0, np.bincount(at >> BITS, d, contexts) / np.maximum(total, 1), 1.0)
        wide = lambda x: x & (SYMBOLS ** (order - 1) - 1)  # noqa: B023, E731
        p_seen = (c - d) / total[at >> BITS] + mass[at >> BITS] * lower[wide(at)]
        if order == ORDER:
            key = _mix(at)
            by = np.argsort(key)
            out = GramModel(key[by], at[by].astype(np.int32), np.log2(p_seen[by]).astype(np.float32), np.log2(lower).astype(np.float32), np.log2(np.maximum(mass, 1e-12)).astype(np.float32))
        else:
            every = np.arange(SYMBOLS**order)
            p = mass[every >> BITS] * lower[wide(every)]
            p[at] = p_seen
            lower = p
    return out


def shared(spark, model: GramModel):
    """The model as a broadcast; its size has the bound stated above."""
    return spark.sparkContext.broadcast(model)


def train(counts: DataFrame, label: int = 0) -> GramModel:
    """The model of one label of count_grams(); the rows collected are bounded by the alphabet."""
    got = counts.filter(F.col("label") == label).select("code", "n").toArrow()
    return kneser_ney(got.column("code").to_numpy(), got.column("n").to_numpy())


def log_probs(model: GramModel, texts: list[bytes], fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """(log2 P, symbols) of each text, end mark included."""
    grams, first, last = codes(texts, fold)
    logp = np.empty(len(grams), np.float32)
    for at in range(0, len(grams), BLOCK):
        logp[at : at + BLOCK] = model.lookup(grams[at : at + BLOCK])
    total = np.concatenate([[0.0], np.cumsum(logp, dtype=np.float64)])
    return total[last] - total[first], last - first
