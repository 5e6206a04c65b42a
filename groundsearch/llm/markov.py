"""Variable-order Markov models of short byte strings: counted by Spark, kept as sorted hash arrays.

A context is the bytes before a place, up to `MAX_ORDER` of them.  Every context of every order is counted with what comes
next, and those seen `LEAST` times or more are kept, so how far back a model looks varies from place to place: to the longest
context that it knows.  Interpolated absolute discounting smooths it, down to equal chances of all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.llm.near_dedup import mix
from groundsearch.llm.ngrams import as_bytes

MAX_ORDER, LEAST, DISCOUNT = 8, 2, 0.75
#: Bytes and the end of a string.
SYMBOLS, END = 257, 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, how many of its text come before, text number) of all texts, each with an end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    symbols = np.zeros(int(sizes.sum()), np.uint64)
    ends = np.cumsum(sizes)
    symbols[ends - 1] = END
    own = np.ones(len(symbols), bool)
    own[ends - 1] = False
    symbols[own] = np.frombuffer(b"".join(texts), np.uint8)
    text = np.repeat(np.arange(len(texts)), sizes)
    return symbols, np.arange(len(symbols)) - (ends - sizes)[text], text


def contexts(symbols: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 0: places that have so long a context, its hash, and the hash of it and what follows."""
    value = np.zeros(len(symbols), np.uint64)
    for order in range(MAX_ORDER + 1):
        at = np.flatnonzero(before >= order)
        if order:
            value[at] = mix(value[at] * _STEP + symbols[at - order] + np.uint64(1))
        context = mix(value[at] + np.uint64(order))
        yield at, context, mix(context * _STEP + symbols[at] + np.uint64(1))


def count_contexts(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """label int, context, gram, n over the rows of df; gram is the hash of a context and what follows it."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = as_bytes(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            symbols, before, text = places(texts)
            for at, context, gram in contexts(symbols, before):
                rows = np.empty(len(at), [("label", np.int32), ("context", np.int64), ("gram", np.int64)])
                rows["label"], rows["context"], rows["gram"] = labels[text[at]], context.view(np.int64), gram.view(np.int64)
                found, n = np.unique(rows, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in ("label", "context", "gram")] + [pa.array(n)], ["label", "context", "gram", "n"])

    take = df.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    return take.mapInArrow(counts, "label int, context long, gram long, n long").groupBy("label", "context", "gram").agg(F.sum("n").alias("n"))


@dataclass
class MarkovModel:
    """Sorted hashes of the contexts kept, with how often each was seen and how many different bytes followed; sorted hashes of what followed, with counts."""

    contexts: np.ndarray
    seen: np.ndarray
    kinds: np.ndarray
    grams: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, context: np.ndarray, gram: np.ndarray, n: np.ndarray) -> MarkovModel:
        contexts_, which = np.unique(context.view(np.uint64), return_inverse=True)
        seen, kinds = np.bincount(which, n, len(contexts_)), np.bincount(which, minlength=len(contexts_))
        keep = seen >= LEAST
        own = keep[which]
        by = np.argsort(gram.view(np.uint64)[own])
        return cls(contexts_[keep], seen[keep], kinds[keep], gram.view(np.uint64)[own][by], n[own][by])

    def log_probs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log2 P, symbols) of each text, its end among them."""
        symbols, before, text = places(texts)
        p = np.full(len(symbols), 1 / SYMBOLS)
        for at, context, gram in contexts(symbols, before):
            where, known = _find(self.contexts, context)
            if not known.any():
                continue
            at, gram, where = at[known], gram[known], where[known]
            place, found = _find(self.grams, gram)
            n = np.where(found, np.maximum(self.n[place] - DISCOUNT, 0.0), 0.0) if len(self.n) else np.zeros(len(at))
            p[at] = (n + DISCOUNT * self.kinds[where] * p[at]) / self.seen[where]
        return np.bincount(text, np.log2(p), len(texts)), np.bincount(text, minlength=len(texts))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of wanted is in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def known(counts: DataFrame) -> DataFrame:
    """The rows of count_contexts() whose context its label has LEAST times or more: all that a model keeps."""
    seen = counts.groupBy("label", "context").agg(F.sum("n").alias("seen")).filter(F.col("seen") >= LEAST).select("label", "context")
    return counts.join(seen.hint("merge"), ["label", "context"])


def train(counts: DataFrame, label: int) -> MarkovModel:
    """The model of one label of count_contexts(); as many rows are collected as the labelled sample has contexts seen LEAST times."""
    got = known(counts).filter(F.col("label") == label).select("context", "gram", "n").toArrow()
    return MarkovModel.of(*(got.column(c).to_numpy() for c in ("context", "gram", "n")))
