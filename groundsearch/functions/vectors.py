"""Column functions over vectors (arrays of float), and the default hash embedder."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from groundsearch.shipping import ship_package

DIMS = 384


def dot(a: Column, b: Column) -> Column:
    """In doubles, whatever the vectors hold."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NaN where a vector is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / F.when(norms > 0, norms)).otherwise(F.lit(float("nan")))


def passes(similarity: Column, threshold: Column) -> Column:
    """similarity >= threshold, where NaN and null never pass (NaN is the greatest double to Spark)."""
    return F.coalesce((similarity >= threshold) & ~F.isnan(similarity), F.lit(False))


class HashEmbedder:
    """Token hashes as signed counts in DIMS places, scaled to length 1; no tokens give zeros."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims

    def places(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place and the sign of each token."""
        digests = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in tokens), np.uint8).reshape(-1, 16)
        at = digests[:, :4].copy().view(">u4").ravel().astype(np.int64) % self.dims
        return at, np.where(digests[:, 4] < 128, 1.0, -1.0)

    def embed_lists(self, lists: pa.ListArray) -> np.ndarray:
        """A row for each list of tokens (null is empty); each different token is hashed once."""
        flat = lists.flatten().dictionary_encode()
        at, sign = self.places(flat.dictionary.to_pylist())
        token = flat.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        v = np.bincount(row * self.dims + at[token], sign[token], len(lists) * self.dims).reshape(-1, self.dims)
        return (v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)).astype(np.float32)

    def embed(self, tokens: list[str]) -> np.ndarray:
        return self.embed_lists(pa.array([list(tokens)], pa.list_(pa.string())))[0]


#: An embedder gives each of a batch's token lists a vector; it is made once in each worker.
Provider = Callable[[], Callable[[list[list[str]]], list[np.ndarray]]]


def hash_provider(dims: int = DIMS) -> Callable[[list[list[str]]], list[np.ndarray]]:
    embedder = HashEmbedder(dims)
    return lambda batch: list(embedder.embed_lists(pa.array(batch, pa.list_(pa.string()))))


def reordered(response: Column) -> Column:
    """The vectors of an embeddings API's JSON response, in the order of their index."""
    data = F.from_json(response, "data array<struct<index:int,embedding:array<float>>>")["data"]
    return F.transform(F.array_sort(data), lambda x: x["embedding"])


def retried(call: Callable, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """call(), again after wait, 2 * wait, ... while it fails for a reason that looks like the network's."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except FileNotFoundError:
            raise
        except (ConnectionError, TimeoutError, OSError):
            if n == attempts:
                raise
            sleep(wait * n)


def api_provider(post: Callable[[dict], dict], model: str, dims: int) -> Provider:
    """A provider that posts texts (tokens joined) to an embeddings API; post sends a body and returns the response."""
    def make():
        def run(batch: list[list[str]]) -> list[np.ndarray]:
            response = retried(lambda: post({"model": model, "input": [" ".join(t) for t in batch]}))
            rows = sorted(response["data"], key=lambda r: r["index"])
            out = [np.array(r["embedding"], np.float32) for r in rows]
            if any(len(v) != dims for v in out):
                raise ValueError(f"expected {dims} dimensions")
            return out

        return run

    return make


def embed(tokens: Column, provider: Provider = hash_provider, batch: int = 64) -> Column:
    """Vectors of token arrays by an embedding provider, in batches that keep the order."""
    if session := SparkSession.getActiveSession():
        ship_package(session)

    if provider is hash_provider:

        @F.arrow_udf("array<float>")
        def hashed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            embedder = HashEmbedder()
            for part in parts:
                found = [embedder.embed_lists(part.slice(at, 1024)).ravel() for at in range(0, len(part), 1024)]
                ends = np.arange(0, (len(part) + 1) * DIMS, DIMS, dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.float32), *found])))

        return hashed(tokens)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for part in parts:
            rows = [list(x) if x is not None else [] for x in part]
            out: list[np.ndarray] = []
            for at in range(0, len(rows), batch):
                out += model(rows[at : at + batch])
            yield pd.Series(out)

    return run(tokens)
