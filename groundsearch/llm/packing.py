"""Packing documents into token sequences along a space-filling curve.

Each document's token ids are hashed into a vector of `SLOTS` signed counts, which a fixed random
matrix projects to `DIMS` dimensions.  Cells of equal probability along each dimension have a
Hilbert key; documents are range-sorted by it and packed in this order, so neighbours in a sequence are
alike.  Each range partition fills its own sequences.  Documents are cut at sequence ends, and what
is left at the end of a partition goes into sequences whose lengths are powers of two: nothing is padded.

Scale: ranges are over (key, id, row), so a key that a third of all rows share is spread over many
ranges.  A task streams: it holds one Arrow batch and one open sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.llm.common import arrow_batches, materialise, read_table, row_ids
from groundsearch.llm.ngrams import as_bytes
from groundsearch.llm.tokenization import default_tokenizer, encoder

LENGTH = 4096
END_ID = 2
SLOTS, DIMS, BITS, SEED = 256, 4, 8, 7


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of integer cells, one row each (Skilling's transform)."""
    x = [c.copy() for c in cells.astype(np.int64).T]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = x[0] ^ np.where(hit, p, swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


def _projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and sign of each id, and the matrix from slots to dimensions."""
    random = np.random.default_rng(SEED)
    return random.integers(0, SLOTS, vocabulary), random.choice([-1.0, 1.0], vocabulary), random.standard_normal((SLOTS, DIMS))


def tokens(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """rid, id, ids (packed), n and z (projected vector) of each row; end_id closes each text."""
    take = row_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("rid", "id", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        slot, sign, matrix = _projection(max(words.tokenizer.get_vocab_size(), end_id + 1))
        end = np.array([end_id], words.dtype).tobytes()
        for batch in batches:
            packed = [x + end for x in words.encode(as_bytes(batch.column(2)))]
            z = np.empty((len(packed), DIMS))
            for i, x in enumerate(packed):
                ids = np.frombuffer(x, words.dtype)
                v = np.bincount(slot[ids], sign[ids], SLOTS)
                z[i] = v @ matrix / max(np.linalg.norm(v), 1e-9)
            sizes = pa.array(np.fromiter(map(len, packed), np.int64, len(packed)) // words.dtype.itemsize)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), sizes, *map(pa.array, np.ascontiguousarray(z.T))], ["rid", "id", "ids", "n", *(f"z{i}" for i in range(DIMS))])

    kind = take.schema["id"].dataType.simpleString()
    return take.mapInArrow(made, f"rid long, id {kind}, ids binary, n long, " + ", ".join(f"z{i} double" for i in range(DIMS)))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    Null or empty text is the end id alone.  Rows that repeat an id are packed each; ties on the curve go by id, then
    by row.  An empty table gives no pieces.  A sequence has `length` tokens, or a smaller power of two.
    """
    arrow_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    dtype = encoder(tokenizer).dtype
    found = materialise(tokens(docs, id_col, text_col, tokenizer, end_id), "tokens")
    axes = [f"z{i}" for i in range(DIMS)]
    stats = found.agg(*(f(a).alias(f"{a}{k}") for a in axes for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([stats[f"{a}m"] or 0.0 for a in axes])
    spread = np.array([stats[f"{a}s"] or 1.0 for a in axes])

    @F.pandas_udf("long")
    def curve(*z: pd.Series) -> pd.Series:
        x = (np.stack([a.to_numpy() for a in z], 1) - mean) / spread
        even = 1 / (1 + np.exp(-1.702 * np.clip(x, -30, 30)))
        return pd.Series(hilbert_key(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    ordered = found.select("rid", "id", "ids", curve(*axes).alias("key"))
    ordered = ordered.repartitionByRange("key", "id", "rid").sortWithinPartitions("key", "id", "rid").select("id", "ids")
    kind = ordered.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        open_, room, rows = [], length, []

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset, total = 0, sum(len(ids) for *_, ids in pieces)
            for id_, start, n, ids in pieces:
                rows.append((id_, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset, total))
                offset += len(ids)
            sequence += 1

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for id_, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(packed, dtype)
                at = 0
                while at < len(ids):
                    piece = ids[at : at + room]
                    open_.append((id_, at, len(ids), piece))
                    at += len(piece)
                    room -= len(piece)
                    if not room:
                        close(open_)
                        open_, room = [], length
            yield batch_of(id_kind)
        left = length - room
        while left:
            size = 1 << (left.bit_length() - 1)
            part, room = [], size
            while room:
                id_, start, n, ids = open_.pop(0)
                part.append((id_, start, n, ids[:room]))
                if len(ids) > room:
                    open_.insert(0, (id_, start + room, n, ids[room:]))
                room -= min(room, len(ids))
            close(part)
            left -= size
        if rows:
            yield batch_of(id_kind)

    return ordered.mapInArrow(cut, f"id {kind}, " + ", ".join(f"{x} long" for x in names[1:])).withColumnRenamed("id", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
