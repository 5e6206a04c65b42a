"""Removal of long repeated byte strings, by run-length index.

A byte goes if a string of `length` bytes that covers it also starts anywhere else.  No index holds the whole corpus;
equal strings are brought together first.  In every window of `length` bytes the grams of `GRAM`
bytes with the least hash are its anchors, so equal windows have equal anchors at equal places.  An
anchor's context is all bytes that a window around it can reach.

1. Anchors that occur once go.  Where the same context (by a hash of 128 bits, beside the anchor's) occurs twice, all
   of it is repeated.
2. What is left are anchors with different contexts, at the borders of repeated passages and in edited copies.  The
   windows around an anchor start in a range of places; in each of `CORES` parts of it they have a core in common, and a
   context none of whose cores another context of its anchor has goes, as no window of it is repeated.
3. One of each different context left goes, by anchor, to a task that joins overlapping ones, builds a run-length index
   of a bounded number of bytes and streams matching statistics; places with a match of `length` or more
   start repeated strings.
4. An anchor with more than `WIDE` different contexts left (a passage in very many documents) doesn't fit one index: its
   windows are counted by hash with map-side aggregation, many at once where they agree.

Scale: shuffled are anchors (some 1% of text positions), the contexts of step 3, and the texts twice, by
row.  Every join side is a written table or a plain exchange, so hot anchors and contexts can be split.
Each table written goes after its last read, and each shuffle once what it was for is written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.llm.common import arrow_batches, fixed, materialise, read_table, replace, row_ids, scratch_scope, shuffles_dropped, sweep
from groundsearch.llm.near_dedup import mix
from groundsearch.llm.ngrams import as_bytes
from groundsearch.llm.run_index import RunLengthIndex

LENGTH, GRAM = 400, 128
#: Different contexts of one anchor that an index takes, and bytes of one index.
WIDE, INDEX_BYTES = 500, 2 << 20
#: Parts of the range of windows around an anchor, each with a core that its windows share; bits kept of a core's hash.
CORES, CORE_BITS = 3, 21
#: Gram places worked on at once.
BLOCK = 1 << 17
_RANDOM = np.random.default_rng(17)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram of data: a rolling polynomial, mixed."""
    n = len(data)
    size = 1 << max(n, 1).bit_length()
    if size not in _powers_of:
        _powers_of.clear()
        _powers_of[size] = _powers(_INVERSE, size), _powers(_BASE, size)
    down, up = _powers_of[size]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * down[:n], out=sums[1:])
    return mix((sums[gram:] - sums[: n + 1 - gram]) * up[: n + 1 - gram])


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each window of width."""
    have = 1
    while have * 2 <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return least(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the anchors of texts; each window of `length` bytes has one at least."""
    window = length - gram + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    long = np.flatnonzero(sizes >= length)
    sizes = sizes[long]
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join([texts[i] for i in long]), np.uint8)
    found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    edge = np.zeros(len(data) + 1, np.int8)  # 1 where a gram lies in one text
    edge[ends - sizes] += 1
    edge[ends - gram + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    for at in range(0, len(data), BLOCK):
        first, last = max(0, at - window + 1), min(len(data) - gram + 1, at + BLOCK + window - 1)
        if last <= first:
            break
        h = gram_hashes(data[first : last + gram - 1], gram)
        h[~inside[first:last]] = _NONE
        low = np.concatenate([np.full(window - 1, _NONE), h, np.full(window - 1, _NONE)])
        high = _sliding(_sliding(low, window, np.minimum), window, np.maximum)  # of all windows around a place, the greatest minimum
        mine = slice(at - first, min(at + BLOCK, last) - first)
        hit = np.flatnonzero((high[mine] == h[mine]) & (h[mine] != _NONE))
        found_at.append(hit + at)
        found.append(h[mine][hit])
    place = np.concatenate(found_at)
    text = np.searchsorted(ends, place, side="right")
    return long[text], place - (ends - sizes)[text], np.concatenate(found)


def core_ranges(length: int, gram: int) -> list[tuple[int, int]]:
    """(first, last) for each part of the windows around an anchor: how far before it they start at most and at least."""
    span = length - gram
    cuts = np.linspace(0, span + 1, min(CORES, span + 1) + 1).astype(int)
    return [(span - int(a), span - int(b) + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def cores(text: bytes, place: int, length: int, ranges: list[tuple[int, int]]) -> int:
    """Hashes of the cores of an anchor at place, packed; 0 for a part without a window in the text."""
    out = 0
    for i, (first, last) in enumerate(ranges):
        if max(place - first, 0) <= min(place - last, len(text) - length):
            core = xxhash.xxh3_64_intdigest(text[place - last : place - first + length])
            out |= (core % ((1 << CORE_BITS) - 1) + 1) << (CORE_BITS * i)
    return out


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, context and more (128 bits of hash), cores, rid, place, low, high (the context's bytes) of each anchor of docs (rid, text)."""
    ranges, half = core_ranges(length, gram), (1 << 64) - 1

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            text, place, anchor = anchors(texts, length, gram)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            low, high = np.maximum(place + gram - length, 0), np.minimum(place + length, sizes[text])
            where = list(zip(text.tolist(), place.tolist(), low.tolist(), high.tolist(), strict=True))
            contexts = [xxhash.xxh3_128_intdigest(texts[t][a:b], p - a) for t, p, a, b in where]
            context, more = (np.fromiter(x, np.uint64, len(where)).view(np.int64) for x in ((c & half for c in contexts), (c >> 64 for c in contexts)))
            core = np.fromiter((cores(texts[t], p, length, ranges) for t, p, _, _ in where), np.int64, len(where))
            rid = batch.column(0).to_numpy()[text]
            columns = (anchor.view(np.int64), context, more, core, rid, place.astype(np.int32), low.astype(np.int32), high.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "context", "more", "cores", "rid", "place", "low", "high"])

    return docs.mapInArrow(made, "anchor long, context long, more long, cores long, rid long, place int, low int, high int")


def _with_partner(contexts: DataFrame) -> DataFrame:
    """Those of contexts (anchor, cores and more) that have a core which another context of the anchor has."""
    mask = (1 << CORE_BITS) - 1
    parts = F.array(*(F.shiftrightunsigned("cores", CORE_BITS * i).bitwiseAND(F.lit(mask)) for i in range(CORES)))
    each = contexts.select("anchor", "cores", F.posexplode(parts).alias("k", "core")).filter("core > 0")
    shared = each.groupBy("anchor", "k", "core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "k", "core")
    shared = materialise(shared, "cores")
    kept = each.join(shared.hint("merge"), ["anchor", "k", "core"]).select("anchor", "cores").distinct()
    kept = replace([shared], kept, "partners")
    return contexts.join(kept.hint("merge"), ["anchor", "cores"])


def joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [low, high), sorted and disjoint; intervals that touch become one."""
    by = np.argsort(low, kind="stable")
    low, high = low[by], np.maximum.accumulate(high[by]) if len(high) else high
    new = np.concatenate([[True], low[1:] > high[:-1]]) if len(low) else np.zeros(0, bool)
    ends = np.concatenate([new[1:], [True]]) if len(low) else new
    return low[new], high[ends]


def index_spans(rids: np.ndarray, low: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, low, high): the bytes of the contexts that a string of `length` covers which also starts elsewhere in them."""
    by = np.lexsort((low, rids))
    strings, places = [], []
    last, end = None, 0
    for i in by.tolist():
        rid, a, part = int(rids[i]), int(low[i]), parts[i]
        if rid == last and a <= end:
            if a + len(part) > end:
                strings[-1].append(part[end - a :])
                end = a + len(part)
        else:
            strings.append([part])
            places.append((rid, a))
            last, end = rid, a + len(part)
    index = RunLengthIndex.build(strings := [b"".join(s) for s in strings])
    hits = np.flatnonzero(index.statistics() >= length)
    begins = np.cumsum([0, *(len(s) + 1 for s in strings)])[:-1]
    a, b = joined(hits, hits + length)
    of = np.searchsorted(begins, a, side="right") - 1
    rid, first = np.array(places, np.int64).reshape(-1, 2).T
    shift = first[of] - begins[of]
    return rid[of], a + shift, b + shift


def _indexed(contexts: DataFrame, length: int) -> DataFrame:
    """rid, low, high of repeated bytes among contexts (anchor, rid, low, part), which are gathered by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            rids, low, parts = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in index_spans(np.array(rids, np.int64), np.array(low, np.int64), parts, length)], ["rid", "low", "high"])

        for batch in batches:
            for anchor, rid, low, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last and size >= INDEX_BYTES:
                    yield flush()
                    size = 0
                held.append((rid, low, part))
                size, last = size + len(part), anchor
        if held:
            yield flush()

    return contexts.select("anchor", "rid", "low", "part").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "rid long, low long, high long")


def _windowed(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors with very many contexts (anchor, rid, place, low, part), by counting hashes in two steps.

    The windows around an anchor start in some span + 1 places, cut into ranges of about the root of that.  Where a range's
    bytes occur twice, all its windows are repeated; where what its windows have in common occurs once, none is.  Only the
    ranges between are cut into single windows, with one of each kind that shares their common bytes.
    """
    span = length - gram
    step = int(span**0.5) + 1
    digest = lambda anchor, offset, data: xxhash.xxh3_128_digest(anchor.to_bytes(8, "little", signed=True) + offset.to_bytes(4, "little") + data)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, rid, place, low, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for offset in range(0, span + 1, step):
                    first, last = place - span + offset, place - span + min(offset + step - 1, span)
                    a, b = max(first, low), min(last, low + len(part) - length)
                    if a <= b:
                        clip = (a - first).to_bytes(4, "little") + (last - b).to_bytes(4, "little")
                        rows.append((digest(anchor, offset, part[last - low : first + length - low]), digest(anchor, offset, clip + part[a - low : b + length - low]), rid, place, a, b))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i < 2 else pa.int64()) for i, c in enumerate(columns)], ["core", "whole", "rid", "place", "a", "b"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, rid, place, low, part, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(digest(anchor, s - place + span, part[s - low : s + length - low]), rid, s) for s in range(a, b + 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i < 1 else pa.int64()) for i, c in enumerate(columns)], ["window", "rid", "low"])

    parts = contexts.select("anchor", "rid", "place", "low", "part")
    cut = materialise(parts.mapInArrow(ranges, "core binary, whole binary, rid long, place long, a long, b long"), "ranges")
    kinds = cut.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "place", "a", "b")).alias("one"))
    kinds = materialise(kinds, "kinds")
    twice = cut.join(kinds.filter("n > 1").select("core", "whole").hint("merge"), ["core", "whole"]).select("rid", F.col("a").alias("low"), (F.col("b") + length).alias("high"))
    twice = replace([cut], twice, "twice")
    between = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("core")
    between = materialise(between, "between")
    places = replace([between, kinds], kinds.join(between.hint("merge"), "core").select("one.rid", "one.place", "one.a", "one.b"), "places")
    single = parts.join(places.hint("merge"), ["rid", "place"]).select("anchor", "rid", "place", "low", "part", "a", "b")
    single = replace([places], single.mapInArrow(windows, "window binary, rid long, low long"), "windows")
    again = materialise(single.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window"), "again")
    repeated = single.join(again.hint("merge"), "window").select("rid", "low", (F.col("low") + length).alias("high"))
    return twice.unionByName(repeated)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """rid, low, high: intervals whose union is the repeated bytes of docs (rid, text)."""
    found = materialise(_occurrences(docs, length, gram), "occurrences")
    mixed = (F.min("context") != F.max("context")) | (F.min("more") != F.max("more"))
    anchors_ = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), mixed.alias("mixed")).filter("n > 1")
    anchors_ = materialise(anchors_.select("anchor", "mixed"), "anchors")
    again = replace([found, anchors_], found.join(anchors_.hint("merge"), "anchor"), "repeated")
    context = ["anchor", "context", "more"]
    contexts = again.groupBy(*context, "cores", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "place", "low", "high")).alias("one"))
    contexts = materialise(contexts, "contexts")
    whole = again.join(contexts.filter("n > 1").select(*context).hint("merge"), context)
    spans = whole.select("rid", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    spans = replace([again], spans, "whole")

    border = replace([contexts], _with_partner(contexts.filter("mixed")), "bordering")
    kinds = materialise(border.groupBy("anchor").agg((F.count(F.lit(1)) > wide).alias("wide")), "kinds")
    per = border.join(kinds.hint("merge"), "anchor").select("anchor", "wide", "one.rid", "one.place", "one.low", "one.high")
    per = per.groupBy("rid").agg(F.collect_list(F.struct("anchor", "wide", "place", "low", "high")).alias("parts"))
    per = replace([border, kinds], per, "border")
    body = docs.select("rid", F.col("text").cast("binary").alias("body")).join(per.hint("merge"), "rid")
    body = body.select("rid", "body", F.explode("parts").alias("p")).select(
        "rid", "p.anchor", "p.wide", "p.place", "p.low", F.expr("substring(body, p.low + 1, p.high - p.low)").alias("part")
    )
    body = replace([per], body, "parts")
    return spans.unionByName(_indexed(body.filter("not wide"), length)).unionByName(_windowed(body.filter("wide"), length, gram))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    Null text counts as empty.  Matches are judged on the whole input and never cross documents; they may overlap.
    Rows that repeat are repeats of each other.  An empty table gives an empty result.  The bytes left
    may end within a character where a repeat does.  A very long text is one row of one task, with its repeats in a list.
    """
    arrow_batches(docs.sparkSession, megabytes=4)
    rows = row_ids(fixed(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    with shuffles_dropped(docs.sparkSession):
        with scratch_scope(scratch := f"repeats-{uuid.uuid4().hex}"):
            spans = repeated_spans(rows.select("rid", "text"), length, gram, wide)
        per = materialise(spans.groupBy("rid").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "spans")
    sweep(docs.sparkSession, scratch)
    both = rows.join(per.hint("merge"), "rid", "left").select("id", F.col("text").cast("binary").alias("text"), "spans.low", "spans.high")
    kind = both.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, low, high in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                a, b = joined(np.array(low or [], np.int64), np.array(high or [], np.int64))
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
                left = b"".join([text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                made.append((len(text), len(text) - len(left), len(a), hashlib.sha256(left).hexdigest(), left))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*made, strict=True)) or [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
