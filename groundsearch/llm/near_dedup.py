"""Near-dedup with order MinHash: sketches of ordered k-mers propose pairs, banded alignment decides.

Every five-word k-mer of a text is labelled with its occurrence number.  Each of `SKETCHES` hash functions
picks the `PICKS` labelled k-mers with the least values, and their hash in text order is one sketch.
Texts that share a sketch are candidates, and those whose word edit similarity is `SIMILARITY` or more
are linked; linked texts are one class.

Exact copies are folded into one row for each text first.  A bucket's members are compared with a pivot, the one
that meets most texts over all its buckets, so a bucket of n texts gives n - 1 pairs, and buckets of one group give
mostly the same ones.  Links so far make components, and a member that is in
another one than its bucket's pivot goes on: in a small bucket it is compared with all members of other
components.  A large one, which a common passage or a group of copies makes, goes on whole: it is dealt anew by the
rarest words of its texts (the prefix filter, which loses no pair), and in each of these word buckets the
members apart are compared with all of other components that share a sketch and that lengths and positions allow.  So no bucket is cut.

Scale: what is shuffled is sketches (8 bytes each) and, once, texts.  Bucket tables are written before
joins, so adaptive execution may split hot buckets, pivots and classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.llm.alignment import similar
from groundsearch.llm.common import arrow_batches, fixed, free_name, materialise, read_table, row_ids, without
from groundsearch.llm.components import components
from groundsearch.llm.ngrams import as_bytes

K, PICKS, SKETCHES, SIMILARITY = 5, 2, 96, 0.8
#: Members of a bucket up to which those apart from the pivot are compared with every member.
SMALL = 12
#: Partners in small buckets up to which a text is compared with each of them; with more, its rare words choose among them.
PARTNERS = 16
#: Hash bits by which the words of large buckets are counted, to take rare ones first.
SLOT_BITS = 20
#: Tokens of a text by which a pair that an earlier word bucket makes is known.
RAREST = 256
#: Rows of word buckets that a Python worker passes on at once, or one text's.
ROWS = 8192
#: Hashes of words that a Python worker keeps, some 150 bytes each.
KNOWN_WORDS = 1 << 17
_RANDOM = np.random.default_rng(11)
_ODD = _RANDOM.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The hash functions: a labelled k-mer's upper 32 bits, multiplied; numpy has vector instructions for these.
_HASHES = _RANDOM.integers(0, 1 << 31, 4 * SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS and len(word) < 64:
            self[word] = found
        return found


_hashes = _WordHashes()


def occurrences(grams: np.ndarray) -> np.ndarray:
    """How often each of grams came before."""
    by = np.argsort(grams, kind="stable")
    new = np.concatenate([[True], grams[by][1:] != grams[by][:-1]])
    times = np.zeros(len(grams), np.int64)
    if not new.all():
        at = np.arange(len(grams))
        times[by] = at - np.maximum.accumulate(np.where(new, at, 0))
    return times


def labelled_kmers(words: list[bytes], k: int = K) -> np.ndarray:
    """Hashes of (k-mer, how often it came before) in text order; a text of fewer than k words is one k-mer."""
    h = word_hashes(words)
    if len(h) < k:
        return mix((h * _ODD[-len(h) :]).sum(keepdims=True) + np.uint64(len(h))) if len(h) else h
    n = len(h) - k + 1
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams += h[i : i + n] * _ODD[-1 - i]
    return labelled(mix(grams))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def labelled(grams: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """One hash of each gram and how often it came before; the first keeps its own."""
    times = (occurrences(grams) if times is None else times).astype(np.uint64)
    return np.where(times > 0, mix(grams + times * np.uint64(0x9E3779B97F4A7C15)), grams)


def order_sketches(grams: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """The order MinHash sketches of labelled k-mers; a text with fewer than `picks` uses all of them."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    upper = (grams >> np.uint64(32)).astype(np.uint32)
    out, step = np.arange(sketches, dtype=np.uint64), max(1, (1 << 18) // len(grams))
    for at in range(0, sketches, step):
        values = upper[None, :] * _HASHES[at : min(at + step, sketches), None]
        row, best = np.arange(len(values)), []
        for _ in range(min(picks, len(grams))):
            best.append(values.argmin(1))
            values[row, best[-1]] = np.uint32(0xFFFFFFFF)
        for place in np.sort(np.stack(best), 0):  # in text order
            out[at : at + len(values)] = mix(out[at : at + len(values)] * np.uint64(0xD6E8FEB86659FD93) + grams[place])
    return out


def sketch_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, id, digest of the text, n_words and sketches of each row."""
    take = row_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("rid", "id", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            words = [t.split() for t in texts]
            sketches = [order_sketches(labelled_kmers(w)).view(np.int64) for w in words]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sketches])))
            digests = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array([len(w) for w in words], pa.int64()), lists], ["rid", "id", "digest", "n_words", "sketches"])

    kind = take.schema["id"].dataType.simpleString()
    return take.mapInArrow(made, f"rid long, id {kind}, digest binary, n_words long, sketches array<long>")


def _aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b, linked for pairs (a, b) of rows; texts has rid and text."""
    left = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [similar(x.split(), y.split(), least) for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return both.mapInArrow(align, "a long, b long, linked boolean")


def links(rows: DataFrame, docs: DataFrame, text_col: str, least: float = SIMILARITY) -> DataFrame:
    """a, b: edges that join what verified links join, between the rows of sketch_rows(), one for each different text; docs has a rid column.

    Links of pivots are given as a star for each component.
    """
    members = materialise(rows.select("rid", "n_words", F.explode("sketches").alias("sketch")), "members")
    buckets = members.groupBy("sketch").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = members.join(materialise(buckets, "buckets").hint("merge"), "sketch")
    members = materialise(members.select("sketch", "rid", "n_words", "size"), "members")
    # The more members a text meets, the nearer it is to the middle of its group of copies, and the more of them it is like.
    central = materialise(members.groupBy("rid").agg(F.sum("size").alias("central")), "central")
    members = materialise(members.join(central.hint("merge"), "rid"), "members")
    pivots = members.groupBy("sketch").agg(F.max(F.struct("central", "rid", "n_words")).alias("pivot"))
    members = members.join(materialise(pivots, "pivots").hint("merge"), "sketch")
    members = materialise(members.select("sketch", "rid", "n_words", "pivot", "size"), "members")
    needed = materialise(members.select("rid").distinct(), "needed")
    texts = materialise(docs.select("rid", F.col(text_col).alias("text")).join(needed.hint("merge"), "rid"), "texts")
    left = members.filter(F.col("rid") != F.col("pivot.rid"))
    to_pivot = lambda m: m.select(F.col("rid").alias("a"), F.col("pivot.rid").alias("b"), F.col("n_words").alias("n_a"), F.col("pivot.n_words").alias("n_b"))
    decided = _decide(to_pivot(left), texts, least)

    # What pivots have linked so far is one; only members apart from their bucket's pivot go on.
    label = components(decided.filter("linked").select("a", "b"))
    members = members.join(label.withColumnRenamed("node", "rid").hint("merge"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    members = members.withColumn("pivot_rid", F.col("pivot.rid")).drop("pivot")
    pivots = label.select(F.col("node").alias("pivot_rid"), F.col("label").alias("pivot_label")).hint("merge")
    is_apart = (F.col("label") != F.coalesce("pivot_label", "pivot_rid")).alias("apart")
    members = materialise(members.join(pivots, "pivot_rid", "left").select("sketch", "rid", "n_words", "size", "label", is_apart), "members")
    apart = members.filter("apart")
    # A large bucket with members apart goes on whole, as what is apart may be like any of its members; so do the small ones of a
    # text that has many partners in them.
    busy = apart.filter(F.col("size") <= SMALL).groupBy("rid").agg(F.sum(F.col("size") - 1).alias("partners")).filter(F.col("partners") > PARTNERS)
    loose = apart.join(busy.select("rid", F.lit(True).alias("busy")).hint("merge"), "rid", "left").filter((F.col("size") > SMALL) | F.col("busy"))
    crowded = materialise(loose.select("sketch").distinct(), "crowded").hint("merge")
    more = _pairs(apart.join(crowded, "sketch", "left_anti"), members.filter(F.col("size") <= SMALL), "sketch")
    inside = members.join(crowded, "sketch")
    whole = inside.groupBy("rid", "n_words", "label").agg(F.max("apart").alias("apart"), F.collect_set("sketch").alias("sketches"))
    big = _with_prefixes(whole, texts, least)
    rest = _decide(more.unionByName(_prefix_pairs(big, least)), texts, least)
    stars = label.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return stars.unionByName(rest.filter("linked").select("a", "b"))


def _pairs(some: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """a, b, n_a, n_b with a > b: rows of some and others (rid, n_words, label) with the same key and different labels; buckets are small."""
    one, two = F.struct("rid", "n_words"), F.struct(F.col("rid_").alias("rid"), F.col("n_words_").alias("n_words"))
    right = others.select(key, F.col("rid").alias("rid_"), F.col("n_words").alias("n_words_"), F.col("label").alias("label_"))
    both = some.select(key, "rid", "n_words", "label").join(right.hint("merge"), key).filter("label <> label_")
    both = both.select(F.greatest(one, two).alias("x"), F.least(one, two).alias("y"))
    return both.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"), F.col("x.n_words").alias("n_a"), F.col("y.n_words").alias("n_b"))


def _decide(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b, linked for each different pair (a, b, n_a, n_b); lengths too far apart need no alignment."""
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least) - 1e-9
    pairs = materialise(pairs.select("a", "b", fits.alias("fits")).distinct(), "pairs")
    return materialise(_aligned(pairs.filter("fits"), texts, least).unionByName(pairs.filter("not fits").select("a", "b", F.lit(False).alias("linked"))), "decided")


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How many tokens of the texts fall to each slot; at most 2 ** SLOT_BITS rows are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            tokens = [labelled(word_hashes(t.split())) for t in as_bytes(batch.column(0))]
            n += np.bincount(_slots(np.concatenate([np.zeros(0, np.uint64), *tokens])), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["slot", "n"])

    got = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def prefix_words(text: bytes, often: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(key, low, high, left) of a text's prefix: its tokens are those of _with_prefixes(), gathered by word.

    A word's tokens whose numbers lie between the same powers of two share a key, and low and high are the least and greatest of
    these numbers; left says how many tokens of the text there are from the first of them on.
    """
    h = word_hashes(text.split())
    times = occurrences(h)
    tokens = labelled(h, times)
    n = len(tokens) - int(np.ceil(least * len(tokens) - 1e-9)) + 1 if len(tokens) else 0
    chosen = np.lexsort((tokens, often[_slots(tokens)]))[:n]
    number = times[chosen] + 1
    key = mix(h[chosen] + np.frexp(number.astype(np.float64))[1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]])) if n else np.zeros(0, np.int64)
    if not len(start):
        return key, number, number, number
    return key[by][start], np.minimum.reduceat(number[by], start), np.maximum.reduceat(number[by], start), len(tokens) - by[start]


def rarest_tokens(text: bytes, often: np.ndarray, least: float, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first `RAREST` tokens of a text's prefix that others may have, and how many of them lie before each of its keys, by left of prefix_words()."""
    tokens = labelled(word_hashes(text.split()))
    n = len(tokens) - int(np.ceil(least * len(tokens) - 1e-9)) + 1 if len(tokens) else 0
    times = often[_slots(tokens)]
    chosen = np.lexsort((tokens, times))[:n]
    at = np.flatnonzero(times[chosen] > 1)[:RAREST]
    return tokens[chosen[at]], np.searchsorted(at, len(tokens) - left)


def _with_prefixes(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """members (rid, n_words, label, apart, sketches) with the words of each text's prefix, as prefix_words() gives them.

    Tokens are (word, how often it came before), those in the rarest slots first, and the prefix of n of them has
    n - ceil(least * n) + 1.  Texts with edit similarity `least` have that share of the longer one's tokens in common, so
    under any order that all texts share they have a token of their prefixes in common.
    """
    wanted = materialise(members.join(texts.hint("merge"), "rid").select("rid", "n_words", "label", "apart", "sketches", "text"), "wanted")
    shared = members.sparkSession.sparkContext.broadcast(_frequencies(wanted))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            texts = as_bytes(batch.column(5))
            made = [prefix_words(text, often, least) for text in texts]
            sizes = np.array([len(m[0]) for m in made], np.int64)
            cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // ROWS)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(made)], strict=True):
                if a == b:
                    continue
                rarest, before = zip(*(rarest_tokens(t, often, least, m[3]) for t, m in zip(texts[a:b], made[a:b], strict=True)), strict=True)
                ends = np.cumsum([0, *map(len, rarest)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rarest).view(np.int64)))
                key, low, high, left = (np.concatenate(x) for x in zip(*made[a:b], strict=True))
                at = pa.array(np.repeat(np.arange(b - a), sizes[a:b]))
                columns = [pa.array(x) for x in (np.concatenate(before).astype(np.int32), low, high, left, key.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in (*batch.slice(a, b - a).columns[:5], lists)), *columns], names)

    names = ["rid", "n_words", "label", "apart", "sketches", "rarest", "cut", "low", "high", "left", "token"]
    kinds = "rid long, n_words long, label long, apart boolean, sketches array<long>, rarest array<long>, cut int, low long, high long, left long, token long"
    return materialise(wanted.mapInArrow(prefixes, kinds), "prefixes")


def _prefix_pairs(big: DataFrame, least: float) -> DataFrame:
    """a, b, n_a, n_b for rows of _with_prefixes(), one of them apart, that share a large bucket's sketch and a token and have other labels.

    Every word bucket is compared in full, less pairs that no sketch proposes, and those that can't be alike: by their lengths, or as
    fewer tokens than they must share are left from the first they share (the position filter).  A pair is made in the first of its
    word buckets: where both texts have a common token before, the bucket of that one passes the same filters and makes the pair.
    As each text looks back on `RAREST` tokens, a pair may be made more than once, but never not at all.
    """
    row = F.struct("rid", "n_words", "label", "apart", "sketches", "low", "high", "left", F.slice("rarest", F.lit(1), F.col("cut")).alias("before"))
    # Both sides are the same rows under names of their own, so that one exchange serves them.
    one, two = big.select("token", row.alias("x")).alias("s"), big.select("token", row.alias("y"))
    common = F.expr("greatest(x.n_words, y.n_words)") * F.lit(least) - 1e-9
    fits = (F.expr("least(x.n_words, y.n_words)") >= common) & (F.least("x.left", "y.left") >= common)
    meet = F.expr("x.low <= y.high and y.low <= x.high and x.label <> y.label and (x.apart or y.apart) and x.rid > y.rid")
    first = F.expr("not arrays_overlap(x.before, y.before)") & F.arrays_overlap("x.sketches", "y.sketches")
    both = one.join(two.hint("merge"), (F.col("s.token") == two["token"]) & meet & fits & first)
    return both.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"), F.col("x.n_words").alias("n_a"), F.col("y.n_words").alias("n_b"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: rid, id, class_id, class_size, kept.

    class_id is the least id of the class (null ids go last, ties by row), and that row is kept.  Null text
    is empty; texts without words are alike only when equal.  Rows that repeat are copies.
    An empty table gives an empty result.  A very long text is compared whole, in memory that grows with the share of its words
    that may differ.
    """
    docs = fixed(docs)
    arrow_batches(docs.sparkSession)
    rows = materialise(sketch_rows(docs, id_col, text_col), "sketches")
    texts = materialise(rows.groupBy("digest").agg(F.min("rid").alias("rid")), "texts")
    firsts = rows.join(texts.select("rid").hint("merge"), "rid")
    edges = links(firsts, row_ids(docs), text_col, least)
    labels = components(materialise(edges, "links"))
    texts = texts.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select("digest", F.coalesce("label", "rid").alias("label"))
    labelled = rows.select("rid", "id", "digest").join(materialise(texts, "labels"), "digest").select("rid", "id", "label")
    labelled = materialise(labelled, "labelled")
    classes = labelled.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    joined = labelled.join(materialise(classes, "classes"), "label")
    return joined.select("rid", "id", F.col("first.id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class, with its columns; nulls, ties, repeated rows and empty tables as in classify()."""
    docs = fixed(docs)
    rid = free_name(docs)
    gone = classify(docs, id_col, text_col, least).filter("not kept").select(F.col("rid").alias(rid))
    return without(row_ids(docs, rid), materialise(gone, "gone"), rid).select(*docs.columns)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
