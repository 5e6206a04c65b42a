"""Token counts, quality rules, packing and span dedup against brute force and the tokenizers library."""

import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundsearch.llm import ngrams, packing, quality_rules, run_index, span_dedup, token_counts, tokenization
from groundsearch.shared import shared_dir

ODD = [None, "", " ", "\n\n", "a", "Ä\u0301 b", "<|endoftext|> x", "日本語 テキスト 🙂🙂", "x" * 3000, "w " * 5000, "a\x00b", "ΑΣ ΟΔΟΣ", "don't we'll 12 3\u00a04\u2003z", "\u0301a \u0301b", "▁x▁"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, ["en", None, "de"][i % 3], "s", len(t or ""), 1) for i, t in enumerate(texts)], SCHEMA)


def test_counts_are_those_of_the_unigram_tokenizer(spark):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = token_counts.default_vocabulary()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    bytes_ = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size()) if model.is_byte(i)]
    known = Tokenizer(models.Unigram([("<unk>", 0.0), *bytes_, *token_counts.load_pieces(path)], unk_id=0, byte_fallback=True))
    known.pre_tokenizer = pre_tokenizers.Metaspace()
    for r in token_counts.count_tokens(frame(spark, ODD * 2)).collect():
        text = (ODD * 2)[r.id] or ""
        assert r.n_tokens == len(known.encode(text, add_special_tokens=False).ids), text[:50]
        assert (r.n_chars, r.n_bytes) == (len(text), len(text.encode()))
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("abc▁x", max_size=24), st.dictionaries(st.text("abc▁", min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -3.0, -4.0]), min_size=1, max_size=12), st.booleans())
def test_ties_and_unknowns(text, pieces, unused):
    from tokenizers import Tokenizer, models, pre_tokenizers

    known = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], unk_id=0, byte_fallback=False))
    known.pre_tokenizer = pre_tokenizers.Metaspace()
    counter = token_counts.TokenCounter(list(pieces.items()), byte_fallback=False)
    assert counter.text(text) == len(known.encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abCé \t\n\x0b\x1c\x85\u00a0\u0301<|Σ'1!.,»²İ\u0958"), max_size=30), max_size=4))
def test_word_encoder_is_the_tokenizer(texts):
    from tokenizers import Tokenizer

    path = tokenization.default_tokenizer()
    plain = Tokenizer.from_file(path)
    got = tokenization.encoder(path).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenization.default_tokenizer())
    texts = ODD + [" ".join(random.Random(i).choices(["the", "of", "stone", "12"], k=i * 7 % 300)) for i in range(80)] + ["same text here"] * 60
    pieces = packing.pack_documents(frame(spark, texts), length=128).collect()
    of, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(of) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = [*plain.encode(t or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(of[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == parts[0].sequence_tokens and (at == 128 or at & (at - 1) == 0 and at < 128)
    assert packing.pack_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert_key(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    along = cells[np.argsort(key)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def plain_features(text):
    words, n = [], 0
    for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text):
        words.append(w)
        n += len(w)
    lines = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(words), n, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab# \n\t\u00a0\u0085é<"), max_size=60))
def test_features(text):
    assert quality_rules.text_features(text.encode()) == plain_features(text)


def test_quality_rules(spark):
    rng = random.Random(4)
    words = ["stone", "river", "of", "the", "lamp", "grows", "under", "winter", "light", "and"]
    clean = [" ".join(rng.choices(words, k=rng.randrange(60, 160))) + "." for _ in range(200)]
    noise = ["".join(rng.choices("#*$%&|<>qxzjkw ", k=600)) for _ in range(3)]
    rows = clean + noise + ODD + ["the stone " * 60]
    got = {r.doc_id: r for r in quality_rules.score_documents(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        n, *rest = plain_features(t or "")
        r = got[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest]
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(200) if not got[i].base_failed)
    assert not any(got[i].kept for i in range(200, 203))
    left = quality_rules.drop_rejected(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.score_documents(frame(spark, [])).count() == 0


def test_bands_and_verdicts_are_brute_force(spark):
    """The perplexities, the quartiles of each language and what lies outside of its band, computed anew."""
    rng = random.Random(14)
    words = ["stone", "river", "of", "the", "lamp", "grows", "under", "winter", "light", "and"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40, 160))) for _ in range(150)] + ["".join(rng.choices("#*$%&|<>qxzjkw  ", k=1500)) for _ in range(4)]
    got = {r.doc_id: r for r in quality_rules.score_documents(frame(spark, texts)).collect()}
    counts = Counter()
    for t in texts:
        s = [0, 0, 0, *ngrams.FOLD[np.frombuffer(t.encode(), np.uint8)].tolist(), 0]
        counts.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    p, known, bits = slow_kneser_ney(counts), {}, {}
    for i, t in enumerate(texts):
        s = [0, 0, 0, *ngrams.FOLD[np.frombuffer(t.encode(), np.uint8)].tolist(), 0]
        grams = [tuple(s[k : k + 4]) for k in range(len(s) - 3)]
        for g in set(grams) - set(known):
            known[g] = math.log2(p(g))
        bits[i] = -sum(known[g] for g in grams) / len(grams)
        assert got[i].perplexity == pytest.approx(2 ** bits[i], rel=1e-3)
    for k in range(3):
        mine = [i for i in range(len(texts)) if i % 3 == k]
        passed = sorted(bits[i] for i in mine if not got[i].base_failed)
        low, high = (passed[math.ceil(q * len(passed)) - 1] for q in (0.25, 0.75))
        reach = 3 * max(high - low, 0.05)
        for i in mine:
            inside = low - reach <= bits[i] <= high + reach
            if min(abs(bits[i] - low + reach), abs(bits[i] - high - reach)) > 1e-4:
                assert got[i].kept == (not got[i].base_failed and inside)
    assert sum(not r.kept and not r.base_failed for r in got.values()) >= 4


def test_bands_part_labelled_junk(spark):
    """Of labelled documents that pass the base rules, most of the junk is rejected and nearly all of the rest kept."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    judged = quality_rules.op2_quality_rules(spark, sf_dir).filter("not base_failed").join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n[0, False] > 0.6 * (n[0, False] + n[0, True])
    assert n.get((1, False), 0) < 0.002 * n[1, True]


def slow_kneser_ney(counts):
    """P(symbol | context) by the textbook recursion over dictionaries."""
    tables = {4: Counter(counts)}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    discount = {}
    for n, table in tables.items():
        k = [sum(c == j for c in table.values()) for j in range(5)]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
        d = [1 - 2 * y * k[2] / k[1] if k[1] else 0.5, 2 - 3 * y * k[3] / k[2] if k[2] else 1.0, 3 - 4 * y * k[4] / k[3] if k[3] else 1.5]
        discount[n] = [0, *(min(max(x, 0.05), j - 0.05) for j, x in enumerate(d, 1))]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 64
        below = {h: c for h, c in tables[n].items() if h[:-1] == g[:-1]}
        total = sum(below.values())
        if not total:
            return p(g[1:])
        mass = sum(discount[n][min(c, 3)] for c in below.values()) / total
        c = below.get(g, 0)
        return (c - discount[n][min(c, 3)]) / total + mass * p(g[1:])

    return p


def test_kneser_ney_and_its_table(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abca b.", k=rng.randrange(0, 60))) for _ in range(40)]
    rows = ngrams.count_grams(frame(spark, texts), "text").collect()
    counts = {tuple((r.code >> s) & 63 for s in (18, 12, 6, 0)): r.n for r in rows}
    expected = Counter()
    for t in texts:
        s = [0, 0, 0, *ngrams.FOLD[np.frombuffer(t.encode(), np.uint8)].tolist(), 0]
        expected.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    assert counts == expected
    model = ngrams.train(ngrams.count_grams(frame(spark, texts), "text"))
    assert (np.diff(model.keys.astype(np.float64)) >= 0).all()
    p = slow_kneser_ney(counts)
    for g in [*list(counts)[:60], (1, 2, 3, 4), (0, 0, 0, 63), (9, 9, 9, 9), (0, 0, 1, 5)]:
        code = (g[0] << 18) | (g[1] << 12) | (g[2] << 6) | g[3]
        assert 2.0 ** float(model.lookup(np.array([code]))[0]) == pytest.approx(p(g), rel=1e-4)
    every = model.lookup(np.arange(ngrams.GRAMS)[: 64 * 40_000])
    assert (2.0 ** every.reshape(-1, 64).astype(float)).sum(1) == pytest.approx(1, abs=1e-3)
    assert math.isfinite(ngrams.log_probs(model, [b"", b"zz\xff"])[0].sum())


def brute_spans(texts, length):
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    for b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        left = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        yield len(b), sum(gone), sum(gone[k] > (gone[k - 1] if k else 0) for k in range(len(b))), hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize(("length", "gram", "wide"), [(40, 12, 3000), (40, 12, 2), (30, 30, 3)])
def test_span_dedup(spark, length, gram, wide):
    rng = random.Random(length + wide)
    passages = [" ".join(rng.choice(["ab", "dé", "zz"]) + str(rng.randrange(30)) for _ in range(14)) for _ in range(5)]
    texts = [None, "", "ab " * 50, "x" * 39, "x" * 200, "y" * 40]
    for _ in range(80):
        parts = [rng.choice(passages)[rng.randrange(9) :] if rng.random() < 0.5 else str(rng.random())[: rng.randrange(18)] for _ in range(rng.randrange(5))]
        texts.append("".join(parts))
    texts += texts[10:14]
    got = {r.id: r for r in span_dedup.remove_repeats(frame(spark, texts), length=length, gram=gram, wide=wide).collect()}
    for i, e in enumerate(brute_spans([(t or "").encode() for t in texts], length)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == e, texts[i]


def test_span_dedup_leaves_one_table_and_no_shuffle(spark):
    def tables():
        return set(os.listdir(os.path.join(shared_dir(spark).removeprefix("file:"), "tables")))

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {int(x) for x in re.findall(r"shuffle_(\d+)_", blocks.mkString(" "))}

    passage = " ".join(map(str, range(40)))
    docs = frame(spark, [f"{i} {passage[i % 9 :]} {i}" for i in range(60)])
    span_dedup.remove_repeats(docs, length=40, gram=12, wide=2).collect()
    old_tables, last = tables(), max(shuffles(), default=-1)
    got = span_dedup.remove_repeats(docs, length=40, gram=12, wide=2)
    assert [x.split("-")[0] for x in tables() - old_tables] == ["spans"]
    until = time.monotonic() + 20  # executors delete files in the background
    while (left := {x for x in shuffles() if x > last}) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
    assert got.filter("n_removed > 0").count() == got.filter("n_removed > 0").count() == 60


def test_span_dedup_of_nothing(spark):
    assert span_dedup.remove_repeats(frame(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=5))
def test_run_length_index(strings):
    index = run_index.RunLengthIndex.build(strings)
    text = index.text.tobytes()
    assert run_index.suffix_array(index.text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    for i, longest in enumerate(index.statistics().tolist()):
        inside = text[i:].split(b"\xff")[0]
        lengths = [k for k in range(len(inside) + 1) if any(text.startswith(inside[:k], j) for j in range(len(text)) if j != i)]
        assert longest == max(lengths, default=0)  # a lone border matches nothing


def test_gram_counts_need_little_memory():
    """Counting takes memory by the codes seen, not 8 bytes for each code of the alphabet."""
    texts = ["".join(random.Random(i).choices("abcdefgh ", k=40_000)) for i in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 8]), pa.array(np.arange(8, dtype=np.int32) % 2)], ["text", "label"]) for i in range(0, 40, 8)]
    tracemalloc.start()
    got = list(ngrams.counted(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 < 8 * ngrams.GRAMS
    for label, batch in enumerate(got):
        n = Counter()
        for t in texts[label::2]:
            n.update(ngrams.codes([t.encode()])[0].tolist())
        assert set(batch.column("label").to_pylist()) == {label}
        assert dict(zip(batch.column("code").to_pylist(), batch.column("n").to_pylist(), strict=True)) == n
