"""Exact dedup, mixing and sharding: brute force and edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest

from groundsearch.llm import exact_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, source string, n_chars long, rid long, name long"


def frame(spark, rows):
    """Rows of (doc_id, text, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, len(t or ""), 7, 7) for i, t, s in rows], SCHEMA)


def fixture_rows():
    random.seed(1)
    base = ["a" * 5000, "a" * 4999 + "b", "a" * 2500 + "c" + "a" * 2499, "", "x", "\U0001f642" * 700, " y ", "y"]
    rows = [(i, random.choice(base), f"s{i % 3}") for i in range(60)]
    return rows + [(None, "x", None), (None, None, "s1"), (5, "x", "s0"), (5, "x", "s0"), (99, "only", None)]


def test_names_follow_texts_and_not_ends(spark):
    rows = fixture_rows()
    got = exact_dedup.name_documents(frame(spark, rows), block=64).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_drop_exact_copies_keeps_columns(spark):
    docs = frame(spark, fixture_rows())
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in fixture_rows()})


def test_rows_that_are_no_scan_are_fixed_first(spark):
    from groundsearch.llm import common

    docs = frame(spark, fixture_rows())
    assert common.fixed(docs.filter("n_chars >= 0").select("*")).sameSemantics(docs.filter("n_chars >= 0").select("*"))
    shuffled = docs.repartition(3)
    assert hasattr(common.fixed(shuffled), "written_to")
    assert hasattr(common.fixed(docs.withColumn("r", __import__("pyspark").sql.functions.rand())), "written_to")
    left = exact_dedup.drop_exact_copies(shuffled)
    assert sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t, _ in fixture_rows()})


def test_a_long_list_is_merged(spark, monkeypatch):
    from groundsearch.llm import common

    docs = frame(spark, fixture_rows())
    short = sorted(map(str, exact_dedup.drop_exact_copies(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert sorted(map(str, exact_dedup.drop_exact_copies(docs).collect())) == short


def test_names_need_no_sample_on_the_driver(spark):
    plan = exact_dedup.name_documents(frame(spark, fixture_rows()))._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.name_documents(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(frame(spark, [])).count() == 0


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.name_documents(frame(spark, fixture_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def water_fill(sizes, weights, budget):
    """Targets by repeated sharing: (size, weight) of each source in exact fractions."""
    full, target = set(), {}
    while True:
        spare = budget - sum(2 * sizes[s] for s in full)
        total = sum(weights[s] for s in sizes if s not in full)
        target = {s: Fraction(2 * sizes[s]) if s in full else spare * weights[s] / total for s in sizes}
        above = {s for s in sizes if s not in full and target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix_targets_and_taken(spark):
    random.seed(2)
    rows = [(i, " ".join("w" for _ in range(random.randrange(0, 40))), random.choice(["a", "b", "c", "d", None])) for i in range(300)]
    rows += [(1000, None, "e"), (1001, "", "f"), (7, "t \t\x0b\r\n w", "a"), (7, "t w", "a")]
    got = mixing.plan_mix(frame(spark, rows), bucket_rows=16).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target = water_fill(sizes, weights, Fraction(3 * sum(sizes.values()), 2))
    taken, buckets = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(target[r.source]))
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        buckets[r.source] += 1
    for s in sizes:
        assert abs(taken[s] - target[s]) <= buckets[s] / 16 + 1
    again = mixing.plan_mix(frame(spark, rows), bucket_rows=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_documents_has_the_words_planned(spark):
    rows = [(i, " " * (i % 2) + " ".join(f"w{k}" for k in range(i % 9)), "abc"[i % 3]) for i in range(90)]
    docs = frame(spark, rows)
    plan = {r.id: r.taken for r in mixing.plan_mix(docs).collect()}
    words, copies = defaultdict(int), defaultdict(list)
    for r in mixing.mix_documents(docs).collect():
        words[r.doc_id] += len(r.text.split())
        copies[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in plan.items() if v} == words
    texts = {i: t for i, t, _ in rows}
    assert all(texts[i].startswith(c) for i, cs in copies.items() for c in cs)


def test_mix_of_nothing(spark):
    assert mixing.plan_mix(frame(spark, [])).count() == 0
    assert mixing.mix_documents(frame(spark, [(1, None, None)])).count() == 0


def test_shards(spark):
    rows = [(i, "é" * (i % 5), "s") for i in range(4000)] + [(3, "x", "s"), (None, None, "s"), (None, "q", "s")]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    slots, seen = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
        assert seen.setdefault(r.id, r.shard) == r.shard
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(400 < len(s) < 600 for s in slots.values())
    assert 300 < sum(r.grown_shard == 8 for r in got) < 600
    texts = {i: t for i, t, _ in rows if i is not None and i != 3}
    for r in got:
        if r.id in texts:
            data = texts[r.id].encode()
            assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def slow_draw(key, node, path=""):
    """The shard of key, by hashlib and math."""
    weight = lambda n: sum(map(weight, n.values())) if isinstance(n, dict) else n
    while isinstance(node, dict):
        u = lambda name: (int(hashlib.md5(f"{sharding.SEED}{path}/{name}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52  # noqa: B023, E731
        name = min(node, key=lambda n: -math.log(u(n)) / weight(node[n])) if len(node) > 1 else next(iter(node))
        node, path = node[name], f"{path}/{name}"
    return name


def test_shards_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    rows = [(i * 7, "t", "s") for i in range(1500)] + [(7, "u", "s"), (None, "v", "s")]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    key = lambda i: "null" if i is None else f"={i}"
    place = lambda i: int(hashlib.md5(f"{sharding.SLOT_SEED}|{key(i)}".encode()).hexdigest()[:13], 16)
    shards = defaultdict(list)
    for i, _, _ in rows:
        shards[slow_draw(key(i), sharding.default_tree())].append(i)
    slots = {}
    for s, ids in shards.items():
        for k, i in enumerate(sorted(ids, key=lambda i: (place(i), i is not None, i or 0))):
            slots.setdefault(i, set()).add((s, k))
    for r in got:
        assert (r.shard, r.slot) in slots[r.id]
        assert r.grown_shard == slow_draw(key(r.id), sharding.default_tree(9))
    assert len({(r.shard, r.slot) for r in got}) == len(rows)


def test_weight_changes_move_rows_within_their_subtree(spark):
    tree = {"r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0, 3: 1.0}}, "r1": {"k2": {4: 2.0, 5: 1.0}, "k3": {6: 1.0}}}
    moved = {"r0": {"k0": {0: 1.5, 1: 0.5}, "k1": {2: 1.0, 3: 1.0}}, "r1": tree["r1"]}
    docs = frame(spark, [(i, "", "s") for i in range(3000)])
    for r in sharding.shard_documents(docs, tree=tree, grown=moved).collect():
        assert r.shard == r.grown_shard or (r.shard, r.grown_shard) == (1, 0)
    share = sharding.shard_documents(docs, tree=tree).groupBy("shard").count().collect()
    assert {r.shard: round(r["count"] / 375) for r in share} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1}


def test_shards_of_nothing_and_no_python(spark):
    out = sharding.shard_documents(frame(spark, []))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
