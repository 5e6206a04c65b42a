"""The corpus pipeline: each stage against its operator or brute force, and the whole run."""

from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
from groundsearch.llm import common, mixing, quality_rules
from groundsearch.llm.alignment import similar

NAMES = ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = common.read_table(spark, sf_dir, "documents")
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs if not stages else stages[last], sf_dir).write.parquet(str(tmp_path / name))  # noqa: F821
        stages[name], last = spark.read.parquet(str(tmp_path / name)), name
        if name != "packing":
            assert stages[name].columns == docs.columns
    texts = {n: [(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for n, s in stages.items() if n != "packing"}

    judged = {r.doc_id for r in quality_rules.score_documents(docs).filter("kept").collect()}
    assert {i for i, _ in texts["quality_rules"]} == judged
    assert Counter(t for _, t in texts["exact_dedup"]) == Counter({t for _, t in texts["quality_rules"]})
    words = {i: t.split() for i, t in texts["exact_dedup"]}
    label = {i: i for i in words}
    for a, b in combinations(sorted(words), 2):
        if min(len(words[a]), len(words[b])) >= 0.8 * max(len(words[a]), len(words[b])) and label[a] != label[b] and similar(words[a], words[b], 0.8):
            label = {k: label[a] if v == label[b] else v for k, v in label.items()}
    assert {i for i, _ in texts["near_dedup"]} == set(label.values())

    plan = {r.id: r.taken for r in mixing.plan_mix(stages["near_dedup"]).collect()}
    mixed = Counter()
    for i, t in texts["mixing"]:
        mixed[i] += len(t.split())
    assert mixed == Counter({k: v for k, v in plan.items() if v})
    pieces = defaultdict(int)
    for r in stages["packing"].collect():
        pieces[r.doc_id] += r.length
    copies = Counter(i for i, _ in texts["mixing"])
    assert set(pieces) == set(copies)


def test_run_is_its_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns)
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, rows.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, again.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_stages_on_an_empty_table_and_with_other_columns(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    clashing = docs.selectExpr("*", "1 as rid", "'x' as label", "2 as id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        left = stage(spark, clashing, sf_dir)
        assert left.columns == clashing.columns and left.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
