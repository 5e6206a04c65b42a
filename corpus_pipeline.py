"""The corpus pipeline: quality rules, exact dedup, MinHash near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundsearch.llm import common, exact_dedup, mixing, near_dedup, packing, quality_rules

_SCOPE = "pipeline"


def _stage(operator):
    """A stage over the operator.  Its docs have been written out, so what earlier stages kept in the shared folder can go."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.sweep(spark, _SCOPE)
        with common.scratch_scope(_SCOPE):
            return operator(docs)

    return run_stage


STAGES = [
    ("quality_rules", _stage(quality_rules.drop_rejected)),
    ("exact_dedup", _stage(exact_dedup.drop_exact_copies)),
    ("near_dedup", _stage(near_dedup.drop_near_copies)),
    ("mixing", _stage(mixing.mix_documents)),
    ("packing", _stage(packing.pack_documents)),
]

#: The perplexity model of the first stage and the alignment of the third have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
