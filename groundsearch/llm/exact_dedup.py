"""Exact dedup by deterministic block naming.

Each text is a string of fixed-size byte blocks.  Distinct blocks are dealt by hash, sorted within their partition and
numbered, and the number is the block's name; then adjacent pairs of names are sorted and numbered in turn, until
each document has one name.  Equal names mean equal texts and nothing is hashed, so there are no
collisions.

A document whose length and two end blocks occur nowhere else already has a name of its own, and
drops out before the rest is named, as finished suffixes do in prefix doubling.

Scale: a name table has one row for each distinct block, counted with map-side partial
aggregation.  It is written out before it is joined, so both join sides are plain exchanges, and
adaptive execution can split a block or group that holds a third of all rows.  The text moves once.
Joins are merge joins at every size: a broadcast would only be chosen on small inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.llm.common import fixed, free_name, materialise, read_table, row_ids, without

BLOCK = 2048
END_BLOCK = 64


def _names(blocks: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Distinct keys, sorted in the partitions that distinct() deals them to, with integer names.

    A sort by range would first send samples of the keys, which are whole blocks, to the driver.
    """
    ordered = blocks.select(*keys).distinct().sortWithinPartitions(*keys)
    return materialise(ordered.withColumn("name", F.monotonically_increasing_id()), what)


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, digest: bool = True) -> DataFrame:
    """One row per row of docs: rid, id, text_sha256 (null without digest), keep_id, group_size, kept.

    Null text counts as empty.  Of equal texts the row with the largest id stays (null ids sort
    first); among rows that repeat this id too, the last row of the scan does.  Other columns of
    docs are not read.  An empty table gives an empty result.  A very long text is many blocks, which no row gathers again.
    """
    docs = fixed(docs)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = row_ids(docs.select(F.col(id_col).alias("id"), body.alias("body")))
    rows = rows.withColumns({
        "size": F.octet_length("body").cast("long"),
        "head": F.substring("body", 1, END_BLOCK),
        "tail": F.expr(f"substring(body, greatest(length(body) - {END_BLOCK - 1}, 1), {END_BLOCK})"),
    })
    ends = ["size", "head", "tail"]
    shared = rows.groupBy(*ends).count().filter("count > 1").select(*ends)
    shared = materialise(shared.withColumn("shared", F.lit(True)), "ends")
    split = materialise(
        rows.join(shared.hint("merge"), ends, "left").select(
            "rid", "id", "size", (F.sha2("body", 256) if digest else F.lit(None).cast("string")).alias("text_sha256"), F.coalesce("shared", F.lit(False)).alias("shared"),
            F.when(F.col("shared"), F.col("body")).alias("body"),
        ),
        "split",
    )
    alone = split.filter(~F.col("shared")).select(
        "rid", "id", "text_sha256", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    most = split.filter("shared").agg(F.max("size")).first()[0]
    if most is None:
        return alone

    blocks = split.filter("shared").select(
        "rid", "id", "size", F.expr(f"greatest(1, (size + {block - 1}) div {block})").alias("n"), "body"
    )
    blocks = blocks.select(
        "rid", "id", "size", "n",
        F.posexplode(F.expr(f"transform(sequence(0L, n - 1), i -> substring(body, cast(i * {block} + 1 as int), {block}))")).alias("k", "block"),
    )
    names = _names(blocks, ["block"], "blocks")
    level = materialise(blocks.join(names.hint("merge"), "block").select("rid", "id", "size", "n", "k", "name"), "level")
    done, width = [level.filter("n = 1")], 1
    while width * block < most:
        pairs = level.filter(F.col("n") > width).groupBy("rid", "id", "size", "n", F.expr("k div 2").cast("int").alias("k")).agg(
            F.max(F.when(F.col("k") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("k") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        names = _names(pairs, ["left", "right"], "pairs")
        level = materialise(pairs.join(names.hint("merge"), ["left", "right"]).select("rid", "id", "size", "n", "k", "name"), "level")
        done.append(level.filter(F.col("n").between(width + 1, 2 * width)))
        width *= 2
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    groups = named.groupBy("size", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "rid")).alias("keep"))
    groups = materialise(groups, "groups")
    found = named.join(groups.hint("merge"), ["size", "name"]).select(
        "rid", F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept")
    )
    repeated = split.filter("shared").select("rid", "id", "text_sha256").join(found.hint("merge"), "rid")
    return alone.unionByName(repeated)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns; nulls, ties, repeated rows and empty tables as in name_documents()."""
    docs = fixed(docs)
    name = free_name(docs)
    gone = name_documents(docs, id_col, text_col, digest=False).filter("not kept").select(F.col("rid").alias(name))
    return without(row_ids(docs, name), materialise(gone, "gone"), name).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = name_documents(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
