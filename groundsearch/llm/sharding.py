"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards.  At each level a document draws a number for every child from its
id and the child's name, and goes to the child with the least -ln(u) / weight, which wins in
proportion to its weight.  When a child's weight grows, rows only move into it; when it falls, only
out of it; rows that stay keep their place below.  So movement is confined to subtrees whose weights
changed.  A new shard that comes as a region of its own takes rows only into itself.

Only built-in functions run here.  A shard's rows go by a hash of their id, then id; their slots are numbered within
buckets, ranges of the hash of some `BUCKET_ROWS` rows each, and shifted by the counts of the buckets before, so no
task sorts a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundsearch.llm.common import materialise, read_table, row_ids

SHARDS, BASE = 8, 8
BUCKET_ROWS = 16_384
#: Bucket counts that may be broadcast: 32 MB.
BROADCAST_BUCKETS = 1_000_000
SEED = "tree-1"
SLOT_SEED = "tree-1|slot"

#: Regions of racks of shards: {region: {rack: {shard: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]


def default_tree(shards: int = SHARDS, base: int = BASE) -> Tree:
    """Equal shards: the first `base` in regions of two racks of two, where that many exist; each further one is a region of its own."""
    whole = base if shards >= base else 0
    tree: Tree = {}
    for s in range(shards):
        region, rack = (f"r{s // 4}", f"k{s // 2}") if s < whole else (f"s{s}", f"s{s}")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _weight(node: dict | float) -> float:
    return float(node) if not isinstance(node, dict) else sum(map(_weight, node.values()))


def draw(key: Column, node: dict, path: str = "", seed: str = SEED) -> Column:
    """The shard that key goes to under node."""
    children = [(name, child) for name, child in node.items() if _weight(child) > 0]

    def under(name, child) -> Column:
        return F.lit(int(name)) if not isinstance(child, dict) else draw(key, child, f"{path}/{name}", seed)

    if len(children) == 1:
        return under(*children[0])
    tries = []
    for i, (name, child) in enumerate(children):
        bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{path}/{name}|"), key)), 1, 13), 16, 10).cast("double")
        tries.append(F.struct((-F.log((bits + 0.5) / float(1 << 52)) / _weight(child)).alias("at"), F.lit(i).alias("child")))
    won = F.array_min(F.array(*tries))["child"]
    # transform() binds the winner once for all branches
    chosen = F.transform(F.array(won), lambda w: _branches(w, [under(*c) for c in children]))
    return chosen[0]


def _branches(winner: Column, outcomes: list[Column]) -> Column:
    out = F.when(winner == 0, outcomes[0])
    for i, x in enumerate(outcomes[1:], 1):
        out = out.when(winner == i, x)
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    The id alone decides under a given tree (law `key`): a null id counts as a key of its own, rows that repeat an
    id share a shard.  size is the text's bytes plus 1, null text has none.  Slots of a shard run from 0 without gaps.
    An empty table gives an empty result.
    """
    tree, grown = tree or default_tree(), grown or default_tree(SHARDS + 1)
    key, text = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("null")), F.coalesce(F.col("text"), F.lit(""))
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SLOT_SEED}|"), key)), 1, 13), 16, 10).cast("long")
    rows = row_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(
        "rid", "id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        draw(key, tree).alias("shard"), draw(key, grown).alias("grown_shard"), place.alias("place"),
    )
    rows = materialise(rows, "placed")
    buckets = -(-rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.floor(F.col("place") * (buckets / float(1 << 52))))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("shard", "bucket", before.alias("before"))
    # A row for each bucket of each shard at most.
    shifts = F.broadcast(shifts) if buckets * SHARDS <= BROADCAST_BUCKETS else shifts.hint("merge")
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("place", "id", "rid")) - 1
    return rows.withColumn("within", within).join(shifts, ["shard", "bucket"]).select(
        "id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), "grown_shard"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
