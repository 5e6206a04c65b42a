"""Chat formatting after cumulative-snapshot collapse.

A chat log often holds a conversation many times, once after each turn.  Rolling hashes of every turn
prefix (128 bits: the exclusive or of hashes of place, role and text) find conversations that are a
prefix of a longer one; anti-joins drop them, and what is left is rendered.

Scale: a conversation's turns are ordered in segments of `SEGMENT` turn numbers, and ranks and hashes are carried from
segment to segment by a small table, so a conversation with a third of all turns is not sorted in one
task.  It is rendered in parts of `PART` turns.  Prefixes are made distinct, with partial aggregation, before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundsearch.llm.common import materialise, read_table

SEGMENT, PART = 256, 512


def turn_prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, role, text, rank (from 1), n_turns, p1 and p2 (hash of the turns up to this one) of each turn.

    Turns go by number, nulls first, then role and text.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))))
    along = Window.partitionBy("conv").orderBy("segment")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv", "segment").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(
        F.col("conv").alias("conv_"), F.col("segment").alias("segment_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"),
        F.sum("n").over(Window.partitionBy("conv")).alias("n_turns"),
    )
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("segment") == F.col("segment_"))
    inside = Window.partitionBy("conv", "segment").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = rows.join(materialise(sizes, "sizes"), same).drop("conv_", "segment_").withColumn("rank", F.row_number().over(inside) + F.col("shift"))
    for k in (1, 2):
        turn = F.xxhash64(F.lit(k), "rank", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
        ranked = ranked.withColumn(f"h{k}", turn)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumns({f"x{k}": F.bit_xor(f"h{k}").over(running) for k in (1, 2)}).select("conv", "segment", "role", "text", "rank", "n_turns", "h1", "h2", "x1", "x2")
    ranked = materialise(ranked, "turns")
    whole = ranked.groupBy("conv", "segment").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    carried = whole.select(F.col("conv").alias("conv_"), F.col("segment").alias("segment_"), *(F.coalesce(F.bit_xor(f"h{k}").over(before), F.lit(0)).alias(f"c{k}") for k in (1, 2)))
    joined = ranked.join(materialise(carried, "carried"), same)
    return joined.select("conv", "role", "text", "rank", "n_turns", *(F.col(f"x{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"p{k}") for k in (1, 2)))


def collapse(turns: DataFrame, **columns: str) -> DataFrame:
    """One row per rendered part of a maximal conversation: conv_id, part (from 0), n_turns, copies, text.

    Of equal conversations the one with the least id stays, and copies says how many there were.  One that is a proper
    prefix of another goes.  Null ids are one conversation; null roles and texts differ from empty ones, and are
    rendered as empty.  A turn mark within a role or text gets a backslash after its first sign, so no text can pose as another
    turn.  Turns that repeat are kept.  Other columns are not read.  An empty table gives an empty result.
    """
    prefixes = materialise(turn_prefixes(turns, **columns), "prefixes")
    wholes = prefixes.filter("rank = n_turns").groupBy("n_turns", "p1", "p2").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies")
    )
    shorter = prefixes.filter("rank < n_turns").select(F.col("rank").alias("n_turns"), "p1", "p2").distinct()
    most = wholes.join(shorter, ["n_turns", "p1", "p2"], "left_anti").select(F.col("conv").alias("conv_"), "copies")
    kept = prefixes.join(materialise(most, "maximal"), F.col("conv").eqNullSafe(F.col("conv_")))
    said = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|(im_start|im_end)\|>", r"<\\|$1|>")
    turn = F.concat(F.lit("<|im_start|>"), said("role"), F.lit("\n"), said("text"), F.lit("<|im_end|>\n"))
    parts = kept.groupBy("conv", F.floor((F.col("rank") - 1) / PART).alias("part"), "n_turns", "copies").agg(
        F.array_sort(F.collect_list(F.struct("rank", turn.alias("turn")))).alias("turns")
    )
    return parts.select(F.col("conv").alias("conv_id"), "part", "n_turns", "copies", F.array_join("turns.turn", "").alias("text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(read_table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations
), c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY k) AS turns, count(*) AS n_turns FROM r GROUP BY conv_id
), d AS (
  SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns, n_turns
), p AS (
  SELECT DISTINCT turns[1:u.k] AS head FROM d, LATERAL (SELECT unnest(range(1, n_turns)) AS k) u
), m AS (
  SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.head = d.turns)
)
SELECT m.conv_id, CAST((r.k - 1) // 512 AS BIGINT) AS part, m.n_turns, m.copies,
       string_agg('<|im_start|>' || regexp_replace(coalesce(r.role, ''), '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') || chr(10)
                  || regexp_replace(coalesce(r.text, ''), '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY r.k) AS text
FROM m JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY ALL
"""
