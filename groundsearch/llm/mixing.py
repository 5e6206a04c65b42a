"""Mixing sources to target weights by capped water-filling.

Sources share a budget by weight.  A source stops at `epochs` times its size, and what it leaves is
shared again by weight until none is above.  The level is found in closed form: in the order of
cap / weight a source is full if its cap lies at or under its share of what those before it left.

Each document then gets its source's whole repetitions, and a seeded sample gets one more: a source's
documents are dealt by hash into buckets of about `bucket_rows`, and each bucket takes documents in
hash order up to its part.  The last one is cut to fit, so a source's words meet its target to within
half a word a bucket, and no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundsearch.llm.common import WORD_PATTERN, fixed, free_name, materialise, read_table, row_ids

WEIGHTS = (3, 1, 2)
#: The budget as a fraction of all sizes.
SHARE = (3, 2)
EPOCHS = 2
SEED = "mix-1"
BUCKET_ROWS = 4096
_WORD_STARTS = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, n_docs, source_size, target.  sizes has source and size.

    Sources go by code point with null last, and take the weights in turn.  The table has one row for
    each source, so its running sums need no more than one task.
    """
    up, down = share
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("turn", turn).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("long"))
    by = Window.orderBy(F.col("source_size") / F.col("w"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    caps, used = F.sum(epochs * F.col("source_size")).over(by), F.sum("w").over(by)
    level = (up * F.sum("source_size").over(every) - down * F.coalesce(caps, F.lit(0))) / (down * (F.sum("w").over(every) - F.coalesce(used, F.lit(0))))
    per = per.withColumn("level", level).withColumn("place", F.coalesce(used, F.lit(0)))
    per = per.withColumn("full", epochs * F.col("source_size") <= F.col("w") * F.col("level"))
    shared = F.min_by("level", F.when(~F.col("full"), F.col("place"))).over(every)
    cap = (epochs * F.col("source_size")).cast("double")
    return per.select("source", "n_docs", "source_size", F.when(F.col("full"), cap).otherwise(F.least(cap, F.col("w") * shared)).alias("target"))


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of docs: rid, id, source, size (words), source_size, target, whole, extra, taken.

    taken = whole * size + extra, extra at most size.  Null text has no words.  A source without words gets
    nothing.  Rows that repeat an id are documents of their own, in the order of a hash of id and text; equal rows go in any
    order.  An empty table gives an empty result.
    """
    text, source = F.col(text_col), F.col(source_col)
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sizes = row_ids(fixed(docs).select(F.col(id_col).alias("id"), source.alias("source"), size.alias("size"), order.alias("order")))
    sizes = materialise(sizes, "sizes")
    sources = materialise(source_targets(sizes, weights, share, epochs), "sources")
    joined = sizes.join(sources.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    buckets = F.ceil(F.col("n_docs") / bucket_rows)
    dealt = joined.withColumn("ratio", ratio).withColumns({
        "whole": F.floor("ratio"), "bucket": F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % buckets,
    })
    group = Window.partitionBy("source", "bucket")
    before = F.sum("size").over(group.orderBy("order", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    part = F.floor((F.col("ratio") - F.col("whole")) * F.sum("size").over(group) + 0.5)
    dealt = dealt.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), part - before)))
    return dealt.select("rid", "id", "source", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix: rows of docs as often as taken, with their columns; a cut repetition has its first words only, and its own chars_col.

    Nulls, repeated rows and empty tables are as in plan_mix(); a text without words is never taken.
    """
    docs = fixed(docs)
    rid = free_name(docs)
    plan = plan_mix(docs, id_col, text_col, source_col, **options).filter("taken > 0")
    plan = materialise(plan.select(F.col("rid").alias(rid), F.struct("whole", "extra", "size").alias(f"{rid}plan")), "mix")
    got = row_ids(docs, rid).join(plan.hint("merge"), rid)
    part, text = F.col(f"{rid}plan"), F.col(text_col)
    full = got.withColumn(f"{rid}n", (part["whole"] + (part["extra"] == part["size"]).cast("int")).cast("int")).filter(F.col(f"{rid}n") > 0)
    full = full.withColumn(f"{rid}copy", F.explode(F.sequence(F.lit(1), F.col(f"{rid}n")))).select(*docs.columns)
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    first_words = F.array_join(F.slice(F.split(text, _WORD_STARTS, -1), F.lit(1), (part["extra"] + lead).cast("int")), "")
    cut = got.filter((part["extra"] > 0) & (part["extra"] < part["size"])).withColumn(text_col, F.regexp_replace(first_words, r"[\x20\x09-\x0D]+\z", ""))
    if chars_col in docs.columns:
        cut = cut.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return full.unionByName(cut.select(*docs.columns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(read_table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS o
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sizes GROUP BY source
), turns AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM per
), weighed AS (
  SELECT *, CAST([3, 1, 2][CAST(turn % 3 + 1 AS INT)] AS BIGINT) AS w FROM turns
), sums AS (
  SELECT *, CAST(coalesce(sum(2 * source_size) OVER b, 0) AS BIGINT) AS caps, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS used,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS weights
  FROM weighed WINDOW b AS (ORDER BY source_size / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, CAST(3 * total - 2 * caps AS DOUBLE) / CAST(2 * (weights - used) AS DOUBLE) AS level FROM sums
), fulls AS (
  SELECT *, 2 * source_size <= w * level AS is_full FROM levels
), targets AS (
  SELECT source, source_size, n_docs,
         CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
              ELSE least(CAST(2 * source_size AS DOUBLE), w * (SELECT arg_min(level, used) FROM fulls WHERE NOT is_full)) END AS target
  FROM fulls
), joined AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.n_docs,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
         s.o
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), dealt AS (
  SELECT *, CAST(floor(ratio) AS BIGINT) AS whole,
         CAST('0x' || substr(o, 1, 8) AS BIGINT) % CAST(ceil(n_docs / 4096.0) AS BIGINT) AS bucket FROM joined
), parts AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, bucket ORDER BY o, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before,
         CAST(floor((ratio - whole) * CAST(sum(size) OVER (PARTITION BY source, bucket) AS DOUBLE) + 0.5) AS BIGINT) AS part
  FROM dealt
)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, part - before)) AS taken FROM parts
"""
