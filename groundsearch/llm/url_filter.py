"""URL filters: host and path rules, and for the rest a character language-model ratio.

The urls that rules allow and block train one variable-order Markov model of bytes each (markov.py), on every such url
that isn't held out.  A url's score is the difference of its log-likelihoods
divided by its length; it is allowed at or above a threshold that makes the mean of both classes' error rates least on
labelled urls held out by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.llm import markov
from groundsearch.llm.common import arrow_batches, materialise, read_table
from groundsearch.llm.ngrams import as_bytes

#: (verdict, host, path): the host and its subdomains, where the path starts so.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: One labelled url in so many is held out to set the threshold.
HELD_OUT = 5
#: Scores are binned so finely for the threshold, within +- SPAN.
BINS, SPAN = 4000, 10.0
def host_and_path(url: Column) -> tuple[Column, Column]:
    """host: from the first :// to the next / ? # or the end, A-Z lower-cased; path: from there to ? or #.  Null or no ://: both empty."""
    found = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    rest = url.substr(F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(found, F.translate(host, upper, upper.lower())).otherwise(""), F.when(found, path).otherwise("")


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of_host, of_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(of_path)
        rule, verdict = F.when(fits, of_host + of_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _score(df: DataFrame, models: list) -> DataFrame:
    """df (id, url, host, path, rule, by_rule) with llr: log2 likelihood of accepted less rejected, a symbol; models are broadcasts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = as_bytes(batch.column(1))
            (yes, n), (no, _) = (m.value.log_probs(urls) for m in models)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((yes - no) / n)], [*batch.schema.names, "llr"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(score, f"{fields}, llr double")


def threshold(scored: DataFrame) -> float:
    """Where the mean of both error rates is least on rows with llr and by_rule; at most 2 * BINS counts are collected."""
    at = F.floor((F.least(F.greatest("llr", F.lit(-SPAN)), F.lit(SPAN)) + SPAN) * (BINS / (2 * SPAN)))
    got = scored.groupBy("by_rule", at.cast("int").alias("bin")).count().collect()
    n = {v: np.zeros(BINS + 2) for v in ("allow", "block")}
    for r in got:
        n[r["by_rule"]][r["bin"] + 1] += r["count"]
    if not all(x.sum() for x in n.values()):
        return 0.0
    error = np.cumsum(n["allow"]) / n["allow"].sum() + 1 - np.cumsum(n["block"]) / n["block"].sum()
    best = np.flatnonzero(error == error.min())
    return float((best[0] + best[-1]) / 2 / (BINS / (2 * SPAN)) - SPAN)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, llr, threshold.

    Null url is empty and is judged by the models.  Without labelled urls of both kinds, what no rule decides is allowed.
    A score equal to the threshold is allowed.  Repeated rows are judged alike, and a very long url like any other, by all its
    bytes.  Other columns are not read.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    arrow_batches(spark, rows=2_000)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, by_rule = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": by_rule})
    held = F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(HELD_OUT)) == 0
    labelled = rows.filter("by_rule is not null")
    learnt = labelled.filter(~held).select("url", F.when(F.col("by_rule") == "allow", 1).otherwise(2).alias("label"))
    counts = materialise(markov.count_contexts(learnt, "url", "label"), "counts")
    if counts.select("label").distinct().count() < 2:
        return rows.select("id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("llr"), F.lit(None).cast("double").alias("threshold"))
    models = [spark.sparkContext.broadcast(markov.train(counts, k)) for k in (1, 2)]
    cut = threshold(_score(labelled.filter(held), models))
    scored = _score(rows, models)
    verdict = F.coalesce("by_rule", F.when(F.col("llr") >= cut, "allow").otherwise("block"))
    return scored.select("id", "host", "path", "rule", verdict.alias("verdict"), "llr", F.lit(cut).alias("threshold"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
