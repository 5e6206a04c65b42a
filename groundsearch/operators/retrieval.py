"""Hybrid search: dense and sparse candidates are fused, verified against the question, and guarded by a threshold.

Everything is by query_id, so any number of questions is one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundsearch.functions import vectors
from groundsearch.functions.text import tokenize
from groundsearch.operators.dense import dense_topk
from groundsearch.operators.keyword import TIE_DIGITS, KeywordIndex, bm25_topk, query_terms

CITATION = ("spec", "version", "source", "section", "paragraph", "heading", "page")


@dataclass(frozen=True)
class Options:
    """Defaults of a search; columns of the same names in the questions override them row by row."""

    top_k: int = 6
    threshold: float = 0.35
    keyword_weight: float = 0.3
    candidates: int = 20
    #: The most candidates that a question may ask for; more is an error.
    most_candidates: int = 100
    #: "bare": a hit that only keywords found has no text, and so is never verified.  "hydrate": it has its own.
    sparse_only: str = "bare"

    def column(self, queries: DataFrame, name: str) -> Column:
        own = F.lit(getattr(self, name))
        return F.coalesce(F.col(name), own) if name in queries.columns else own

    def params(self, queries: DataFrame) -> DataFrame:
        """query_id and the four parameters of each question."""
        rows = queries.select("query_id", *(self.column(queries, n).alias(n) for n in ("top_k", "threshold", "keyword_weight", "candidates")))
        if "candidates" not in queries.columns:
            return rows
        message = F.concat(F.lit(f"at most {self.most_candidates} candidates, asked for "), F.col("candidates").cast("string"))
        return rows.withColumn("candidates", F.when(F.col("candidates") <= self.most_candidates, F.col("candidates")).otherwise(F.raise_error(message).cast("int")))


def fusion_outer(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """query_id, id, dense_sim, dense_rank, bm25, sparse_rank."""
    return dense.join(sparse, ["query_id", "id"], "full_outer")


def fusion_minmax(hits: DataFrame) -> DataFrame:
    """The hits with the least and greatest score of each list among their question's candidates."""
    mine = Window.partitionBy("query_id")
    return hits.withColumns({f"{f}_{n}": getattr(F, f)(c).over(mine) for n, c in (("dense", "dense_sim"), ("sparse", "bm25")) for f in ("min", "max")})


def _scaled(value: Column, low: Column, high: Column) -> Column:
    """value between low and high as 0 to 1; 1 where they don't differ."""
    return F.when(high > low, (value - low) / F.when(high > low, high - low)).otherwise(F.lit(1.0))


def fusion_scores(hits: DataFrame, weight: Column | float = 0.3) -> DataFrame:
    """fusion_minmax() hits with hybrid: missing dense scores count as the least, missing keyword scores as 0."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    dense = _scaled(F.coalesce("dense_sim", "min_dense"), F.col("min_dense"), F.col("max_dense"))
    sparse = F.when(F.col("bm25").isNotNull(), _scaled(F.col("bm25"), F.col("min_sparse"), F.col("max_sparse"))).otherwise(0.0)
    return hits.withColumn("hybrid", (1 - weight) * dense + weight * sparse)


def fusion_topk(scored: DataFrame, k: Column | int = 20) -> DataFrame:
    """The k best by hybrid with hybrid_rank; ties in dense order, then in keyword order."""
    by = Window.partitionBy("query_id").orderBy(F.round("hybrid", TIE_DIGITS).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last())
    return scored.withColumn("hybrid_rank", F.row_number().over(by)).filter(F.col("hybrid_rank") <= k)


def verify_candidates(hits: DataFrame, chunks: DataFrame, queries: DataFrame, options: Options = Options(), provider: vectors.Provider = vectors.hash_provider) -> DataFrame:
    """Candidates with their chunk's columns and score, the cosine of the text's own embedding to the question's.

    chunks has id, text and any columns of CITATION; queries has query_id and vector.
    """
    meta = [c for c in CITATION if c in chunks.columns]
    rows = hits.join(chunks.select("id", "text", *meta), "id", "left")
    if options.sparse_only == "bare":
        unseen = F.col("dense_rank").isNull()
        rows = rows.withColumns({c: F.when(~unseen, F.col(c)) for c in meta} | {"text": F.when(~unseen, F.col("text"))})
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("own_vector", vectors.embed(tokenize(F.col("text")), provider))
    asked = queries.select("query_id", F.col("vector").alias("asked_vector"))
    return rows.join(asked, "query_id").withColumn("score", vectors.cosine(F.col("own_vector"), F.col("asked_vector"))).drop("own_vector", "asked_vector")


def threshold_guard(verified: DataFrame, params: DataFrame) -> DataFrame:
    """All verified candidates with returned: among a question's candidates at its threshold or above, the first top_k in hybrid order; and rank among those."""
    rows = verified.join(params.select("query_id", "threshold", "top_k"), "query_id").withColumn("passed", vectors.passes(F.col("score"), F.col("threshold")))
    place = F.sum(F.col("passed").cast("int")).over(Window.partitionBy("query_id").orderBy("hybrid_rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("place", place).withColumn("returned", F.col("passed") & (F.col("place") <= F.col("top_k")))
    return rows.withColumn("rank", F.when(F.col("returned"), F.col("place"))).drop("place", "threshold", "top_k")


def discarded_counts(guarded: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n_candidates, n_results, discarded (verified and not returned) of every question."""
    per = guarded.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("returned").alias("r"))
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("r", F.lit(0))
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", n.alias("n_candidates"), r.alias("n_results"), (n - r).alias("discarded"))


def hybrid_search(chunks: DataFrame, queries: DataFrame, options: Options = Options(), provider: vectors.Provider = vectors.hash_provider, index: KeywordIndex | None = None) -> DataFrame:
    """All verified candidates of each question, as threshold_guard() gives them.

    chunks: id long, text, vector and columns of CITATION.  With a stored index of them no text is read but the candidates'.  queries: query_id long, query, and parameters where a question has its own.
    """
    asked = queries.withColumn("vector", vectors.embed(tokenize(F.col("query")), provider))
    params = options.params(queries)
    # Where questions have their own numbers of candidates, the lists are as long as any may ask for, and are cut to these.
    most = options.most_candidates if "candidates" in queries.columns else options.candidates
    dense = dense_topk(chunks, asked, most)
    if index is None:
        sparse = bm25_topk(chunks, queries, most, id_col="id", query_id="query_id", query_text="query")
    else:
        sparse = index.topk(query_terms(queries, "query_id", "query"), most)
    own = params.select("query_id", "candidates", "keyword_weight")
    if "candidates" in queries.columns:
        dense = dense.join(own.select("query_id", "candidates"), "query_id").filter("dense_rank <= candidates").drop("candidates")
        sparse = sparse.join(own.select("query_id", "candidates"), "query_id").filter("sparse_rank <= candidates").drop("candidates")
    hits = fusion_minmax(fusion_outer(dense, sparse)).join(own, "query_id")
    top = fusion_topk(fusion_scores(hits, F.col("keyword_weight")), F.col("candidates")).drop("candidates", "keyword_weight")
    return threshold_guard(verify_candidates(top, chunks, asked, options, provider), params)


def search_response(guarded: DataFrame, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per question: query_id, query, results (citations in rank order), discarded, candidates, top_k, threshold.

    Results and counts come from one aggregation, so the search is planned once.
    """
    fields = [c for c in ("id", "text", *CITATION, "score", "dense_sim", "bm25") if c in guarded.columns]
    per = guarded.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("returned"), F.struct("rank", *fields)))).alias("results"),
        F.count(F.lit(1)).alias("n"), F.count_if("returned").alias("r"),
    )
    empty = F.array().cast(per.schema["results"].dataType)
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("r", F.lit(0))
    out = queries.select("query_id", "query").join(per, "query_id", "left").join(options.params(queries), "query_id")
    return out.select("query_id", "query", F.coalesce("results", empty).alias("results"), (n - r).alias("discarded"), n.alias("candidates"), "top_k", "threshold")
