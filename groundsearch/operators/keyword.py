"""The inverted index and BM25.

An index is four tables: term frequencies, document frequencies, document lengths and one row of corpus
statistics.  A batch of questions is one job.  Scoring without a stored index reads the documents once and
shuffles only the postings of the questions' terms and one row for each document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundsearch.functions.text import is_stop_word, tokenize, words

K1, B = 1.2, 0.75
TOP = 20
#: Scores that agree to so many digits are ties, and go by insertion order.
TIE_DIGITS = 9


def with_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("tokens", tokenize(F.col(text_col)))


def term_freq(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, term, tf.

    The outer explode keeps Spark from asking for the array's size below, which would find all words twice; stop words go
    after it, in generated code.
    """
    terms = docs.select(id_col, F.explode_outer(words(F.col(text_col))).alias("term")).filter(F.col("term").isNotNull() & ~is_stop_word(F.col("term")))
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """term, df; tf has a row for each document of a term."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_len(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, len: kept tokens; documents without any stay."""
    return with_tokens(docs, text_col).select(id_col, F.size("tokens").cast("long").alias("len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avg_len (0 without documents)."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))


def query_terms(queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
    """query_id, term: the distinct terms of each question; how often one asks for a term doesn't count."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokenize(F.col(text_col)))).alias("term"))


@dataclass
class KeywordIndex:
    """Stored index tables; tf is id, term, tf, len."""

    tf: DataFrame
    df: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str = "text") -> KeywordIndex:
        rows = with_tokens(docs, text_col).select(F.col(id_col).alias("id"), "tokens", F.size("tokens").cast("long").alias("len"))
        tf = rows.select("id", "len", F.explode("tokens").alias("term")).groupBy("id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
        return cls(tf, doc_freq(tf), corpus_stats(rows))

    def write(self, path: str) -> None:
        """Postings and frequencies sorted by term, so a scan for some terms skips row groups."""
        self.tf.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/tf")
        self.df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/df")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark, path: str) -> KeywordIndex:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("tf", "df", "stats")))

    def scores(self, terms: DataFrame) -> DataFrame:
        """query_id, id, bm25 of each document that has a term of the question; terms is query_id, term."""
        wanted = terms.select("term").distinct()
        return _bm25(self.tf.join(wanted, "term"), self.df, self.stats, terms)

    def topk(self, terms: DataFrame, k: int = TOP) -> DataFrame:
        """query_id, id, bm25, sparse_rank."""
        return top_k(self.scores(terms).filter("bm25 > 0"), "bm25", k, "sparse_rank")


def _bm25(postings: DataFrame, df: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    rows = terms.join(df, "term").join(postings, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.groupBy("query_id", "id").agg(F.sum(idf * weight).alias("bm25"))


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_id, id, bm25 without a stored index, in one scan of docs.

    Each document has a row for each of the questions' terms in it and one with an empty term, which carries its length.
    Document frequencies and corpus statistics are sums over these rows that use the same columns as the scores do, so
    the plan has one exchange of them, which is read three times.
    """
    terms = query_terms(queries, query_id, query_text)
    wanted = terms.select("term").union(queries.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    rows = with_tokens(docs, text_col).select(F.col(id_col).alias("id"), F.concat("tokens", F.array(F.lit(""))).alias("tokens"), F.size("tokens").cast("long").alias("len"))
    rows = rows.select("id", "len", F.explode_outer("tokens").alias("term")).filter("term is not null").join(wanted, "term", "left_semi")
    postings = rows.groupBy("id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    of_document = F.when(F.col("term") == "", F.col("tf"))
    stats = postings.agg(F.coalesce(F.sum(of_document), F.lit(0)).alias("n_docs"), (F.sum(of_document * F.col("len")) / F.sum(of_document)).alias("avg_len"))
    frequencies = postings.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, F.col("id"))).alias("df"))
    return _bm25(postings, frequencies, stats, terms)


def top_k(scores: DataFrame, score: str, k: int = TOP, rank: str = "rank") -> DataFrame:
    """The k best of each query_id with their rank from 1; ties by id.  The limit is applied before the rows meet (window group limit)."""
    by = Window.partitionBy("query_id").orderBy(F.round(score, TIE_DIGITS).desc(), "id")
    return scores.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) <= k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = TOP, **columns: str) -> DataFrame:
    """query_id, id, bm25, sparse_rank."""
    return top_k(bm25_scores(docs, queries, **columns).filter("bm25 > 0"), "bm25", k, "sparse_rank")
