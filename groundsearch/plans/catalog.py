"""The registered queries of the retrieval engine and their SQL.

Every query runs over its whole tables.  Scores are rounded to six digits on both sides.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.config import Config
from groundsearch.functions import clients, vectors, versions
from groundsearch.functions import text as T
from groundsearch.operators import chunking, dense, grounding, keyword, resolve, retrieval
from groundsearch.plans import corpora, engine, sql
from groundsearch.plans.corpora import table
from groundsearch.shared import shared_dir
from groundsearch.shipping import ship_package
from groundsearch.sources import archives, documents
from groundsearch.sources.store import VectorStore
from groundsearch.streaming import events, questions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = sql.QUERIES


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


# The catalog of documents.
CATALOG = {
    "release": 18,
    "specs": [
        {"number": "23.501", "title": "System architecture for the 5G System (5GS)"},
        {"number": "23.502", "title": "Procedures for the 5G System (5GS)"},
        {"number": "23.503", "title": "Policy and charging control framework for the 5G System"},
        {"number": "33.501", "title": "Security architecture and procedures for 5G System"},
        {"number": "38.300", "title": "NR and NG-RAN Overall Description"},
        {"number": "38.331", "title": "NR; Radio Resource Control (RRC) protocol specification"},
    ],
}


def _catalog(spark: SparkSession) -> DataFrame:
    rows = spark.range(1).select(F.from_json(F.lit(json.dumps(CATALOG)), resolve.CATALOG_SCHEMA).alias("c"))
    return resolve.catalog_rows(rows.select("c.*"))


def _listings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sql.LISTINGS, "number string, html string")


# Keyword index


@query
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


@query
def term_freq(spark, d):
    return keyword.term_freq(table(spark, d, "documents"), "doc_id")


@query
def doc_freq(spark, d):
    return keyword.doc_freq(keyword.term_freq(table(spark, d, "documents"), "doc_id"))


@query
def doc_len(spark, d):
    return keyword.doc_len(table(spark, d, "documents"), "doc_id")


@query
def corpus_stats(spark, d):
    return keyword.corpus_stats(keyword.doc_len(table(spark, d, "documents"), "doc_id")).select("n_docs", six("avg_len"))


@query
def bm25_scores(spark, d):
    return keyword.bm25_scores(table(spark, d, "documents"), table(spark, d, "benchmark")).select("query_id", "id", six("bm25"))


@query
def bm25_topk(spark, d):
    return keyword.bm25_topk(table(spark, d, "documents"), table(spark, d, "benchmark")).select("query_id", "id", six("bm25"), "sparse_rank")


# Vectors


@query
def cosine_pairs(spark, d):
    rows = table(spark, d, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return rows.join(first, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))


@query
def dense_topk(spark, d):
    rows = table(spark, d, "embeddings")
    found = dense.dense_topk(rows, rows.filter("vec_id % 50 = 0"), 20, "vec_id", "embedding", "vec_id", "embedding")
    return found.select("query_id", "id", six("dense_sim"), "dense_rank")


@query
def dims_check(spark, d):
    rows = dense.dims_check(table(spark, d, "embeddings"), 64, "embedding")
    return rows.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def embed_hash(spark, d):
    rows = corpora.chunks(spark, d).select(F.col("id").alias("doc_id"), F.posexplode("vector").alias("place", "v"))
    return rows.filter("v <> 0").select("doc_id", "place", F.round(F.col("v").cast("double"), 6).alias("v"))


@query
def embed_reorder(spark, d):
    rows = spark.createDataFrame(sql.RESPONSES, "batch long, response string")
    return rows.select("batch", F.posexplode(vectors.reordered(F.col("response"))).alias("place", "v")).select("batch", "place", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v"))


# Hybrid search


def _lists(spark, d):
    chunks, asked = corpora.chunks(spark, d), corpora.questions(spark, d)
    asked = asked.withColumn("vector", vectors.embed(T.tokenize(F.col("query"))))
    near = dense.dense_topk(chunks, asked, 20)
    words = keyword.bm25_topk(chunks, asked, 20, id_col="id", query_id="query_id", query_text="query")
    return chunks, asked, retrieval.fusion_outer(near, words)


@query
def fusion_outer(spark, d):
    return _lists(spark, d)[2].select("query_id", "id", six("dense_sim"), "dense_rank", six("bm25"), "sparse_rank")


@query
def fusion_minmax(spark, d):
    hits = retrieval.fusion_minmax(_lists(spark, d)[2])
    return hits.select("query_id", *(six(c) for c in ("min_dense", "max_dense", "min_sparse", "max_sparse"))).distinct()


def _fused(spark, d):
    chunks, asked, hits = _lists(spark, d)
    return chunks, asked, retrieval.fusion_scores(retrieval.fusion_minmax(hits))


@query
def fusion_scores(spark, d):
    return _fused(spark, d)[2].select("query_id", "id", six("hybrid"))


@query
def fusion_topk(spark, d):
    return retrieval.fusion_topk(_fused(spark, d)[2]).select("query_id", "id", six("hybrid"), "hybrid_rank")


@query
def verify_candidates(spark, d):
    chunks, asked, scored = _fused(spark, d)
    rows = retrieval.verify_candidates(retrieval.fusion_topk(scored), chunks, asked)
    return rows.select("query_id", "id", F.length("text").cast("long").alias("n_text"), F.when(~F.isnan("score"), F.round("score", 6)).alias("score"))


@query
def threshold_guard(spark, d):
    rows = retrieval.hybrid_search(corpora.chunks(spark, d), corpora.questions(spark, d))
    return rows.select("query_id", "id", "passed", "returned", "rank")


@query
def discarded_counts(spark, d):
    asked = corpora.questions(spark, d)
    return retrieval.discarded_counts(retrieval.hybrid_search(corpora.chunks(spark, d), asked), asked)


@query
def hybrid_search(spark, d):
    rows = retrieval.hybrid_search(corpora.chunks(spark, d), corpora.questions(spark, d)).filter("returned")
    return rows.select("query_id", "rank", "id", "spec", "section", "heading", six("score"), six("dense_sim"), six("bm25"), six("hybrid"))


@query
def hybrid_params(spark, d):
    asked = corpora.own_parameters(corpora.questions(spark, d))
    rows = retrieval.hybrid_search(corpora.chunks(spark, d), asked).filter("returned")
    return rows.select("query_id", "rank", "id", six("score"), six("hybrid"))


def _stored_corpus(spark, d) -> tuple[DataFrame, keyword.KeywordIndex]:
    """The chunks with their vectors, and their keyword index, as tables: embedded and tokenized once, whatever the number of searches."""
    rows = corpora.chunks(spark, d)
    root = f"{shared_dir(spark)}/corpus-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    store = VectorStore(spark, f"{root}/chunks", rows.schema)
    store.replace(rows)
    keyword.KeywordIndex.build(store.scan("id", "text"), "id").write(f"{root}/keywords")
    return store.scan(), keyword.KeywordIndex.read(spark, f"{root}/keywords")


@query
def stored_search(spark, d):
    """hybrid_search on stored vectors and a stored keyword index."""
    chunks, index = _stored_corpus(spark, d)
    rows = retrieval.hybrid_search(chunks, corpora.questions(spark, d), index=index).filter("returned")
    return rows.select("query_id", "rank", "id", "spec", "section", "heading", six("score"), six("dense_sim"), six("bm25"), six("hybrid"))


# Text and chunks


@query
def heading_flags(spark, d):
    rows = chunking.heading_flags(corpora.specification_lines(table(spark, d, "documents")).select("doc_id", "text"))
    return rows.select("doc_id", "pos", "line", "is_heading", "section", "heading", "paragraph")


@query
def page_numbers(spark, d):
    return chunking.page_numbers(corpora.specification_lines(table(spark, d, "documents")), "doc_id")


def _chunked(docs):
    return chunking.chunk_documents(docs.select("doc_id", "lang", "source", "text"))


@query
def chunk_documents(spark, d):
    return _chunked(table(spark, d, "documents")).select("doc_id", "pos", "section", "paragraph", "heading", "page", "text")


@query
def chunk_specs(spark, d):
    return _chunked(corpora.specification_lines(table(spark, d, "documents"))).select("doc_id", "pos", "section", "paragraph", "heading", "page", "text")


@query
def chunk_ids(spark, d):
    rows = chunking.with_ids(_chunked(corpora.specification_lines(table(spark, d, "documents"))), "source", ["source", "doc_id"])
    return rows.select("doc_id", "pos", "ordinal", "id")


@query
def ingest_chunks(spark, d):
    docs = table(spark, d, "documents")
    stem = F.concat(F.col("source"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    rows = chunking.stored(chunking.with_ids(_chunked(corpora.specification_lines(docs)), "source", ["source", "doc_id"]))
    return rows.select("id", versions.version_of(stem).alias("version"), "section", "paragraph", "heading", "page", "text")


@query
def extract_body(spark, d):
    return corpora.framed_lines(table(spark, d, "documents")).select("doc_id", T.extract_body(F.col("text")).alias("body"))


@query
def xml_decode(spark, d):
    coded = F.concat("html", F.lit("&#"), (F.col("page_id") % 5000 + 60).cast("string"), F.lit(";&#x41;&#X1F642;&#38;lt;&quot;&apos;&amp;lt;&none;&"))
    return table(spark, d, "pages").select("page_id", T.xml_decode(coded).alias("text"))


# Versions


@query
def catalog_inline(spark, d):
    return _catalog(spark)


@query
def spec_urls(spark, d):
    n = F.col("number")
    return _catalog(spark).select(
        "number", versions.series_of(n).alias("series"), versions.folder_url(n).alias("folder"), versions.compact(n).alias("compact"),
        versions.file_url(n, F.concat(versions.compact(n), F.lit("-i50.zip"))).alias("file"),
    )


@query
def version_key(spark, d):
    rows = spark.createDataFrame([(s,) for s in sql.SUFFIXES], "suffix string")
    return rows.select("suffix", versions.version_key(F.col("suffix")).alias("key"), versions.release_of(F.col("suffix")).alias("release"))


@query
def listing_parse(spark, d):
    return resolve.parse_listings(_listings(spark))


@query
def pick_best(spark, d):
    files = resolve.parse_listings(_listings(spark))
    any_ = resolve.pick_best(files).withColumn("asked", F.lit(None).cast("int"))
    return any_.unionByName(resolve.pick_best(files, 17).withColumn("asked", F.lit(17))).select("asked", "number", "filename", "key")


@query
def incremental_anti(spark, d):
    present = spark.createDataFrame(sql.PRESENT, "number string, suffix string")
    return resolve.missing(resolve.pick_best(resolve.parse_listings(_listings(spark))), present).select("number", "suffix")


# Files


@query
def zip_member_pick(spark, d):
    rows = corpora.archives(table(spark, d, "documents")).select("doc_id", documents.pick_member(F.col("content")).alias("m"))
    return rows.select("doc_id", F.col("m.name").alias("name"), F.decode("m.content", "UTF-8").alias("text"), "m.error")


@query
def docx_extract(spark, d):
    return documents.parse_documents(corpora.word_files(table(spark, d, "documents"))).select("doc_id", "text", "error")


@query
def pdf_extract(spark, d):
    return documents.parse_documents(corpora.page_files(table(spark, d, "documents"))).select("doc_id", "text", "error")


class Archive:
    """A fetch function over the listings; one archive is missing and one is broken."""

    def __init__(self, listings: list[tuple[str, str]]):
        self.listings = listings

    def __call__(self, url: str) -> bytes:
        for number, html in self.listings:
            if url.endswith(f"/{number}/"):
                return html.encode()
        if not url.endswith(".zip"):
            raise FileNotFoundError("no listing")
        if "33501" in url:
            return b"not a ZIP file"
        with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
            z.writestr(url.rsplit("/", 1)[-1].replace(".zip", ".docx"), url)
        return buffer.getvalue()


@query
def download_archives(spark, d):
    """Every document of the catalog: its latest archive's content, or what went wrong with it alone."""
    ship_package(spark)
    rows = archives.download(_catalog(spark).select("number"), Archive(sql.LISTINGS))
    return rows.select("number", "suffix", "name", F.decode("content", "UTF-8").alias("text"), "status", F.substring_index("error", ":", 1).alias("error"))


# Store


def _store(spark, d) -> VectorStore:
    from pyspark.sql import types

    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").alias("page"), F.col("embedding").alias("vector"))
    schema = types.StructType([rows.schema[c] for c in ("id", "page", "vector")])
    store = VectorStore(spark, f"{shared_dir(spark)}/store-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}", schema)
    store.replace(rows.limit(1))
    store.replace(rows)
    return store


@query
def store_count(spark, d):
    return spark.createDataFrame([(_store(spark, d).count(),)], "n long")


@query
def store_scan(spark, d):
    return _store(spark, d).scan("id", "page")


@query
def store_roundtrip(spark, d):
    return _store(spark, d).scan().select("id", "page", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


# Answers


@query
def validate_queries(spark, d):
    rows = table(spark, d, "conversations")
    blank = F.when(F.col("turn") % 3 == 0, F.lit(" \t\u00a0\ufeff\n")).when(F.col("turn") % 5 == 0, F.lit(None)).otherwise(F.col("text"))
    return grounding.validate_queries(rows.withColumn("query", blank)).select("conv_id", "turn", "status")


def _responses(spark, d):
    asked = corpora.questions(spark, d)
    return retrieval.search_response(retrieval.hybrid_search(corpora.chunks(spark, d), asked), asked)


@query
def build_context(spark, d):
    return _responses(spark, d).select("query_id", grounding.build_context(F.col("results")).alias("context"))


@query
def build_messages(spark, d):
    rows = _responses(spark, d).select("query_id", F.posexplode(grounding.build_messages(grounding.build_context(F.col("results")), F.col("query"))).alias("pos", "m"))
    return rows.select("query_id", "pos", "m.role", "m.content")


@query
def refusal_detect(spark, d):
    return corpora.model_answers(spark, d).select("conv_id", "turn", grounding.is_confident(F.col("answer")).alias("confident"))


def _sections():
    return F.array(F.lit("5.2.1"), F.lit("5.3.2"), F.lit(""))


@query
def grounding_check(spark, d):
    return corpora.model_answers(spark, d).select("conv_id", "turn", grounding.is_grounded(F.col("answer"), _sections()).alias("grounded"))


@query
def answer_confidence(spark, d):
    sure = grounding.is_confident(F.col("answer")) & grounding.is_grounded(F.col("answer"), _sections())
    return corpora.model_answers(spark, d).select("conv_id", "turn", sure.alias("confident"))


@query
def fallback_answers(spark, d):
    return grounding.answers(_responses(spark, d)).filter(F.size("citations") == 0).select("query_id", "answer", "discarded", "confident")


@query
def answer_extractive(spark, d):
    return grounding.answers(_responses(spark, d)).filter(F.size("citations") > 0).select("query_id", "answer")


@query
def rag_answers(spark, d):
    rows = grounding.answers(_responses(spark, d))
    ids = F.array_join(F.transform("citations", lambda c: c["id"].cast("string")), ",")
    return rows.select("query_id", "answer", ids.alias("citations"), "discarded", "confident")


@query
def answer_json(spark, d):
    rows = grounding.answers(_responses(spark, d))
    cited = F.transform("citations", lambda c: F.struct(c["id"].alias("id"), c["spec"].alias("spec"), c["section"].alias("section")))
    return rows.select("query_id", F.to_json(F.struct("answer", cited.alias("citations"), "discarded", "confident")).alias("body"))


@query
def citation_label(spark, d):
    rows = retrieval.hybrid_search(corpora.chunks(spark, d), corpora.questions(spark, d)).filter("returned")
    return rows.select("query_id", "rank", grounding.citation_label(F.col("rank"), F.col("spec"), F.col("section"), F.round("score", 9)).alias("label"))


@query
def citation_summary(spark, d):
    return _responses(spark, d).select("query_id", grounding.citation_summary(F.col("results")).alias("summary"))


@query
def model_completion(spark, d):
    """Answers of a model server that repeats its settings and the length of the question."""
    ship_package(spark)
    generator = clients.chat_generator(Config(), Echo())
    asked = corpora.questions(spark, d).withColumn("messages", grounding.build_messages(F.lit(""), F.col("query")))
    return asked.select("query_id", grounding.generate(F.col("messages"), generator).alias("answer"))


class Echo:
    """A model server's stand-in."""

    def __call__(self, body: dict) -> dict:
        said = f"{body['model']} {body['temperature']} {body['max_tokens']} {len(body['messages'])} {len(body['messages'][1]['content'])}"
        return {"choices": [{"message": {"role": "assistant", "content": said}}]}


# Service


@query
def health(spark, d):
    return spark.createDataFrame([(engine.health()["status"],)], "status string")


@query
def config_values(spark, d):
    """The settings of an environment with blanks, bad numbers and alternative names in it."""
    config = Config.from_env(sql.ENVIRONMENT)
    return spark.createDataFrame([(n, str(getattr(config, n))) for n in sql.SETTINGS], "name string, value string")


@query
def store_exists(spark, d):
    there, none = _store(spark, d), VectorStore(spark, f"{shared_dir(spark)}/none-{uuid.uuid4().hex}")
    return spark.createDataFrame([(there.exists(), none.exists(), none.count())], "there boolean, none boolean, n_none long")


# Streams


@query
def token_stream(spark, d):
    return events.token_stream(corpora.streamed_turns(spark, d))


@query
def token_fold(spark, d):
    return events.token_fold(events.token_stream(corpora.streamed_turns(spark, d)))


@query
def sse_encode(spark, d):
    return events.encode(corpora.streamed_turns(spark, d))


@query
def sse_decode(spark, d):
    """A model's stream of each turn, with a comment, a broken frame and an empty delta in it and a frame after its end."""
    frame = lambda t: F.concat(F.lit('data: {"choices":[{"delta":'), F.to_json(F.struct(t.alias("content"))), F.lit("}]}\n"))
    frames = F.array_join(F.transform(events.tokens_of(F.col("answer")), frame), "")
    raw = F.concat(F.lit(': ping\ndata: {"bad\ndata: {"choices":[{"delta":{"content":""}}]}\n'), frames, F.lit("data: [DONE]\n"), frame(F.lit("late")))
    return events.decode_model(corpora.streamed_turns(spark, d).withColumn("raw", raw))


@query
def stream_retrieval(spark, d):
    """Questions as a file stream, answered until the stream's end."""
    ship_package(spark)
    folder = f"{shared_dir(spark)}/questions-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    asked = table(spark, d, "benchmark")
    asked.repartition(3).write.parquet(f"{folder}/in")
    docs = table(spark, d, "documents")
    stream = questions.answer_stream(
        spark, f"{folder}/in", "item_id long, text string", lambda batch: keyword.bm25_topk(docs, batch), f"{folder}/out", f"{folder}/state", available_now=True, files_per_batch=1,
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("query_id", "id", six("bm25"), "sparse_rank")


@query
def stream_answers(spark, d):
    """Questions as a file stream, each micro-batch answered by hybrid search on stored vectors and a stored keyword index."""
    chunks, index = _stored_corpus(spark, d)
    ship_package(spark)
    folder = f"{shared_dir(spark)}/asked-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    corpora.questions(spark, d).repartition(3).write.parquet(f"{folder}/in")

    def answer(batch: DataFrame) -> DataFrame:
        return grounding.answers(retrieval.search_response(retrieval.hybrid_search(chunks, batch, index=index), batch))

    stream = questions.answer_stream(spark, f"{folder}/in", "query_id long, query string", answer, f"{folder}/out", f"{folder}/state", available_now=True)
    stream.awaitTermination()
    ids = F.array_join(F.transform("citations", lambda c: c["id"].cast("string")), ",")
    return spark.read.parquet(f"{folder}/out").select("query_id", "answer", ids.alias("citations"), "discarded", "confident")


@query
def events_decode(spark, d):
    """The application's own frames of each turn, joined to one stream and decoded, with a comment before them."""
    frames = events.encode(corpora.streamed_turns(spark, d)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", "frame"))).alias("frames"))
    raw = F.concat(F.lit(": ping\n\ndata: {}\n"), F.array_join("frames.frame", ""))
    return events.decode_events(frames.select("query_id", raw.alias("raw")))
