"""End to end: download documents, extract their text, build a store from it, and answer questions from that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundsearch.config import Config
from groundsearch.functions import clients, vectors
from groundsearch.functions import text as T
from groundsearch.functions.versions import version_of
from groundsearch.operators import chunking, grounding, retrieval
from groundsearch.operators.dense import dims_check
from groundsearch.operators.keyword import KeywordIndex
from groundsearch.sources import archives, documents
from groundsearch.sources.store import VectorStore
from groundsearch.streaming import events, questions

SELF_CHECK = "How does the AMF support UE registration?"


def health() -> dict[str, str]:
    return {"status": "ok"}


def ingest(texts: DataFrame, config: Config = Config(), provider: vectors.Provider = vectors.hash_provider) -> DataFrame:
    """Stored rows of spec, version, source and text: chunks with ids and vectors."""
    rows = chunking.with_ids(chunking.chunk_documents(texts), "spec", ["spec", "source"])
    rows = chunking.stored(rows).withColumn("vector", vectors.embed(T.tokenize(F.col("text")), provider))
    return dims_check(rows, config.embedding_dims)


class Engine:
    """Answers questions from the store's current version.  Providers and clients come from the configuration where none is passed in."""

    def __init__(
        self, spark: SparkSession, config: Config = Config(), provider: vectors.Provider | None = None, generator: grounding.Generator | None = None,
        fetch: clients.Fetch | None = None, reader: documents.PdfReader = documents.read_pages,
    ):
        self.spark, self.config, self.fetch, self.reader = spark, config, fetch, reader
        self.provider = provider or clients.embedding_provider(config)
        self.generator = generator or (clients.chat_generator(config) if config.llm_api_key else None)
        self.store = VectorStore(spark, f"{config.data_dir}/index")

    def _at(self, part: str) -> str:
        return f"{self.config.data_dir}/{part}"

    def download(self, specs: DataFrame, release: int | None = None) -> DataFrame:
        """Fetch the latest archives of specs (number) that aren't there yet, and append their documents to the files table; returns it.

        A document that fails has a row with its error; it is tried again next time.
        """
        path = self._at("files")
        present = self._table(path)
        found = archives.download(specs, self.fetch or clients.http_fetch(), release, present.filter("status = 'saved'") if present is not None else None)
        found.filter("status <> 'present'").write.mode("append").parquet(path)
        return self.spark.read.parquet(path)

    def _table(self, path: str) -> DataFrame | None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.parquet(path) if there else None

    def extract(self, source_path: str | None = None) -> DataFrame:
        """Write the body text of every document, under source_path or in the files table, to the texts table: spec, version, source, text, error."""
        if source_path:
            files = documents.read_files(self.spark, source_path).select("spec", "name", "content")
        else:
            files = self.spark.read.parquet(self._at("files")).filter("status = 'saved'").select(F.col("number").alias("spec"), "name", "content")
        parsed = documents.parse_documents(files, self.reader)
        version = version_of(F.regexp_replace("name", r"(?i)\.(docx|pdf)\z", ""))
        rows = parsed.select("spec", version.alias("version"), F.col("name").alias("source"), T.extract_body(F.col("text")).alias("text"), "error")
        rows.write.mode("overwrite").parquet(self._at("texts"))
        return self.spark.read.parquet(self._at("texts"))

    def build(self, text_path: str | None = None, force: bool = False) -> int:
        """Chunk, embed, index and store the texts, unless a table is there already; returns its rows.

        Texts are .txt files under text_path; without it those of extract(), or else those under the data folder.
        """
        if force or not self.store.exists():
            texts = self._table(self._at("texts")) if text_path is None else None
            if texts is None:
                texts = documents.read_texts(self.spark, text_path or self._at("text"))
            else:
                texts = texts.filter("text is not null").drop("error")
            self.store.replace(ingest(texts, self.config, self.provider))
            KeywordIndex.build(self.store.scan("ordinal", "text"), "ordinal").write(self._index_path())
        return self.store.count()

    def _index_path(self) -> str:
        """The keyword index of the store's current version."""
        return f"{self.config.data_dir}/keywords/{self.store.versions()[-1]}"

    def options(self) -> retrieval.Options:
        c = self.config
        return retrieval.Options(c.top_k, c.threshold, c.keyword_weight, c.fusion_candidates)

    def search(self, queries: DataFrame) -> DataFrame:
        """Search responses of queries (query_id, query, own parameters)."""
        rows = self.store.scan()
        if rows.isEmpty():
            raise ValueError("the table is empty; build it first")
        chunks = rows.withColumn("chunk_id", F.col("id")).withColumn("id", F.col("ordinal"))
        index = KeywordIndex.read(self.spark, self._index_path())
        return retrieval.search_response(retrieval.hybrid_search(chunks, queries, self.options(), self.provider, index), queries, self.options())

    def ask(self, queries: DataFrame) -> DataFrame:
        """query_id, status, answer, citations, discarded, confident; blank questions have status 400 and nothing else."""
        checked = grounding.validate_queries(queries)
        good = grounding.answers(self.search(checked.filter("status = 200").drop("status")), self.generator).drop("query")
        return checked.select("query_id", "status").join(good, "query_id", "left")

    def stream(self, queries: DataFrame) -> DataFrame:
        """The same as event rows."""
        asked = self.ask(queries).withColumn("error", F.when(F.col("status") == 400, "query is required"))
        return events.encode(asked)

    def stream_tokens(self, queries: DataFrame, generator: grounding.Generator | None = None) -> DataFrame:
        """query_id, seq, content: the deltas that a streaming model sends for each question with results."""
        found = self.search(grounding.validate_queries(queries).filter("status = 200").drop("status")).filter(F.size("results") > 0)
        asked = grounding.build_messages(grounding.build_context(F.col("results")), F.col("query"))
        raw = found.select("query_id", grounding.generate(asked, generator or clients.stream_generator(self.config)).alias("raw"))
        return events.decode_model(raw)

    def answer_stream(self, source: str, sink: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Files of questions (query_id, query as JSON lines) as they come, each micro-batch answered by hybrid search as event rows."""
        schema = "query_id long, query string"
        return questions.answer_stream(self.spark, source, schema, self.stream, sink, checkpoint, available_now, file_format="json")

    def self_check(self) -> DataFrame:
        """The fixed question after a build, with five results at most."""
        return self.search(self.spark.createDataFrame([(0, SELF_CHECK, 5)], "query_id long, query string, top_k int"))
