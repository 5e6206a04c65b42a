"""BM25, dense search, fusion, guard, answers, events, sources, store and streams."""

import io
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundsearch.config import Config
from groundsearch.functions import vectors
from groundsearch.operators import dense, grounding, keyword, resolve, retrieval
from groundsearch.plans.engine import Engine
from groundsearch.sources import documents
from groundsearch.sources.store import VectorStore
from groundsearch.streaming import events, questions

DOCS = [(0, "AMF handles UE registration registration"), (1, "SMF handles PDU session"), (2, "AMF and SMF session handling session"), (3, "the of")]


def scores(spark, *asked):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    return docs, queries, {(r.query_id, r.id): round(r.bm25, 6) for r in keyword.bm25_topk(docs, queries).collect()}


def test_bm25_and_its_stored_index(spark, tmp_path):
    docs, queries, got = scores(spark, "AMF registration", "session SMF session", "zzz")
    assert got == {(0, 0): 2.067134, (0, 2): 0.58975, (1, 2): 1.440305, (1, 1): 1.309751}
    keyword.KeywordIndex.build(docs, "doc_id").write(str(tmp_path / "index"))
    index = keyword.KeywordIndex.read(spark, str(tmp_path / "index"))
    again = index.scores(keyword.query_terms(queries, "item_id", "text")).collect()
    assert {(r.query_id, r.id): round(r.bm25, 6) for r in again} == got
    assert keyword.corpus_stats(keyword.doc_len(docs, "doc_id")).first() == (4, 3.5)
    assert keyword.corpus_stats(keyword.doc_len(docs.limit(0), "doc_id")).first() == (0, 0.0)


def test_repeating_a_term_does_not_count(spark):
    assert scores(spark, "AMF")[2] == scores(spark, "AMF amf AMF")[2]


def test_top_k_is_limited_before_the_shuffle(spark):
    docs, queries, _ = scores(spark, "AMF")
    plan = keyword.bm25_topk(docs, queries)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_bm25_scans_its_documents_once(spark, sf_dir):
    """The executed plan has one exchange of postings, which statistics and document frequencies reuse."""
    docs, asked = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = keyword.bm25_topk(docs, asked)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("sf0.001/documents.parquet") == 1 and "ReusedExchange" in final


def test_term_freq_finds_words_once(spark, sf_dir):
    plan = keyword.term_freq(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_dense_is_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[7] = 0
    v[11] = v[12]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>").repartition(5)
    asked = rows.filter("id % 10 = 1").withColumnRenamed("id", "query_id")
    got = {}
    for r in dense.dense_topk(rows, asked, 5, block=16).orderBy("query_id", "dense_rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    u = v.astype(float) / np.where((n := np.linalg.norm(v.astype(float), axis=1, keepdims=True)) > 0, n, np.nan)
    for k in range(1, 300, 10):
        sims = u @ u[k]
        by = sorted((i for i in range(300) if sims[i] == sims[i]), key=lambda i: (-round(sims[i], 9), i))
        assert got[k] == by[:5]


def test_dims_are_checked_on_every_row(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vector array<float>")
    with pytest.raises(Exception, match="expected 2 dimensions"):
        dense.dims_check(rows, 2).collect()


def test_fusion(spark):
    near = spark.createDataFrame([(1, i, s, k + 1) for k, (i, s) in enumerate([(0, 0.9), (1, 0.5), (2, 0.3)])], "query_id long, id long, dense_sim double, dense_rank int")
    words = spark.createDataFrame([(1, i, s, k + 1) for k, (i, s) in enumerate([(1, 4.0), (2, 2.0), (3, 1.5)])], "query_id long, id long, bm25 double, sparse_rank int")
    fuse = lambda a, b: [(r.id, round(r.hybrid, 6)) for r in retrieval.fusion_topk(retrieval.fusion_scores(retrieval.fusion_minmax(retrieval.fusion_outer(a, b)))).orderBy("hybrid_rank").collect()]
    assert fuse(near, words) == [(0, 0.7), (1, 0.533333), (2, 0.06), (3, 0.0)]
    assert fuse(near.limit(0), words) == [(1, 1.0), (2, 0.76), (3, 0.7)]
    assert fuse(near, words.limit(0)) == [(0, 0.7), (1, 0.233333), (2, 0.0)]
    assert fuse(near.filter("id = 1"), words.limit(0)) == [(1, 0.7)]


def search_corpus(spark):
    rng = random.Random(2)
    words = ["amf", "smf", "registration", "session", "handover", "cell", "key", "slice"]
    rows = [(i, "23.501", f"5.{i}", "", " ".join(rng.choices(words, k=6)) if i else "") for i in range(40)]
    chunks = spark.createDataFrame(rows, "id long, spec string, section string, heading string, text string")
    return chunks.withColumn("vector", vectors.embed(F.split("text", " ")))


def test_search_properties(spark):
    chunks = search_corpus(spark)
    asked = spark.createDataFrame([(1, "amf registration", 2, None), (2, "nothing known", None, None), (3, "slice key key", 3, 0.99)], "query_id long, query string, top_k int, threshold double")
    found = {r.query_id: r for r in retrieval.search_response(retrieval.hybrid_search(chunks, asked), asked).collect()}
    assert len(found[1].results) == 2 and not found[2].results
    assert [r.rank for r in found[1].results] == [1, 2]
    for r in found.values():
        assert len(r.results) + r.discarded == r.candidates <= 20
        assert all(c.score >= r.threshold for c in r.results)
    guarded = retrieval.hybrid_search(chunks, asked).collect()
    assert all(-1e-9 <= r.hybrid <= 1 + 1e-9 for r in guarded)
    answers = {r.query_id: r for r in grounding.answers(retrieval.search_response(retrieval.hybrid_search(chunks, asked), asked)).collect()}
    assert answers[2].answer == grounding.FALLBACK and not answers[2].confident and answers[1].confident


def test_stored_index_gives_the_same_search(spark, tmp_path):
    chunks = search_corpus(spark)
    asked = spark.createDataFrame([(1, "amf registration", 7), (2, "slice key", 12)], "query_id long, query string, candidates int")
    keyword.KeywordIndex.build(chunks, "id").write(str(tmp_path))
    index = keyword.KeywordIndex.read(spark, str(tmp_path))
    rows = [sorted(map(str, retrieval.hybrid_search(chunks, asked, index=i).select("query_id", "id", F.round("bm25", 9), "hybrid_rank", "returned").collect())) for i in (None, index)]
    assert rows[0] == rows[1]
    with pytest.raises(Exception, match="at most 10 candidates"):
        retrieval.hybrid_search(chunks, asked, retrieval.Options(most_candidates=10)).collect()


def test_hash_vectors(spark):
    """A batch of lists against one token at a time."""
    import hashlib

    lists = [["a", "b", "a"], [], None, ["zz"] * 3, ["b"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, t array<string>").withColumn("v", vectors.embed(F.col("t"))).orderBy("i").collect()
    for r, tokens in zip(rows, lists, strict=True):
        v = np.zeros(vectors.DIMS)
        for t in tokens or []:
            d = hashlib.md5(t.encode()).hexdigest()
            v[int(d[:8], 16) % vectors.DIMS] += 1 if int(d[8], 16) < 8 else -1
        assert np.allclose(r.v, v / max(np.linalg.norm(v), 1e-300), atol=1e-6)


def test_hits_without_a_dense_score_have_no_text_unless_hydrated(spark):
    chunks = search_corpus(spark)
    hits = spark.createDataFrame([(1, 5, None, 1)], "query_id long, id long, dense_rank int, hybrid_rank int")
    asked = spark.createDataFrame([(1, "amf")], "query_id long, query string").withColumn("vector", vectors.embed(F.split("query", " ")))
    bare = retrieval.verify_candidates(hits, chunks, asked).first()
    full = retrieval.verify_candidates(hits, chunks, asked, retrieval.Options(sparse_only="hydrate")).first()
    assert bare.text == "" and bare.spec is None and bare.score != bare.score
    assert full.text and full.spec == "23.501" and full.score == full.score


@pytest.mark.parametrize(("answer", "grounded"), [
    ("As per §5.2.1, the AMF supports registration.", True), ("As per §9.9.9, something happens.", False), ("No reference.", True), ("Per §5.2.1.", False), ("§5.2.1a x", True),
])
def test_grounding(spark, answer, grounded):
    row = spark.createDataFrame([(answer, ["5.2.1", "5.3.2", "", None])], "a string, s array<string>")
    assert row.select(grounding.is_grounded(F.col("a"), F.col("s"))).first()[0] is grounded


@pytest.mark.parametrize(("answer", "confident"), [
    ("The AMF handles registration and authentication.", True), ("I don't have enough information from the provided specifications.", False), ("No information available in the context.", False),
])
def test_refusals(spark, answer, confident):
    assert spark.createDataFrame([(answer,)], "a string").select(grounding.is_confident(F.col("a"))).first()[0] is confident


def test_generators_and_api_embeddings(spark):
    chunks, asked = search_corpus(spark), spark.createDataFrame([(1, "amf registration")], "query_id long, query string")
    response = retrieval.search_response(retrieval.hybrid_search(chunks, asked), asked)
    made = grounding.answers(response, lambda: lambda batch: [f"{len(m)} {m[1]['role']} §9.9" for m in batch]).first()
    assert made.answer == "2 user §9.9" and not made.confident
    post = lambda body: {"data": [{"index": i, "embedding": [float(i), float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}
    run = vectors.api_provider(post, "m", 2)()
    assert [v.tolist() for v in run([["a"], ["bb", "c"]])] == [[0.0, 1.0], [1.0, 4.0]]
    waits, left = [], [ConnectionError(), TimeoutError()]

    def call():
        if left:
            raise left.pop()
        return 5

    assert vectors.retried(call, sleep=waits.append) == 5 and waits == [1.0, 2.0]


def test_events(spark):
    answers = spark.createDataFrame([(1, " a  b\nc", ["x"], 2, None), (2, "", [], 0, None), (3, "t", [], 0, "query is required")], "query_id long, answer string, citations array<string>, discarded int, error string")
    rows = events.encode(answers).orderBy("query_id", "seq").collect()
    assert [r.type for r in rows] == ["meta", "token", "token", "token", "token", "done", "meta", "done", "error"]
    assert rows[0].frame == 'data: {"type":"meta","citations":["x"],"discarded":2}\n\n'
    raw = spark.createDataFrame([(1, "".join(r.frame for r in rows[:6]))], "query_id long, raw string")
    assert [r.payload for r in events.decode_events(raw).orderBy("seq").collect()] == [r.payload for r in rows[:6]]
    assert events.token_fold(events.token_stream(answers)).filter("query_id = 1").first().answer == " a  b\nc"
    stream = 'data: {"choices":[{"delta":{"content":"a"}}]}\r\n: x\ndata: {bad\ndata: {"choices":[{"delta":{"content":""}}]}\ndata: {"choices":[{"delta":{"content":"b"}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"z"}}]}\n'
    got = events.decode_model(spark.createDataFrame([(1, stream)], "query_id long, raw string")).orderBy("seq").collect()
    assert [r.content for r in got] == ["a", "b"]


def archive(**members):
    with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


def test_files(spark, tmp_path):
    xml = '<w:p><w:pPr><w:x/></w:pPr><w:r><w:t>5.2</w:t><w:tab/><w:t xml:space="preserve">Scope  &#38;lt; x </w:t></w:r></w:p><w:p><w:r><w:t>lost</w:t></w:r><w:proofErr/><w:r><w:t>kept</w:t></w:r></w:p><w:p/>'
    for name, data in {"a.docx": archive(**{"word/document.xml": xml}), "b.DOCX": b"broken", "c.pdf": b"one  two|three", "d.txt": b"no"}.items():
        (tmp_path / "23.501").mkdir(exist_ok=True)
        (tmp_path / "23.501" / name).write_bytes(data)
    files = documents.read_files(spark, str(tmp_path))
    reader = lambda data: [page.split(" ") for page in data.decode().split("|")]
    rows = {r.name: r for r in documents.parse_documents(files, reader).collect()}
    assert set(rows) == {"a.docx", "b.DOCX", "c.pdf"} and rows["a.docx"].spec == "23.501"
    assert rows["a.docx"].text == "5.2Scope < x\nkept" and "BadZipFile" in rows["b.DOCX"].error
    assert rows["c.pdf"].text == "one two\fthree"
    whole = documents.parse_documents(files, reader, paragraphs="whole").filter("name = 'a.docx'").first()
    assert whole.text == "5.2Scope < x\nlostkept"
    zips = spark.createDataFrame([(archive(**{"x.docx/": "", "n.txt": "", "d/B.PDF": "pdf", "c.docx": "c"}),), (archive(n=""),), (b"?",)], "c binary")
    picked = zips.select(documents.pick_member(F.col("c")).alias("m")).select("m.*").collect()
    assert (picked[0].name, bytes(picked[0].content)) == ("B.PDF", b"pdf") and picked[1].error and picked[2].error


def test_pdf_reader():
    from groundsearch.plans.corpora import pdf_file
    from groundsearch.sources.pdf import read_pages, shown

    for packed in (False, True):
        assert ["".join(p) for p in read_pages(pdf_file("ab (c)\\d é\nsecond 🙂", packed))] == ["ab (c)\\d é", "second 🙂"]
    assert shown(b"BT (a\\(b(c)\\)\\101\\n) Tj [(x) -300 (y) 5 <7A>] TJ (one) ' 1 2 (two) \" ET", {}) == ["a(b(c))A\n", "x yz", "one", "two"]
    for bad in (b"no", b"%PDF-1.4 /Encrypt 3 0 R"):
        with pytest.raises(ValueError):
            read_pages(bad)


def test_versions_resolve(spark):
    listing = '<a href="q/23501-i50.zip"></a><A HREF="r/23501-H90.ZIP"></A><a href="s/23501-i50.zip"></a><a href="t/23502-j00.zip"></a>'
    files = resolve.parse_listings(spark.createDataFrame([("23.501", listing), ("99.999", "")], "number string, html string"))
    assert [(r.suffix, r.key, r.release) for r in files.orderBy("pos").collect()] == [("i50", 23508, 18), ("H90", 22356, None), ("i50", 23508, 18)]
    assert resolve.pick_best(files).first().url == "q/23501-i50.zip"
    assert resolve.pick_best(files, 17).count() == 0
    assert resolve.missing(resolve.pick_best(files), spark.createDataFrame([("23.501", "i50")], "number string, suffix string")).count() == 0


def test_store_replaces_whole_tables(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    assert not store.exists() and store.count() == 0
    with pytest.raises(FileNotFoundError):
        store.scan()
    row = {"spec": "s", "version": "v", "source": "f", "section": "", "paragraph": "", "heading": "", "page": 1, "text": "t", "id": "s-0", "ordinal": 0, "vector": [1.0]}
    store.replace(spark.createDataFrame([row, row], store.schema))
    store.replace(spark.createDataFrame([row], store.schema))
    assert store.count() == 1 and store.scan("id", "text").first() == ("s-0", "t")
    assert len(store.versions()) == 2
    old = spark.read.schema(store.schema).parquet(f"{store.root}/{store.versions()[0]}")
    store.replace(spark.createDataFrame([row], store.schema))
    assert len(store.versions()) == len(list((tmp_path / "s").iterdir())) == 2
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        old.collect()  # two versions back
    plan = store.scan("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string>" in plan


def test_engine_end_to_end(spark, tmp_path):
    for spec, text in {"23.501": "1Scope\nThe AMF registers the UE.\n5.2Registration\n5.2.1 The AMF accepts registration of the UE.", "23.502": "4Session\nThe SMF sets up sessions."}.items():
        (tmp_path / "text" / spec).mkdir(parents=True)
        (tmp_path / "text" / spec / f"{spec}-i50.txt").write_text(text)
    engine = Engine(spark, Config(data_dir=str(tmp_path)))
    assert engine.build() == 3 and engine.build() == 3
    asked = spark.createDataFrame([(1, "AMF registration of the UE"), (2, "  "), (3, "zebra")], "query_id long, query string")
    got = {r.query_id: r for r in engine.ask(asked).collect()}
    assert got[1].status == 200 and got[1].confident and got[1].citations[0].spec == "23.501"
    assert got[2].status == 400 and got[2].answer is None
    assert got[3].answer == grounding.FALLBACK
    kinds = {}
    for r in engine.stream(asked).orderBy("query_id", "seq").collect():
        kinds.setdefault(r.query_id, []).append(r.type)
    assert kinds[1][0] == "meta" and kinds[1][-1] == "done" and kinds[2] == ["error"]
    assert engine.self_check().first().candidates == 3


def test_stream_is_batch(spark, tmp_path):
    docs, queries, got = scores(spark, "AMF registration", "session SMF session", "handles")
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    run = questions.answer_stream(spark, str(tmp_path / "in"), "item_id long, text string", lambda b: keyword.bm25_topk(docs, b), str(tmp_path / "out"), str(tmp_path / "state"), True, 1)
    run.awaitTermination(120)
    time.sleep(0)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.query_id, r.id): round(r.bm25, 6) for r in rows} == got


def test_config():
    c = Config.from_env({"PORT": "-1", "RETRIEVAL_TOP_K": "9", "RETRIEVAL_THRESHOLD": "", "LLM_BASE_URL": " http://x// ", "GEMINI_API_KEY": "k", "LLM_PROVIDER": "OLLAMA", "EMBED_DIMS": "x"})
    assert (c.port, c.top_k, c.threshold, c.llm_base_url, c.llm_api_key, c.llm_provider, c.embedding_dims) == (3000, 9, 0.0, "http://x", "k", "ollama", 384)
