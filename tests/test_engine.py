"""The whole way from archives to streamed answers, with fakes for the network."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from groundsearch.config import Config
from groundsearch.functions import clients, vectors
from groundsearch.operators import grounding
from groundsearch.plans.engine import Engine
from groundsearch.sources import archives

LINES = ["Cover", "1Scope\t7", "1Scope", "The AMF registers the UE.", "5.2Registration", "5.2.1 The AMF accepts registration of the UE.", "Annex B (informative): Change history", "row"]


def zipped(**members) -> bytes:
    with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


def word_file(lines: list[str]) -> bytes:
    return zipped(**{"word/document.xml": "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)})


def fake_archive():
    """A fetch function of its own; workers don't have this module."""
    pages = {
        "/23.501/": b'<a href="x/23501-i50.zip"></a><a href="x/23501-h00.zip"></a>', "/23.502/": b'<a href="x/23502-i10.zip"></a>',
        "23501-i50.zip": zipped(**{"23501-i50.docx": word_file(LINES)}), "23502-i10.zip": b"broken",
    }

    def fetch(url: str) -> bytes:
        for end, data in pages.items():
            if url.endswith(end):
                return data
        raise FileNotFoundError(url)

    return fetch


def specs(spark):
    return spark.createDataFrame([("23.501",), ("23.502",), ("38.300",)], "number string")


def test_one_bad_document_does_not_stop_the_rest(spark):
    rows = {r.number: r for r in archives.download(specs(spark), fake_archive()).collect()}
    assert (rows["23.501"].status, rows["23.501"].name, rows["23.501"].error) == ("saved", "23501-i50.docx", None)
    assert rows["23.502"].status == rows["38.300"].status == "failed"
    assert "BadZipFile" in rows["23.502"].error and "FileNotFoundError" in rows["38.300"].error
    present = spark.createDataFrame([("23.501", "i50")], "number string, suffix string")
    again = {r.number: r for r in archives.download(specs(spark), fake_archive(), present=present).collect()}
    assert (again["23.501"].status, again["23.501"].content) == ("present", None)
    old = archives.download(specs(spark), fake_archive(), release=17).filter("number = '23.502'").first()
    assert old.error == "no archive in the listing"


def test_from_archives_to_streamed_answers(spark, tmp_path):
    engine = Engine(spark, Config(data_dir=str(tmp_path / "data")), fetch=fake_archive())
    assert engine.download(specs(spark)).filter("status = 'saved'").count() == 1
    assert engine.download(specs(spark)).filter("status = 'saved'").count() == 1  # what is there is not fetched again
    body = engine.extract().first()
    assert (body.spec, body.version, body.text) == ("23.501", "i50", "\n".join(LINES[2:6]))
    assert engine.build() == 2
    asked = spark.createDataFrame([(1, "AMF registration of the UE"), (2, " ")], "query_id long, query string")
    answer = engine.ask(asked).filter("query_id = 1").first()
    assert answer.confident and answer.citations[0].section == "5.2"

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.json").write_text("\n".join(json.dumps({"query_id": r.query_id, "query": r.query}) for r in asked.collect()))
    run = engine.answer_stream(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    run.awaitTermination(120)
    kinds = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("query_id", "seq").collect():
        kinds.setdefault(r.query_id, []).append(r.type)
    assert kinds[1][0] == "meta" and kinds[1][-1] == "done" and kinds[2] == ["error"]

    def sse(batch):
        return ['data: {"choices":[{"delta":{"content":"Per "}}]}\ndata: {"choices":[{"delta":{"content":"§5.2"}}]}\ndata: [DONE]\n' for _ in batch]

    deltas = engine.stream_tokens(asked, lambda: sse).orderBy("seq").collect()
    assert [(r.query_id, r.content) for r in deltas] == [(1, "Per "), (1, "§5.2")]


def test_model_client(spark):
    bodies = []

    def post(body):
        bodies.append(body)
        return {"choices": [{"message": {"content": "yes"}}]} if body["messages"][0]["content"] != "bad" else {"error": "e" * 500}

    config = Config(llm_model="m", llm_temperature=0.5, llm_max_tokens=7)
    run = clients.chat_generator(config, post)()
    assert run([[{"role": "user", "content": "x"}]]) == ["yes"]
    assert bodies == [{"model": "m", "messages": [{"role": "user", "content": "x"}], "temperature": 0.5, "max_tokens": 7}]
    with pytest.raises(clients.ModelError) as e:
        run([[{"role": "user", "content": "bad"}]])
    assert len(str(e.value)) < 250
    streamed = clients.stream_generator(config, lambda body: f"data: {body['stream']}")()
    assert streamed([[{"role": "user", "content": "x"}]]) == ["data: True"]


def test_providers_by_configuration():
    assert clients.embedding_provider(Config()) is vectors.hash_provider
    post = lambda body: {"data": [{"index": 0, "embedding": [1.0, 2.0]}]}
    made = clients.embedding_provider(Config(embedding_provider="api", embedding_dims=2), post=post)()
    assert made([["a"]])[0].tolist() == [1.0, 2.0]
    with pytest.raises(ValueError, match="unknown"):
        clients.embedding_provider(Config(embedding_provider="none"))


def test_citation_summary(spark):
    cited = [("23.501", f"{i}", 0.5) for i in range(6)]
    rows = spark.createDataFrame([(cited,), (cited[:2],), ([],)], "r array<struct<spec:string,section:string,score:double>>")
    got = [r[0].split("\n") for r in rows.select(grounding.citation_summary(F.col("r"))).collect()]
    assert got[0][0] == "[1] TS 23.501 §0 — sim 50%" and got[0][4] == "+2 more" and len(got[0]) == 5
    assert len(got[1]) == 2 and got[2] == [""]
