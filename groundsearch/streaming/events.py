"""Server-sent events: token streams, their encoding, decoding and folding, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "array<struct<seq:bigint,type:string,payload:string>>"


def tokens_of(answer: Column) -> Column:
    """The words of an answer, each with the white space after it; leading white space is one token."""
    return F.regexp_extract_all(answer, F.lit(r"[^ \t\n\r]+[ \t\n\r]*|[ \t\n\r]+"), F.lit(0))


def token_stream(answers: DataFrame) -> DataFrame:
    """query_id, seq, token: the chunks that a streaming model sends for each answer."""
    return answers.select("query_id", F.posexplode(tokens_of(F.col("answer"))).alias("seq", "token"))


def token_fold(tokens: DataFrame) -> DataFrame:
    """query_id, answer: tokens joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "token")))
    return tokens.groupBy("query_id").agg(F.array_join(parts.getField("token"), "").alias("answer"))


def encode(answers: DataFrame) -> DataFrame:
    """query_id, seq, type, payload, frame of each event: meta, the tokens, done; or, where error isn't null, one error event.

    answers: query_id, answer, citations (any type), discarded, and error if there is one.  An answer without evidence is streamed too.
    """
    def event(kind: str, **fields: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.to_json(F.struct(F.lit(kind).alias("type"), *(c.alias(n) for n, c in fields.items()))).alias("payload"))

    tokens = F.transform(tokens_of(F.col("answer")), lambda t: event("token", content=t))
    good = F.concat(F.array(event("meta", citations=F.col("citations"), discarded=F.col("discarded"))), tokens, F.array(event("done")))
    events = good
    if "error" in answers.columns:
        events = F.when(F.col("error").isNotNull(), F.array(event("error", error=F.col("error")))).otherwise(good)
    rows = answers.select("query_id", F.posexplode(events).alias("seq", "e")).select("query_id", "seq", "e.type", "e.payload")
    return rows.withColumn("frame", F.concat(F.lit("data: "), "payload", F.lit("\n\n")))


def decode_model(streams: DataFrame) -> DataFrame:
    """query_id, seq, content of a model's stream in raw (all bytes of a response): non-empty deltas up to [DONE]; other lines and bad JSON are skipped."""
    data = F.transform(F.filter(F.split("raw", "\n", -1), lambda l: F.startswith(l, F.lit("data: "))), lambda l: F.btrim(F.substr(l, F.lit(7)), F.lit(" \r\t")))
    end = F.array_position(data, "[DONE]")
    live = F.when(end > 0, F.slice(data, F.lit(1), (end - 1).cast("int"))).otherwise(data)
    content = F.filter(F.transform(live, lambda d: F.get_json_object(d, "$.choices[0].delta.content")), lambda c: c.isNotNull() & (c != ""))
    return streams.select("query_id", F.posexplode(content).alias("seq", "content"))


def decode_events(streams: DataFrame) -> DataFrame:
    """query_id, seq, type, payload of the application's own events in raw."""
    data = F.transform(F.filter(F.split("raw", "\n", -1), lambda l: F.startswith(l, F.lit("data: "))), lambda l: F.substr(l, F.lit(7)))
    known = F.filter(data, lambda d: F.get_json_object(d, "$.type").isNotNull())
    rows = streams.select("query_id", F.posexplode(known).alias("seq", "payload"))
    return rows.select("query_id", "seq", F.get_json_object("payload", "$.type").alias("type"), "payload")
