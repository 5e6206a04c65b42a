"""Context, prompts, answers and their checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsearch.functions.text import trim
from groundsearch.shipping import ship_package

# The prompt, the fallback answer and the refusals that answers are compared with.
SYSTEM_PROMPT = """You are a precise 3GPP technical specifications assistant.

Rules:
1. Answer ONLY using the provided context chunks. Never use outside knowledge.
2. Cite sources using [1], [2] etc. matching the context chunk numbers.
3. If the context does not contain enough information, reply exactly: "I don't have enough information from the provided specifications to answer this question."
4. Never fabricate section numbers, clause references, or technical values not present in the context.
5. Use exact 3GPP terminology (e.g. "AMF", "NSSAI", "PDU session").
6. When multiple context chunks are relevant, synthesize them rather than listing chunks separately.
7. If you are unsure, say so rather than guessing."""
USER_PROMPT = ("Context from 3GPP specifications:\n\n", "\n\n---\n\nQuestion: ")
FALLBACK = "I don't have enough information from the provided specifications to answer this question."
REFUSALS = ("don't have enough information", "i do not have enough", "not provided in the context", "cannot answer", "no information")


def build_context(results: Column) -> Column:
    """The numbered context of an array of citations."""
    def one(c: Column, i: Column) -> Column:
        title = F.when(F.coalesce(c["heading"], F.lit("")) == "", "N/A").otherwise(c["heading"])
        return F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] TS "), F.coalesce(c["spec"], F.lit("")), F.lit(" §"), F.coalesce(c["section"], F.lit("")),
            F.lit(" ("), title, F.lit("):\n"), c["text"],
        )

    return F.array_join(F.transform(results, one), "\n\n")


def build_messages(context: Column, query: Column) -> Column:
    """The system and the user message."""
    user = F.concat(F.lit(USER_PROMPT[0]), context, F.lit(USER_PROMPT[1]), query)
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))
    )


def is_confident(answer: Column) -> Column:
    """Whether the answer holds none of the refusals."""
    low = F.lower(answer)
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | F.contains(low, F.lit(phrase))
    return ~refused


def is_grounded(answer: Column, sections: Column) -> Column:
    """Whether each section that the answer refers to is one of sections (empty and null ones don't count)."""
    cited = F.filter(sections, lambda s: s.isNotNull() & (s != ""))
    refs = F.regexp_extract_all(answer, F.lit("§([0-9.]+)"), F.lit(1))
    return F.forall(refs, lambda r: F.coalesce(F.array_contains(cited, r), F.lit(False)))


def extractive(results: Column) -> Column:
    """The offline answer: the best citation's section and the head of its text."""
    best = F.get(results, 0)
    section = F.coalesce(best["section"], F.lit(""))
    where = F.when(section == "", "").otherwise(F.concat(F.lit("Per §"), section, F.lit(", ")))
    return F.concat(where, F.substring(best["text"], 1, 200))


#: A generator gives each of a batch's message lists an answer; it is made once in each worker.
Generator = Callable[[], Callable[[list[list[dict]]], list[str]]]


def generate(messages: Column, generator: Generator) -> Column:
    """Answers by a provider."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = generator()
        for part in parts:
            yield pd.Series(answer([[dict(m) for m in row] for row in part]))

    return run(messages)


def answers(responses: DataFrame, generator: Generator | None = None) -> DataFrame:
    """query_id, query, answer, citations, discarded, confident of search responses.

    Without results the answer is the fallback and isn't confident.  generator None answers by extraction, without leaving the JVM.
    """
    some = F.size("results") > 0
    if generator is None:
        made = responses.withColumn("made", extractive(F.col("results")))
    else:
        ship_package(responses.sparkSession)
        asked = responses.withColumn("messages", build_messages(build_context(F.col("results")), F.col("query")))
        made = asked.withColumn("made", generate(F.col("messages"), generator)).drop("messages")
    sure = is_confident(F.col("made")) & is_grounded(F.col("made"), F.col("results.section"))
    return made.select(
        "query_id", "query", F.when(some, F.col("made")).otherwise(FALLBACK).alias("answer"), F.col("results").alias("citations"), "discarded",
        F.when(some, sure).otherwise(False).alias("confident"),
    )


def validate_queries(queries: DataFrame, text_col: str = "query") -> DataFrame:
    """queries with status: 400 for null or blank text, else 200."""
    return queries.withColumn("status", F.when(trim(F.coalesce(text_col, F.lit(""))) == "", 400).otherwise(200))


def citation_label(position: Column, spec: Column, section: Column, score: Column) -> Column:
    """`[i] TS spec §section — sim NN%`."""
    percent = F.round(score * 100).cast("int").cast("string")
    return F.concat(F.lit("["), position.cast("string"), F.lit("] TS "), spec, F.lit(" §"), section, F.lit(" — sim "), percent, F.lit("%"))


def citation_summary(results: Column, shown: int = 4) -> Column:
    """The labels of the first citations of an array, one a line, and `+n more` for the rest."""
    labels = F.transform(F.slice(results, 1, shown), lambda c, i: citation_label(i + 1, c["spec"], c["section"], F.round(c["score"], 9)))
    more = F.when(F.size(results) > shown, F.array(F.concat(F.lit("+"), (F.size(results) - shown).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(labels, more), "\n")
