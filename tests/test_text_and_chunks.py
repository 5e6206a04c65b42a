"""Golden cases of chunking, body extraction, tokens, headings and entities."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundsearch.functions import text as T
from groundsearch.functions import versions as V
from groundsearch.operators import chunking

CHUNKS = {
    "basic": (900, ["1Scope", "This document defines things.", "5.2.1 Registration  procedure", "5.2.1.1 The UE shall register.", "5.2.1.2 The AMF shall accept.", "Annex B (normative): Keys", "x"], [
        ("1", None, "1Scope", 1, "1Scope This document defines things."),
        ("5.2.1", "5.2.1.2", "5.2.1 Registration procedure", 1, "5.2.1 Registration procedure 5.2.1.1 The UE shall register. 5.2.1.2 The AMF shall accept."),
        ("Annex B", None, "Annex B (normative): Keys", 1, "Annex B (normative): Keys x"),
    ]),
    "overflow": (30, ["4.1Intro", "4.1.1 aaaaaaaaaa.", "4.1.2 bbbbbbbbbb."], [
        ("4.1", "4.1.2", "4.1Intro", 1, "4.1Intro 4.1.1 aaaaaaaaaa."), ("4.1", "4.1.2", "4.1Intro", 1, "4.1.2 bbbbbbbbbb."),
    ]),
    "pages": (900, ["2Refs", "alpha", "\fbeta", "\f3Terms", "gamma"], [("2", None, "2Refs", 3, "2Refs alpha beta"), ("3", None, "3Terms", 3, "3Terms gamma")]),
    "odd": (900, ["6.2.2.1.3Deep heading", "6.2.2.1.3 Deep para", "5GS architecture overview", "5.1aVariant", "5.2Ends with stop."], [
        (None, None, None, 1, "6.2.2.1.3Deep heading 6.2.2.1.3 Deep para"), ("5", None, "5GS architecture overview", 1, "5GS architecture overview"),
        ("5.1a", None, "5.1aVariant", 1, "5.1aVariant 5.2Ends with stop."),
    ]),
    "one line of pages": (900, ["p1 text\fp2 text\fp3 text"], [(None, None, None, 3, "p1 text p2 text p3 text")]),
    "long line": (10, ["a" * 24, "bb"], [(None, None, None, 1, "a" * 24), (None, None, None, 1, "bb")]),
    "annex": (900, ["annex c foo, bar.", "body"], [("Annex c", None, "annex c foo, bar.", 1, "annex c foo, bar. body")]),
    "trailing feeds": (900, ["x", "\f", "\f"], [(None, None, None, 3, "x")]),
    "empty": (900, ["", "  ", "﻿"], []),
}


@pytest.mark.parametrize("name", CHUNKS)
def test_chunks(spark, name):
    most, lines, expected = CHUNKS[name]
    rows = chunking.chunk_documents(spark.createDataFrame([("\r\n".join(lines),)], "text string"), max_chars=most).orderBy("pos").collect()
    assert [(r.section, r.paragraph, r.heading, r.page, r.text) for r in rows] == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab1.A \t"), max_size=12), max_size=25))
def test_chunks_lose_no_text(spark, lines):
    rows = chunking.chunk_documents(spark.createDataFrame([("\n".join(lines),)], "text string"), max_chars=20).orderBy("pos").collect()
    assert " ".join(r.text for r in rows).split() == " ".join(lines).split()
    kept = {" ".join(l.split()) for l in lines} | {l.strip() for l in lines}
    assert all(len(r.text) <= 20 or r.text in kept for r in rows)


def test_long_and_null_texts(spark):
    lines = [f"{k} words of a line that is no heading" for k in range(30_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "x"), (4, "")], "d long, text string")
    rows = chunking.chunk_documents(docs).orderBy("d", "pos").collect()
    assert " ".join(r.text for r in rows if r.d == 1) == " ".join(lines) and all(len(r.text) <= 900 for r in rows)
    assert [(r.d, r.text) for r in rows if r.d > 1] == [(3, "x")]


def test_ids_run_across_documents(spark):
    docs = spark.createDataFrame([("s2", "b", "x"), ("s1", "z", "1A\n2B"), ("s1", "a", "1A\n2B\n3C")], "spec string, source string, text string")
    rows = chunking.with_ids(chunking.chunk_documents(docs), "spec", ["spec", "source"]).orderBy("ordinal").collect()
    assert [(r.id, r.source, r.pos) for r in rows] == [("s1-0", "a", 0), ("s1-1", "a", 1), ("s1-2", "a", 2), ("s1-3", "z", 0), ("s1-4", "z", 1), ("s2-5", "b", 0)]


@pytest.mark.parametrize(("lines", "body"), [
    (["Cover", "1Scope\t7", "Annex C (informative): Change history\t90", "", "1Scope", "Text.", "", "Annex C (informative):Change history", "row"], "1Scope\nText."),
    (["Cover", "2Refs 9", "2Refs", "x", "Change history", "y"], "2Refs\nx"),
    (["no headings"], "no headings"),
    (["Change history", "x"], ""),
])
def test_body(spark, lines, body):
    assert spark.createDataFrame([("\n".join(lines),)], "t string").select(T.extract_body(F.col("t"))).first()[0] == body


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_tokens(spark):
    text = "The AMF supports UE registration, e.g. 5G-NR étage (TS 23.501 §5.15.2)!"
    assert " ".join(one(spark, text, T.tokenize)) == "amf supports ue registration 5g nr tage ts 23 501 15"
    assert one(spark, None, T.tokenize) == []


@pytest.mark.parametrize(("coded", "plain"), [("&#65;&#x42;&amp;lt;&lt;&quot;&apos;&gt;", "AB&lt;<\"'>"), ("&#38;lt; &#x1F642; & &x; &#;", "< \U0001f642 & &x; &#;"), ("", "")])
def test_entities(spark, coded, plain):
    assert one(spark, coded, T.xml_decode) == plain


def test_trim_knows_all_white_space(spark):
    assert one(spark, " ﻿\x0b  a  b　\n", T.trim) == "a  b"


def test_versions(spark):
    rows = spark.createDataFrame([(s,) for s in ("i50", "h90", "j00", "f10", "950", "I50")], "s string").select(V.version_key(F.col("s")), V.release_of(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(23508, 18), (22356, 17), (24624, 19), (19476, 15), (11844, None), (23508, None)]
