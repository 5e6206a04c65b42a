"""Corpora derived from the tables, for operators whose input the tables don't hold: the same in Spark and in SQL."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.functions import vectors
from groundsearch.functions.text import tokenize
from groundsearch.shipping import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def specification_lines(docs: DataFrame) -> DataFrame:
    """documents with headings, numbered paragraphs and form feeds among their lines."""
    def line(l, i):
        number = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("."), F.floor(i / 7 + 1).cast("string"))
        body = F.when(i % 7 == 0, F.concat(number, F.lit("Section title "), F.char(65 + i % 26))).when(i % 7 == 3, F.concat(number, F.lit(".1 "), l)).otherwise(l)
        return F.concat(F.when(i % 11 == 10, F.lit("\f")).otherwise(F.lit("")), body)

    return docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"))


def framed_lines(docs: DataFrame) -> DataFrame:
    """The same with front matter and, in each tenth one, a change history."""
    end = F.when(F.col("doc_id") % 10 == 0, F.lit("\nAnnex B (informative): Change history\nlast row")).otherwise(F.lit(""))
    return specification_lines(docs).withColumn("text", F.concat(F.lit("Cover\n1Scope\t7\n1Scope\n"), "text", end))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks with sections and hash vectors; some have no section or heading."""
    d = F.col("doc_id")
    section = F.when(d % 10 == 0, "").otherwise(F.concat((d % 9 + 1).cast("string"), F.lit("."), (d % 4 + 1).cast("string")))
    heading = F.when(d % 5 == 0, "").otherwise(F.concat(F.lit("Topic "), (d % 7).cast("string")))
    rows = table(spark, sf_dir, "documents").select(d.alias("id"), F.col("source").alias("spec"), section.alias("section"), heading.alias("heading"), "text")
    ship_package(spark)
    return rows.withColumn("vector", vectors.embed(tokenize(F.col("text"))))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def own_parameters(queries: DataFrame) -> DataFrame:
    q = F.col("query_id")
    return queries.withColumns({
        "top_k": (1 + q % 6).cast("int"), "threshold": (q % 5) / F.lit(10.0), "keyword_weight": (q % 4) / F.lit(4.0), "candidates": (5 + q % 20).cast("int"),
    })


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers, some with refusals or section references."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    ends = F.array(*map(F.lit, (" No information here.", " Per §5.2.1, yes.", " See §9.9.9", " Per §5.2.1.", "")))
    return rows.select("conv_id", "turn", F.concat("text", F.element_at(ends, (F.col("conv_id") % 5 + 1).cast("int"))).alias("answer"))


def streamed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("answer"), F.array("role").alias("citations"), F.col("turn").alias("discarded"))


def archives(docs: DataFrame) -> DataFrame:
    """A ZIP file for each document, with a folder, a note and, except in each seventh, two documents."""
    ship_package(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
                    z.writestr("folder.docx/", "")
                    z.writestr("notes.txt", "docx")
                    if i % 7:
                        z.writestr(f"folder.docx/{i}.{'PDF' if i % 2 else 'docx'}", text or "")
                        z.writestr("second.docx", "second")
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    return docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, content binary")


def word_files(docs: DataFrame) -> DataFrame:
    """A DOCX file for each document: a paragraph for each line, in two runs with a tab between."""
    ship_package(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                halves = [(l[: len(l) // 2], l[len(l) // 2 :]) for l in (text or "").split("\n")]
                body = "".join(f'<w:p w:id="1"><w:r><w:t>{escape(a)}</w:t><w:tab/><w:t xml:space="preserve">{escape(b)}</w:t></w:r></w:p>' for a, b in halves)
                with zipfile.ZipFile(buffer := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
                out.append(buffer.getvalue())
            names = pa.array([f"{i}.docx" for i in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(out, pa.binary())], ["doc_id", "name", "content"])

    return docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, name string, content binary")


def page_files(docs: DataFrame) -> DataFrame:
    """A PDF file for each document: each line of its text is a page, shown in two strings; every other file is compressed."""
    ship_package(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pdf_file(text or "", bool(i % 2)) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            names = pa.array([f"{i}.pdf" for i in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(out, pa.binary())], ["doc_id", "name", "content"])

    return docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, name string, content binary")


def pdf_file(text: str, packed: bool) -> bytes:
    """A file of one font whose two-byte codes are UTF-16 units."""
    lines = text.split("\n")
    cmap = b"1 beginbfrange\n<0000> <FFFF> <0000>\nendbfrange"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /ToUnicode 4 0 R >>", 4: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)}
    pages = range(5, 5 + 2 * len(lines), 2)
    objects[2] = b"<< /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Kids [%s] >>" % b" ".join(b"%d 0 R" % p for p in pages)
    for p, line in zip(pages, lines, strict=True):
        halves = (line[: len(line) // 2], line[len(line) // 2 :])
        content = b"BT /F1 9 Tf " + b" ".join(b"[<%s> -10 <%s>] TJ" % (x[: len(x) // 2].encode("utf-16-be").hex().encode(), x[len(x) // 2 :].encode("utf-16-be").hex().encode()) for x in halves) + b" ET"
        coded = zlib.compress(content) if packed else content
        objects[p] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (p + 1)
        objects[p + 1] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(coded), b"/Filter /FlateDecode" if packed else b"", coded)
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"
