"""Documents from archives and files: ZIP members, DOCX and PDF text, and whole text files.

Files come through Spark's binaryFile and text readers; only unpacking runs in Python, in Arrow batches.  A file that can't
be read gives an error column and doesn't stop the others.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.functions import text as T
from groundsearch.functions.versions import version_of
from groundsearch.shipping import ship_package
from groundsearch.sources.pdf import read_pages

BODY = "word/document.xml"
_PARAGRAPH_END, _PARAGRAPH = "</w:p>", "<w:p"
#: Text from page strings of a PDF file's bytes.
PdfReader = Callable[[bytes], list[list[str]]]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """spec (the folder), name, path, content of each .docx and .pdf file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,pdf,DOCX,PDF,Docx,Pdf}").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("spec"), F.element_at(parts, -1).alias("name"), "path", "content")


def read_texts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """spec (the folder), version, source (the file name), text of each .txt file under path; with limit, of the first folders only."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = files.select(F.element_at(parts, -2).alias("spec"), F.element_at(parts, -1).alias("source"), F.col("value").alias("text"))
    rows = rows.select("spec", version_of(F.regexp_replace("source", r"\.txt\z", "")).alias("version"), "source", "text")
    if limit is not None:
        rows = rows.join(rows.select("spec").distinct().orderBy("spec").limit(limit), "spec", "left_semi")
    return rows


def pick_member(content: Column) -> Column:
    """The first .pdf or .docx member of a ZIP file: struct name (without folders), content, error."""

    @F.pandas_udf("struct<name:string,content:binary,error:string>")
    def pick(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    member = next((m for m in z.infolist() if not m.is_dir() and re.search(r"\.(pdf|docx)\Z", m.filename, re.I)), None)
                    rows.append((member.filename.rsplit("/", 1)[-1], z.read(member), None) if member else (None, None, "no document in the archive"))
            except Exception as e:  # noqa: BLE001  one bad archive must not stop the rest
                rows.append((None, None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["name", "content", "error"])

    return pick(content)


def _unpack_body(content: Column) -> Column:
    """The XML of a DOCX file's body, and an error."""

    @F.pandas_udf("struct<xml:string,error:string>")
    def unpack(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows.append((z.read(BODY).decode("utf-8", "replace"), None))
            except Exception as e:  # noqa: BLE001
                rows.append((None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["xml", "error"])

    return unpack(content)


def docx_text(xml: Column, paragraphs: str = "last_tag") -> Column:
    """One line for each paragraph: its text runs, decoded, with tabs and blanks collapsed.

    Tabs and breaks between runs leave nothing.  paragraphs="last_tag": a paragraph starts at the last tag before its end
    whose name starts with w:p, so text before a proofing mark or after paragraph properties within is lost or
    kept as there; "whole": at its own start tag.
    """
    ended = F.split(xml, _PARAGRAPH_END)
    parts = F.slice(ended, F.lit(1), F.size(ended) - 1)
    start = r"(?s)\A.*<w:p" if paragraphs == "last_tag" else r"(?s)\A.*?<w:p(?=[ >])"

    def line(part: Column) -> Column:
        own = F.regexp_replace(part, start, "")
        runs = F.regexp_extract_all(own, F.lit(r"<w:t\b[^>]*>([^<]*)</w:t>"), F.lit(1))
        return T.trim(F.regexp_replace(T.xml_decode(F.array_join(runs, "")), "[\t ]+", " "))

    return F.array_join(F.transform(parts, line), "\n")


def pdf_text(content: Column, reader: PdfReader) -> Column:
    """struct text, error of a PDF file: each page's strings joined by blanks and collapsed, pages joined by form feeds."""

    @F.pandas_udf("struct<text:string,error:string>")
    def read(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                rows.append(("\f".join(re.sub(r"[\t ]+", " ", " ".join(page)).strip() for page in reader(data)), None))
            except Exception as e:  # noqa: BLE001  one bad file must not stop the rest
                rows.append((None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["text", "error"])

    return read(content)


def parse_documents(files: DataFrame, reader: PdfReader = read_pages, paragraphs: str = "last_tag") -> DataFrame:
    """files (name, content and others) with text and error; what is neither .docx nor .pdf is an error."""
    ship_package(files.sparkSession)
    docx, pdf = F.col("name").rlike(r"(?i)\.docx\z"), F.col("name").rlike(r"(?i)\.pdf\z")
    some = files.filter(docx).withColumn("unpacked", _unpack_body(F.col("content")))
    some = some.withColumns({"text": docx_text(F.col("unpacked.xml"), paragraphs), "error": F.col("unpacked.error")}).drop("unpacked", "content")
    more = files.filter(pdf).withColumn("read", pdf_text(F.col("content"), reader))
    more = more.withColumns({"text": F.col("read.text"), "error": F.col("read.error")}).drop("read", "content")
    rest = files.filter(~docx & ~pdf).withColumns({"text": F.lit(None).cast("string"), "error": F.lit("unsupported file type")}).drop("content")
    return some.unionByName(more).unionByName(rest)
