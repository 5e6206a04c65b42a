"""Section-aware chunks of documents, and their ids.

Lines become an array of records by built-in functions, with headings and numbers found.  Packing them goes line by line, and
Spark's own fold copies its whole state at each: four times the time for twice the text.  So an Arrow function
packs each batch of documents in time that grows with their lines.  A document is independent of all others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundsearch.functions import text as T
from groundsearch.shared import shared_dir

MAX_CHARS = 900
CHUNK = "struct<section:string,paragraph:string,heading:string,page:int,text:string>"


def lines_of(c: Column) -> Column:
    """Records (feeds, line) of a text's lines: form feeds in it, and the line trimmed without them."""
    raw = F.split(F.replace(c, F.lit("\u00a0"), F.lit(" ")), r"\r?\n", -1)
    return F.transform(raw, lambda r: F.struct(
        (F.length(r) - F.length(F.replace(r, F.lit("\f"), F.lit("")))).alias("feeds"), T.trim(F.replace(r, F.lit("\f"), F.lit(" "))).alias("line")
    ))


def heading_flags(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line: df's other columns, pos, feeds, line, is_heading, section, heading, paragraph."""
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(*rest, F.posexplode(lines_of(F.col(text_col))).alias("pos", "l")).select(*rest, "pos", "l.feeds", "l.line")
    line, is_heading = F.col("line"), T.is_heading(F.col("line"))
    return rows.withColumns({
        "is_heading": is_heading, "section": F.when(is_heading, T.section_of(line)), "heading": F.when(is_heading, T.collapse(line)),
        "paragraph": F.when(~is_heading, T.paragraph_of(line)),
    })


def page_numbers(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, pos, page of each line: one more than the form feeds up to and in it."""
    up_to = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return heading_flags(df.select(id_col, text_col), text_col).select(id_col, "pos", (F.sum("feeds").over(up_to) + 1).cast("int").alias("page"))


def chunks_of(c: Column, max_chars: int = MAX_CHARS) -> Column:
    """An array of chunk records.

    A heading starts a section and a chunk.  A line that would make the chunk longer than max_chars starts another one, and the chunk
    before it ends with that line's paragraph number and page.  A longer line is a chunk by itself.
    """
    flagged = F.transform(F.filter(lines_of(c), lambda l: (l["line"] != "") | (l["feeds"] > 0)), lambda l: F.struct(
        l["feeds"].alias("feeds"), l["line"].alias("line"), T.is_heading(l["line"]).alias("head"),
        T.section_of(l["line"]).alias("section"), T.collapse(l["line"]).alias("heading"), T.paragraph_of(l["line"]).alias("paragraph"),
    ))

    @F.arrow_udf(f"array<{CHUNK}>")
    def pack(lists: pa.Array) -> pa.Array:
        records = lists.flatten()
        lines = list(zip(*(records.field(i).to_pylist() for i in range(6)), strict=True))
        sizes = [0 if n is None else n for n in lists.value_lengths().to_pylist()]
        columns, ends, at = ([], [], [], [], []), [0], 0
        for size in sizes:
            text, section, paragraph, heading, page = "", None, None, None, 1

            def close(paragraph):
                for column, value in zip(columns, (section, paragraph, heading, page, text), strict=True):  # noqa: B023
                    column.append(value)

            for feeds, line, head, own_section, own_heading, number in lines[at : at + size]:
                page += feeds
                if not head and number is not None:
                    paragraph = number
                if text and line and (head or len(text) + 1 + len(line) > max_chars):
                    close(paragraph)
                    text = ""
                if head:
                    text, section, paragraph, heading = own_heading, own_section, None, own_heading
                elif line:
                    text = f"{text} {line}" if text else line
            if text:
                close(paragraph)
            at += size
            ends.append(len(columns[0]))
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
        chunks = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["section", "paragraph", "heading", "page", "text"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)

    return pack(flagged)


def chunk_documents(df: DataFrame, text_col: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per chunk: df's other columns, pos (from 0), section, paragraph, heading, page, text."""
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(*rest, F.posexplode(chunks_of(F.col(text_col), max_chars)).alias("pos", "c"))
    return rows.select(*rest, "pos", "c.section", "c.paragraph", "c.heading", "c.page", "c.text")


def with_ids(chunks: DataFrame, spec_col: str, order: list[str]) -> DataFrame:
    """Chunks with ordinal, their place from 0 in the order of the documents (order) and of pos, and id, `spec-ordinal`.

    Documents' chunk counts are sorted by range and checkpointed, which fixes who is in which partition; they are summed within
    partitions, and only the partitions' totals in one window.  Chunks stay where they are.
    """
    shared_dir(chunks.sparkSession)
    counts = chunks.groupBy(*order).agg(F.count(F.lit(1)).alias("n")).orderBy(*order)
    counts = counts.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).checkpoint()
    totals = counts.groupBy("part").agg(F.sum("n").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("of_parts"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("inside", F.sum("n").over(inside) - F.col("n"))
    shift = counts.join(totals, "part").select(*order, (F.col("of_parts") + F.col("inside")).alias("shift"))
    ordinal = (F.col("shift") + F.col("pos")).cast("long")
    placed = chunks.join(shift, order).withColumn("ordinal", ordinal).drop("shift")
    return placed.withColumn("id", F.concat(F.col(spec_col), F.lit("-"), F.col("ordinal").cast("string")))


def stored(chunks: DataFrame) -> DataFrame:
    """Null section, paragraph and heading as empty strings."""
    return chunks.withColumns({c: F.coalesce(c, F.lit("")) for c in ("section", "paragraph", "heading")})
