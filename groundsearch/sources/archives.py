"""Archives of documents: listings, the latest version of each document, downloads.

What goes wrong with one document is an error in its row and doesn't stop the others.  Each row is fetched in a task of its
partition; contents are rows, so saving them is writing the table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsearch.functions import versions as V
from groundsearch.functions.clients import Fetch
from groundsearch.functions.vectors import retried
from groundsearch.operators import resolve
from groundsearch.shipping import ship_package
from groundsearch.sources.documents import pick_member


def fetched(url: Column, fetch: Fetch) -> Column:
    """struct content, error of a URL column; null URLs give neither."""

    @F.pandas_udf("struct<content:binary,error:string>")
    def get(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for address in urls:
            try:
                rows.append((retried(lambda: fetch(address)), None) if address else (None, None))  # noqa: B023
            except Exception as e:  # noqa: BLE001  one document must not stop the rest
                rows.append((None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["content", "error"])

    return get(url)


def listings(specs: DataFrame, fetch: Fetch) -> DataFrame:
    """number, html, error of the archive folder of each of specs (number)."""
    ship_package(specs.sparkSession)
    rows = specs.select("number", fetched(V.folder_url(F.col("number")), fetch).alias("got"))
    return rows.select("number", F.decode("got.content", "UTF-8").alias("html"), "got.error")


def download(specs: DataFrame, fetch: Fetch, release: int | None = None, present: DataFrame | None = None) -> DataFrame:
    """One row for each of specs (number): number, suffix, filename, name and content of the document in the latest archive, status, error.

    status: `saved`; `present` where the version is among present (number, suffix), which is not fetched; `failed` with an error.
    """
    listed = listings(specs, fetch)
    best = resolve.pick_best(resolve.parse_listings(listed.filter("html is not null").select("number", "html")), release)
    rows = listed.select("number", F.col("error").alias("listing_error")).join(best.select("number", "suffix", "filename", "url"), "number", "left")
    have = F.lit(False)
    if present is not None:
        rows = rows.join(present.select("number", "suffix", F.lit(True).alias("have")), ["number", "suffix"], "left")
        have = F.coalesce("have", F.lit(False))
    address = F.when(~have & F.col("filename").isNotNull(), V.file_url(F.col("number"), F.col("filename")))
    rows = rows.withColumn("is_present", have).withColumn("got", fetched(address, fetch))
    rows = rows.withColumn("member", F.when(F.col("got.content").isNotNull(), pick_member(F.coalesce("got.content", F.lit(b"")))))
    none = F.when(F.col("filename").isNull() & F.col("listing_error").isNull(), "no archive in the listing")
    error = F.when(~F.col("is_present"), F.coalesce("listing_error", none, "got.error", "member.error"))
    status = F.when(F.col("is_present"), "present").when(F.col("member.content").isNotNull(), "saved").otherwise("failed")
    return rows.select("number", "suffix", "filename", F.col("member.name").alias("name"), F.col("member.content").alias("content"), status.alias("status"), error.alias("error"))
