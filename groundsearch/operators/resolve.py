"""Version resolution: archive listings, the latest version of each document, and what is still to be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundsearch.functions import versions as V

CATALOG_SCHEMA = "release int, specs array<struct<number:string,title:string>>"


def catalog_rows(catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """release, pos, number, title of a catalog's documents; with limit, its first ones."""
    rows = catalog.select("release", F.posexplode("specs").alias("pos", "s")).select("release", "pos", "s.number", "s.title")
    return rows if limit is None else rows.filter(F.col("pos") < limit)


def parse_listings(listings: DataFrame) -> DataFrame:
    """number, pos, url, filename, suffix, key, release of each archive link in listings (number, html)."""
    name = F.regexp_replace(V.compact(F.col("number")), r"([^0-9A-Za-z])", r"\\$1")
    pattern = F.concat(F.lit('(?i)href="([^"]+?/'), name, F.lit(r'-([0-9a-z]{3})\.zip)"'))
    links = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("url"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("suffix"))
    rows = listings.select("number", F.posexplode(links).alias("pos", "f")).select("number", "pos", "f.url", "f.suffix")
    return rows.select(
        "number", "pos", "url", F.concat(V.compact(F.col("number")), F.lit("-"), "suffix", F.lit(".zip")).alias("filename"), "suffix",
        V.version_key(F.col("suffix")).alias("key"), V.release_of(F.col("suffix")).alias("release"),
    )


def pick_best(files: DataFrame, release: int | None = None) -> DataFrame:
    """The file with the greatest key for each number, the first of equal ones; with release, among its files only."""
    if release is not None:
        files = files.filter(F.col("release") == release)
    by = Window.partitionBy("number").orderBy(F.col("key").desc(), "pos")
    return files.withColumn("place", F.row_number().over(by)).filter("place = 1").drop("place")


def missing(best: DataFrame, present: DataFrame) -> DataFrame:
    """Files that aren't among present (number, suffix)."""
    return best.join(present, ["number", "suffix"], "left_anti")
