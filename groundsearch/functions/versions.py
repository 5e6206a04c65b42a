"""Column functions over document numbers and version suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The archive's root and the letters of its releases.
ARCHIVE_ROOT = "https://www.3gpp.org/ftp/Specs/archive"
RELEASES = {"f": 15, "g": 16, "h": 17, "i": 18, "j": 19, "k": 20}


def series_of(number: Column) -> Column:
    return F.concat(F.substring_index(number, ".", 1), F.lit("_series"))


def folder_url(number: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_ROOT + "/"), series_of(number), F.lit("/"), number, F.lit("/"))


def file_url(number: Column, name: Column) -> Column:
    return F.concat(folder_url(number), name)


def compact(number: Column) -> Column:
    """Without its first dot."""
    return F.regexp_replace(number, r"^([^.]*)\.", "$1")


def version_key(suffix: Column) -> Column:
    """The suffix as a number to base 36."""
    return F.conv(suffix, 36, 10).cast("int")


def release_of(suffix: Column) -> Column:
    """The release that the suffix's first letter stands for, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in RELEASES.items() for x in pair)), F.substring(suffix, 1, 1))


def version_of(stem: Column) -> Column:
    """The last three characters of a file's stem."""
    return F.right(stem, F.lit(3))
