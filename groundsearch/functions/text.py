"""Column functions over text: trimming, tokens, headings, sections, body extraction, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a result must agree on.
#: White space as ECMAScript's \s and trim() know it.
SPACE = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
STOP_WORDS = (
    "a an the of for and or to in on with is are as by at from that this these those "
    "it its be been being was were can could shall should may might will would must not "
    "no per such which whose when where than then also between within without using used "
    "use based according following defined figure table clause annex section subclause "
    "supporting supported provide provides provisioning via vs e.g i.e i.e."
).split()
TOKEN = "[a-z0-9]+"
NUMBER = r"[0-9]+(?:\.[0-9]+){0,3}[a-z]?"
NUMBERED_HEADING = rf"^({NUMBER}){SPACE}*[A-Z]"
ANNEX_HEADING = rf"(?i)^Annex{SPACE}+([A-Z])\b"
NUMBERED_PARAGRAPH = rf"^([0-9]+(?:\.[0-9]+){{1,3}}){SPACE}"
SCOPE_LINE = rf"^1{SPACE}*Scope\b"
CHANGE_ANNEX = rf"(?i)^Annex{SPACE}+[A-Z][^\n]*change{SPACE}*history"
CHANGE_HEADING = r"(?i)^Change history"
MAX_HEADING = 90
NAMED_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def trim(c: Column) -> Column:
    """Both ends without any of SPACE."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def found(c: Column, pattern: str) -> Column:
    """The first group of pattern in c, or null."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def words(c: Column) -> Column:
    """Lower-case ASCII words of two characters or more, stop words among them."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def is_stop_word(word: Column) -> Column:
    """A search in a hash set: Spark makes one of so long a list."""
    return word.isin(*STOP_WORDS)


def tokenize(c: Column) -> Column:
    """words() that aren't stop words."""
    return F.filter(words(c), lambda w: ~is_stop_word(w))


def is_heading(line: Column) -> Column:
    """Whether a trimmed line is a heading: an annex, or a short unpunctuated line that starts with a number and a capital."""
    plain = line.rlike(NUMBERED_HEADING) & (F.length(line) <= MAX_HEADING) & ~line.rlike(r"[.;,:]\z")
    return line.rlike(ANNEX_HEADING) | plain


def section_of(heading: Column) -> Column:
    """`Annex X`, or the leading number."""
    return F.coalesce(F.concat(F.lit("Annex "), found(heading, rf"(?i)^Annex{SPACE}+([A-Z])")), found(heading, f"^({NUMBER})"))


def paragraph_of(line: Column) -> Column:
    """The number of a numbered paragraph, or null."""
    return found(line, NUMBERED_PARAGRAPH)


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def body_lines(c: Column) -> Column:
    return F.transform(F.split(c, r"\r?\n", -1), trim)


def extract_body(c: Column) -> Column:
    """The text between the front matter and the change history, without blank lines.

    It starts at the first scope line that doesn't end in a page number, else at such a numbered line, else at the top; it ends
    before the first change history annex from there on, else before such a heading.
    """

    def in_lines(lines: Column) -> Column:
        first = lambda test: F.nullif(F.array_position(F.transform(lines, test), True), F.lit(0))
        unpaged = lambda x: ~x.rlike(r"[0-9]\z")
        start = F.coalesce(first(lambda x: x.rlike(SCOPE_LINE) & unpaged(x)), first(lambda x: x.rlike(NUMBERED_HEADING) & unpaged(x)), F.lit(1))

        def from_start(start: Column) -> Column:
            after = lambda pattern: first(lambda x, i: (i + 1 >= start) & x.rlike(pattern))
            end = F.coalesce(after(CHANGE_ANNEX), after(CHANGE_HEADING), F.size(lines) + 1)
            body = F.slice(lines, start.cast("int"), (end - start).cast("int"))
            return F.array_join(F.filter(body, lambda x: x != ""), "\n")

        return F.transform(F.array(start), from_start)[0]

    return F.transform(F.array(body_lines(c)), in_lines)[0]


def _code_points(c: Column, pattern: str, base: int) -> Column:
    """c with each reference of pattern (whose group is a number in base) as its character."""
    parts = F.regexp_extract_all(c, F.lit(rf"(?s){pattern}|[^&]+|&"), F.lit(0))

    def one(part: Column) -> Column:
        number = F.conv(F.regexp_extract(part, pattern, 1), base, 16)
        return F.when(part.rlike(pattern), F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def xml_decode(c: Column) -> Column:
    """Decimal references, then hexadecimal ones, then the five named entities."""
    c = _code_points(_code_points(c, "&#([0-9]+);", 10), "&#[xX]([0-9a-fA-F]+);", 16)
    # One pass over the named ones: what an ampersand leaves must not be decoded again.
    parts = F.regexp_extract_all(c, F.lit("(?s)&(?:amp|lt|gt|quot|apos);|[^&]+|&"), F.lit(0))
    names = F.create_map(*(F.lit(x) for pair in (*NAMED_ENTITIES, ("&amp;", "&")) for x in pair))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(names, p), p)), "")
