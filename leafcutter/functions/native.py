"""Text predicates and transforms as column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trim_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def collapse(c: Column) -> Column:
    return trim_ascii(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def without_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?(?:-->|\z)", "")


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\u001b\\[[^@-~]*[@-~]?", "")


def without_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"\A---\n(?s:.*?)\n---\n+", "")


def sentences(c: Column) -> Column:
    parts = F.transform(F.split(c, r"(?<=[.!?])(?=[ \t\n\r])"), trim_ascii)
    return F.filter(parts, lambda s: s != "")


def keywords(c: Column) -> Column:
    stop = F.array(*map(F.lit, sorted(T.STOPWORDS)))
    words = F.filter(F.split(ascii_lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    return F.array_except(F.array_distinct(words), stop)


def starts_with_any(c: Column, openings: tuple[str, ...]) -> Column:
    start = ascii_lower(F.substring(c, 1, 24))
    out = F.lit(False)
    for o in openings:
        out = out | start.startswith(o)
    return out


def prose_kind(c: Column) -> Column:
    n = F.octet_length(c)
    return F.when(n > 900, "long_single_paragraph").when(n < 90, "short_disconnected_paragraph").otherwise("plain_paragraph")


def is_list_item(c: Column) -> Column:
    return c.rlike(r"^(?:[-*+] |\[[xX ]\]|[0-9]{1,3}[.)].|[A-Za-z][.)].)")


def is_underline(c: Column) -> Column:
    return c.rlike("^(?:={4,}|-{4,})$")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def column_number(c: Column) -> Column:
    """0-based number of a column's letters."""
    letters = F.filter(F.split(F.upper(c), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def delimiter(line: Column) -> Column:
    """The most frequent of ``, tab ; |`` outside quotes, the first among equals."""
    bare = F.regexp_replace(line, '"(?:[^"]|"")*"', "")
    counts = [F.length(bare) - F.length(F.replace(bare, F.lit(x), F.lit(""))) for x in (",", "\t", ";", "|")]
    top = F.greatest(*counts)
    return F.when(counts[0] == top, ",").when(counts[1] == top, "\t").when(counts[2] == top, ";").otherwise("|")


def signal(c: Column) -> Column:
    """The reason for which a paragraph's opening continues, breaks or says nothing."""
    return (
        F.when(starts_with_any(c, T.TRANSITION_BREAKS), "break")
        .when(starts_with_any(c, T.REFERENCE_STARTS), "reference_continuity")
        .when(starts_with_any(c, T.ELABORATION_STARTS), "elaboration")
        .when(starts_with_any(c, T.EXAMPLE_STARTS), "example")
        .when(starts_with_any(c, T.CAUSE_EFFECT_STARTS), "cause_effect")
        .when(starts_with_any(c, T.CONTRAST_CONTINUATION), "contrast_continuation")
        .otherwise("none")
    )
