"""Text functions with the same meaning in every engine: ASCII word characters, full trims, token splits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query does not count (fixed values).
STOP_WORDS = ("the", "a", "an", "of", "to", "in", "that", "this", "for", "and", "or", "with", "on")

WORD_CHARACTER = "[A-Za-z0-9_]"


def quoted(literal: str) -> str:
    """A regular expression that matches a literal, for Java and RE2 alike."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", literal)


def whole_word(name: str) -> str:
    """``name`` between ASCII word boundaries. Java's own ``\\b`` also counts accented letters."""
    edge = f"(?:(?<={WORD_CHARACTER})(?!{WORD_CHARACTER})|(?<!{WORD_CHARACTER})(?={WORD_CHARACTER}))"
    return edge + quoted(name) + edge


def trimmed(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, r"\s+", " ")


def lines_of(text: Column) -> Column:
    """Lines of a text; a final line feed leaves an empty last line."""
    return F.split(text, r"\r?\n", -1)


def terms(text: Column) -> Column:
    """Lower-cased word pieces of an identifier, path or text: two characters or more, without stop words."""
    pieces = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.]", " ")
    return F.filter(F.split(F.lower(pieces), "[^a-z0-9]+", -1), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def subsequence(text: Column, query: str) -> Column:
    """Whether the characters of ``query`` occur in ``text`` in this order."""
    return text.rlike("(?s)" + ".*".join(quoted(c) for c in query))


def caret(column: Column, width: Column, lead: int = 0) -> Column:
    """A line of carets under ``width`` characters from the 1-based ``column`` on."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), column - 1 - lead).cast("int")), F.repeat(F.lit("^"), F.greatest(F.lit(1), width).cast("int")))


def literal_hits(line: Column, literal: str) -> Column:
    """1-based columns of the non-overlapping occurrences of ``literal`` in a line, as an array."""
    pieces = F.split(line, quoted(literal), -1)
    width = len(literal)
    # A hit ends every piece but the last; its column follows from the lengths of the pieces before.
    ends = F.aggregate(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("hits")),
        lambda acc, piece: F.struct((acc["at"] + F.length(piece) + width).alias("at"), F.concat(acc["hits"], F.array((acc["at"] + F.length(piece)).cast("int"))).alias("hits")),
    )
    return ends["hits"]


def pattern_hits(line: Column, pattern: str) -> Column:
    """(col, text) of the non-overlapping matches of a pattern that never matches the empty string."""
    found = F.regexp_extract_all(line, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(line, pattern, -1)
    walked = F.aggregate(
        F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("before"), found.alias("hit")),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<col:int,text:string>>").alias("hits")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["before"]) + F.length(x["hit"])).alias("at"),
            F.concat(acc["hits"], F.array(F.struct((acc["at"] + F.length(x["before"])).cast("int").alias("col"), x["hit"].alias("text")))).alias("hits"),
        ),
    )
    return walked["hits"]
