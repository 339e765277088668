"""Brace depth, spans between declarations, skeletons and selectors, within one file at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def brace_depth(scanned: DataFrame, column: str = "line") -> DataFrame:
    """Lines (path, line_no, ...) with opens, closes and the depth before them, never below zero.

    The clamped sum has a closed form: with S the plain running sum, it is S less the least value that S (or 0) had so far.
    """
    opens = F.length(column) - F.length(F.replace(F.col(column), F.lit("{"), F.lit("")))
    closes = F.length(column) - F.length(F.replace(F.col(column), F.lit("}"), F.lit("")))
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = scanned.withColumn("opens", opens.cast("long")).withColumn("closes", closes.cast("long"))
    d = d.withColumn("__s", F.sum(F.col("opens") - F.col("closes")).over(upto))
    s, low = F.coalesce(F.lag("__s").over(Window.partitionBy("path").orderBy("line_no")), F.lit(0)), F.coalesce(F.min("__s").over(before), F.lit(0))
    return d.withColumn("depth", (s - F.least(F.lit(0), low)).cast("long")).drop("__s")


def widest_spans(symbols: DataFrame, listed: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` longest spans of each file: from a top-level symbol to the next, or to the file's end."""
    nxt = F.lead("line").over(Window.partitionBy("path").orderBy("line", "name"))
    spans = symbols.filter(F.coalesce(F.col("depth"), F.lit(0)) == 0).withColumn("__next", nxt).join(listed.select("path", "n_lines"), "path")
    spans = spans.select("path", "name", F.col("line").cast("long").alias("line"), (F.coalesce("__next", F.col("n_lines") + 1) - F.col("line")).cast("long").alias("span"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("span"), "line", "name"))
    return spans.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def skeleton(symbols: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, line, text): the first symbol's line of each line, its opening brace or colon cut off, with its number."""
    first = symbols.groupBy("path", "line").agg(F.min("ord").alias("ord"))
    at = first.join(scanned.select("path", F.col("line_no").alias("line"), F.col("line").alias("raw")), ["path", "line"])
    indent = F.regexp_extract("raw", r"^[ \t]*", 0)
    text = F.rtrim(F.regexp_replace(F.trim("raw"), r"[{:]\s*$", ""))
    return at.select("path", "line", F.concat(indent, text, F.lit(" … {"), F.col("line").cast("string"), F.lit("}")).alias("text"))


def next_ceiling(symbols: DataFrame) -> DataFrame:
    """(path, line, next_line): the next line of the file that declares something."""
    once = symbols.select("path", "line").distinct()
    return once.withColumn("next_line", F.lead("line").over(Window.partitionBy("path").orderBy("line")))


def selectors(scanned: DataFrame, masked: str = "line", most: int = 4) -> DataFrame:
    """(path, line_no, ord, name, kind) of style sheets: an at-rule, else up to ``most`` different class and id selectors."""
    head = F.trim(F.substring_index(F.col(masked), "{", 1))
    opened = scanned.filter(F.col(masked).contains("{")).withColumn("head", head).filter(F.col("head") != "")
    word, rest = F.regexp_extract("head", r"^@([A-Za-z-]+)", 1), F.regexp_extract("head", r"^@[A-Za-z-]+\s*(.*)$", 1)
    cond = F.substring(F.regexp_replace(F.trim(rest), r"\s+", " "), 1, 60)
    at_rule = F.trim(F.concat(F.lit("@"), word, F.lit(" "), cond))
    names = F.slice(F.array_distinct(F.regexp_extract_all("head", F.lit(r"([.#][A-Za-z_-][A-Za-z0-9_-]*)"), F.lit(1))), 1, most)
    found = opened.withColumn("__at", F.col("head").rlike("^@[A-Za-z-]+")).withColumn("__names", F.when(F.col("__at"), F.array(at_rule)).otherwise(names))
    return found.select("path", "line_no", F.posexplode("__names").alias("ord", "name"), F.when(F.col("__at"), "at-rule").otherwise("rule").alias("kind"))
