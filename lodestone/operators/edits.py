"""Edits and diffs: hunks to lines, overlap, spans after edits, splicing texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hunk_lines(patch: DataFrame) -> DataFrame:
    """(diff, path, line): lines that the hunks of each diff (diff, line_no, text) touch in the new file.

    A ``+++`` header holds for the hunks below it. A hunk without a count has one line; one of none touches none.
    """
    down = Window.partitionBy("diff").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    path = F.last(F.when(F.col("text").rlike(r"^\+\+\+ "), F.regexp_extract("text", r"^\+\+\+ (?:b/)?(.*)$", 1)), ignorenulls=True).over(down)
    hunks = patch.withColumn("path", path).filter(F.col("text").rlike(r"^@@ "))
    start = F.regexp_extract("text", r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)", 1).cast("long")
    count = F.regexp_extract("text", r"^@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+,([0-9]+)", 1)
    n = F.when(count == "", F.lit(1)).otherwise(F.expr("try_cast(nullif(regexp_extract(text, '^@@ -[0-9]+(?:,[0-9]+)? [+][0-9]+,([0-9]+)', 1), '') as bigint)"))
    return hunks.withColumn("s", start).withColumn("n", n).filter(F.col("n") > 0).select("diff", "path", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("line"))


def numstat(rows: DataFrame) -> DataFrame:
    """(path, added, deleted) of tab-separated counts; ``-`` counts as 0 and a renaming as its new name."""
    parts = F.split("text", "\t", -1)
    path = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), r"\{[^}]* => ([^}]*)\}", "$1"), r"^.* => ", "")
    number = lambda i: F.coalesce(F.expr(f"try_cast(split(text, '\t', -1)[{i}] as bigint)"), F.lit(0))
    return rows.select(F.regexp_replace(path, "//+", "/").alias("path"), number(0).alias("added"), number(1).alias("deleted"))


def name_status(rows: DataFrame) -> DataFrame:
    """(path, status) of tab-separated lines: the first letter of the first field, and the last field, a renaming's new name."""
    parts = F.split("text", "\t", -1)
    found = rows.filter(F.trim("text") != "").select(F.replace(F.element_at(parts, -1), F.lit("\\"), F.lit("/")).alias("path"), F.substring(F.element_at(parts, 1), 1, 1).alias("status"))
    return found.filter(F.col("path") != "")


def overlaps(edits: DataFrame) -> DataFrame:
    """Edits (path, id, start_line, end_line) that begin before an earlier one of their file has ended."""
    before = Window.partitionBy("path").orderBy("start_line", "end_line", "id").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("overlaps", F.coalesce(F.max("end_line").over(before) >= F.col("start_line"), F.lit(False)))


def new_spans(edits: DataFrame) -> DataFrame:
    """Where edits (path, id, start_line, end_line, new_len) stand afterwards: shifted by what those above them add."""
    grown = F.col("new_len") - (F.col("end_line") - F.col("start_line") + 1)
    before = Window.partitionBy("path").orderBy("start_line", "id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("start_line") + F.coalesce(F.sum(grown).over(before), F.lit(0))
    return edits.withColumn("new_start", start).withColumn("new_end", F.col("new_start") + F.col("new_len") - 1)


def splice(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, text) with the line spans of ``edits`` (path, start_line, end_line, body) replaced; line ends are kept.

    ``end_line`` = ``start_line`` - 1 inserts before ``start_line``. A file whose edits overlap is refused: its text is null.
    One row for each file is built from the pieces around its edits; lines are never exploded.
    """
    e = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "body"))).alias("__edits"))
    d = texts.join(e, "path", "left").withColumn("__eol", F.when(F.col("text").contains("\r\n"), "\r\n").otherwise("\n"))
    d = d.withColumn("__lines", F.split("text", r"\r?\n", -1))
    walked = """aggregate(__edits, struct(cast(1 as bigint) as next, cast(array() as array<string>) as out, false as bad),
        (a, x) -> struct(cast(x.end_line + 1 as bigint) as next,
            concat(a.out, slice(__lines, cast(a.next as int), cast(greatest(x.start_line - a.next, 0) as int)), split(x.body, '\r?\n', -1)) as out,
            (a.bad or x.start_line < a.next or x.end_line > size(__lines)) as bad),
        a -> if(a.bad, null, array_join(concat(a.out, slice(__lines, cast(a.next as int), cast(greatest(size(__lines) - a.next + 1, 0) as int))), __eol)))"""
    return d.select("path", F.when(F.col("__edits").isNull(), F.col("text")).otherwise(F.expr(walked)).alias("text"))


def dropped_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, name) of symbols that are there no more."""
    return before.select("path", "name").subtract(after.select("path", "name"))
