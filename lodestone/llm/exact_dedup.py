"""Exact dedup: groups by a 128-bit content hash, one row of each group stays, and bytes are compared inside groups.

Only DataFrame functions. A row of some 70 bytes (hash, length, id) stands for each document. A second scan compares the texts
of groups of two or more: the least and the greatest text of a group are aggregated before the shuffle, so each task sends
two texts of a group, however many copies it holds. Where they differ the hash has collided, and the rows of that hash are grouped
by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import broadcast_if_small, keep, release

#: What is deleted before texts are compared.
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """A text without the characters of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def content_hash(sha: Column) -> Column:
    """128 bits: the first half of a SHA-256."""
    return F.substring(sha, 1, 16)


def _stays(rows: DataFrame, by: str) -> DataFrame:
    """(by, n_rows, first) of each group: of its longest texts the one with the smallest id, and its row."""
    # An absent id comes after all others; the row number decides between rows of one id.
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), F.min(order).alias("first"))


def _marked(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    met = rows.join(groups, by, "left")
    alone = F.col("n_rows").isNull()
    return met.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n_rows", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are equal if they are the same without white space. Of equal texts the row with the most code points stays, then the one
    with the smallest doc_id; a null doc_id comes last. Exactly one row of a group is kept, also of rows that repeat an id. A null
    text is empty, and empty texts are equal. Texts are read whole, of any length; no rows give no rows.

    Args:
        hashed: the key of a group, from the SHA-256 of its text.
    """
    text = normalised(F.col("text"))
    # The row number tells repeated rows apart; it is written, so it does not change when a task runs again.
    read = docs.select(F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.unhex(F.sha2(text, 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    rows = keep(read.withColumn("h", hashed(F.col("sha"))), "exact-rows")
    groups = keep(_stays(rows, "h").filter(F.col("n_rows") > 1), "exact-groups")
    several = broadcast_if_small(groups.select("h"))

    # Bytes: the least and the greatest text of a group are one, or the hash has collided.
    again = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("h", hashed(F.col("sha")))
    differ = again.join(several, "h", "left_semi").groupBy("h").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter(F.col("least") != F.col("most"))
    collided = keep(differ.select("h"), "exact-collisions")
    if collided.isEmpty():
        release(collided)
        return _marked(rows, broadcast_if_small(groups), "h")
    few = broadcast_if_small(collided)
    mixed = keep(again.join(few, "h", "left_semi").select(F.col("doc_id").alias("id"), F.length("raw").cast("long").alias("n"), "sha", "text", F.monotonically_increasing_id().alias("row")), "exact-mixed")
    by_text = _stays(mixed, "text").filter(F.col("n_rows") > 1)
    return _marked(rows.join(few, "h", "left_anti"), groups.join(few, "h", "left_anti"), "h").unionByName(_marked(mixed, by_text, "text"))


def drop_duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The ids that stay: (doc_id) of the kept row of each group of equal texts."""
    return exact_duplicates(docs, hashed).filter("kept").select("doc_id")
