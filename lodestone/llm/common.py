"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import keep, release

#: Rows and bytes in one Arrow batch of whole texts: what a Python worker holds at once, however long the texts are.
TEXT_ROWS, TEXT_BYTES = 256, "16m"

#: What stands for a null document id inside an operator.
NO_ID = -(2**63)


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, since a row can be a whole text of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)


@contextmanager
def number_batches(spark: SparkSession, rows: int = 65536) -> Iterator[None]:
    """Around a write: let Arrow batches hold many rows of a few numbers each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether the CRC-32 of the id, as text, leaves 2 when divided by 4; false for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts, null read as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(rows: dict[str, list], schema: pa.Schema, size: int = 20000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows from columns of equal length."""
    n = len(next(iter(rows.values())))
    for at in range(0, n, size):
        yield pa.record_batch([pa.array(rows[f.name][at : at + size], f.type) for f in schema], schema=schema)


def bounded_sample(rows: DataFrame, by: str, per_value: int, most_chars: int) -> list[tuple]:
    """At most ``per_value`` (by, key, text) rows for each value of ``by``, chosen by a hash of the key: always the same ones.

    Args:
        rows: has the columns ``by``, ``key`` (of a key that repeats, the least text counts) and ``text``. Values of ``by`` are
            few (languages, labels).
        most_chars: of all texts of a value together; the first that does not fit ends its sample. Texts are never cut.

    The share of hashes that is looked at comes from the number of different keys, so a key that repeats a billion times is one
    row, and what is sorted, written and collected does not grow with the table.
    """
    hashed = rows.select(by, "key", "text", F.xxhash64("key").alias("h"))
    few = keep(hashed.groupBy(by).agg(F.approx_count_distinct("h").alias("n")), "sample-counts").collect()
    near = F.lit(False)
    for r in few:
        reach = min(1.0, 3 * (per_value + 30) / max(r["n"], 1))  # a few times as many as are wanted
        near = near | (F.col(by).eqNullSafe(F.lit(r[by])) & (F.col("h") <= F.lit(int(-(2**63) + reach * (2**64 - 1)) if reach < 1 else 2**63 - 1)))
    one = keep(hashed.filter(near).groupBy(by, "key", "h").agg(F.min("text").alias("text")), "sample")
    chosen: list[tuple] = []
    for value in sorted((r[by] for r in few), key=str):
        size = 0
        of_value = one.filter(F.col(by).eqNullSafe(F.lit(value)))
        ends = of_value.select("h", F.length("text").alias("n")).orderBy("h", "n").limit(per_value).collect()
        hashes = []
        for r in ends:
            size += r["n"] or 0
            if size > most_chars:
                break
            hashes.append(r["h"])
        if hashes:
            found = of_value.filter(F.col("h") <= hashes[-1]).orderBy("h", F.length("text")).limit(len(hashes)).collect()
            chosen += [(r[by], r["key"], r["text"]) for r in found]
    release(one)
    return chosen
