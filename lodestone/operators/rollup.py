"""Roll-ups of a corpus by directory and extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import MARKUP_EXTENSIONS, directory_key, extension, under


def by_directory(listed: DataFrame, depth: int) -> DataFrame:
    """Files, lines and symbols (0 where ``listed`` has no n_symbols) for each directory key."""
    symbols = F.col("n_symbols") if "n_symbols" in listed.columns else F.lit(0)
    return listed.groupBy(directory_key(F.col("path"), depth).alias("directory")).agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum(symbols).alias("n_symbols"))


def drill_down(listed: DataFrame, prefix: str, n: int = 20) -> DataFrame:
    """The ``n`` longest files under a prefix, each with the totals of all of them."""
    inside = listed.filter(under(F.col("path"), prefix))
    totals = inside.agg(F.count("*").alias("total_files"), F.sum("n_lines").alias("total_lines"))
    top = inside.select("path", "n_lines").orderBy(F.desc("n_lines"), "path").limit(n)
    return top.select("path", "n_lines", *[totals.select(c).scalar().alias(c) for c in totals.columns])


def extension_mix(paths: DataFrame, n: int = 5) -> DataFrame:
    counts = paths.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "extension").limit(n)


def markup_share(paths: DataFrame, threshold: float = 0.2) -> DataFrame:
    """One row: files, markup files, their share, and whether it is that of a visual project."""
    s = paths.agg(F.count("*").alias("n_files"), F.count_if(extension(F.col("path")).isin(*MARKUP_EXTENSIONS)).alias("n_markup"))
    share = F.col("n_markup") / F.col("n_files")
    return s.select("n_files", "n_markup", F.round(share, 6).alias("share"), (share >= threshold).alias("visual"))


def empty_rate(rows: DataFrame, by: str, is_empty: Column, least: int = 3, marks: tuple[float, float] = (0.25, 0.5)) -> DataFrame:
    """Per group of at least ``least`` rows: rows, empty ones, their rate, and 0, 1 or 2 for the marks it reaches."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(is_empty).alias("n_empty")).filter(F.col("n") >= least)
    rate = F.col("n_empty") / F.col("n")
    return g.select(by, "n", "n_empty", F.round(rate, 6).alias("rate"), ((rate >= marks[0]).cast("int") + (rate >= marks[1]).cast("int")).cast("long").alias("flag"))
