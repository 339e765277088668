"""Files and lines of a corpus, and what changed between two scans of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import under
from lodestone.functions.text import lines_of


def files(texts: DataFrame) -> DataFrame:
    """(path, text) rows with size, number of lines and content hash."""
    return texts.select("path", F.length("text").cast("long").alias("size"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.sha2("text", 256).alias("content_hash"))


def lines(texts: DataFrame) -> DataFrame:
    """(path, line_no, line), lines counted from 1. A map: nothing is shuffled."""
    return texts.select("path", F.posexplode(lines_of(F.col("text"))).alias("at", "line")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def read_range(texts: DataFrame, start: int, end: int) -> DataFrame:
    """Lines ``start`` to ``end`` of each file, clamped to what it has; sliced before they are exploded."""
    first = max(1, start)
    part = F.slice(lines_of(F.col("text")), first, max(0, end - first + 1))
    return texts.select("path", F.posexplode(part).alias("at", "line")).select("path", (F.col("at") + first).cast("long").alias("line_no"), "line")


def refresh(scan: DataFrame, prior: DataFrame) -> DataFrame:
    """(path, action) from the current and the prior (path, mtime, content_hash): one full outer join by path.

    Actions: ``reused`` (same mtime), ``touched`` (other mtime, same hash), ``changed`` (other hash), ``new``, ``removed``.
    """
    s, p = scan.alias("s"), prior.alias("p")
    action = (
        F.when(F.col("p.path").isNull(), "new")
        .when(F.col("s.path").isNull(), "removed")
        .when(F.col("s.mtime") == F.col("p.mtime"), "reused")
        .when(F.col("s.content_hash") == F.col("p.content_hash"), "touched")
        .otherwise("changed")
    )
    return s.join(p, F.col("s.path") == F.col("p.path"), "full_outer").select(F.coalesce("s.path", "p.path").alias("path"), action.alias("action"))


def changed_paths(scan: DataFrame, prior: DataFrame) -> DataFrame:
    """Paths known before whose content differs; new files and new times alone do not count."""
    return refresh(scan, prior).filter(F.col("action") == "changed").select("path")


def removed_paths(scan: DataFrame, prior: DataFrame) -> DataFrame:
    return prior.select("path").join(scan.select("path"), "path", "left_anti")


def stale_paths(scan: DataFrame, indexed: DataFrame, slack_ms: int = 1) -> DataFrame:
    """Indexed paths whose file is newer than the index by more than ``slack_ms``; a missing file is not stale."""
    i = indexed.select("path", F.col("mtime").alias("known"))
    return scan.join(i, "path").filter(F.unix_millis("mtime") > F.unix_millis("known") + slack_ms).select("path")


def drifted_paths(scan: DataFrame, indexed: DataFrame) -> DataFrame:
    """Indexed paths (path, mtime, content_hash) that cannot be trusted: newer, of another hash, or not there to be read."""
    s = scan.select("path", F.col("mtime").alias("now"), F.col("content_hash").alias("found"))
    met = indexed.join(s, "path", "left")
    same = (F.col("now") <= F.col("mtime")) & (F.col("found") == F.col("content_hash"))
    return met.filter(~F.coalesce(same, F.lit(False))).select("path")


def duplicate_content(listed: DataFrame) -> DataFrame:
    """(content_hash, n, first_path) of content that several files hold."""
    return listed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).filter(F.col("n") > 1)


def covered(paths: DataFrame, prefixes: list[str]) -> DataFrame:
    """Paths under one of ``prefixes``; all paths where none is given."""
    keep = F.lit(not prefixes)
    for p in prefixes:
        keep = keep | under(F.col("path"), p)
    return paths.filter(keep)
