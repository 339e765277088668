"""Source trees, hook logs and diffs as DataFrames."""

from __future__ import annotations

import json
import os
import posixpath
import subprocess
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import extension, is_generated, is_minified
from lodestone.sources.config import Config
from lodestone.sources.walk import contents, listing

HOOKS = "t string, tool string, file string, lines int, bytes long, fired boolean, reason string, symbol string, g string"


def taken(path: Column, config: Config) -> Column:
    """Whether a repository path is indexed: by extension or suffix, outside ignored directories, without an excluded part."""
    name = F.lower(path)
    keep = extension(path).isin(*sorted(config.extensions))
    for s in config.suffixes:
        keep = keep | name.endswith(s)
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    keep = keep & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in sorted(config.ignored)]))
    for p in config.ignored_paths:
        keep = keep & ~((path == p) | path.startswith(p + "/"))
    for x in config.exclude:
        keep = keep & ~path.contains(x)
    return keep


def source_tree(spark: SparkSession, root: str, config: Config | None = None, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of a tree: (path, mtime, size, text) to index, and (path, reason) of what was passed over.

    A folder of this machine or a mounted one is listed in parallel, see ``walk``: ignored folders, and those outside ``scope``, a
    folder of the tree, are never opened, links are told and not followed. Names and sizes are judged before a file is read. Trees of
    other stores are listed by Spark's reader, which leaves out names that begin with a dot or an underscore.
    """
    config = config or Config()
    root = root.rstrip("/")
    if "://" in root and not root.startswith("file://"):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        path = F.substring_index(F.col("path"), root + "/", -1)
        listed = found.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
        every, links = listed.filter(_within(scope)).filter(taken(F.col("path"), config)), None
        read = every.filter(F.col("size") <= config.most_bytes)
    else:
        root = root.removeprefix("file:").replace("//", "/")
        listed = listing(spark, root, config.ignored).filter(_within(scope))
        links = listed.filter("link")
        every = listed.filter(~F.col("link")).select("path", F.timestamp_millis("ms").alias("mtime"), "size").filter(taken(F.col("path"), config))
        read = contents(every.filter(F.col("size") <= config.most_bytes), root)
    large = every.filter(F.col("size") > config.most_bytes).select("path", F.lit("too large").alias("reason"))
    text = F.decode("content", "UTF-8")
    built = F.when(F.col("text").isNull(), "unreadable").when(is_minified(F.col("text")), "minified").when(is_generated(F.col("text")) & F.col("path").rlike(r"(?i)\.html?$"), "generated")
    judged = read.select("path", "mtime", "size", text.alias("text")).withColumn("reason", built)
    skipped = large.unionByName(judged.filter(F.col("reason").isNotNull()).select("path", "reason"))
    if links is not None:
        skipped = skipped.unionByName(links.select("path", F.lit("symbolic link").alias("reason")))
    return judged.filter(F.col("reason").isNull()).drop("reason"), skipped


def _within(scope: str | None) -> Column:
    return F.col("path").startswith(scope.strip("/") + "/") if scope else F.lit(True)


def hook_events(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Hook rows of a JSON-lines log; torn and blank lines are dropped."""
    rows = spark.read.schema(HOOKS).option("mode", "DROPMALFORMED").json(path).withColumn("t", F.try_to_timestamp("t")).filter(F.col("t").isNotNull())
    return rows.filter(F.col("t") >= F.lit(since).cast("timestamp")) if since else rows


def append_hook(path: str, row: dict, most_bytes: int = 256 * 1024, most_lines: int = 500) -> None:
    """Add a row to a JSON-lines log; a log that is longer than ``most_bytes`` keeps its last ``most_lines`` lines."""
    with open(path, "a", encoding="utf-8") as log:
        log.write(json.dumps(row) + "\n")
    if os.path.getsize(path) > most_bytes:
        with open(path, encoding="utf-8") as log:
            last = deque(log, maxlen=most_lines)
        with open(f"{path}.new", "w", encoding="utf-8") as log:
            log.writelines(last)
        os.replace(f"{path}.new", path)


def contained(root: str, path: str) -> str | None:
    """The normalized path inside a tree, or None if it leads out of it."""
    joined = posixpath.normpath(posixpath.join(root, path))
    return joined if joined == root.rstrip("/") or joined.startswith(root.rstrip("/") + "/") else None


def git_diff(spark: SparkSession, repository: str, base: str = "HEAD") -> DataFrame:
    """(diff, line_no, text) of a repository's changes since ``base``, without context lines."""
    if base.startswith("-"):
        raise ValueError("a base that starts with a dash is an option, not a revision")
    return _git(spark, repository, "diff", "--unified=0", base, "--")


def git_changes(spark: SparkSession, repository: str, base: str = "HEAD") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of text (diff, line_no, text) with the counts and the statuses of changed files since ``base``, and with untracked files."""
    if base.startswith("-"):
        raise ValueError("a base that starts with a dash is an option, not a revision")
    asked = (("diff", "--numstat", base, "--"), ("diff", "--name-status", base, "--"), ("ls-files", "--others", "--exclude-standard"))
    return tuple(_git(spark, repository, *x).filter(F.trim("text") != "") for x in asked)


def _git(spark: SparkSession, repository: str, *arguments: str) -> DataFrame:
    out = subprocess.run(["git", "-C", repository, *arguments], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(0, n, line) for n, line in enumerate(out.split("\n"))], "diff int, line_no int, text string")
