"""Changed files with the symbols they touch, hook verdicts, audits, and name references through wiring files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import graph, search

# Symbols listed for a file, lines of an edit that is worth a verdict, and the head in which it must define something.
SYMBOLS_SHOWN, WHOLE_EDIT_LINES, DEFINITION_WINDOW = 12, 25, 10
NAMED_KINDS = ("class", "interface", "enum", "type", "trigger")
NAMED_FILES = r"\.(cls|trigger)$"
XML_BYTES = 256 * 1024
TRUTH_PATTERNS = (
    r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+[A-Za-z_$]",
    r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+[A-Za-z_$]",
    r"^\s*(?:export\s+)?interface\s+[A-Za-z_$]",
    r"^\s*(?:export\s+)?(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*(?:async\s*)?(?:function|\()",
    r"^\s*(?:async\s+)?def\s+[A-Za-z_]",
    r"^\s*func\s+",
    r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+",
    r"^\s*(?:public|private|protected)\s+[\w<>\[\],.\s]+\s+[A-Za-z_]\w*\s*\(",
)


def changed_files(counts: DataFrame, status: DataFrame, touched: DataFrame, symbols: DataFrame, untracked: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(path, status, added, deleted, symbols) of counts (path, added, deleted), most changed first; the first ``limit``.

    ``status`` (path, status) defaults to M; ``touched`` (path, line) names symbols by the nearest one above; ``untracked``
    (path, n_lines) files count as added with the status ``?`` and name their first symbols.
    """
    at = search.attribute(touched.select("path", F.col("line").alias("line_no"), F.lit(0).alias("x")), symbols).filter(F.col("symbol").isNotNull())
    named = at.groupBy("path").agg(F.slice(F.array_sort(F.collect_set(F.concat_ws(" ", "kind", "symbol"))), 1, SYMBOLS_SHOWN).alias("symbols"))
    rows = counts.join(status, "path", "left").select("path", F.coalesce("status", F.lit("M")).alias("status"), "added", "deleted")
    if untracked is not None:
        rows = rows.unionByName(untracked.select("path", F.lit("?").alias("status"), F.coalesce(F.col("n_lines"), F.lit(0)).cast("long").alias("added"), F.lit(0).cast("long").alias("deleted")))
        own = symbols.join(untracked.select("path"), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "ord", F.concat_ws(" ", "kind", "name").alias("label")))).alias("all"))
        named = named.join(untracked.select("path"), "path", "left_anti").unionByName(own.select("path", F.slice(F.transform("all", lambda x: x["label"]), 1, SYMBOLS_SHOWN).alias("symbols")))
    found = rows.join(named, "path", "left").select("path", "status", "added", "deleted", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))
    ordered = found.orderBy(F.desc(F.col("added") + F.col("deleted")), "path")
    return ordered.limit(limit) if limit else ordered


def hook_verdicts(edits: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, fired, name, ambiguous): whether an edit (id, path, start_line, n_lines) re-sends a whole symbol.

    It does if it is long enough and a symbol starts in its first lines; the first such is named, and ambiguous if the
    name is defined more than once.
    """
    times = symbols.groupBy("name").agg(F.count("*").alias("times"))
    end = F.least(F.col("start_line") + F.col("n_lines") - 1, F.col("start_line") + DEFINITION_WINDOW)
    near = edits.filter(F.col("n_lines") >= WHOLE_EDIT_LINES).withColumn("__end", end)
    s = symbols.select(F.col("path").alias("__path"), F.col("line").alias("__line"), "ord", "name")
    met = near.join(s, (F.col("path") == F.col("__path")) & F.col("__line").between(F.col("start_line"), F.col("__end")))
    first = met.groupBy("id").agg(F.min_by("name", F.struct("__line", "ord")).alias("name")).join(times, "name")
    return edits.select("id").join(first, "id", "left").select("id", F.col("name").isNotNull().alias("fired"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.col("times") > 1, F.lit(False)).alias("ambiguous"))


def ambiguous_names(symbols: DataFrame) -> DataFrame:
    """Names that more than one symbol bears, with how many."""
    return symbols.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def inside(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, name) of symbols inside each span (id, path, start_line, end_line)."""
    s = symbols.select(F.col("path").alias("__path"), F.col("line").alias("__line"), "name")
    return spans.join(s, (F.col("path") == F.col("__path")) & F.col("__line").between(F.col("start_line"), F.col("end_line"))).select("id", "name")


def truth_lines(line: Column) -> Column:
    """Whether independent patterns call a line of bounded length a declaration."""
    return (F.length(line) <= 400) & reduce(Column.__or__, [line.rlike(p) for p in TRUTH_PATTERNS])


def recall_audit(scanned: DataFrame, symbols: DataFrame, by: Column) -> DataFrame:
    """(group, truth, found, rate): declarations by independent patterns, and those found, at most the truth of each file."""
    truth = scanned.groupBy("path").agg(F.count_if(truth_lines(F.col("line"))).alias("truth"))
    found = symbols.groupBy("path").agg(F.count("*").alias("n"))
    per_file = truth.join(found, "path", "left").select(by.alias("group"), "truth", F.least("truth", F.coalesce("n", F.lit(0))).alias("found"))
    g = per_file.groupBy("group").agg(F.sum("truth").alias("truth"), F.sum("found").alias("found"))
    return g.select("group", "truth", "found", F.round(F.col("found") / F.greatest(F.col("truth"), F.lit(1)), 6).alias("rate"))


def wiring_edges(scanned: DataFrame, symbols: DataFrame, xml: DataFrame | None = None) -> DataFrame:
    """(src, dst): code and XML (path, size, text) files that name a top-level type of a class or trigger file.

    Code is read masked, so names in strings and comments do not count; nor do those in XML comments or in large XML files.
    """
    types = symbols.filter(F.col("path").rlike(NAMED_FILES) & (F.col("depth") == 0) & F.col("kind").isin(*NAMED_KINDS)).select("name", "path")
    word = F.lit("([A-Za-z_][A-Za-z0-9_]*)")
    tokens = scanned.filter(F.col("path").rlike(NAMED_FILES)).select("path", F.explode(F.regexp_extract_all("masked", word, F.lit(1))).alias("token"))
    if xml is not None:
        plain = F.regexp_replace("text", r"(?s)<!--.*?-->", " ")
        tokens = tokens.unionByName(xml.filter(F.col("size") <= XML_BYTES).select("path", F.explode(F.regexp_extract_all(plain, word, F.lit(1))).alias("token")))
    return graph.name_edges(tokens, types)


def snapshot(texts: DataFrame, paths: DataFrame, store: str, keep: int = 10, most_bytes: int = 2_000_000) -> str:
    """Write the listed files as the next snapshot of a folder and delete all but the newest ``keep``; gives its path."""
    spark = texts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    known = sorted(s.getPath().getName() for s in files.listStatus(path(store))) if files.exists(path(store)) else []
    name = f"s{int(known[-1][1:]) + 1 if known else 1:09d}"
    texts.join(paths.select("path"), "path", "left_semi").filter(F.octet_length("text") <= most_bytes).write.parquet(f"{store}/{name}")
    for old in [*known, name][:-keep]:
        files.delete(path(f"{store}/{old}"), True)
    return f"{store}/{name}"


def newest_per_key(rows: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` rows of each key by ``seq``, as snapshots are kept."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return rows.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
