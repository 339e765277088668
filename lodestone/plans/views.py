"""The driver's tables seen as files, symbols, edges, calls and facts; each view in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import url_path
from lodestone.operators.corpus import lines
from lodestone.sources.tables import table

#: A document's path; Spanish documents stand for tests.
FILES_SQL = r"""f AS (SELECT source || '/' || CASE WHEN lang = 'es' THEN 'tests' ELSE lang END || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, doc_id, lang, text FROM documents)"""
LINES_SQL = FILES_SQL + r""", l AS (SELECT path, CAST(unnest(generate_series(1, len(ls))) AS BIGINT) AS line_no, unnest(ls) AS line FROM (SELECT path, regexp_split_to_array(text, '\r?\n') AS ls FROM f))"""
#: Lines of at most three words stand for declarations; their first word is the name.
SYMBOLS_SQL = LINES_SQL + r""", s AS (SELECT path, line_no AS line, 1 AS ord, regexp_extract(line, '^([A-Za-z]+)', 1) AS name, CASE WHEN length(line) % 2 = 0 THEN 'test' ELSE 'function' END AS kind FROM l WHERE regexp_matches(line, '^[A-Za-z]+[^ ]*( [^ ]+){0,2}$'))"""
PAGES_SQL = r"""g AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, html FROM pages)"""
CALLS_SQL = r"""c AS (SELECT event_id AS seq, ts, event_type AS tool, CAST(floor(value * 100) AS BIGINT) AS chars, event_type = 'error' AS is_error, user_id AS key, props FROM events)"""
EDGES_SQL = r"""e AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem UNION SELECT DISTINCT 'p' || CAST(l_partkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 1)"""
FACTS_SQL = r"""k AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, text, [role] AS tags, conv_id, turn FROM conversations)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("lang") == "es", "tests").otherwise(F.col("lang"))
    path = F.concat(F.col("source"), F.lit("/"), folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), "doc_id", "lang", "text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", "text")


def symbols(spark: SparkSession, sf_dir: str, holding: str | None = None) -> DataFrame:
    """All symbols, or those of files that hold a string, as a table stored by file would give them."""
    of = texts(spark, sf_dir)
    named = lines(of.filter(F.col("text").contains(holding)) if holding else of).filter(F.col("line").rlike(r"^[A-Za-z]+[^ ]*( [^ ]+){0,2}$"))
    kind = F.when(F.length("line") % 2 == 0, "test").otherwise("function")
    return named.select("path", F.col("line_no").alias("line"), F.lit(1).alias("ord"), F.regexp_extract("line", "^([A-Za-z]+)", 1).alias("name"), kind.alias("kind"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url_path(F.col("url")).alias("path"), "html")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("tool"), chars.alias("chars"), (F.col("event_type") == "error").alias("is_error"), F.col("user_id").alias("key"), "props")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    supplier, part = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return li.select(supplier.alias("src"), part.alias("dst")).union(li.filter("l_linenumber = 1").select(part, supplier)).distinct()


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"), "text", F.array("role").alias("tags"), "conv_id", "turn")
