"""BM25 over symbols or texts, relevance floor and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import is_doc
from lodestone.functions.text import terms
from lodestone.sources.scratch import keep

K1, B = 1.5, 0.75
#: Hits that are always kept, and the share of the best score that others need (fixed values).
MIN_KEEP, FLOOR = 3, 0.3


def postings(docs: DataFrame, of: Column) -> DataFrame:
    """(id, terms): the terms of each document, repeats included."""
    return docs.select("id", of.alias("terms"))


def term_frequencies(posted: DataFrame) -> DataFrame:
    """(id, term, tf): how often each document holds each of its terms."""
    return posted.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def query_terms(query: str, df: DataFrame) -> DataFrame:
    """The distinct terms of a query, one row each; few by nature."""
    one = df.sparkSession.range(1).select(F.explode(F.array_distinct(terms(F.lit(query)))).alias("term"))
    return one


def bm25(posted: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of documents that hold a term of the query.

    The terms of a document are read once: its length and its counts of the query's terms go to a slim table, from which
    the corpus statistics and the scores are taken. The vocabulary is never shuffled.
    """
    words = [r["term"] for r in query_terms(query, posted).collect()]
    if not words:
        return posted.select("id", F.lit(0.0).alias("score")).limit(0)
    asked = posted.select("id", F.size("terms").cast("double").alias("length"), F.filter("terms", lambda t: t.isin(*words)).alias("terms"))
    slim = keep(asked.select("id", "length", *[_tf(w).alias(f"tf{i}") for i, w in enumerate(words)]), "term-counts")
    stats = slim.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(words))])
    known = stats.select(F.struct(*stats.columns).alias("s")).scalar()  # one row, computed once and seen as a constant
    score = F.lit(0.0)
    for i in range(len(words)):
        tf = F.col(f"tf{i}")
        idf = F.log(1 + (known["n"] - known[f"df{i}"] + 0.5) / (known[f"df{i}"] + 0.5))
        score = score + F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("length") / known["mean"]))).otherwise(0.0)
    return slim.select("id", score.alias("score")).filter(F.col("score") > 0)


def _tf(word: str) -> Column:
    return F.size(F.filter("terms", lambda t: t == word)).cast("double")


def matched_terms(posted: DataFrame, query: str) -> DataFrame:
    """(term, matched): whether any document holds a term of the query."""
    words = query_terms(query, posted)
    held = posted.select(F.explode(F.array_distinct(F.array_intersect("terms", F.array_distinct(terms(F.lit(query)))))).alias("term")).distinct().withColumn("__held", F.lit(True))
    return words.join(held, "term", "left").select("term", F.col("__held").isNotNull().alias("matched"))


def tier(path: Column, kind: Column) -> Column:
    """0 implementation, 1 tests, 2 documentation; smaller comes first."""
    return F.when(is_doc(path), 2).when(kind == "test", 1).otherwise(0)


def relevant(hits: DataFrame, keep: int = MIN_KEEP, floor: float = FLOOR) -> DataFrame:
    """The best ``keep`` hits, and those that score at least ``floor`` of the best. The top is found by aggregation."""
    best = hits.agg(F.max("score")).scalar()
    first = hits.orderBy(F.desc("score"), "id").limit(keep).select("id", F.lit(True).alias("__first"))
    return hits.join(F.broadcast(first), "id", "left").filter((F.col("score") >= best * floor) | F.col("__first").isNotNull()).select(*hits.columns)


def budget_prefix(blocks: DataFrame, budget: int, header: int = 0) -> DataFrame:
    """Blocks (group, ord, chars) of each group in order while they fit a budget; the first always stays.

    The first block that exceeds the budget ends its group.
    """
    before = Window.partitionBy("group").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    used = blocks.withColumn("used", F.sum("chars").over(before) + header)
    over = F.max(((F.col("used") > budget) & (F.col("__n") > 1)).cast("int")).over(before)
    numbered = used.withColumn("__n", F.row_number().over(Window.partitionBy("group").orderBy("ord")))
    return numbered.withColumn("__over", over).filter(F.col("__over") == 0).drop("__n", "__over")
