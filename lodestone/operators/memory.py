"""Facts and digests: previews, search, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapsed, trimmed
from lodestone.sources.scratch import keep

#: Length of a preview, of a saved fact that draws a warning and of one that is refused (fixed values).
PREVIEW, WARN, REFUSE = 150, 1200, 20_000
#: How a text names files and symbols (fixed values).
CODE_FILE = r"(?i)(?<![A-Za-z0-9_])([A-Za-z0-9_./-]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|cs|kt|rb|php|swift|scala|cls|trigger|cpp|hpp|cc|c|h|m|mm))(?![A-Za-z0-9_])"
SYMBOL_MENTIONS = (r"`([A-Za-z_][A-Za-z0-9_]*)`", r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{2,})\s*\(", r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{2,}):[0-9]+")


def previews(facts: DataFrame, width: int = PREVIEW) -> DataFrame:
    """(id, preview, chars, level): the flattened head of each fact; level tells a long one (warn) and one too long (refuse)."""
    flat = trimmed(collapsed(F.col("text")))
    level = F.when(F.length("text") > REFUSE, "refuse").when(F.length("text") > WARN, "warn").otherwise("ok")
    return facts.select("id", F.substring(flat, 1, width).alias("preview"), F.length("text").cast("long").alias("chars"), level.alias("level"))


def search_facts(facts: DataFrame, query: str | None = None, tag: str | None = None) -> DataFrame:
    """Facts (id, text, tags) that hold a substring, whatever its case, and a tag."""
    keep = F.lit(True)
    if query:
        keep = keep & F.lower("text").contains(query.lower())
    if tag:
        keep = keep & F.array_contains("tags", tag)
    return facts.filter(keep)


def newest(facts: DataFrame, n: int) -> DataFrame:
    return facts.orderBy(F.desc("created"), F.desc("id")).limit(n)


def recall(facts: DataFrame, n: int = 3) -> DataFrame:
    """Previews of the newest facts, as a session opens with them."""
    return previews(newest(facts, n))


def mentions(facts: DataFrame) -> DataFrame:
    """(id, kind, name): files and symbols that a fact names."""
    found = F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda x: F.struct(F.lit("symbol").alias("kind"), x.alias("name"))) for p in SYMBOL_MENTIONS])
    files = F.transform(F.regexp_extract_all("text", F.lit(CODE_FILE), F.lit(1)), lambda x: F.struct(F.lit("file").alias("kind"), x.alias("name")))
    return facts.select("id", F.explode(F.array_distinct(F.concat(files, F.flatten(found)))).alias("m")).select("id", "m.kind", "m.name")


def staleness(facts: DataFrame, named: DataFrame, live: DataFrame) -> DataFrame:
    """(id, flag): '' without mentions (id, kind, name), 'ok' if one of them is live (kind, name), else 'stale'.

    Files are live by base name, which a full match or a match of the end implies.
    """
    base = F.when(F.col("kind") == "file", F.regexp_extract("name", r"[^/]*$", 0)).otherwise(F.col("name"))
    asked = named.select("id", "kind", base.alias("name"))
    # Names that facts mention are few beside all that is live: they meet first, and only what is left is made distinct.
    alive = live.select("kind", base.alias("name")).join(asked.select("kind", "name").distinct(), ["kind", "name"], "left_semi").distinct().withColumn("__live", F.lit(1))
    judged = asked.join(alive, ["kind", "name"], "left").groupBy("id").agg(F.max(F.coalesce("__live", F.lit(0))).alias("__live"))
    return facts.select("id").join(judged, "id", "left").select("id", F.when(F.col("__live").isNull(), "").when(F.col("__live") == 1, "ok").otherwise("stale").alias("flag"))


def digest_state(scan: DataFrame, prefix_covers: DataFrame) -> DataFrame:
    """(digest, n_covered, n_stale): files (path, mtime) under each cover (digest, prefix, saved_at), and those newer than it.

    A path meets its own beginnings by equality, and no path meets a cover: what a cover asks for is how many paths its prefix
    has, and how many of them are newer, which running counts over (prefix, time) tell for all covers of the prefix at once. They
    are made in ranges of the time, so no task has all paths of a prefix. Covers of a digest may lie in each other: the outermost
    counts the paths; a path is stale if it is newer than one of those above it, so each takes back what the ones above have found.
    """
    points = scan.groupBy("path").agg(F.max("mtime").alias("at")).select(F.explode(_beginnings("path")).alias("prefix"), "at")
    covers = prefix_covers.filter(F.col("prefix").isNotNull()).groupBy("digest", "prefix").agg(F.min("saved_at").alias("saved_at"))
    outer = covers.select(F.col("digest").alias("__d"), F.col("prefix").alias("__p"), F.col("saved_at").alias("above"))
    inner = covers.select("digest", "prefix", F.explode(F.slice(_beginnings("prefix"), F.lit(1), F.size(_beginnings("prefix")) - 1)).alias("__p"))
    inner = inner.join(outer, F.col("digest").eqNullSafe(F.col("__d")) & (inner["__p"] == outer["__p"])).groupBy("digest", "prefix").agg(F.min("above").alias("above"), F.lit(True).alias("inside"))
    inner = inner.withColumnsRenamed({"digest": "__d", "prefix": "__p"})
    nested = covers.join(inner, F.col("digest").eqNullSafe(F.col("__d")) & (F.col("prefix") == F.col("__p")), "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    asks = F.array(F.struct(F.least("saved_at", "above").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("above").alias("at"), F.lit(-1).alias("sign")))
    asked = nested.select("digest", "prefix", "inside", F.explode(asks).alias("ask")).select("digest", "prefix", "inside", "ask.at", "ask.sign").filter(F.col("inside") | (F.col("sign") == 1))
    # The newest first, so that what comes before a time is newer than it; a time that is not known is never newer.
    newest = F.col("at").desc_nulls_last()
    counted = points.groupBy("prefix", "at").agg(F.count(F.lit(1)).alias("n")).join(covers.select("prefix").distinct(), "prefix", "left_semi")
    steps = asked.select("prefix", "at", F.lit(0).cast("long").alias("n")).unionByName(counted).groupBy("prefix", "at").agg(F.sum("n").alias("n"))
    steps = keep(steps.repartitionByRange("prefix", newest).withColumn("range", F.spark_partition_id()), "digest-steps")
    # One row for each prefix in a range.
    of_prefix = Window.partitionBy("prefix")
    parts = steps.groupBy("prefix", "range").agg(F.sum("n").alias("part"))
    parts = parts.select("prefix", "range", (F.sum("part").over(of_prefix.orderBy("range")) - F.col("part")).alias("before"), F.sum("part").over(of_prefix).alias("whole"))
    here = F.sum("n").over(Window.partitionBy("prefix", "range").orderBy(newest)) - F.col("n")
    told = steps.withColumn("here", here).join(parts, ["prefix", "range"]).select(F.col("prefix").alias("__p"), F.col("at").alias("__at"), "whole", (F.col("before") + F.col("here")).alias("newer"))
    met = asked.join(told, (F.col("prefix") == F.col("__p")) & F.col("at").eqNullSafe(F.col("__at")))
    stale = F.when(F.col("at").isNull(), 0).otherwise(F.col("sign") * F.col("newer"))
    found = met.groupBy("digest").agg(F.sum(F.when(F.col("inside"), 0).otherwise(F.col("whole"))).alias("n_covered"), F.sum(stale).alias("n_stale"))
    return found.filter(F.col("n_covered") > 0)


def _beginnings(path: str) -> Column:
    """A path's beginnings that end before a slash, and the path."""
    segments = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))
