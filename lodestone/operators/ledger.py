"""Tool-call ledgers: usage, sessions, first hops, blind writes, repeats, recaps.

Ordered questions are asked within a key (user, session), so each key is a unit of work of its own; questions about a
whole ledger (the last N rows, tops) use aggregation and top-N, never a window over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Retained journal rows, tools that a journal leaves out, the chars from which a repeat is suppressed.
JOURNAL_ROWS = 400
JOURNAL_SKIP = ("stats", "recap", "memory_save", "memory_search", "memory_list", "memory_delete", "batch", "index_repo", "snapshot")
REPEAT_CHARS = 800
GAP_MINUTES = 30


def usage(calls: DataFrame, is_error: Column) -> DataFrame:
    """Calls, chars, largest answer, errors and mean per tool, and a TOTAL row, from (tool, chars): one rollup."""
    u = calls.rollup("tool").agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"), F.max("chars").alias("max_chars"), F.count_if(is_error).alias("errors"), F.grouping("tool").alias("g"))
    return u.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("tool")).alias("tool"), "calls", "chars", "max_chars", "errors", F.floor(F.col("chars") / F.col("calls") + 0.5).cast("long").alias("mean_chars"))


def usage_windows(calls: DataFrame, checkpoint: Column) -> DataFrame:
    """Per tool, all-time tallies beside those since a checkpoint (a maximum has no difference, so both are kept)."""
    since = F.col("ts") >= checkpoint
    return calls.groupBy("tool").agg(
        F.count("*").alias("calls"), F.sum("chars").alias("chars"), F.max("chars").alias("max_chars"),
        F.count_if(since).alias("calls_since"), F.coalesce(F.sum(F.when(since, F.col("chars"))), F.lit(0)).alias("chars_since"), F.max(F.when(since, F.col("chars"))).alias("max_chars_since"),
    )


def follow_through(calls: DataFrame, outlines: tuple[str, ...], narrow: tuple[str, ...]) -> DataFrame:
    """One row: outline calls, narrow reads, and whether the reads lag behind."""
    n = calls.agg(F.count_if(F.col("tool").isin(*outlines)).alias("n_outlines"), F.count_if(F.col("tool").isin(*narrow)).alias("n_narrow"))
    return n.withColumn("low", (F.col("n_outlines") > 0) & (F.col("n_narrow") < F.col("n_outlines")))


def unused_tools(calls: DataFrame, tools: tuple[str, ...], least_calls: int = 5) -> DataFrame:
    """Tools of a list that were never called, once there are ``least_calls`` calls at all."""
    listed = calls.sparkSession.createDataFrame([(t,) for t in tools], "tool string")
    used = calls.groupBy("tool").count()
    total = used.agg(F.sum("count").alias("__total"))
    return listed.join(used, "tool", "left_anti").filter(total.scalar() >= least_calls).select("tool")


def sessions(events: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Events (key, ts, seq, ...) with their session number: a gap longer than ``gap_minutes`` opens a new one."""
    order = Window.partitionBy("key").orderBy("ts", "seq")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    opens = F.when(gap.isNull() | (gap > gap_minutes * 60_000_000), 1).otherwise(0)
    return events.withColumn("__opens", opens).withColumn("session", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def session_rows(events: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """(key, session, started, ended, calls)."""
    return sessions(events, gap_minutes).groupBy("key", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("calls"))


def first_hops(events: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """(side, n, percent): with which side sessions begin. ``events`` also has ``side``."""
    first = sessions(events, gap_minutes).groupBy("key", "session").agg(F.min_by("side", F.struct("ts", "seq")).alias("side"))
    n = first.groupBy("side").agg(F.count("*").alias("n"))
    total = first.agg(F.count("*").alias("total"))
    return n.select("side", "n", F.floor(F.col("n") * 100 / total.scalar() + 0.5).cast("long").alias("percent"))


def side_kinds(events: DataFrame) -> DataFrame:
    return events.groupBy("side", "kind").agg(F.count("*").alias("n"))


def blind_writes(events: DataFrame, is_write: Column, is_check: Column) -> DataFrame:
    """(key, writes, blind): writes of each key, and those with no check since the write before."""
    order = Window.partitionBy("key").orderBy("ts", "seq")
    before = F.coalesce(F.sum(is_write.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = events.withColumn("__span", before).groupBy("key", "__span").agg(F.max(is_write.cast("int")).alias("w"), F.max(is_check.cast("int")).alias("c"))
    return spans.groupBy("key").agg(F.sum("w").alias("writes"), F.count_if((F.col("w") == 1) & (F.col("c") == 0)).alias("blind"))


def write_report(events: DataFrame, is_write: Column, written: Column, is_external: Column, is_check: Column) -> DataFrame:
    """(key, calls, symbols, external_files, checks, blind): writes of each key, the symbols they wrote, edits of other tools, checks."""
    totals = events.groupBy("key").agg(F.count_if(is_write).alias("calls"), F.sum(F.when(is_write, written).otherwise(0)).alias("symbols"), F.count_if(is_external).alias("external_files"), F.count_if(is_check).alias("checks"))
    return totals.join(blind_writes(events, is_write, is_check).select("key", "blind"), "key")


def merged_logs(*logs: DataFrame, n: int = 500) -> DataFrame:
    """The last ``n`` rows of several logs (seq, ts, side) taken together, newest first."""
    rows = logs[0]
    for log in logs[1:]:
        rows = rows.unionByName(log)
    return rows.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def repeats(calls: DataFrame, least_chars: int = REPEAT_CHARS) -> DataFrame:
    """Calls (key, seq, signature, chars) with ``suppressed``: every second of a run of equal, long answers to one key."""
    order = Window.partitionBy("key").orderBy("seq")
    new = F.coalesce((F.col("signature") != F.lag("signature").over(order)) | (F.lag("chars").over(order) < least_chars), F.lit(True))
    runs = calls.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("key", "__run").orderBy("seq"))
    return runs.withColumn("suppressed", (place % 2 == 0)).drop("__new", "__run")


def retained(rows: DataFrame, n: int = JOURNAL_ROWS) -> DataFrame:
    """The last ``n`` rows by ``seq``, by top-N."""
    return rows.orderBy(F.desc("seq")).limit(n)


def tops(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of a column; ties go to the one seen first."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return counts.orderBy(F.desc("n"), "first_seq").limit(n)


def recent_hints(rows: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` different hints, by their latest row."""
    return rows.filter(F.col("hint").isNotNull()).groupBy("hint").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(n)


def bypass(hooks: DataFrame) -> DataFrame:
    """One row from hook rows (tool, fired, file): edits that fired, edits that did not (rows without the field count), reads that fired."""
    fired = F.coalesce(F.col("fired"), F.lit(False))
    return hooks.agg(F.count_if((F.col("tool") == "Edit") & fired).alias("whole_symbol_edits"), F.count_if((F.col("tool") == "Edit") & ~fired).alias("generic_edits"), F.count_if((F.col("tool") == "Read") & fired).alias("whole_file_reads"))


def slow_or_large(calls: DataFrame, most_ms: int = 5000, most_chars: int = 12_500) -> DataFrame:
    """Calls that failed, took long or answered at length."""
    return calls.withColumn("slow", F.col("ms") > most_ms).withColumn("large", F.col("chars") > most_chars).filter(F.col("slow") | F.col("large") | F.col("is_error"))


#: Journal tools by what their hint names (fixed values).
FILE_TOOLS, SEARCH_TOOLS = ("read_lines", "get_file_skeleton", "outline_file"), ("search_code",)


def recap(journal: DataFrame, limit: int = 200) -> dict[str, DataFrame]:
    """Files, symbols, searches and tools of the last ``limit`` rows (seq, tool, hint) of a journal."""
    last = retained(journal, limit)
    tool = F.col("tool")
    words = last.filter(~tool.isin(*FILE_TOOLS, *SEARCH_TOOLS) & F.col("hint").isNotNull()).select("seq", F.posexplode(F.split("hint", " ")).alias("k", "word"))
    return {
        "files": tops(last.filter(tool.isin(*FILE_TOOLS)), "hint", 10),
        "symbols": tops(words.select((F.col("seq") * 1000 + F.col("k")).alias("seq"), "word"), "word", 10),
        "searches": recent_hints(last.filter(tool.isin(*SEARCH_TOOLS)), 5),
        "tools": tops(last, "tool", 8),
    }


def impact_line(counts: DataFrame) -> DataFrame:
    """One line of text for the row of ``search.impact``."""
    floor = F.when(F.col("capped"), "+").otherwise("")
    text = F.format_string("referenced in %d%s other file(s), %d test file(s)", "n_files", floor, "n_tests")
    none = (F.col("n_files") == 0) & (F.col("n_tests") == 0)
    return counts.select(F.when(none, "no other references").otherwise(text).alias("line"))
