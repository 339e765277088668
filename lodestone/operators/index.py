"""An index of a source tree: one row a file with its lines, symbols and imports, and the symbols by their words.

Each file is read once, by ``rules.parsed``; a saved index is that one table, in buckets of paths, and the term rows of its symbols,
in buckets of terms. Questions are projections of the rows of the files concerned, so they shuffle nothing but their answers: the symbol
that a line stands in, the end of a block and a file's text lie in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import is_test, under
from lodestone.functions.text import lines_of, pattern_hits, terms, trimmed, whole_word
from lodestone.operators import corpus, grams, graph, rank, rules, search

VERSION = 3
#: Blocks from which a budget chooses.
SHOWN_BLOCKS = 1000
#: Buckets of paths of a saved index, unless it is told otherwise.
BUCKETS = 16


@dataclass
class Index:
    """One row a file; every question is a DataFrame expression over it.

    ``rows``: path, mtime, size, n_lines, content_hash, text, and what ``rules.parsed`` finds. ``words``: the term rows of its symbols,
    see ``term_rows``. ``buckets``: of a saved index, into how many its paths are dealt. ``posted``: of a saved index with postings of
    three-character strings, see ``grams``.
    """

    rows: DataFrame
    words: DataFrame | None = None
    buckets: int | None = None
    posted: DataFrame | None = None

    @property
    def texts(self) -> DataFrame:
        """(path, text)"""
        return self.rows.select("path", "text")

    @property
    def files(self) -> DataFrame:
        """(path, mtime, size, n_lines, content_hash, truncated): ``truncated`` files have more symbols than are kept."""
        return self.rows.select("path", "mtime", "size", "n_lines", "content_hash", "truncated")

    @property
    def lines(self) -> DataFrame:
        """(path, line_no, line, masked, depth)"""
        return rules.lines(self.rows)

    @property
    def symbols(self) -> DataFrame:
        """(path, ord, name, kind, line, col, depth)"""
        return rules.symbols(self.rows)

    @property
    def imports(self) -> DataFrame:
        """(path, line, module)"""
        return rules.imports(self.rows)

    def edges(self) -> tuple[DataFrame, DataFrame]:
        return graph.resolve(self.imports, self.rows.select("path"))

    def of_path(self, path: str) -> DataFrame:
        """The row of one path; of a saved index only its bucket is read."""
        rows = self.rows.filter(F.col("path") == path)
        return rows.filter(F.col("bucket") == _bucket(F.lit(path), self.buckets)) if self.buckets else rows

    def term_rows(self) -> DataFrame:
        """(path, ord, line, name, kind, length, term, tf): how often each symbol's words hold each of them.

        A symbol's words are those of its name, its kind and its file's name.
        """
        if self.words is not None:
            return self.words
        words = F.concat(terms(F.col("name")), F.array(F.lower("kind")), terms(F.regexp_extract("path", r"[^/]*$", 0)))
        known = self.symbols.select("path", "ord", "line", "name", "kind", words.alias("words"))
        counted = F.transform(F.array_distinct("words"), lambda t: F.struct(t.alias("term"), F.size(F.filter("words", lambda w: w == t)).cast("long").alias("tf")))
        return known.select("path", "ord", "line", "name", "kind", F.size("words").cast("long").alias("length"), F.inline(counted))


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _listed(tree: DataFrame) -> DataFrame:
    """``tree`` (path, mtime, text) with what tells whether a file has changed."""
    return tree.select(
        "path", "mtime", F.length("text").cast("long").alias("size"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.sha2("text", 256).alias("content_hash"), "text"
    )


def build(tree: DataFrame, most: int = rules.SYMBOLS_A_FILE) -> Index:
    """An index of (path, mtime, text); each file is read once, by whatever asks first."""
    return Index(rules.parsed(_listed(tree), most))


def save(index: Index, folder: str, buckets: int = BUCKETS) -> None:
    """Write the index in a folder of its format version: files by buckets of paths, and their term rows by term."""
    _dealt(index.rows, buckets).sortWithinPartitions("bucket", "slot").write.mode("overwrite").partitionBy("bucket").parquet(_files(folder))
    _save_words(index.rows.sparkSession, folder, buckets)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumns({"bucket": _bucket(F.col("path"), buckets), "slot": grams.slot(F.col("path"))})


def _files(folder: str) -> str:
    return f"{folder}/v{VERSION}/files"


def _grams(folder: str) -> str:
    return f"{folder}/v{VERSION}/grams"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def save_grams(spark: SparkSession, folder: str, touched: list[int] | None = None) -> None:
    """Post the three-character strings of a saved index's files, of all buckets or of those named; updates keep them up."""
    files = spark.read.parquet(_files(folder))
    if touched is not None:
        files = files.filter(F.col("bucket").isin(*touched))
    made = grams.postings(files).repartition("bucket").sortWithinPartitions("bucket", "gram")
    made.write.mode("overwrite").option("partitionOverwriteMode", "static" if touched is None else "dynamic").partitionBy("bucket").parquet(_grams(folder))
    spark.catalog.refreshByPath(_grams(folder))


def _save_words(spark: SparkSession, folder: str, buckets: int) -> None:
    """By buckets of terms, so that a question reads those of its words; a bucket is cut by path, since one term may have most rows."""
    words = Index(spark.read.parquet(_files(folder))).term_rows().withColumn("bucket", _bucket(F.col("term"), buckets))
    dealt = words.repartition(buckets, "bucket", F.pmod(F.xxhash64("path"), F.lit(4))).sortWithinPartitions("bucket", "term")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v{VERSION}/words")


def write(tree: DataFrame, folder: str, buckets: int = BUCKETS) -> Index:
    """Build and save an index of ``tree``; the texts are dealt into buckets before they are read, each bucket by one task."""
    spark = tree.sparkSession
    dealt = tree.select("path", "mtime", "text").repartition(buckets, _bucket(F.col("path"), buckets))
    save(build(dealt), folder, buckets)
    return load(spark, folder, buckets)


def load(spark: SparkSession, folder: str, buckets: int | None = None) -> Index:
    """Read a saved index; one of another version is not there. ``buckets`` as it was saved with."""
    files = spark.read.parquet(_files(folder))
    posted = spark.read.schema("gram long, slots array<int>, bucket int").parquet(_grams(folder)) if _there(spark, _grams(folder)) else None
    terms_of = Index(files).term_rows().withColumn("bucket", F.lit(0)).schema  # told, since a tree without symbols has written no rows
    return Index(files, spark.read.schema(terms_of).parquet(f"{folder}/v{VERSION}/words"), buckets, posted)


def _actions(scan: DataFrame, known: DataFrame) -> DataFrame:
    return corpus.refresh(scan.select("path", "mtime", "content_hash"), known.select("path", "mtime", "content_hash"))


def refresh(index: Index, tree: DataFrame) -> tuple[Index, DataFrame]:
    """(new index, actions): only new and changed files are read; rows of removed and changed files are replaced."""
    scan = _listed(tree)
    actions = _actions(scan, index.rows)
    fresh = build(tree.join(actions.filter(F.col("action").isin("new", "changed")).select("path"), "path", "left_semi"))
    kept = actions.filter(F.col("action").isin("reused", "touched")).select("path")
    times = scan.select("path", F.col("mtime").alias("__mtime"))
    old = index.rows.join(kept, "path", "left_semi").join(times, "path").withColumn("mtime", F.col("__mtime")).select(*fresh.rows.columns)
    return Index(old.unionByName(fresh.rows)), actions


def update(folder: str, changes: DataFrame, buckets: int = BUCKETS) -> Index:
    """Apply ``changes`` (path, mtime, text; a null text removes the path) to a saved index.

    Only buckets with a changed path are read and written again, and a change that is there already changes nothing, so the same
    batch may come twice. Of changes to one path the latest counts.
    """
    spark = changes.sparkSession
    from lodestone.sources.scratch import keep, release

    last = changes.groupBy("path").agg(F.max_by(F.struct("mtime", "text"), F.struct("mtime", F.col("text").isNotNull(), "text")).alias("c")).select("path", "c.mtime", "c.text")
    last = keep(last.withColumn("bucket", _bucket(F.col("path"), buckets)), "index-changes")
    touched = [r["bucket"] for r in last.select("bucket").distinct().collect()]  # at most as many as there are buckets
    if not touched:
        return load(spark, folder, buckets)
    old = spark.read.parquet(_files(folder)).filter(F.col("bucket").isin(*touched))
    fresh = build(last.filter(F.col("text").isNotNull()).select("path", "mtime", "text")).rows
    left = old.join(last.select("path"), "path", "left_anti").select(*fresh.columns)
    rows = keep(_dealt(left.unionByName(fresh), buckets), "index-buckets")  # what is read is written over
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(_files(folder))
    # A bucket that lost its last file is not among the rows.
    empty = set(touched) - {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_files(folder))
    for bucket in empty:
        for table in (_files(folder), _grams(folder)):
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/bucket={bucket}"), True)
    release(last, rows)
    spark.catalog.refreshByPath(_files(folder))
    if _there(spark, _grams(folder)):
        save_grams(spark, folder, touched)
    _save_words(spark, folder, buckets)
    return load(spark, folder, buckets)


# ---- texts that can hold what is looked for


def candidate_rows(index: Index, literals: list[str], ignore_case: bool = False) -> DataFrame:
    """The index's rows, less files that the postings show not to hold all ``literals``; all rows where they cannot tell.

    Buckets without a candidate are not read, and few candidates are named to the scan, which passes over other pages.
    """
    from lodestone.sources.scratch import broadcast_if_small, keep

    wanted = grams.needed(literals, ignore_case)
    if index.posted is None or not wanted:
        return index.rows
    some = keep(grams.candidates(index.posted, wanted), "candidates")
    few = [(r["bucket"], r["slot"]) for r in some.limit(grams.NAMED + 1).collect()]
    rows = index.rows
    if len(few) <= grams.NAMED:
        named = F.lit(False)
        for n in sorted({n for _, n in few}):
            named = named | (F.col("slot") == n)
        rows = rows.filter(F.col("bucket").isin(*{b for b, _ in few}) & named)
    return rows.join(broadcast_if_small(some), ["bucket", "slot"], "left_semi")


def find_literal(index: Index, literal: str, ignore_case: bool = False, hits_a_line: int | None = search.HITS_A_LINE) -> DataFrame:
    """``search.find_literal`` over the files that can hold the literal."""
    return search.find_literal(candidate_rows(index, [literal], ignore_case).select("path", "text"), literal, ignore_case, hits_a_line)


def find_pattern(index: Index, pattern: str, hits_a_line: int | None = search.HITS_A_LINE) -> DataFrame:
    """``search.find_pattern`` over the files that can hold the strings that every match holds."""
    return search.find_pattern(candidate_rows(index, grams.literals_of(pattern)).select("path", "text"), pattern, None, hits_a_line)


# ---- hits, each with the symbol that it stands in


def hits(rows: DataFrame, name: str, hits_a_line: int = search.HITS_A_LINE) -> DataFrame:
    """(path, line_no, col, text, symbol, kind, symbol_line, defines) of each whole-word occurrence of a name in files of an index.

    ``symbol`` is the nearest at or above the line; ``defines``: the line declares the name. A map: files without the name
    are dropped, and a hit's symbol is found by its place in the file's row.
    """
    pattern = whole_word(name)
    some = rows.filter(F.col("text").contains(name))
    each = some.select("path", "symbols", "owners", F.posexplode(lines_of(F.col("text"))).alias("at", "line")).filter(F.col("line").contains(name) & F.col("line").rlike(pattern))
    cols = F.slice(F.transform(pattern_hits(F.col("line"), pattern), lambda h: h["col"]), 1, hits_a_line)
    owner = F.element_at("owners", F.col("at") + 1)
    near = F.when(owner > 0, F.element_at("symbols", owner)).alias("s")
    defines = F.exists("symbols", lambda s: (s["line"] == F.col("at") + 1) & (s["name"] == name)).alias("defines")
    found = each.select("path", (F.col("at") + 1).cast("long").alias("line_no"), F.explode(cols).alias("col"), F.substring(trimmed(F.col("line")), 1, search.SHOWN).alias("text"), near, defines)
    return found.select("path", "line_no", F.col("col").cast("long").alias("col"), "text", F.col("s.name").alias("symbol"), F.col("s.kind").alias("kind"), F.col("s.line").alias("symbol_line"), "defines")


def definitions_page(index: Index, name: str, offset: int = 0, limit: int = 50, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """One page of the definitions of ``name`` by path and line, each row with the exact total; see ``search.definitions``."""
    forms = [name, "." + name, "#" + name]
    rows = index.rows.filter(under(F.col("path"), prefix)) if prefix else index.rows
    some = rows.filter(F.exists("symbols", lambda s: s["name"].isin(*forms)))
    found = rules.symbols(some).filter(F.col("name").isin(*forms))
    return search.definitions_page(found, name, offset, limit, kind, prefix)


def references_page(index: Index, name: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of the references to ``name`` by path, line and column, each row with the exact total."""
    found = hits(index.rows, name)
    return search.page(found, offset, limit).drop("defines").withColumn("total", found.agg(F.count("*")).scalar())


def tests_page(index: Index, name: str, limit: int = 50, scan: int = 500) -> DataFrame:
    """The first references in tests: of the first ``scan`` in files with tests, those in test files or under test symbols."""
    narrow = index.rows.filter(is_test(F.col("path")) | F.exists("symbols", lambda s: s["kind"] == "test"))
    found = search.page(hits(narrow, name), 0, scan).drop("defines")
    return found.filter(is_test(F.col("path")) | (F.col("kind") == "test")).orderBy("path", "line_no", "col").limit(limit)


def skeleton(index: Index, path: str) -> DataFrame:
    """(path, line, text): the lines of one file that declare something, their opening brace or colon cut off, numbered."""
    row = index.of_path(path).select("path", lines_of(F.col("text")).alias("lines"), F.explode(F.array_distinct(F.transform("symbols", lambda s: s["line"]))).alias("line"))
    raw = F.element_at("lines", F.col("line").cast("int"))
    text = F.rtrim(F.regexp_replace(F.trim(raw), r"[{:]\s*$", ""))
    return row.select("path", "line", F.concat(F.regexp_extract(raw, r"^[ \t]*", 0), text, F.lit(" … {"), F.col("line").cast("string"), F.lit("}")).alias("text"))


def search_intent(index: Index, query: str, limit: int = 10) -> DataFrame:
    """(path, ord, line, name, kind, score, tier): symbols by BM25 over their words, implementation before tests before documents.

    Of a saved index the rows of the query's words are read, and lengths from a column of the others. Scores equal to nine digits are
    ties, which path and line decide.
    """
    rows = index.term_rows()
    words = [r["term"] for r in rank.query_terms(query, rows).collect()]
    some = rows.filter(F.col("term").isin(*words))
    if index.buckets:
        some = some.filter(F.col("bucket").isin(*[_bucket(F.lit(w), index.buckets) for w in words]))
    # A symbol's rows carry its length once for each different word; tf adds up to it.
    whole = rows.agg(F.sum("tf").alias("words")).select(F.struct("words", index.rows.agg(F.sum(F.size("symbols"))).scalar().alias("n")).alias("s")).scalar()
    n, mean = whole["n"].cast("double"), whole["words"] / whole["n"]
    of_term = some.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = idf * (tf * (rank.K1 + 1)) / (tf + rank.K1 * (1 - rank.B + rank.B * F.col("length") / mean))
    scored = some.join(F.broadcast(of_term), "term").groupBy("path", "ord", "line", "name", "kind").agg(F.sum(part).alias("score"))  # as many rows as the query has words
    ordered = scored.withColumn("tier", rank.tier(F.col("path"), F.col("kind")))
    return ordered.orderBy("tier", F.desc(F.round("score", 9)), "path", "line", "ord").limit(limit)


def symbol_bodies(index: Index, wanted: DataFrame | None = None, most_lines: int = 200) -> DataFrame:
    """(path, line, name, end, loc, body) of the blocks that ``wanted`` (path, line, name) open, or all symbols.

    A block that does not close has neither end nor body. Ends are known, so a file's row is cut and never read by a lexer again.
    """
    if wanted is None:
        met = index.rows.select("path", "text", "ends", F.transform("symbols", lambda s: F.struct(s["line"].alias("line"), s["name"].alias("name"))).alias("asked"))
    else:
        asked = wanted.groupBy("path").agg(F.collect_list(F.struct(F.col("line").cast("long").alias("line"), "name")).alias("asked"))
        met = asked.join(index.rows.select("path", "text", "ends"), "path")

    def block(lines: Column) -> Column:
        def one(s: Column) -> Column:
            end = F.nullif(F.get("ends", s["line"].cast("int") - 1), F.lit(0)).cast("long")
            loc = end - s["line"] + 1
            body = F.array_join(F.slice(lines, F.greatest(s["line"].cast("int"), F.lit(1)), F.least(loc, F.lit(most_lines)).cast("int")), "\n")
            return F.struct(s["line"].alias("line"), s["name"].alias("name"), end.alias("end"), loc.alias("loc"), F.when(end.isNotNull(), body).alias("body"))

        return F.transform("asked", one)

    # The text is split once for all blocks of a file.
    blocks = F.transform(F.array(lines_of(F.coalesce("text", F.lit("")))), block)
    return met.select("path", F.inline(F.element_at(blocks, 1)))


def context_pack(index: Index, query: str, budget: int = 6000, hits: int = 8, bodies: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relevant symbols, their files' edges one hop in and out, bodies within the budget)."""
    found = rank.relevant(search_intent(index, query, hits).withColumn("id", F.concat_ws(":", "path", "ord")))
    edges, _ = index.edges()
    near = found.select(F.col("path").alias("src")).distinct()
    hop = edges.join(near, "src", "left_semi").unionByName(edges.join(near.withColumnRenamed("src", "dst"), "dst", "left_semi")).distinct()
    best = found.orderBy("tier", F.desc("score"), "path", "line").limit(bodies)
    blocks = symbol_bodies(index, best, 30).join(best.select("path", "line", "score", "tier"), ["path", "line"])
    return found, hop, within_budget(blocks, budget, ["tier", F.desc("score"), "path", "line"])


def within_budget(blocks: DataFrame, budget: int, order: list) -> DataFrame:
    """(path, line, name, body, ord): the few best blocks in order while their bodies fit a budget; the first always stays."""
    best = blocks.orderBy(*order).limit(SHOWN_BLOCKS)  # so that the numbering is of a bounded set
    sized = best.withColumn("group", F.lit(0)).withColumn("chars", F.length(F.coalesce("body", F.lit("")))).withColumn("ord", F.row_number().over(Window.partitionBy("group").orderBy(*order)))
    return rank.budget_prefix(sized, budget).select("path", "line", "name", "body", F.col("ord").cast("long").alias("ord"))


#: The parts of ``get_context``.
SECTIONS = ("definitions", "callers", "imports", "external", "dependents")


def get_context(index: Index, name: str, limit: int = 12, sections: tuple[str, ...] = SECTIONS) -> dict[str, DataFrame]:
    """Definitions of a symbol, its callers with the symbol they stand in, imports of and dependents on its files.

    Only the ``sections`` that are asked for are in the result, and what is not read is not computed.
    """
    defs = search.definitions(index.symbols, name)
    edges, external = index.edges()
    files = defs.select("path").distinct()
    every = {
        "definitions": defs,
        "callers": hits(index.rows, name).filter(~F.col("defines")).groupBy("path", "line_no", "symbol").agg(F.min("col").alias("col")).orderBy("path", "line_no").limit(limit),
        "imports": edges.join(files.withColumnRenamed("path", "src"), "src", "left_semi"),
        "external": external.join(files.withColumnRenamed("path", "src"), "src", "left_semi"),
        "dependents": edges.join(files.withColumnRenamed("path", "dst"), "dst", "left_semi").select("dst", "src"),
    }
    return {k: every[k] for k in sections}


def brief(index: Index, journal: DataFrame) -> dict[str, DataFrame]:
    """What opens a session: counts, extension mix, the most called tools of the journal (seq, tool, hint)."""
    from lodestone.operators import ledger, rollup

    counts = index.files.agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"))
    counts = counts.withColumn("n_symbols", index.symbols.agg(F.count("*")).scalar())
    kept = ledger.retained(journal.filter(~F.col("tool").isin(*ledger.JOURNAL_SKIP)), 200)
    return {"counts": counts, "extensions": rollup.extension_mix(index.files), "markup": rollup.markup_share(index.files), "tools": ledger.tops(kept, "tool", 8), "hints": ledger.recent_hints(kept)}


def changed_symbols(index: Index, touched: DataFrame, most: int = 12) -> DataFrame:
    """(path, symbols): the symbols in which touched lines (path, line) of a diff stand."""
    at = search.attribute(touched.select("path", F.col("line").alias("line_no"), F.lit(0).alias("x")), index.symbols)
    return at.filter(F.col("symbol").isNotNull()).groupBy("path").agg(F.slice(F.array_sort(F.collect_set("symbol")), 1, most).alias("symbols"))


def coverage(index: Index, name: str) -> DataFrame:
    """(path, tests): the test files that refer to a symbol."""
    return hits(index.rows.filter(is_test(F.col("path"))), name).groupBy("path").agg(F.count("*").alias("n"))


def symbol_context(index: Index, name: str | None = None, path: str | None = None, line: int | None = None, pad: int = 2) -> DataFrame:
    """(path, line_no, line) of one symbol's block with ``pad`` lines around it, never into the next declaration.

    The symbol is the one named, or the nearest at or above a line of a path. ValueError lists the candidates of a name that is
    not unique.
    """
    row = index.of_path(path) if path else index.rows
    if name is not None:
        found = search.definitions(rules.symbols(row.filter(F.col("text").contains(name.lstrip(".#")))), name)
    else:
        found = rules.symbols(row).filter(F.col("line") <= line).orderBy(F.desc("line"), "ord").limit(1)
    rows = found.select("path", "line", "name").orderBy("path", "line").limit(11).collect()  # one is expected, ten are listed
    if len(rows) != 1:
        raise ValueError("no such symbol" if not rows else "not unique: " + ", ".join(f"{r['path']}:{r['line']}" for r in rows[:10]) + (" and more" if len(rows) > 10 else ""))
    at = rows[0]["line"]
    # A block that does not close is shown up to the next declaration; all is in the file's row.
    known = index.of_path(rows[0]["path"]).select("path", lines_of(F.col("text")).alias("lines"), F.nullif(F.get("ends", F.lit(at - 1)), F.lit(0)).alias("end"), "symbols")
    known = known.withColumn("after", F.array_min(F.filter(F.transform("symbols", lambda s: s["line"]), lambda n: n > F.coalesce("end", F.lit(at)))))
    last = F.when(F.col("end").isNull(), F.coalesce(F.col("after") - 1, F.size("lines"))).otherwise(F.least(F.col("end") + pad, F.coalesce(F.col("after") - 1, F.size("lines")), F.size("lines")))
    shown = known.select("path", "lines", F.explode(F.sequence(F.lit(max(1, at - pad)), last.cast("int"))).alias("line_no"))
    return shown.select("path", F.col("line_no").cast("long").alias("line_no"), F.element_at("lines", F.col("line_no")).alias("line"))


def replace_symbols(index: Index, plan: DataFrame) -> DataFrame:
    """(path, text) of the files that ``plan`` (path, line, body) edits: each named line's block is replaced by its body.

    All spans are found in the original; a file whose edits overlap, or with a block that does not close, has a null text.
    Nothing is written.
    """
    from lodestone.operators.edits import splice

    spans = symbol_bodies(index, plan.select("path", "line", F.lit("").alias("name"))).select("path", "line", "end")
    edits = plan.join(spans, ["path", "line"]).select("path", F.col("line").cast("long").alias("start_line"), F.coalesce("end", F.lit(2**40)).alias("end_line"), "body")
    return splice(index.texts.join(plan.select("path").distinct(), "path", "left_semi"), edits)


def insert_at_symbols(index: Index, plan: DataFrame, after: bool = False) -> DataFrame:
    """(path, text) of the files that ``plan`` (path, line, body) edits: each body goes before the named line, or after its block."""
    from lodestone.operators.edits import splice

    if after:
        spans = symbol_bodies(index, plan.select("path", "line", F.lit("").alias("name"))).select("path", "line", "end")
        at = F.coalesce(F.col("end") + 1, F.lit(2**40))
        edits = plan.join(spans, ["path", "line"]).select("path", at.alias("start_line"), (at - 1).alias("end_line"), "body")
    else:
        edits = plan.select("path", F.col("line").cast("long").alias("start_line"), (F.col("line") - 1).cast("long").alias("end_line"), "body")
    return splice(index.texts.join(plan.select("path").distinct(), "path", "left_semi"), edits)


def healed_search(index: Index, tree: DataFrame, find: Callable[[DataFrame], DataFrame], first_page: bool = True) -> tuple[DataFrame, Index]:
    """(hits, index): a first page without any hit refreshes the index from the tree and searches once more."""
    hits = find(index.texts)
    if not first_page or not hits.isEmpty():
        return hits, index
    fresh, _ = refresh(index, tree)
    return find(fresh.texts), fresh


def cached(index: Index) -> Index:
    """The index with its rows kept by Spark between questions, on disk where memory is short."""
    return replace(index, rows=index.rows.persist(StorageLevel.MEMORY_AND_DISK))


def batch(index: Index, calls: list[tuple[str, dict]], most: int = 20) -> list[DataFrame | dict | str]:
    """The answers of several calls (name, arguments); a call that is not known or fails answers with its error."""
    if not 1 <= len(calls) <= most:
        raise ValueError(f"1 to {most} calls")
    known = {
        "find_definition": lambda name, **k: definitions_page(index, name, **k),
        "find_references": lambda name, **k: references_page(index, name, **k),
        "find_tests": lambda name, **k: tests_page(index, name, **k),
        "search": lambda literal, **k: find_literal(index, literal, **k),
        "search_symbols": lambda query, **k: search_intent(index, query, **k),
        "get_context": lambda name, **k: get_context(index, name, **k),
        "symbol_context": lambda **k: symbol_context(index, **k),
    }
    answers: list[DataFrame | dict | str] = []
    for name, arguments in calls:
        try:
            answers.append(known[name](**arguments) if name in known else f"unknown call: {name}")
        except (TypeError, ValueError) as e:
            answers.append(f"{name}: {e}")
    return answers
