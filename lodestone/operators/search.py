"""Positional search, references with the declaration above them, definitions, tests and fuzzy names."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import is_test, under
from lodestone.functions.text import literal_hits, pattern_hits, subsequence, trimmed, whole_word
from lodestone.operators.corpus import lines

#: Hits of one line and characters of a shown line (fixed values).
HITS_A_LINE, SHOWN = 10, 240
#: A pattern that is a call, and signs that mean something in a pattern only (fixed values).
CALL_SHAPE, PATTERN_SIGNS = re.compile(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("), re.compile(r"[|()\[\]{}.*+?^$\\]")


def find_literal(texts: DataFrame, literal: str, ignore_case: bool = False, hits_a_line: int | None = HITS_A_LINE) -> DataFrame:
    """(path, line_no, col, text) of each occurrence of a literal. Files without it are dropped before lines are made."""
    seen = F.lower if ignore_case else (lambda c: c)
    needle = literal.lower() if ignore_case else literal
    candidates = texts.filter(seen(F.col("text")).contains(needle))
    found = lines(candidates).withColumn("cols", literal_hits(seen(F.col("line")), needle))
    return _exploded(found, F.slice("cols", 1, hits_a_line) if hits_a_line else F.col("cols"))


def find_pattern(texts: DataFrame, pattern: str, literal: str | None = None, hits_a_line: int | None = HITS_A_LINE) -> DataFrame:
    """(path, line_no, col, text) of each match of a pattern that matches no empty string.

    ``literal``: a string that every match contains; files without it are not cut into lines.
    """
    candidates = texts.filter(F.col("text").contains(literal)) if literal else texts
    hits = F.transform(pattern_hits(F.col("line"), pattern), lambda h: h["col"])
    return _exploded(lines(candidates).filter(F.col("line").rlike(pattern)), F.slice(hits, 1, hits_a_line) if hits_a_line else hits)


def find_each(texts: DataFrame, pattern: str, literal: str | None = None, ignore_case: bool = False, hits_a_line: int | None = HITS_A_LINE) -> DataFrame:
    """(path, line_no, col, width, text) of each match of any pattern, also one that matches nothing between characters.

    Behind an empty match the search goes on one character further, as behind any other at its end. The pattern is Python's. A line is
    read in the task that holds its file; ``literal`` as in ``find_pattern``.
    """
    re.compile(pattern)
    candidates = texts.filter(F.col("text").contains(literal)) if literal else texts.filter(F.col("text").isNotNull())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = re.compile(pattern, re.IGNORECASE if ignore_case else 0).search
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, line in enumerate(re.split(r"\r?\n", text), 1):
                    at = found = 0
                    while at <= len(line) and (hits_a_line is None or found < hits_a_line) and (m := search(line, at)):
                        a, b = m.span()
                        for column, value in zip(columns, (path, n, a + 1, b - a, line), strict=True):
                            column.append(value)
                        at, found = (b if b > a else b + 1), found + 1
                    if len(columns[0]) >= 20000:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _EACH, strict=True)], schema=_EACH)
                        columns = [[], [], [], [], []]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _EACH, strict=True)], schema=_EACH)

    rows = candidates.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(each, "path string, line_no long, col long, width long, line string")
    return rows.select("path", "line_no", "col", "width", F.substring(trimmed(F.col("line")), 1, SHOWN).alias("text"))


_EACH = pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("col", pa.int64()), ("width", pa.int64()), ("line", pa.string())])


def _exploded(found: DataFrame, cols: Column) -> DataFrame:
    hits = found.select("path", "line_no", F.explode(cols).alias("col"), "line")
    return hits.select("path", "line_no", F.col("col").cast("long").alias("col"), F.substring(trimmed(F.col("line")), 1, SHOWN).alias("text"))


def find_word(texts: DataFrame, name: str, hits_a_line: int | None = HITS_A_LINE) -> DataFrame:
    """Whole-word occurrences of a name."""
    return find_pattern(texts, whole_word(name), name, hits_a_line)


def page(hits: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order of path, line and column."""
    return hits.orderBy("path", "line_no", "col").offset(offset).limit(limit)


def summary(hits: DataFrame, scan_cap: int = 1000) -> DataFrame:
    """One row: total hits, the total as a capped scan would give it, whether that is exact, files with a hit."""
    s = hits.agg(F.count("*").alias("total"), F.count_distinct("path").alias("n_files"))
    return s.select("total", F.least("total", F.lit(scan_cap)).cast("long").alias("shown_total"), (F.col("total") <= scan_cap).alias("exact"), "n_files")


def cursor(offset: int, version: str) -> str:
    """An opaque cursor for the next page of an index version."""
    return base64.urlsafe_b64encode(json.dumps({"o": offset, "v": version}).encode()).decode().rstrip("=")


def read_cursor(text: str, version: str) -> tuple[int, bool]:
    """(offset, whether the index has changed since); ValueError for what is no cursor."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        return int(found["o"]), found["v"] != version
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"not a cursor: {text!r}") from e


def attribute(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """``hits`` (path, line_no, ...) with the nearest symbol at or above their line: symbol, kind, symbol_line.

    An as-of join in one pass: symbols and hits are sorted together by path and line, and the last symbol is carried down.
    Of symbols on one line the first by ``ord`` counts. The unit of work is one file.
    """
    once = symbols.groupBy("path", F.col("line").cast("long").alias("line_no")).agg(F.min_by(F.struct("name", "kind"), "ord").alias("s"))
    marked = once.select("path", "line_no", F.lit(0).alias("__hit"), F.struct("s.name", "s.kind", F.col("line_no").alias("line")).alias("__s"))
    rest = [c for c in hits.columns if c not in ("path", "line_no")]
    probes = hits.select("path", "line_no", F.lit(1).alias("__hit"), F.struct(*rest).alias("__rest"))
    above = Window.partitionBy("path").orderBy("line_no", "__hit").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.unionByName(probes, allowMissingColumns=True).withColumn("__near", F.last("__s", ignorenulls=True).over(above))
    return both.filter(F.col("__hit") == 1).select("path", "line_no", *[F.col(f"__rest.{c}").alias(c) for c in rest], F.col("__near.name").alias("symbol"), F.col("__near.kind").alias("kind"), F.col("__near.line").alias("symbol_line"))


def references(texts: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Whole-word occurrences of ``name``, each with the symbol that it stands in; definitions are not left out.

    Only symbols of files that hold the name at all are sorted with the hits.
    """
    holding = texts.filter(F.col("text").contains(name)).select("path")
    return attribute(find_word(texts, name), symbols.join(holding, "path", "left_semi"))


def callers(texts: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """References outside the lines that define ``name``."""
    defs = symbols.filter(F.col("name") == name).select("path", F.col("line").cast("long").alias("line_no"))
    return references(texts, symbols, name).join(defs, ["path", "line_no"], "left_anti")


def definitions(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Symbols named ``name``, else ``.name``, else ``#name``: the first form with any hit wins whole."""
    forms = [name, "." + name, "#" + name]
    hits = symbols.filter(F.col("name").isin(*forms))
    if kind:
        hits = hits.filter(F.col("kind") == kind)
    rank = F.array_position(F.array(*map(F.lit, forms)), F.col("name"))
    best = hits.agg(F.min(rank).alias("__best"))
    return hits.join(F.broadcast(best), rank == F.col("__best")).drop("__best")


def definitions_page(symbols: DataFrame, name: str, offset: int = 0, limit: int = 50, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """One page of the definitions of ``name`` by path and line, each row with the exact total; optionally under a path."""
    found = definitions(symbols, name, kind)
    if prefix:
        found = found.filter(under(F.col("path"), prefix))
    total = found.agg(F.count("*")).scalar()
    return found.orderBy("path", "line", "ord").offset(offset).limit(limit).withColumn("total", total)


def references_page(texts: DataFrame, symbols: DataFrame, name: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of the references to ``name``, each row with the exact total; only the page is attributed to symbols."""
    hits = find_word(texts, name)
    rows = attribute(page(hits, offset, limit), symbols.join(texts.filter(F.col("text").contains(name)).select("path"), "path", "left_semi"))
    return rows.withColumn("total", hits.agg(F.count("*")).scalar())


def tests_page(texts: DataFrame, symbols: DataFrame, name: str, limit: int = 50, scan: int = 500) -> DataFrame:
    """The first references in tests: of the first ``scan`` in files with tests, those in test files or under test symbols."""
    narrow = _with_tests(texts, symbols)
    found = attribute(page(find_word(narrow, name), 0, scan), symbols.join(narrow.filter(F.col("text").contains(name)).select("path"), "path", "left_semi"))
    return found.filter(is_test(F.col("path")) | (F.col("kind") == "test")).orderBy("path", "line_no", "col").limit(limit)


def _with_tests(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Texts of test files, or with a symbol of kind ``test``."""
    titled = symbols.filter(F.col("kind") == "test").select("path").distinct().withColumn("__titled", F.lit(True))
    return texts.join(titled, "path", "left").filter(is_test(F.col("path")) | F.col("__titled").isNotNull()).drop("__titled")


def zero_hints(pattern: str, regex: bool = False) -> list[str]:
    """Why a search may have found nothing: a call, which is a symbol's question; signs of a pattern taken as they are."""
    hints = []
    if call := CALL_SHAPE.fullmatch(pattern):
        hints.append(f"{call[1]} looks like a symbol: ask for its definition or references")
    if not regex and PATTERN_SIGNS.search(pattern):
        try:
            re.compile(pattern)
            hints.append("the pattern was taken literally; search by pattern if it is one")
        except re.error:
            hints.append("not a valid pattern, so literal search is the right one")
    return hints


def fuzzy_names(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols by how their lower-cased name meets the query: rank 0 equal, 1 start, 2 part, 3 subsequence."""
    q, name = query.lower(), F.lower("name")
    rank = F.when(name == q, 0).when(name.startswith(q), 1).when(name.contains(q), 2).when(subsequence(name, q), 3)
    return symbols.withColumn("rank", rank.cast("long")).filter(F.col("rank").isNotNull())


def fuzzy_page(symbols: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """The best ``limit`` symbols of ``fuzzy_names``: by rank, then short names first, then by name."""
    return fuzzy_names(symbols, query).orderBy("rank", F.length("name"), "name").limit(limit)


def tests_of(texts: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """References in tests: in test files, or under a symbol of kind ``test``. The corpus is narrowed first."""
    return references(_with_tests(texts, symbols), symbols, name).filter(is_test(F.col("path")) | (F.col("kind") == "test"))


def concentration(hits: DataFrame, listed: DataFrame, least: int = 8, share: float = 0.6, long: int = 300) -> DataFrame:
    """One row: hits, the file with most of them, its part and lines, and whether the search sits in one long file."""
    by_file = hits.groupBy("path").agg(F.count("*").alias("n"))
    top = by_file.agg(F.sum("n").alias("total"), F.max(F.struct("n", F.col("path"))).alias("top"))
    top = top.select("total", F.col("top.path").alias("path"), F.col("top.n").alias("n"))
    flag = (F.col("total") >= least) & (F.col("n") >= F.ceil(F.col("total") * share)) & (F.col("n_lines") >= long)
    return top.join(listed.select("path", "n_lines"), "path").select("path", "total", "n", "n_lines", flag.alias("concentrated"))


def impact(hits: DataFrame, definition: str, cap: int = 80) -> DataFrame:
    """One row: files and test files other than the definition's that hold a hit, and whether hits reach ``cap``."""
    other = hits.select("path").distinct().filter(F.col("path") != definition)
    counts = other.agg(F.count_if(~is_test(F.col("path"))).alias("n_files"), F.count_if(is_test(F.col("path"))).alias("n_tests"))
    return counts.select("n_files", "n_tests", (hits.agg(F.count("*")).scalar() >= cap).alias("capped"))

