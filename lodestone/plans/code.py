"""Queries over source code: lexing, symbols, imports, blocks, pages of definitions, context, edits.

The driver's tables hold no code, so each document becomes a source file: every capitalized word of its text names one
declaration, comment or import, by turns of the forms in ``FORMS``. The SQL builds the same files, and states what each form
holds instead of parsing it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS
from lodestone.operators import changes, corpus, edits, graph, index, ledger, memory, rollup, rules, search
from lodestone.operators.lexer import scanned_lines
from lodestone.plans import views as v
from lodestone.sources.scratch import keep, table_path
from lodestone.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Lines of each form; @ stands for the word.
FORMS = (
    ("import { x } from './n_@';",),
    ("export class n_@ {", "  run_@(a) {", '    return "class Fake {";', "  }", "}"),
    ("/* class n_@ {", "   function n_@() { */"),
    ("export function n_@(a, b) {", "  const s = 'function no() {';", "}"),
    ("const n_@ = (x) => x + 1;",),
    ("def n_@(self):", "    pass"),
    ("// function n_@() {}",),
    ("export enum n_@ {", "  A, B", "}"),
)
#: (form, line, masked, depth) as a lexer leaves it; ~ stands for as many blanks as the word has letters.
_BLANK = {(f, k): re.sub("[^@]", " ", FORMS[f][k]).replace("@", "~") for f, k in ((2, 0), (2, 1), (6, 0))}
_STRING = {(0, 0): "import { x } from '    ~';", (1, 2): '    return "            ";', (3, 1): "  const s = '               ';"}
_DEPTH = {(1, 1): 1, (1, 2): 2, (1, 3): 2, (1, 4): 1, (3, 1): 1, (3, 2): 1, (7, 1): 1, (7, 2): 1}
#: (form, line, kind, beginning of the name, column, depth, lines of the block, whether an outline shows it).
SYMBOLS = (
    (1, 0, "class", "n_", 14, 0, 5, True), (1, 1, "method", "run_", 3, 1, 3, True), (3, 0, "function", "n_", 17, 0, 3, True),
    (4, 0, "function", "n_", 7, 0, 1, False), (5, 0, "function", "n_", 5, 0, 2, True), (7, 0, "enum", "n_", 13, 0, 3, True),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LINES = [(f, k, line, _BLANK.get((f, k), _STRING.get((f, k), line)), _DEPTH.get((f, k), 0)) for f, form in enumerate(FORMS) for k, line in enumerate(form)]
CODE_SQL = rf"""WITH w AS (SELECT source || CASE WHEN lang = 'es' THEN '/tests/' ELSE '/' || lang || '/' END || CAST(doc_id AS VARCHAR) || '.ts' AS path, doc_id, regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS ws FROM documents),
u AS (SELECT path, doc_id, CAST(unnest(range(len(ws))) AS BIGINT) AS j, unnest(ws) AS x FROM w), t(f, k, tpl, msk, depth) AS (VALUES {", ".join(f"({f}, {k}, {_quoted(line)}, {_quoted(masked)}, {depth})" for f, k, line, masked, depth in _LINES)}),
l AS (SELECT path, doc_id, j, f, k, x, replace(tpl, '@', x) AS line, replace(replace(msk, '@', x), '~', repeat(' ', length(x))) AS masked, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY path ORDER BY j, k) AS line_no FROM u JOIN t ON j % {len(FORMS)} = f),
e(f, k, kind, pre, col, sdepth, n, outlined) AS (VALUES {", ".join(f"({f}, {k}, '{kind}', '{pre}', {col}, {depth}, {n}, {outlined})" for f, k, kind, pre, col, depth, n, outlined in SYMBOLS)}),
s0 AS (SELECT path, pre || x AS name, kind, line_no AS line, CAST(col AS BIGINT) AS col, CAST(sdepth AS BIGINT) AS depth, n, outlined, l.line AS text, row_number() OVER (PARTITION BY path ORDER BY line_no) AS ord FROM l JOIN e USING (f, k)),
s AS (SELECT * FROM s0 WHERE ord <= {rules.SYMBOLS_A_FILE}), f AS (SELECT path, coalesce(string_agg(line, chr(10) ORDER BY line_no), '') AS text, count(line_no) AS n_lines FROM w LEFT JOIN l USING (path) GROUP BY path)"""


#: For statements that read lines and symbols several times.
_MATERIALIZED_SQL = CODE_SQL.replace("\nl AS (", "\nl AS MATERIALIZED (").replace("\ns AS (", "\ns AS MATERIALIZED (")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the source files that the documents stand for; as many files as documents."""
    return _as_code(table(spark, sf_dir, "documents").repartition("doc_id"))  # one row group of texts is one task, and lexing is dear


def _as_code(d: DataFrame) -> DataFrame:
    folder = F.when(F.col("lang") == "es", F.lit("/tests/")).otherwise(F.concat(F.lit("/"), "lang", F.lit("/")))
    words = F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"), F.lit(1))

    def unit(word, at):
        made = F.lit("\n".join(FORMS[-1]))
        for f, form in enumerate(FORMS[:-1]):
            made = F.when(at % len(FORMS) == f, F.lit("\n".join(form))).otherwise(made)
        return F.replace(made, F.lit("@"), word)

    return d.select(F.concat("source", folder, F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.array_join(F.transform(words, unit), "\n").alias("text"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("path", F.lit(0).cast("timestamp").alias("mtime"), "text")


#: Saved indexes of this application, by what their documents were when they were read.
_saved: dict[tuple, str] = {}


def _documents_key(spark: SparkSession, sf_dir: str) -> tuple:
    path = f"{sf_dir}/documents.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    said = files.getContentSummary(at)
    return spark.sparkContext.applicationId, path, files.getFileStatus(at).getModificationTime(), said.getLength(), said.getFileCount()


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The saved index of the files; written by the first question of an application, and again if the documents have changed."""
    key = _documents_key(spark, sf_dir)
    folder = _saved.get(key)
    if folder is None or not files_of(spark, folder):
        folder = _saved[key] = table_path(spark, "code-index")
        return index.write(_tree(spark, sf_dir), folder)
    return index.load(spark, folder, index.BUCKETS)


def files_of(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.parsed(code(spark, sf_dir))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.symbols(_parsed(spark, sf_dir))


@query(f"{CODE_SQL} SELECT path, line_no, masked, depth FROM l UNION ALL SELECT path, 1, '', 0 FROM w WHERE len(ws) = 0")
def code_lines_masked(spark, sf_dir):
    return scanned_lines(code(spark, sf_dir)).select("path", "line_no", "masked", "depth")


@query(f"{CODE_SQL} SELECT path, ord, name, kind, line, col, depth FROM s")
def code_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir).withColumn("ord", F.col("ord").cast("long"))


@query(f"{CODE_SQL} SELECT path, line_no AS line, './n_' || x AS module FROM l WHERE f = 0")
def code_imports(spark, sf_dir):
    return rules.imports(_parsed(spark, sf_dir))


@query(f"{CODE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS place FROM s0 WHERE outlined) SELECT path, line, kind, text FROM o WHERE place <= {rules.OUTLINE_A_FILE}")
def code_outline(spark, sf_dir):
    return rules.outline(_parsed(spark, sf_dir))


@query(f"{CODE_SQL}, b AS (SELECT s.path, s.line, s.name, s.line + s.n - 1 AS \"end\", CAST(s.n AS BIGINT) AS loc, sha256(string_agg(l.line, chr(10) ORDER BY l.line_no)) AS body_sha256 FROM s JOIN l ON s.path = l.path AND l.line_no BETWEEN s.line AND s.line + s.n - 1 GROUP BY ALL) SELECT * FROM b")
def code_blocks(spark, sf_dir):
    i = _index(spark, sf_dir)
    return index.symbol_bodies(i).select("path", "line", "name", "end", "loc", F.sha2("body", 256).alias("body_sha256"))


@query(f"{CODE_SQL} SELECT path, count(*) FILTER (WHERE regexp_matches(trim(line), '^(//|#|\\*|/\\*|--)')) AS n_comments, count(*) AS n_lines FROM l GROUP BY path")
def code_comment_lines(spark, sf_dir):
    rows = corpus.lines(code(spark, sf_dir).filter(F.col("text") != ""))
    return rows.groupBy("path").agg(F.count_if(rules.is_comment(F.col("line"))).alias("n_comments"), F.count("*").alias("n_lines"))


@query(f"{CODE_SQL} SELECT kind, count(*) AS n FROM s GROUP BY kind")
def code_symbol_kinds(spark, sf_dir):
    return _symbols(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND lang <> 'es' GROUP BY source, lang")
def tree_read(spark, sf_dir):
    """The ids of all documents as a tree of files by source and language; the folders of one language are ignored."""
    from lodestone.sources.config import Config
    from lodestone.sources.tree import source_tree

    root = table_path(spark, "tree")
    d = table(spark, sf_dir, "documents").filter(F.col("source").isNotNull() & F.col("lang").isNotNull())
    d.select("source", "lang", F.col("doc_id").cast("string")).write.partitionBy("source", "lang").option("maxRecordsPerFile", 50_000).text(root)
    files, _ = source_tree(spark, root, Config(ignored={"lang=es"}, extensions={".txt"}))
    folder = F.split("path", "/")
    rows = files.select(F.substring(folder[0], 8, 1000).alias("source"), F.substring(folder[1], 6, 1000).alias("lang"), F.explode(F.split("text", "\n")).alias("id")).filter("id <> ''")
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


@query(f"{CODE_SQL}, n AS (SELECT path, count(*) AS ns FROM s GROUP BY path), k AS (SELECT path, greatest(n_lines, 1) AS n_lines, coalesce(ns, 0) AS ns, string_split(path, '/') AS parts FROM f LEFT JOIN n USING (path)) SELECT array_to_string(parts[1:greatest(1, least(2, len(parts) - 1))], '/') AS directory, count(*) AS n_files, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(ns) AS BIGINT) AS n_symbols FROM k GROUP BY 1")
def code_rollup(spark, sf_dir):
    i = _index(spark, sf_dir)
    n = i.symbols.groupBy("path").agg(F.count("*").alias("n_symbols"))
    return rollup.by_directory(i.files.join(n, "path", "left").fillna(0, ["n_symbols"]), 2)


@query(f"{CODE_SQL}, b AS (SELECT path, row_number() OVER (ORDER BY rank, length(name), name, path, line) AS i, name FROM (SELECT *, CASE WHEN lower(name) = 'run_the' THEN 0 WHEN starts_with(lower(name), 'run_the') THEN 1 WHEN contains(lower(name), 'run_the') THEN 2 WHEN regexp_matches(lower(name), 'r.*u.*n.*_.*t.*h.*e') THEN 3 END AS rank FROM s) WHERE rank IS NOT NULL) SELECT name, count(*) AS n FROM b WHERE i <= 25 GROUP BY name")
def fuzzy_page_names(spark, sf_dir):
    return search.fuzzy_page(_symbols(spark, sf_dir), "run_The").groupBy("name").agg(F.count("*").alias("n"))


@query(f"{CODE_SQL} SELECT path FROM w WHERE doc_id % 6 IN (1, 2, 3)")
def drifted_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.when(F.col("lang") == "es", F.lit("/tests/")).otherwise(F.concat(F.lit("/"), "lang", F.lit("/"))), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.sha2("text", 256).alias("content_hash"))
    odd = F.col("doc_id") % 6
    # One sixth is newer, one has another text at the same time, one is gone.
    scan = d.filter(odd != 3).select("path", F.when(odd == 1, 9).otherwise(5).alias("mtime"), F.when(odd == 2, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return corpus.drifted_paths(scan, d.select("path", F.lit(5).alias("mtime"), "content_hash"))


@query(f"{CODE_SQL} SELECT path, sha256(text) AS text_sha256 FROM f WHERE starts_with(path, 'src1/')")
def snapshot_of_files(spark, sf_dir):
    texts = code(spark, sf_dir)
    store = table_path(spark, "snapshots")
    for _ in range(3):
        path = changes.snapshot(texts, texts.filter(F.col("path").startswith("src1/")), store, keep=2)
    return spark.read.parquet(path).select("path", F.sha2("text", 256).alias("text_sha256"))


def _posted(spark: SparkSession, sf_dir: str) -> index.Index:
    """The saved index with postings of three-character strings; they are made by the first search of an application."""
    found = _index(spark, sf_dir)
    if found.posted is None:
        folder = _saved[_documents_key(spark, sf_dir)]
        index.save_grams(spark, folder)
        found = index.load(spark, folder, index.BUCKETS)
    return found


@query(f"{CODE_SQL} SELECT path, line_no, CAST(strpos(line, 'run_Re') AS BIGINT) AS col, trim(line) AS text FROM l WHERE contains(line, 'run_Re')")
def indexed_literal(spark, sf_dir):
    return index.find_literal(_posted(spark, sf_dir), "run_Re")


@query(f"{CODE_SQL} SELECT path, line_no, CAST(strpos(lower(line), 'enum n_an') AS BIGINT) AS col, trim(line) AS text FROM l WHERE contains(lower(line), 'enum n_an')")
def indexed_ignore_case(spark, sf_dir):
    return index.find_literal(_posted(spark, sf_dir), "Enum N_an", ignore_case=True)


@query(f"{CODE_SQL} SELECT path, line_no, CAST(strpos(line, regexp_extract(line, 'class n_[A-M][a-z]*n ')) AS BIGINT) AS col, trim(line) AS text FROM l WHERE regexp_matches(line, 'class n_[A-M][a-z]*n ')")
def indexed_pattern(spark, sf_dir):
    return index.find_pattern(_posted(spark, sf_dir), "class n_[A-M][a-z]*n ")


_DEFINITIONS = "(SELECT * FROM s WHERE name = 'n_The' AND kind = 'class')"


@query(f"{CODE_SQL} SELECT path, line, name, kind, (SELECT count(*) FROM {_DEFINITIONS}) AS total FROM {_DEFINITIONS} ORDER BY path, line OFFSET 5 LIMIT 20")
def definitions_page(spark, sf_dir):
    return index.definitions_page(_index(spark, sf_dir), "n_The", 5, 20, "class").select("path", "line", "name", "kind", "total")


@query(f"{CODE_SQL}, d AS (SELECT * FROM s WHERE name = 'n_The' AND starts_with(path, 'src1/')) SELECT path, line, name, kind, (SELECT count(*) FROM d) AS total FROM d ORDER BY path, line LIMIT 50")
def definitions_page_scoped(spark, sf_dir):
    return index.definitions_page(_index(spark, sf_dir), "n_The", prefix="src1").select("path", "line", "name", "kind", "total")


def _hits_sql(word: str) -> str:
    """Hits of a name (h), and the symbol at or above each (r)."""
    return f"{CODE_SQL}, h AS (SELECT path, line_no, CAST(strpos(line, 'n_{word}') AS BIGINT) AS col FROM l WHERE x = '{word}' AND strpos(line, 'n_{word}') > 0 AND NOT regexp_matches(line, 'run_{word}')), r AS (SELECT h.path, h.line_no, h.col, s.name AS symbol, s.kind FROM h ASOF LEFT JOIN s ON h.path = s.path AND h.line_no >= s.line)"


_HITS_SQL = _hits_sql("The")


@query(f"{_HITS_SQL} SELECT path, line_no, col, coalesce(symbol, '') AS symbol, (SELECT count(*) FROM h) AS total FROM r ORDER BY path, line_no, col OFFSET 10 LIMIT 20")
def references_page(spark, sf_dir):
    return index.references_page(_index(spark, sf_dir), "n_The", 10, 20).select("path", "line_no", "col", F.coalesce("symbol", F.lit("")).alias("symbol"), "total")


@query(f"{_hits_sql('Las')} SELECT path, line_no, col, coalesce(symbol, '') AS symbol FROM (SELECT * FROM r WHERE contains(path, '/tests/') ORDER BY path, line_no, col LIMIT 500) ORDER BY path, line_no, col LIMIT 50")
def tests_page(spark, sf_dir):
    return index.tests_page(_index(spark, sf_dir), "n_Las").select("path", "line_no", "col", F.coalesce("symbol", F.lit("")).alias("symbol"))


@query(f"{_HITS_SQL}, q AS (SELECT * FROM h WHERE (path, line_no) NOT IN (SELECT (path, line) FROM s WHERE name = 'n_The')), z AS (SELECT q.path, q.line_no, r.symbol, min(q.col) AS col FROM q JOIN r USING (path, line_no, col) GROUP BY ALL) SELECT path, line_no, coalesce(symbol, '') AS symbol, col FROM z ORDER BY path, line_no LIMIT 12")
def context_callers(spark, sf_dir):
    found = index.get_context(_index(spark, sf_dir), "n_The", sections=("callers",))["callers"]
    return found.select("path", "line_no", F.coalesce("symbol", F.lit("")).alias("symbol"), "col")


@query(f"{CODE_SQL} SELECT DISTINCT path AS src, './n_' || x AS module FROM l WHERE f = 0 AND path IN (SELECT path FROM s WHERE name = 'n_The')")
def context_external(spark, sf_dir):
    return index.get_context(_index(spark, sf_dir), "n_The", sections=("external",))["external"]


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _terms_sql(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({column}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-.]', ' ', 'g')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP_SQL}))"


_INTENT = "run class erth"
_INTENT_SQL = f"""{CODE_SQL}, d AS (SELECT path, line, name, kind, list_concat(list_concat({_terms_sql("name")}, [kind]), {_terms_sql("regexp_extract(path, '[^/]*$', 0)")}) AS ts FROM s), m AS (SELECT CAST(count(*) AS DOUBLE) AS nn, avg(CAST(len(ts) AS DOUBLE)) AS mean FROM d),
q(term) AS (VALUES ('run'), ('class'), ('erth')), y0 AS (SELECT term, (SELECT CAST(count(*) AS DOUBLE) FROM d WHERE list_contains(ts, term)) AS df FROM q),
y AS (SELECT path, line, name, kind, ln(1 + (nn - df + 0.5) / (df + 0.5)) AS idf, CAST(len(list_filter(ts, lambda t: t = term)) AS DOUBLE) AS tf, len(ts) AS dl, mean FROM d, y0, m WHERE list_contains(ts, term)),
z AS (SELECT path, line, name, kind, sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM y GROUP BY ALL)"""


@query(f"{_INTENT_SQL} SELECT path, line, name, tier, round(score, 6) AS score FROM (SELECT *, CASE WHEN kind = 'test' THEN 1 ELSE 0 END AS tier FROM z) ORDER BY tier, round(score, 9) DESC, path, line LIMIT 10")
def intent_search(spark, sf_dir):
    found = index.search_intent(_index(spark, sf_dir), _INTENT)
    return found.select("path", "line", "name", "tier", F.round("score", 6).alias("score"))


@query(f"""{CODE_SQL}, a AS (SELECT count(*) AS n_files, CAST(sum(greatest(n_lines, 1)) AS BIGINT) AS n_lines FROM f) SELECT n_files, n_lines, (SELECT count(*) FROM s) AS n_symbols FROM a""")
def brief_counts(spark, sf_dir):
    return index.brief(_index(spark, sf_dir), _journal(spark, sf_dir))["counts"]


@query(f"{CODE_SQL} SELECT '.ts' AS extension, count(*) AS n FROM f")
def brief_extensions(spark, sf_dir):
    return index.brief(_index(spark, sf_dir), _journal(spark, sf_dir))["extensions"]


#: Event types as the tools of a journal.
_TOOLS = {"view": "read_lines", "click": "search_code", "purchase": "find_definition", "signup": "get_context", "error": "stats"}
_JOURNAL_SQL = f"WITH j AS (SELECT event_id AS seq, CASE event_type {' '.join(f'WHEN {_quoted(a)} THEN {_quoted(b)}' for a, b in _TOOLS.items())} ELSE event_type END AS tool, 'u' || CAST(user_id % 40 AS VARCHAR) || ' v' || CAST(event_id % 7 AS VARCHAR) AS hint FROM events)"


def _journal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tool = F.col("event_type")
    for a, b in _TOOLS.items():
        tool = F.when(F.col("event_type") == a, b).otherwise(tool)
    hint = F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"), F.lit(" v"), (F.col("event_id") % 7).cast("string"))
    return e.select(F.col("event_id").alias("seq"), tool.alias("tool"), hint.alias("hint"))


def _top_sql(rows: str, column: str, n: int) -> str:
    return f"(SELECT {column} AS value, count(*) AS n FROM {rows} GROUP BY ALL ORDER BY n DESC, min(seq) LIMIT {n})"


@query(f"""{_JOURNAL_SQL}, r AS (SELECT * FROM j ORDER BY seq DESC LIMIT 200), rw AS (SELECT tool, seq * 1000 + unnest([0, 1]) AS seq, unnest(string_split(hint, ' ')) AS word FROM r WHERE tool NOT IN ('read_lines', 'search_code', 'get_file_skeleton', 'outline_file'))
SELECT 'files' AS section, value, n FROM {_top_sql("(SELECT * FROM r WHERE tool = 'read_lines')", 'hint', 10)} UNION ALL SELECT 'symbols', value, n FROM {_top_sql('rw', 'word', 10)} UNION ALL SELECT 'tools', value, n FROM {_top_sql('r', 'tool', 8)}""")
def recap_sections(spark, sf_dir):
    found = ledger.recap(_journal(spark, sf_dir))
    parts = [found[k].select(F.lit(k).alias("section"), "value", "n") for k in ("files", "symbols", "tools")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"{_JOURNAL_SQL}, r AS (SELECT * FROM j WHERE tool NOT IN ({', '.join(map(_quoted, ledger.JOURNAL_SKIP))}) ORDER BY seq DESC LIMIT 200) SELECT value, n FROM {_top_sql('r', 'tool', 8)}")
def brief_tools(spark, sf_dir):
    return index.brief(_index(spark, sf_dir), _journal(spark, sf_dir))["tools"].select("value", "n")


@query(f"""{_HITS_SQL}, o AS (SELECT DISTINCT path FROM h WHERE path <> 'src1/en/1.ts'), c AS (SELECT count(*) FILTER (WHERE NOT contains(path, '/tests/')) AS nf, count(*) FILTER (WHERE contains(path, '/tests/')) AS nt FROM o) SELECT CASE WHEN nf = 0 AND nt = 0 THEN 'no other references' ELSE 'referenced in ' || nf || CASE WHEN (SELECT count(*) FROM h) >= 80 THEN '+' ELSE '' END || ' other file(s), ' || nt || ' test file(s)' END AS line FROM c""")
def impact_line(spark, sf_dir):
    hits = search.find_word(code(spark, sf_dir), "n_The")
    return ledger.impact_line(search.impact(hits, "src1/en/1.ts"))


@query(f"""{CODE_SQL}, p AS (SELECT path, j, CASE WHEN f = 3 THEN 'function replaced() {{' || chr(10) || '}}' ELSE string_agg(line, chr(10) ORDER BY k) END AS text FROM l GROUP BY path, j, f) SELECT path, sha256(string_agg(text, chr(10) ORDER BY j)) AS text_sha256 FROM p GROUP BY path HAVING count(*) > 3""")
def replaced_blocks(spark, sf_dir):
    i = _index(spark, sf_dir)
    plan = i.lines.filter(F.col("line").startswith("export function")).select("path", F.col("line_no").alias("line"), F.lit("function replaced() {\n}").alias("body"))
    return index.replace_symbols(i, plan).select("path", F.sha2("text", 256).alias("text_sha256"))


def _inserted_sql(before: bool) -> str:
    note = "'// note'"
    made = f"{note} || chr(10) || text" if before else f"text || chr(10) || {note}"
    return f"""{CODE_SQL}, p AS (SELECT path, j, f, string_agg(line, chr(10) ORDER BY k) AS text FROM l GROUP BY path, j, f) SELECT path, sha256(string_agg(CASE WHEN f = 7 THEN {made} ELSE text END, chr(10) ORDER BY j)) AS text_sha256 FROM p GROUP BY path HAVING count(*) > 7"""


def _inserted(spark, sf_dir, after: bool):
    i = _index(spark, sf_dir)
    plan = i.lines.filter(F.col("line").startswith("export enum")).select("path", F.col("line_no").alias("line"), F.lit("// note").alias("body"))
    return index.insert_at_symbols(i, plan, after).select("path", F.sha2("text", 256).alias("text_sha256"))


@query(_inserted_sql(True))
def inserted_before(spark, sf_dir):
    return _inserted(spark, sf_dir, False)


@query(_inserted_sql(False))
def inserted_after(spark, sf_dir):
    return _inserted(spark, sf_dir, True)


@query(f"""{_MATERIALIZED_SQL}, a AS (SELECT path, min(line) AS line FROM s WHERE name = 'n_The' AND kind = 'class' GROUP BY path ORDER BY path LIMIT 1), n AS (SELECT min(s.line) AS after FROM s, a WHERE s.path = a.path AND s.line > a.line + 4) SELECT l.path, l.line_no, l.line FROM l, a, n WHERE l.path = a.path AND l.line_no BETWEEN a.line - 2 AND least(a.line + 6, coalesce(after - 1, a.line + 6))""")
def symbol_context(spark, sf_dir):
    i = _index(spark, sf_dir)
    at = index.definitions_page(i, "n_The", 0, 1, "class").first()
    return index.symbol_context(i, path=at["path"], line=at["line"])


@query(f"""{CODE_SQL}, z AS (SELECT path, line, name, n, 0 AS tier FROM s WHERE name IN ('run_Erth', 'run_The') AND kind = 'method'), b AS (SELECT z.path, z.line, z.name, string_agg(l.line, chr(10) ORDER BY l.line_no) AS body FROM z JOIN l ON z.path = l.path AND l.line_no BETWEEN z.line AND z.line + z.n - 1 GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY path, line) AS ord FROM b), k AS (SELECT *, sum(length(body)) OVER (ORDER BY ord) AS used FROM o) SELECT path, line, name, body, ord FROM k WHERE used <= 6000 OR ord = 1""")
def bodies_within_budget(spark, sf_dir):
    i = _index(spark, sf_dir)
    wanted = i.symbols.filter(F.col("name").isin("run_Erth", "run_The") & (F.col("kind") == "method"))
    return index.within_budget(index.symbol_bodies(i, wanted.select("path", "line", "name")), 6000, ["path", "line"])


@query(f"{CODE_SQL} SELECT name, count(*) AS n FROM (SELECT 'texts' AS name FROM f UNION ALL SELECT 'files' FROM f UNION ALL SELECT 'symbols' FROM s UNION ALL SELECT 'imports' FROM l WHERE f = 0) GROUP BY name")
def index_saved_and_loaded(spark, sf_dir):
    again = index.write(_tree(spark, sf_dir), table_path(spark, "saved-index"))
    parts = [getattr(again, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("texts", "files", "symbols", "imports")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


#: Another day's tree: changed, removed and new files.
@query(f"{CODE_SQL}, g AS (SELECT w.path, w.doc_id, len(ws) FROM w) SELECT CASE WHEN doc_id % 5 = 1 THEN 'removed' WHEN doc_id % 5 = 2 THEN 'changed' WHEN doc_id % 5 = 3 THEN 'new' ELSE 'reused' END AS action, count(*) AS n, CAST(sum(CASE doc_id % 5 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE coalesce(ns, 0) END) AS BIGINT) AS n_symbols FROM g LEFT JOIN (SELECT path, count(*) AS ns FROM s GROUP BY path) USING (path) GROUP BY 1")
def index_refreshed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.when(F.col("lang") == "es", F.lit("/tests/")).otherwise(F.concat(F.lit("/"), "lang", F.lit("/"))), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"))
    tree = code(spark, sf_dir).join(d, "path").select("path", "doc_id", F.lit(0).cast("timestamp").alias("mtime"), "text")
    odd = F.col("doc_id") % 5
    old = index.build(tree.filter(odd != 3).drop("doc_id"))
    changed = odd == 2
    now = tree.filter(odd != 1).select("path", F.when(changed, F.lit(9)).otherwise(F.lit(0)).cast("timestamp").alias("mtime"), F.when(changed, F.lit("class only {\n}")).otherwise(F.col("text")).alias("text"))
    new, actions = index.refresh(old, now)
    n = new.symbols.groupBy("path").agg(F.count("*").alias("ns"))
    return actions.join(n, "path", "left").groupBy("action").agg(F.count("*").alias("n"), F.sum(F.coalesce("ns", F.lit(0))).alias("n_symbols"))


@query(f"""{CODE_SQL}, c AS (SELECT path, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id % 50 END AS added, doc_id % 7 AS deleted, doc_id FROM w WHERE doc_id % 4 <> 3), a AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'M' END AS status, CAST(added AS BIGINT) AS added, CAST(deleted AS BIGINT) AS deleted, [] AS symbols FROM c),
n AS (SELECT w.path, '?' AS status, CAST(greatest(f.n_lines, 1) AS BIGINT) AS added, 0 AS deleted, coalesce(y.symbols, []) AS symbols FROM w JOIN f USING (path) LEFT JOIN (SELECT path, list(kind || ' ' || name ORDER BY ord) AS symbols FROM s WHERE ord <= 12 GROUP BY path) y USING (path) WHERE doc_id % 4 = 3)
SELECT path, status, added, deleted, array_to_string(symbols, ',') AS symbols FROM (SELECT * FROM a UNION ALL SELECT * FROM n) ORDER BY added + deleted DESC, path LIMIT 30""")
def changes_with_untracked(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.when(F.col("lang") == "es", F.lit("/tests/")).otherwise(F.concat(F.lit("/"), "lang", F.lit("/"))), F.col("doc_id").cast("string"), F.lit(".ts"))
    known = d.select(path.alias("path"), "doc_id").filter(F.col("doc_id") % 4 != 3)
    # As git writes them: counts, where a binary file has none, and one line of status each; every sixth file was renamed.
    added = F.when(F.col("doc_id") % 9 == 0, F.lit("-")).otherwise((F.col("doc_id") % 50).cast("string"))
    name = F.when(F.col("doc_id") % 6 == 1, F.concat(F.lit("{old => "), F.regexp_extract("path", "^[^/]*", 0), F.lit("}"), F.regexp_extract("path", "^[^/]*(.*)$", 1))).otherwise(F.col("path"))
    counts = edits.numstat(known.select(F.concat_ws("\t", added, (F.col("doc_id") % 7).cast("string"), name).alias("text")))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("A\t"), "path")).otherwise(F.when(F.col("doc_id") % 6 == 1, F.concat(F.lit("M100\told.ts\t"), "path")).otherwise(F.concat(F.lit("M\t"), "path")))
    status = edits.name_status(known.select(said.alias("text")))
    i = _index(spark, sf_dir)
    untracked = i.files.join(d.filter(F.col("doc_id") % 4 == 3).select(path.alias("path")), "path", "left_semi").select("path", "n_lines")
    touched = spark.createDataFrame([], "path string, line long")
    found = changes.changed_files(counts, status, touched, i.symbols, untracked, 30)
    return found.select("path", "status", "added", "deleted", F.array_join("symbols", ",").alias("symbols"))


#: A note about each document's first word.
_NOTES_SQL = f"{CODE_SQL}, o AS (SELECT doc_id AS id, path, ws[1] AS x FROM w WHERE len(ws) > 0)"


def _notes(spark, sf_dir):
    word = F.regexp_extract("text", "([A-Z][a-z]{2,})", 1)
    text = F.concat(F.lit("Mend `n_"), word, F.lit("` of lib/"), word, F.lit(".ts: call run_"), word, F.lit(" (2) at n_"), word, F.lit(":12"))
    return table(spark, sf_dir, "documents").filter(word != "").select(F.col("doc_id").alias("id"), text.alias("text"))


@query(f"{_NOTES_SQL} SELECT id, 'file' AS kind, 'lib/' || x || '.ts' AS name FROM o UNION ALL SELECT id, 'symbol', 'n_' || x FROM o UNION ALL SELECT id, 'symbol', 'run_' || x FROM o")
def fact_mentions(spark, sf_dir):
    return memory.mentions(_notes(spark, sf_dir))


@query(f"{_NOTES_SQL} SELECT id, CASE WHEN x IN (SELECT x FROM u WHERE j % 16 = 1) THEN 'ok' ELSE 'stale' END AS flag FROM o")
def fact_files_live(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    words = table(spark, sf_dir, "documents").select(F.posexplode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"), F.lit(1))).alias("j", "x")).filter(F.col("j") % 16 == 1)
    live = words.select(F.lit("file").alias("kind"), F.concat(F.lit("elsewhere/"), "x", F.lit(".ts")).alias("name"))
    return memory.staleness(notes, memory.mentions(notes), live)


@query("SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, length(text) AS chars FROM conversations ORDER BY turn DESC, id DESC LIMIT 3")
def newest_facts(spark, sf_dir):
    return memory.recall(v.facts(spark, sf_dir).withColumn("created", F.col("turn"))).select("id", "chars")


@query(f"{CODE_SQL} SELECT path FROM f WHERE starts_with(path, 'src1/') OR starts_with(path, 'src2/tests/')")
def covered_paths(spark, sf_dir):
    return corpus.covered(code(spark, sf_dir).select("path"), ["src1", "src2/tests"])


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 2 = 0")
def stale_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    at = lambda c: F.timestamp_millis(c.cast("long"))
    scan = d.filter(F.col("doc_id") % 5 != 0).select("path", at(F.lit(1000) + F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)).otherwise(0)).alias("mtime"))
    return corpus.stale_paths(scan, d.select("path", at(F.lit(1000)).alias("mtime")))


@query("""WITH e AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem), c AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS i FROM e QUALIFY i <= 121), a AS (SELECT * FROM c WHERE i <= 120),
o AS (SELECT node, min(place) AS place FROM (SELECT src AS node, 2 * i AS place FROM a UNION ALL SELECT dst, 2 * i + 1 FROM a) GROUP BY node), n AS (SELECT node, place, row_number() OVER (ORDER BY place) - 1 AS k FROM o),
g AS (SELECT i, '  n' || x.k || CASE WHEN x.place = 2 * i THEN '["' || src || '"]' ELSE '' END || ' --> n' || y.k || CASE WHEN y.place = 2 * i + 1 THEN '["' || dst || '"]' ELSE '' END AS line FROM a JOIN n x ON x.node = src JOIN n y ON y.node = dst)
SELECT 'graph LR' || chr(10) || string_agg(line, chr(10) ORDER BY i) || CASE WHEN (SELECT count(*) FROM c) > 120 THEN chr(10) || '  %% more edges not shown' ELSE '' END AS text FROM g""")
def mermaid_text(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    return spark.createDataFrame([(graph.mermaid(edges),)], "text string")


def _stream(spark, sf_dir, name: str) -> DataFrame:
    """A table of the driver as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(path)


def _drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream gives when all that is there has been read: the last output of each micro-batch, in a scratch table."""
    from lodestone.streaming.ledger import typed_state

    out: list[DataFrame] = []
    run = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: out.append(keep(batch, name))).trigger(availableNow=True)
    with typed_state(stream.sparkSession):
        going = run.option("checkpointLocation", f"{table_path(stream.sparkSession, name)}-state").start()
    going.awaitTermination()
    return out[-1] if mode == "complete" else _all(out)


def _all(frames: list[DataFrame]) -> DataFrame:
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found


@query(f"WITH {v.CALLS_SQL} SELECT tool, count(*) AS calls, CAST(sum(chars) AS BIGINT) AS chars, max(chars) AS max_chars, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10') AS calls_since FROM c GROUP BY tool")
def stream_usage(spark, sf_dir):
    from lodestone.streaming import ledger as streams

    e = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.floor(F.col("value") * 100).cast("long").alias("chars"), "ts")
    return _drained(streams.usage_since_stream(e, "2024-01-10"), "complete", "usage").select("tool", "calls", "chars", "max_chars", "calls_since")


@query(f"WITH {v.CALLS_SQL}, o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS opens FROM c WINDOW w AS (PARTITION BY key ORDER BY ts, seq)), n AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY ts, seq) AS session FROM o) SELECT key, count(DISTINCT session) AS sessions, count(*) AS calls FROM n GROUP BY key")
def stream_sessions(spark, sf_dir):
    from lodestone.streaming import ledger as streams

    e = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return _drained(streams.session_stream(e), "complete", "sessions").groupBy("key").agg(F.count("*").alias("sessions"), F.sum("calls").alias("calls"))


_BLIND_SQL = f"WITH {v.CALLS_SQL}, o AS (SELECT *, coalesce(sum((tool = 'purchase')::INT) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM c), g AS (SELECT key, span, max((tool = 'purchase')::INT) AS w, max((tool = 'view')::INT) AS k FROM o GROUP BY key, span)"


@query(f"{_BLIND_SQL} SELECT key, CAST(sum(w) AS BIGINT) AS writes, count(*) FILTER (WHERE w = 1 AND k = 0) AS blind FROM g GROUP BY key")
def stream_blind_writes(spark, sf_dir):
    from lodestone.streaming import ledger as streams

    e = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("tool"))
    # A key's last state is the one with most writes seen.
    rows = _drained(streams.blind_write_stream(e, "purchase", "view"), "update", "blind-writes")
    return rows.groupBy("key").agg(F.max("writes").alias("writes"), F.max("blind").alias("blind"))


@query(f"""WITH {v.CALLS_SQL}, o AS (SELECT CAST(key AS VARCHAR) || ':' || tool AS key, ts, seq, json_extract_string(props, '$.k')::INT // 25 AS signature, chars FROM c), m AS (SELECT *, CASE WHEN coalesce(signature <> lag(signature) OVER w OR lag(chars) OVER w < 800, true) THEN 1 ELSE 0 END AS fresh FROM o WINDOW w AS (PARTITION BY key ORDER BY ts, seq)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts, seq) AS run FROM m),
x AS (SELECT key, ts, seq, row_number() OVER (PARTITION BY key, run ORDER BY ts, seq) % 2 = 0 AS suppressed FROM r) SELECT key, seq, suppressed FROM x WHERE ts <= (SELECT max(ts) FROM c) - INTERVAL 1 HOUR""")
def stream_repeats(spark, sf_dir):
    """Rows of the stream's last hour still wait for others that may come late."""
    from lodestone.streaming import ledger as streams

    signature = F.expr("cast(get_json_object(props, '$.k') as int) div 25").cast("int").alias("signature")
    e = _stream(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), signature, F.floor(F.col("value") * 100).cast("long").alias("chars"))
    return _drained(streams.repeat_stream(e, lateness="1 hour"), "append", "repeats")


@query(f"WITH {v.CALLS_SQL} SELECT 'Edit' AS tool, count(*) AS n, count(*) FILTER (WHERE chars % 2 = 0) AS fired FROM c WHERE tool = 'purchase'")
def hook_log_read(spark, sf_dir):
    from lodestone.sources.tree import hook_events

    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    chars = F.floor(F.col("value") * 100).cast("long")
    rows = e.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.lit("Edit").alias("tool"), chars.alias("bytes"), (chars % 2 == 0).alias("fired"))
    path = table_path(spark, "hooks")
    rows.select(F.to_json(F.struct("t", "tool", "bytes", "fired"))).write.text(path)
    return hook_events(spark, path).groupBy("tool").agg(F.count("*").alias("n"), F.count_if("fired").alias("fired"))


@query(f"{CODE_SQL}, n AS (SELECT path, count(*) AS ns FROM s0 GROUP BY path) SELECT coalesce(ns, 0) > 12 AS truncated, count(*) AS n_files, CAST(sum(least(coalesce(ns, 0), 12)) AS BIGINT) AS n_symbols FROM w LEFT JOIN n USING (path) GROUP BY 1")
def truncated_files(spark, sf_dir):
    files = rules.parsed(code(spark, sf_dir), most=12)
    return files.groupBy("truncated").agg(F.count("*").alias("n_files"), F.sum(F.size("symbols")).alias("n_symbols"))


@query(f"""{_INTENT_SQL}, h AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, path, line) AS i FROM z QUALIFY i <= 8), b AS (SELECT h.path, h.line, h.name, h.i, string_agg(l.line, chr(10) ORDER BY l.line_no) AS body FROM h JOIN s USING (path, line, name) JOIN l ON l.path = h.path AND l.line_no BETWEEN h.line AND h.line + s.n - 1 WHERE h.i <= 3 GROUP BY ALL)
SELECT 'relevant' AS section, path, line, name, '' AS body FROM h WHERE i <= 3 OR score >= 0.3 * (SELECT max(score) FROM h) UNION ALL SELECT 'body', path, line, name, body FROM b""")
def context_packed(spark, sf_dir):
    found, _, bodies = index.context_pack(_index(spark, sf_dir), _INTENT)
    one = found.select(F.lit("relevant").alias("section"), "path", "line", "name", F.lit("").alias("body"))
    return one.unionByName(bodies.select(F.lit("body").alias("section"), "path", "line", "name", "body"))


@query(f"{CODE_SQL}, m AS (SELECT path, count(*) AS ns FROM s GROUP BY path) SELECT doc_id % 5 AS turn, count(*) AS n_files, CAST(sum(CASE doc_id % 5 WHEN 2 THEN 1 ELSE coalesce(ns, 0) END) AS BIGINT) AS n_symbols FROM w LEFT JOIN m USING (path) WHERE doc_id % 5 <> 1 GROUP BY 1")
def stream_index_update(spark, sf_dir):
    """Removed, changed and new files arrive in a stream, and once more; the saved index is that of the last tree."""
    from lodestone.streaming import ledger as streams

    turn = F.regexp_extract("path", r"(\d+)\.ts$", 1).cast("long") % 5
    folder = table_path(spark, "streamed-index")
    index.write(_tree(spark, sf_dir).filter(turn != 3), folder)
    text = F.when(turn == 1, F.lit(None)).when(turn == 2, F.lit("class only {\n}")).otherwise(F.col("text"))
    for k in (1, 2):
        changes_ = _as_code(_stream(spark, sf_dir, "documents")).filter(turn.isin(1, 2, 3)).select("path", F.lit(9).cast("timestamp").alias("mtime"), text.alias("text"))
        streams.index_stream(changes_, folder, f"{table_path(spark, 'index-stream')}-{k}").awaitTermination()
    rows = index.load(spark, folder, index.BUCKETS).rows
    return rows.groupBy(turn.alias("turn")).agg(F.count("*").alias("n_files"), F.sum(F.size("symbols")).alias("n_symbols"))


@query("""WITH l AS (SELECT doc_id, line, row_number() OVER () AS id FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, id, line, unnest(range(1, length(line) + 2)) AS col FROM l), h AS (SELECT doc_id, col, row_number() OVER (PARTITION BY id ORDER BY col) AS i FROM p WHERE col = 1 OR NOT (substr(line, col, 1) = 'e' AND substr(line, col - 1, 1) = 'e'))
SELECT CAST(doc_id AS VARCHAR) AS path, count(*) AS n, CAST(sum(col) AS BIGINT) AS cols FROM h WHERE i <= 10 GROUP BY 1""")
def search_zero_width(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return search.find_each(d, "e*").groupBy("path").agg(F.count("*").alias("n"), F.sum("col").alias("cols"))
