"""Queries over files and lines: scans, rejection, refresh, search, ranking, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths, text
from lodestone.operators import corpus, rank, rollup, search, spans
from lodestone.plans import views as v
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


#: The index of an earlier day, against which the scan is compared: some files unknown to it, some with another hash or time, some since removed.
_PRIOR_SQL = """n AS (SELECT path, CASE WHEN doc_id % 7 = 3 THEN 1 ELSE 0 END AS mtime, sha256(text) AS content_hash, doc_id FROM f),
p AS (SELECT path, CASE WHEN doc_id % 11 IN (4, 5) THEN 9 ELSE mtime END AS mtime, CASE WHEN doc_id % 11 = 4 THEN 'old' ELSE content_hash END AS content_hash FROM n WHERE doc_id % 13 <> 6),
t AS (SELECT path, mtime, content_hash FROM n WHERE doc_id % 17 <> 8)"""


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = v.files(spark, sf_dir).select("path", F.when(F.col("doc_id") % 7 == 3, 1).otherwise(0).alias("mtime"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    odd = F.col("doc_id") % 11
    prior = n.filter(F.col("doc_id") % 13 != 6).select("path", F.when(odd.isin(4, 5), 9).otherwise(F.col("mtime")).alias("mtime"), F.when(odd == 4, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return n.filter(F.col("doc_id") % 17 != 8).drop("doc_id"), prior


_ACTION_SQL = f"""WITH {v.FILES_SQL}, {_PRIOR_SQL}, a AS (SELECT coalesce(t.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'new' WHEN t.path IS NULL THEN 'removed' WHEN t.mtime = p.mtime THEN 'reused' WHEN t.content_hash = p.content_hash THEN 'touched' ELSE 'changed' END AS action FROM t FULL OUTER JOIN p ON t.path = p.path)"""


@query(f"WITH {v.FILES_SQL} SELECT path, CAST(length(text) AS BIGINT) AS size, CAST(len(regexp_split_to_array(text, '\\r?\\n')) AS BIGINT) AS n_lines, sha256(text) AS content_hash FROM f")
def scan_files(spark, sf_dir):
    return corpus.files(v.texts(spark, sf_dir))


@query("SELECT page_id, len(list_filter(string_split(html, chr(10)), lambda x: length(x) > 5000)) > 0 AS minified FROM pages")
def reject_minified(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.is_minified(F.col("html")).alias("minified"))


@query(f"""SELECT page_id, regexp_matches(substring(html, 1, 4096), '{paths.GENERATED_PATTERNS[0].replace("'", "''")}') OR regexp_matches(substring(html, 1, 4096), '{paths.GENERATED_PATTERNS[1].replace("'", "''")}') AS generated FROM pages""")
def reject_generated_head(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.is_generated(F.col("html")).alias("generated"))


@query(f"WITH {v.FILES_SQL} SELECT path FROM f WHERE path = 'src1' OR starts_with(path, 'src1/')")
def path_prefix_scope(spark, sf_dir):
    return v.texts(spark, sf_dir).filter(paths.under(F.col("path"), "src1/")).select("path")


@query(f"""WITH {v.PAGES_SQL} SELECT page_id, path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ({", ".join(repr(e) for e in paths.EXTENSIONS)}) OR ends_with(lower(path), '-meta.xml') AS indexed FROM g""")
def ext_allowlist(spark, sf_dir):
    path = F.col("path")
    return v.pages(spark, sf_dir).select("page_id", "path", paths.extension(path).alias("extension"), paths.is_indexed(path).alias("indexed"))


@query(_ACTION_SQL + " SELECT path, action FROM a")
def refresh_actions(spark, sf_dir):
    return corpus.refresh(*_scans(spark, sf_dir))


@query(_ACTION_SQL + " SELECT action, count(*) AS n FROM a GROUP BY action")
def index_summary(spark, sf_dir):
    return corpus.refresh(*_scans(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@query(_ACTION_SQL + " SELECT path FROM a WHERE action = 'changed'")
def changed_paths(spark, sf_dir):
    return corpus.changed_paths(*_scans(spark, sf_dir))


@query(f"WITH {v.FILES_SQL}, {_PRIOR_SQL} SELECT path FROM p WHERE path NOT IN (SELECT path FROM t)")
def removed_paths(spark, sf_dir):
    return corpus.removed_paths(*_scans(spark, sf_dir))


@query(f"WITH {v.FILES_SQL} SELECT sha256(text) AS content_hash, count(*) AS n, min(path) AS first_path FROM f GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    return corpus.duplicate_content(corpus.files(v.texts(spark, sf_dir)))


@query(f"WITH {v.LINES_SQL} SELECT path, line_no, line FROM l WHERE line_no BETWEEN 3 AND 6")
def read_line_range(spark, sf_dir):
    return corpus.read_range(v.texts(spark, sf_dir), 3, 6)


_TRIM_SQL = r"substring(regexp_replace(line, '^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$', '', 'g'), 1, 240) AS text"


def _hits_sql(pieces: str, width: str, where: str, most: int | None = 10) -> str:
    """Columns of hits from the pieces between them."""
    cut = f"AND i <= {most}" if most else ""
    return rf""", h0 AS (SELECT path, line_no, line, {pieces} AS ps, {width} AS ws FROM l WHERE {where}), h1 AS (SELECT path, line_no, line, ps, ws, unnest(generate_series(1, len(ps) - 1)) AS i FROM h0), h AS (SELECT path, line_no, CAST(1 + list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS col, {_TRIM_SQL} FROM h1 WHERE true {cut})"""


_THAT_SQL = f"WITH {v.LINES_SQL}" + _hits_sql("string_split(line, 'that')", "list_transform(range(len(string_split(line, 'that'))), lambda x: 'that')", "contains(line, 'that')")
_PATTERN = "th[aeiou]+n[a-z]*"


@query(_THAT_SQL + " SELECT path, line_no, col, text FROM h")
def search_literal(spark, sf_dir):
    return search.find_literal(v.texts(spark, sf_dir), "that")


@query(f"WITH {v.LINES_SQL}" + _hits_sql("string_split(lower(line), 'the')", "list_transform(range(len(string_split(lower(line), 'the'))), lambda x: 'the')", "contains(lower(line), 'the')") + " SELECT path, line_no, col, text FROM h")
def search_ignore_case(spark, sf_dir):
    return search.find_literal(v.texts(spark, sf_dir), "The", ignore_case=True)


@query(f"WITH {v.LINES_SQL}" + _hits_sql(f"regexp_split_to_array(line, '{_PATTERN}')", f"regexp_extract_all(line, '{_PATTERN}')", f"regexp_matches(line, '{_PATTERN}')", None) + " SELECT path, line_no, col, text FROM h")
def search_regex(spark, sf_dir):
    return search.find_pattern(v.texts(spark, sf_dir), _PATTERN, hits_a_line=None)


@query(_THAT_SQL + " SELECT count(*) AS total, least(count(*), 1000) AS shown_total, count(*) <= 1000 AS exact, count(DISTINCT path) AS n_files FROM h")
def search_summary(spark, sf_dir):
    return search.summary(search.find_literal(v.texts(spark, sf_dir), "that"))


@query(_THAT_SQL + " SELECT path, line_no, col, text FROM h ORDER BY path, line_no, col LIMIT 20 OFFSET 40")
def search_page(spark, sf_dir):
    return search.page(search.find_literal(v.texts(spark, sf_dir), "that"), 40, 20)


@query(_THAT_SQL + " SELECT path, line_no, col, repeat(' ', col - 1) || '^^^^' AS caret FROM h")
def caret_highlight(spark, sf_dir):
    hits = search.find_literal(v.texts(spark, sf_dir), "that")
    return hits.select("path", "line_no", "col", text.caret(F.col("col"), F.lit(4)).alias("caret"))


_WORD_SQL = f"WITH {v.SYMBOLS_SQL}" + _hits_sql(r"regexp_split_to_array(line, '\bthat\b')", r"regexp_extract_all(line, '\bthat\b')", r"regexp_matches(line, '\bthat\b')")
_ASOF_SQL = _WORD_SQL + ", r AS (SELECT h.path, h.line_no, h.col, h.text, s.name AS symbol, s.kind, s.line AS symbol_line FROM h ASOF LEFT JOIN s ON h.path = s.path AND h.line_no >= s.line)"
_IS_TEST_SQL = "(" + " OR ".join(f"regexp_matches(path, '{p}')" for p in paths.TEST_PATTERNS) + ")"


def _references(spark, sf_dir):
    return search.references(v.texts(spark, sf_dir), v.symbols(spark, sf_dir, "that"), "that")


@query(_ASOF_SQL + " SELECT path, line_no, col, text, coalesce(symbol, '') AS symbol, coalesce(kind, '') AS kind, coalesce(symbol_line, 0) AS symbol_line FROM r")
def find_references(spark, sf_dir):
    return _references(spark, sf_dir).fillna("", ["symbol", "kind"]).fillna(0, ["symbol_line"])


@query(f"WITH {v.SYMBOLS_SQL}, d AS (SELECT path, line FROM s WHERE name = 'That')" + _hits_sql(r"regexp_split_to_array(line, '\bThat\b')", r"regexp_extract_all(line, '\bThat\b')", r"regexp_matches(line, '\bThat\b')") + " SELECT path, line_no, col FROM h WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = h.path AND d.line = h.line_no)")
def callers_without_definitions(spark, sf_dir):
    return search.callers(v.texts(spark, sf_dir), v.symbols(spark, sf_dir, "That"), "That").select("path", "line_no", "col")


@query(_ASOF_SQL + f", q AS (SELECT * FROM r WHERE {_IS_TEST_SQL} OR path IN (SELECT path FROM s WHERE kind = 'test')) SELECT * FROM q WHERE {_IS_TEST_SQL} OR kind = 'test'")
def find_tests_scope(spark, sf_dir):
    return search.tests_of(v.texts(spark, sf_dir), v.symbols(spark, sf_dir), "that")


@query(_THAT_SQL + f", b AS (SELECT path, count(*) AS n FROM h GROUP BY path), w AS (SELECT * FROM b ORDER BY n DESC, path DESC LIMIT 1) SELECT w.path, (SELECT CAST(sum(n) AS BIGINT) FROM b) AS total, w.n, CAST(len(regexp_split_to_array(f.text, '\\r?\\n')) AS BIGINT) AS n_lines, (SELECT sum(n) FROM b) >= 8 AND w.n >= ceil((SELECT sum(n) FROM b) * 0.6) AND len(regexp_split_to_array(f.text, '\\r?\\n')) >= 300 AS concentrated FROM w JOIN f ON w.path = f.path")
def hit_concentration(spark, sf_dir):
    t = v.texts(spark, sf_dir)
    return search.concentration(search.find_literal(t, "that"), corpus.files(t))


@query(_THAT_SQL + f", o AS (SELECT DISTINCT path FROM h WHERE path <> 'src1/en/1.txt') SELECT count(*) FILTER (WHERE NOT {_IS_TEST_SQL}) AS n_files, count(*) FILTER (WHERE {_IS_TEST_SQL}) AS n_tests, (SELECT count(*) >= 80 FROM h) AS capped FROM o")
def impact_counts(spark, sf_dir):
    return search.impact(search.find_literal(v.texts(spark, sf_dir), "that"), "src1/en/1.txt")


def _brands(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.regexp_extract("p_brand", "(#[0-9]+)$", 1).alias("name"), F.col("p_type").alias("kind"))


@query("SELECT p_partkey AS id, regexp_extract(p_brand, '(#[0-9]+)$', 1) AS name, p_type AS kind FROM part WHERE regexp_extract(p_brand, '(#[0-9]+)$', 1) = '#13'")
def find_definition(spark, sf_dir):
    return search.definitions(_brands(spark, sf_dir), "13")


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS w FROM part), r AS (SELECT id, name, CAST(CASE WHEN w = 'ring' THEN 0 WHEN starts_with(w, 'ring') THEN 1 WHEN contains(w, 'ring') THEN 2 WHEN regexp_matches(w, 'r.*i.*n.*g') THEN 3 END AS BIGINT) AS rank FROM n) SELECT * FROM r WHERE rank IS NOT NULL""")
def fuzzy_rank(spark, sf_dir):
    return search.fuzzy_names(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "ring")


_STOP_SQL = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TERMS_SQL = rf"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-.]', ' ', 'g')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP_SQL}))"


@query(f"WITH t AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL")
def tokenize_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return rank.term_frequencies(rank.postings(d, text.terms(F.col("text")))).withColumnRenamed("id", "doc_id")


_QUERY = "reading that ndred then from erth"
_BM25_SQL = f"""WITH {v.FILES_SQL}, d AS (SELECT doc_id AS id, path, {_TERMS_SQL} AS ts FROM f), m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(ts) AS DOUBLE)) AS mean FROM d),
q AS (SELECT DISTINCT unnest(ts) AS term FROM (SELECT {_TERMS_SQL} AS ts FROM (SELECT '{_QUERY}' AS text))), x AS (SELECT term, (SELECT CAST(count(*) AS DOUBLE) FROM d WHERE list_contains(ts, term)) AS df FROM q),
y AS (SELECT id, path, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, CAST(len(list_filter(ts, lambda t: t = term)) AS DOUBLE) AS tf, len(ts) AS dl, mean FROM d, x, m WHERE list_contains(ts, term)),
b AS (SELECT id, path, sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM y GROUP BY id, path)"""


def _bm25(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return rank.bm25(rank.postings(d, text.terms(F.col("text"))), _QUERY)


@query(_BM25_SQL + " SELECT id, round(score, 6) AS score FROM b")
def bm25_documents(spark, sf_dir):
    return _bm25(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


@query(_BM25_SQL + f", z AS (SELECT id, path, score, CASE WHEN {' OR '.join(f'''regexp_matches(path, '{p}')''' for p in paths.DOC_PATTERNS)} THEN 2 WHEN {_IS_TEST_SQL} THEN 1 ELSE 0 END AS tier FROM (SELECT id, replace(path, 'src1', 'docs') AS path, score FROM (SELECT id, replace(path, '.txt', '.py') AS path, score FROM b))) SELECT id, path, CAST(tier AS BIGINT) AS tier, round(score, 6) AS score FROM z ORDER BY tier, z.score DESC, path LIMIT 10")
def bm25_tiers(spark, sf_dir):
    path = F.replace(F.replace(F.col("path"), F.lit(".txt"), F.lit(".py")), F.lit("src1"), F.lit("docs"))
    named = v.files(spark, sf_dir).select(F.col("doc_id").alias("id"), path.alias("path"))
    found = _bm25(spark, sf_dir).join(named, "id")
    tier = rank.tier(F.col("path"), F.when(paths.is_test(F.col("path")), "test").otherwise(""))
    top = found.select("id", "path", tier.cast("long").alias("tier"), "score").orderBy("tier", F.desc("score"), "path").limit(10)
    return top.withColumn("score", F.round("score", 6))


@query(f"WITH d AS (SELECT DISTINCT unnest({_TERMS_SQL}) AS term FROM documents), q AS (SELECT DISTINCT unnest(ts) AS term FROM (SELECT {_TERMS_SQL} AS ts FROM (SELECT '{_QUERY} zzqx' AS text))) SELECT term, term IN (SELECT term FROM d) AS matched FROM q")
def query_terms_matched(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return rank.matched_terms(rank.postings(d, text.terms(F.col("text"))), _QUERY + " zzqx")


@query(_BM25_SQL + " SELECT id, round(score, 6) AS score FROM b QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 3 OR score >= 0.3 * max(score) OVER ()")
def relevance_floor(spark, sf_dir):
    return rank.relevant(_bm25(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {v.FILES_SQL}, b AS (SELECT lang AS grp, doc_id AS ord, length(text) AS chars, sum(length(text)) OVER w + 200 AS used, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY lang ORDER BY doc_id)), o AS (SELECT *, max(CASE WHEN used > 6000 AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY ord) AS bad FROM b) SELECT grp AS \"group\", ord, CAST(chars AS BIGINT) AS chars, CAST(used AS BIGINT) AS used FROM o WHERE bad = 0")
def budget_prefix(spark, sf_dir):
    blocks = v.files(spark, sf_dir).select(F.col("lang").alias("group"), F.col("doc_id").alias("ord"), F.length("text").cast("long").alias("chars"))
    return rank.budget_prefix(blocks, 6000, 200)


@query(f"WITH {v.PAGES_SQL}, k AS (SELECT path, len(string_split(html, chr(10))) AS n_lines, string_split(path, '/') AS parts FROM g) SELECT array_to_string(parts[1:greatest(1, least(2, len(parts) - 1))], '/') AS directory, count(*) AS n_files, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(0 AS BIGINT) AS n_symbols FROM k GROUP BY 1")
def dir_rollup(spark, sf_dir):
    return rollup.by_directory(v.pages(spark, sf_dir).select("path", F.size(F.split("html", "\n", -1)).alias("n_lines")), 2)


@query(f"WITH {v.FILES_SQL}, k AS (SELECT path, CAST(len(regexp_split_to_array(text, '\\r?\\n')) AS BIGINT) AS n_lines FROM f WHERE starts_with(path, 'src2/')) SELECT path, n_lines, (SELECT count(*) FROM k) AS total_files, (SELECT CAST(sum(n_lines) AS BIGINT) FROM k) AS total_lines FROM k ORDER BY n_lines DESC, path LIMIT 20")
def dir_drilldown(spark, sf_dir):
    return rollup.drill_down(corpus.files(v.texts(spark, sf_dir)), "src2")


@query(f"WITH {v.PAGES_SQL} SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, extension LIMIT 5")
def ext_mix(spark, sf_dir):
    return rollup.extension_mix(v.pages(spark, sf_dir))


@query(f"WITH {v.PAGES_SQL}, x AS (SELECT count(*) AS n_files, count(*) FILTER (WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ({', '.join(repr(e) for e in paths.MARKUP_EXTENSIONS)})) AS n_markup FROM g) SELECT n_files, n_markup, round(n_markup / n_files, 6) AS share, n_markup / n_files >= 0.2 AS visual FROM x")
def markup_share(spark, sf_dir):
    return rollup.markup_share(v.pages(spark, sf_dir))


@query("WITH x AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT contains(text, 'that')) AS n_empty FROM documents GROUP BY lang HAVING count(*) >= 3) SELECT lang, n, n_empty, round(n_empty / n, 6) AS rate, CAST((n_empty / n >= 0.25)::INT + (n_empty / n >= 0.5)::INT AS BIGINT) AS flag FROM x")
def empty_rate(spark, sf_dir):
    return rollup.empty_rate(table(spark, sf_dir, "documents"), "lang", ~F.col("text").contains("that"))


@query(f"""WITH {v.PAGES_SQL}, l AS (SELECT page_id AS path, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT page_id, regexp_split_to_array(replace(replace(html, '<', chr(10) || '{{'), '>', '}}'), '\\r?\\n') AS ls FROM g)),
d AS (SELECT path, line_no, length(line) - length(replace(line, '{{', '')) AS opens, length(line) - length(replace(line, '}}', '')) AS closes FROM l),
r AS (SELECT *, sum(opens - closes) OVER (PARTITION BY path ORDER BY line_no) AS s FROM d)
SELECT path, CAST(line_no AS BIGINT) AS line_no, CAST(opens AS BIGINT) AS opens, CAST(closes AS BIGINT) AS closes, CAST(coalesce(lag(s) OVER (PARTITION BY path ORDER BY line_no), 0) - least(0, coalesce(min(s) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS depth FROM r""")
def brace_depth(spark, sf_dir):
    braced = F.replace(F.replace(F.col("html"), F.lit("<"), F.lit("\n{")), F.lit(">"), F.lit("}"))
    scanned = corpus.lines(v.pages(spark, sf_dir).select(F.col("page_id").alias("path"), braced.alias("text")))
    return spans.brace_depth(scanned).drop("line")


@query(f"WITH {v.PAGES_SQL}, l AS (SELECT page_id AS path, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT page_id, regexp_split_to_array(regexp_replace(regexp_replace(html, '<div class=\"([a-z]+)\">', chr(10) || '.\\1 #\\1{{', 'g'), '<(/?)style>', chr(10) || '@media \\1style{{', 'g'), '\\r?\\n') AS ls FROM g)), o AS (SELECT path, line_no, trim(string_split(line, '{{')[1]) AS head FROM l WHERE contains(line, '{{')), k AS (SELECT path, line_no, CASE WHEN regexp_matches(head, '^@[A-Za-z-]+') THEN [trim('@' || regexp_extract(head, '^@([A-Za-z-]+)', 1) || ' ' || substring(regexp_replace(trim(regexp_extract(head, '^@[A-Za-z-]+\\s*(.*)$', 1)), '\\s+', ' ', 'g'), 1, 60))] ELSE regexp_extract_all(head, '([.#][A-Za-z_-][A-Za-z0-9_-]*)', 1) END AS names, CASE WHEN regexp_matches(head, '^@[A-Za-z-]+') THEN 'at-rule' ELSE 'rule' END AS kind FROM o WHERE head <> ''), w AS (SELECT path, line_no, kind, unnest(generate_series(1, len(names))) AS i, unnest(names) AS name FROM k), z AS (SELECT path, line_no, kind, name, min(i) AS i FROM w GROUP BY ALL) SELECT path, CAST(line_no AS BIGINT) AS line_no, CAST(row_number() OVER (PARTITION BY path, line_no ORDER BY i) - 1 AS INTEGER) AS ord, name, kind FROM z QUALIFY row_number() OVER (PARTITION BY path, line_no ORDER BY i) <= 4")
def css_selectors(spark, sf_dir):
    sheet = F.regexp_replace(F.regexp_replace("html", '<div class="([a-z]+)">', "\n.$1 #$1{"), "<(/?)style>", "\n@media $1style{")
    return spans.selectors(corpus.lines(v.pages(spark, sf_dir).select(F.col("page_id").alias("path"), sheet.alias("text"))))


@query(f"WITH {v.SYMBOLS_SQL}, k AS (SELECT s.path, s.name, s.line, coalesce(lead(s.line) OVER (PARTITION BY s.path ORDER BY s.line, s.name), len(regexp_split_to_array(f.text, '\\r?\\n')) + 1) - s.line AS span FROM s JOIN f ON s.path = f.path) SELECT path, name, line, CAST(span AS BIGINT) AS span, row_number() OVER (PARTITION BY path ORDER BY span DESC, line, name) AS rank FROM k QUALIFY rank <= 3")
def widest_spans(spark, sf_dir):
    return spans.widest_spans(v.symbols(spark, sf_dir).withColumn("depth", F.lit(0)), corpus.files(v.texts(spark, sf_dir)))


@query(f"WITH {v.SYMBOLS_SQL} SELECT s.path, s.line, regexp_extract(l.line, '^[ \\t]*', 0) || rtrim(regexp_replace(trim(l.line), '[{{:]\\s*$', '')) || ' … {{' || CAST(s.line AS VARCHAR) || '}}' AS text FROM s JOIN l ON s.path = l.path AND s.line = l.line_no")
def file_skeleton(spark, sf_dir):
    return spans.skeleton(v.symbols(spark, sf_dir), corpus.lines(v.texts(spark, sf_dir)))
