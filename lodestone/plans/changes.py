"""Queries over changes, hooks and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.paths import TEST_PATTERNS, is_test
from lodestone.operators import changes, corpus, edits, graph, ledger, spans
from lodestone.plans import views as v

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {v.SYMBOLS_SQL} SELECT name, count(*) AS n FROM s GROUP BY name HAVING count(*) > 1")
def ambiguous_names(spark, sf_dir):
    return changes.ambiguous_names(v.symbols(spark, sf_dir))


#: An edit of each document: where it starts and how many lines it takes follow from the document's size.
_EDIT_SQL = v.SYMBOLS_SQL + ", t AS (SELECT doc_id AS id, path, CAST(1 + length(text) % 5 AS BIGINT) AS start_line, CAST(length(text) % 60 AS BIGINT) AS n_lines FROM f)"


def _edits(spark, sf_dir):
    return v.files(spark, sf_dir).select(F.col("doc_id").alias("id"), "path", (1 + F.length("text") % 5).cast("long").alias("start_line"), (F.length("text") % 60).cast("long").alias("n_lines"))


@query(f"WITH {_EDIT_SQL}, m AS (SELECT t.id, arg_min(s.name, s.line) AS name FROM t JOIN s ON t.path = s.path AND s.line BETWEEN t.start_line AND least(t.start_line + t.n_lines - 1, t.start_line + 10) WHERE t.n_lines >= 25 GROUP BY t.id), c AS (SELECT name, count(*) AS times FROM s GROUP BY name) SELECT t.id, m.name IS NOT NULL AS fired, coalesce(m.name, '') AS name, coalesce(times > 1, false) AS ambiguous FROM t LEFT JOIN m ON t.id = m.id LEFT JOIN c ON m.name = c.name")
def hook_verdicts(spark, sf_dir):
    return changes.hook_verdicts(_edits(spark, sf_dir), v.symbols(spark, sf_dir))


@query(f"WITH {_EDIT_SQL} SELECT t.id, s.name FROM t JOIN s ON t.path = s.path AND s.line BETWEEN t.start_line AND t.start_line + t.n_lines - 1")
def symbols_in_span(spark, sf_dir):
    e = _edits(spark, sf_dir).withColumn("end_line", F.col("start_line") + F.col("n_lines") - 1)
    return changes.inside(v.symbols(spark, sf_dir), e)


@query(f"WITH {_EDIT_SQL}, n AS (SELECT t.path, CAST(t.n_lines AS BIGINT) AS added, t.start_line AS deleted FROM t), h AS (SELECT DISTINCT t.path, s.kind || ' ' || s.name AS symbol FROM t ASOF JOIN s ON t.path = s.path AND t.start_line >= s.line), g AS (SELECT path, array_to_string(list_sort(list(symbol)), ',') AS symbols FROM h GROUP BY path) SELECT n.path, CASE WHEN contains(n.path, '/de/') THEN 'A' ELSE 'M' END AS status, added, deleted, coalesce(symbols, '') AS symbols FROM n LEFT JOIN g ON n.path = g.path")
def changed_files(spark, sf_dir):
    e = _edits(spark, sf_dir)
    counts = e.select("path", F.col("n_lines").alias("added"), F.col("start_line").alias("deleted"))
    status = e.filter(F.col("path").contains("/de/")).select("path", F.lit("A").alias("status"))
    found = changes.changed_files(counts, status, e.select("path", F.col("start_line").alias("line")), v.symbols(spark, sf_dir))
    return found.withColumn("symbols", F.array_join("symbols", ","))


@query(f"WITH {v.SYMBOLS_SQL}, t AS (SELECT path, count(*) FILTER (WHERE length(line) <= 400 AND regexp_matches(line, '^[A-Z][a-z]+[.]$')) AS truth FROM l GROUP BY path), c AS (SELECT path, count(*) AS n FROM s GROUP BY path), p AS (SELECT split_part(t.path, '/', 2) AS grp, truth, least(truth, coalesce(n, 0)) AS found FROM t LEFT JOIN c ON t.path = c.path) SELECT grp AS \"group\", CAST(sum(truth) AS BIGINT) AS truth, CAST(sum(found) AS BIGINT) AS found, round(sum(found) / greatest(sum(truth), 1), 6) AS rate FROM p GROUP BY grp")
def recall_audit(spark, sf_dir):
    # The documents hold prose; a line of one word and a full stop stands for a declaration.
    declared = F.when(F.col("line").rlike(r"^[A-Z][a-z]+[.]$"), F.concat(F.lit("def "), F.col("line"))).otherwise("")
    scanned = corpus.lines(v.texts(spark, sf_dir)).withColumn("line", declared)
    return changes.recall_audit(scanned, v.symbols(spark, sf_dir), F.split_part(F.col("path"), F.lit("/"), F.lit(2)))


@query(f"WITH {v.SYMBOLS_SQL}, o AS (SELECT DISTINCT path, line FROM s) SELECT path, line, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line), 0) AS next_line FROM o")
def next_ceiling(spark, sf_dir):
    return spans.next_ceiling(v.symbols(spark, sf_dir)).fillna(0, ["next_line"])


@query(f"WITH {v.SYMBOLS_SQL} SELECT name FROM s WHERE kind = 'function' EXCEPT SELECT name FROM s WHERE kind = 'test'")
def dropped_names(spark, sf_dir):
    s = v.symbols(spark, sf_dir).withColumn("path", F.lit(""))
    return edits.dropped_names(s.filter("kind = 'function'"), s.filter("kind = 'test'")).select("name")


@query(f"WITH {v.SYMBOLS_SQL} SELECT name FROM s WHERE kind = 'function' INTERSECT SELECT name FROM s WHERE kind = 'test'")
def shared_names(spark, sf_dir):
    s = v.symbols(spark, sf_dir)
    return graph.shared_names(s.filter("kind = 'function'"), s.filter("kind = 'test'"))


@query("SELECT event_id AS seq, user_id AS key, event_type AS tool FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def snapshot_retention(spark, sf_dir):
    return changes.newest_per_key(v.calls(spark, sf_dir).select("seq", "key", "tool"))


@query(f"WITH {v.CALLS_SQL}, u AS (SELECT seq, ts, 'builtin' AS side FROM c WHERE tool = 'click' UNION ALL SELECT seq, ts, 'index' FROM c WHERE tool = 'view') SELECT seq, ts, side FROM u ORDER BY ts DESC, seq DESC LIMIT 500")
def merged_logs(spark, sf_dir):
    c = v.calls(spark, sf_dir)
    side = lambda tool, name: c.filter(F.col("tool") == tool).select("seq", "ts", F.lit(name).alias("side"))
    return ledger.merged_logs(side("click", "builtin"), side("view", "index"))


@query(f"""WITH {v.CALLS_SQL}, w AS (SELECT key, count(*) FILTER (WHERE tool = 'purchase') AS calls, CAST(sum(CASE WHEN tool = 'purchase' THEN 1 + chars % 3 ELSE 0 END) AS BIGINT) AS symbols, count(*) FILTER (WHERE tool = 'signup') AS external_files, count(*) FILTER (WHERE tool = 'view') AS checks FROM c GROUP BY key),
o AS (SELECT *, coalesce(sum((tool = 'purchase')::INT) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM c), g AS (SELECT key, span, max((tool = 'purchase')::INT) AS w, max((tool = 'view')::INT) AS k FROM o GROUP BY key, span),
x AS (SELECT key, count(*) FILTER (WHERE w = 1 AND k = 0) AS blind FROM g GROUP BY key) SELECT w.*, x.blind FROM w JOIN x USING (key)""")
def write_report(spark, sf_dir):
    tool = F.col("tool")
    return ledger.write_report(v.calls(spark, sf_dir), tool == "purchase", 1 + F.col("chars") % 3, tool == "signup", tool == "view")


@query(f"WITH {v.FILES_SQL} SELECT path, " + "(" + " OR ".join(f"regexp_matches(path, '{p}')" for p in TEST_PATTERNS) + ") AS is_test FROM f")
def test_paths(spark, sf_dir):
    return v.files(spark, sf_dir).select("path", is_test(F.col("path")).alias("is_test"))


@query("SELECT user_id AS key, event_type AS tool, count(*) AS calls, CAST(max(floor(value * 100)) AS BIGINT) AS max_chars FROM events WHERE event_type NOT IN ('error') GROUP BY ALL")
def journal_without_bookkeeping(spark, sf_dir):
    c = v.calls(spark, sf_dir).filter(~F.col("tool").isin("error", *ledger.JOURNAL_SKIP))
    return c.groupBy("key", "tool").agg(F.count("*").alias("calls"), F.max("chars").alias("max_chars"))
