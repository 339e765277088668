"""Queries over ledgers, graphs, facts and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.paths import url_path
from lodestone.operators import edits, graph, ledger, memory
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


#: Which side of the ledger an event type stands for, and what kind of work it is.
_SIDE_SQL = "CASE WHEN tool IN ('view', 'click') THEN 'index' ELSE 'builtin' END"
_KIND_SQL = "CASE WHEN tool IN ('purchase', 'signup') THEN 'edit' ELSE 'read' END"
_SESSION_SQL = f"WITH {v.CALLS_SQL}, o AS (SELECT *, {_SIDE_SQL} AS side, {_KIND_SQL} AS kind, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS opens FROM c WINDOW w AS (PARTITION BY key ORDER BY ts, seq)), n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY key ORDER BY ts, seq) AS BIGINT) AS session FROM o)"


def _events(spark, sf_dir):
    side = F.when(F.col("tool").isin("view", "click"), "index").otherwise("builtin")
    kind = F.when(F.col("tool").isin("purchase", "signup"), "edit").otherwise("read")
    return v.calls(spark, sf_dir).withColumn("side", side).withColumn("kind", kind)


@query(f"WITH {v.CALLS_SQL} SELECT coalesce(tool, 'TOTAL') AS tool, count(*) AS calls, CAST(sum(chars) AS BIGINT) AS chars, max(chars) AS max_chars, count(*) FILTER (WHERE is_error) AS errors, CAST(floor(sum(chars) / count(*) + 0.5) AS BIGINT) AS mean_chars FROM c GROUP BY ROLLUP (tool)")
def tool_usage(spark, sf_dir):
    return ledger.usage(v.calls(spark, sf_dir), F.col("is_error"))


@query(f"WITH {v.CALLS_SQL} SELECT tool, count(*) AS calls, CAST(sum(chars) AS BIGINT) AS chars, max(chars) AS max_chars, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10') AS calls_since, CAST(coalesce(sum(chars) FILTER (WHERE ts >= TIMESTAMP '2024-01-10'), 0) AS BIGINT) AS chars_since, max(chars) FILTER (WHERE ts >= TIMESTAMP '2024-01-10') AS max_chars_since FROM c GROUP BY tool")
def usage_two_windows(spark, sf_dir):
    return ledger.usage_windows(v.calls(spark, sf_dir), F.lit("2024-01-10").cast("timestamp_ntz"))


@query(f"WITH {v.CALLS_SQL} SELECT *, n_outlines > 0 AND n_narrow < n_outlines AS low FROM (SELECT count(*) FILTER (WHERE tool = 'view') AS n_outlines, count(*) FILTER (WHERE tool IN ('click', 'purchase')) AS n_narrow FROM c)")
def follow_through(spark, sf_dir):
    return ledger.follow_through(v.calls(spark, sf_dir), ("view",), ("click", "purchase"))


@query("SELECT tool FROM (VALUES ('view'), ('refund'), ('share'), ('click')) AS t(tool) WHERE tool NOT IN (SELECT event_type FROM events) AND (SELECT count(*) FROM events) >= 5")
def unused_tools(spark, sf_dir):
    return ledger.unused_tools(v.calls(spark, sf_dir), ("view", "refund", "share", "click"))


@query(_SESSION_SQL + " SELECT key, session, min(ts) AS started, max(ts) AS ended, count(*) AS calls FROM n GROUP BY key, session")
def sessions(spark, sf_dir):
    return ledger.session_rows(v.calls(spark, sf_dir)).withColumn("session", F.col("session").cast("long"))


@query(_SESSION_SQL + ", h AS (SELECT key, session, arg_min(side, (ts, seq)) AS side FROM n GROUP BY key, session) SELECT side, count(*) AS n, CAST(floor(count(*) * 100 / (SELECT count(*) FROM h) + 0.5) AS BIGINT) AS percent FROM h GROUP BY side")
def first_hop(spark, sf_dir):
    return ledger.first_hops(_events(spark, sf_dir))


@query(f"WITH {v.CALLS_SQL} SELECT {_SIDE_SQL} AS side, {_KIND_SQL} AS kind, count(*) AS n FROM c GROUP BY ALL")
def side_kind_totals(spark, sf_dir):
    return ledger.side_kinds(_events(spark, sf_dir))


@query(f"WITH {v.CALLS_SQL}, o AS (SELECT *, coalesce(sum((tool = 'purchase')::INT) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM c), g AS (SELECT key, span, max((tool = 'purchase')::INT) AS w, max((tool = 'view')::INT) AS k FROM o GROUP BY key, span) SELECT key, CAST(sum(w) AS BIGINT) AS writes, count(*) FILTER (WHERE w = 1 AND k = 0) AS blind FROM g GROUP BY key")
def blind_writes(spark, sf_dir):
    return ledger.blind_writes(v.calls(spark, sf_dir), F.col("tool") == "purchase", F.col("tool") == "view")


@query(f"""WITH {v.CALLS_SQL}, o AS (SELECT CAST(key AS VARCHAR) || ':' || tool AS key, seq, json_extract_string(props, '$.k')::INT // 25 AS signature, chars FROM c), m AS (SELECT *, CASE WHEN coalesce(signature <> lag(signature) OVER w OR lag(chars) OVER w < 800, true) THEN 1 ELSE 0 END AS fresh FROM o WINDOW w AS (PARTITION BY key ORDER BY seq)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY seq) AS run FROM m) SELECT key, seq, signature, chars, row_number() OVER (PARTITION BY key, run ORDER BY seq) % 2 = 0 AS suppressed FROM r""")
def repeat_suppression(spark, sf_dir):
    c = v.calls(spark, sf_dir).select(F.concat_ws(":", "key", "tool").alias("key"), "seq", F.expr("cast(get_json_object(props, '$.k') as int) div 25").cast("int").alias("signature"), "chars")
    return ledger.repeats(c)


@query(f"WITH {v.CALLS_SQL} SELECT seq, ts, tool FROM c ORDER BY seq DESC LIMIT 400")
def rolling_retention(spark, sf_dir):
    return ledger.retained(v.calls(spark, sf_dir).select("seq", "ts", "tool"))


@query(f"WITH {v.CALLS_SQL}, r AS (SELECT * FROM c WHERE tool <> 'error' ORDER BY seq DESC LIMIT 200) SELECT tool AS value, count(*) AS n, min(seq) AS first_seq FROM r GROUP BY tool ORDER BY n DESC, first_seq LIMIT 8")
def recap_tops(spark, sf_dir):
    kept = v.calls(spark, sf_dir).filter(F.col("tool") != "error")
    return ledger.tops(ledger.retained(kept, 200), "tool", 8)


@query("SELECT props AS hint, max(event_id) AS seq FROM events GROUP BY props ORDER BY seq DESC LIMIT 8")
def recent_hints(spark, sf_dir):
    return ledger.recent_hints(v.calls(spark, sf_dir).select("seq", F.col("props").alias("hint")))


@query(f"WITH {v.CALLS_SQL} SELECT count(*) FILTER (WHERE tool = 'Edit' AND fired) AS whole_symbol_edits, count(*) FILTER (WHERE tool = 'Edit' AND NOT fired) AS generic_edits, count(*) FILTER (WHERE tool = 'Read' AND fired) AS whole_file_reads FROM (SELECT CASE WHEN tool = 'purchase' THEN 'Edit' ELSE 'Read' END AS tool, chars > 3000 AS fired FROM c)")
def bypass_report(spark, sf_dir):
    c = v.calls(spark, sf_dir)
    return ledger.bypass(c.select(F.when(F.col("tool") == "purchase", "Edit").otherwise("Read").alias("tool"), F.when(F.col("chars") > 3000, True).alias("fired")))


@query(f"WITH {v.CALLS_SQL} SELECT seq, tool, ms, chars, is_error, ms > 5000 AS slow, chars > 12500 AS large FROM (SELECT seq, tool, chars // 3 AS ms, chars, is_error FROM c) WHERE ms > 5000 OR chars > 12500 OR is_error")
def response_audit(spark, sf_dir):
    c = v.calls(spark, sf_dir).select("seq", "tool", F.expr("chars div 3").alias("ms"), "chars", "is_error")
    return ledger.slow_or_large(c)


#: Names that an import of a part may mean: candidates in the order in which they are tried.
@query("WITH a AS (SELECT DISTINCT l_suppkey AS path, l_partkey AS module FROM lineitem), t AS (SELECT path, module, unnest([0, 1, 2]) AS rank, unnest([module * 3, module * 2 + 1, module // 2]) AS dst FROM a), k AS (SELECT path, module, arg_min(dst, rank) AS dst FROM t WHERE dst IN (SELECT p_partkey FROM part) GROUP BY ALL) SELECT DISTINCT path AS src, dst FROM k")
def resolve_candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("module"))
    options = F.array(F.col("module") * 3, F.col("module") * 2 + 1, F.expr("module div 2"))
    return graph.resolve(li, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path")), options)[0]


def _links(spark, sf_dir):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(url_path(F.col("url")).alias("path"), F.explode(hrefs).alias("module"))


@query(f"WITH {v.PAGES_SQL} SELECT DISTINCT path AS src, module FROM (SELECT path, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS module FROM g) WHERE module NOT IN (SELECT path FROM g)")
def external_refs(spark, sf_dir):
    return graph.resolve(_links(spark, sf_dir), v.pages(spark, sf_dir).select("path"), F.array("module"))[1]


@query(f"WITH {v.FILES_SQL}, y AS (SELECT DISTINCT path, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS token FROM f), n AS (SELECT name, max(path) AS dst FROM (SELECT regexp_extract(text, '^([A-Za-z]+)', 1) AS name, path FROM f) WHERE length(name) > 6 GROUP BY name) SELECT DISTINCT y.path AS src, n.dst FROM y JOIN n ON y.token = n.name WHERE y.path <> n.dst")
def name_ref_edges(spark, sf_dir):
    f = v.texts(spark, sf_dir)
    tokens = f.select("path", F.explode(F.array_distinct(F.split("text", "[^A-Za-z]+", -1))).alias("token"))
    types = f.select(F.regexp_extract("text", "^([A-Za-z]+)", 1).alias("name"), "path").filter(F.length("name") > 6)
    return graph.name_edges(tokens, types)


@query(f"WITH {v.EDGES_SQL} SELECT src, dst FROM e UNION SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation")
def merged_edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    return graph.merged(v.edges(spark, sf_dir), n)


@query(f"WITH {v.EDGES_SQL} SELECT dst, count(DISTINCT src) AS n FROM e GROUP BY dst")
def dependents(spark, sf_dir):
    return graph.dependents(v.edges(spark, sf_dir))


@query(f"WITH RECURSIVE {v.EDGES_SQL}, b AS (SELECT 's7' AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON b.node = e.src WHERE b.depth < 3), m AS (SELECT node, min(depth) AS depth FROM b GROUP BY node) SELECT e.src, e.dst, m.depth FROM e JOIN m ON e.src = m.node WHERE m.depth < 3")
def bfs_edges(spark, sf_dir):
    return graph.walk(v.edges(spark, sf_dir), spark.createDataFrame([("s7",)], "node string"), 3)


@query(f"WITH {v.FACTS_SQL} SELECT id, substring(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^[\\s\\x{{a0}}\\x{{feff}}]+|[\\s\\x{{a0}}\\x{{feff}}]+$', '', 'g'), 1, 150) AS preview, CAST(length(text) AS BIGINT) AS chars, CASE WHEN length(text) > 20000 THEN 'refuse' WHEN length(text) > 1200 THEN 'warn' ELSE 'ok' END AS level FROM k")
def memory_preview(spark, sf_dir):
    return memory.previews(v.facts(spark, sf_dir))


@query(f"WITH {v.FACTS_SQL} SELECT id, text FROM k WHERE contains(lower(text), 'then') AND list_contains(tags, 'user')")
def memory_search(spark, sf_dir):
    return memory.search_facts(v.facts(spark, sf_dir), "Then", "user").select("id", "text")


@query(f"WITH {v.FACTS_SQL}, a AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM documents), n AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '([A-Za-z]{{14,}})', 1)) AS name FROM k), j AS (SELECT id, max((a.name IS NOT NULL)::INT) AS live FROM n LEFT JOIN a ON n.name = a.name GROUP BY id) SELECT k.id, CASE WHEN live IS NULL THEN '' WHEN live = 1 THEN 'ok' ELSE 'stale' END AS flag FROM k LEFT JOIN j ON k.id = j.id")
def fact_staleness(spark, sf_dir):
    facts = v.facts(spark, sf_dir)
    named = facts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]{14,})"), F.lit(1)))).alias("name")).select("id", F.lit("symbol").alias("kind"), "name")
    live = v.texts(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", "[^A-Za-z]+", -1))).alias("name")).select(F.lit("symbol").alias("kind"), "name")
    return memory.staleness(facts, named, live)


@query("WITH s AS (SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS path, max(ts) AS mtime FROM events GROUP BY 1), c AS (SELECT user_id AS digest, event_type AS prefix, max(ts) AS saved_at FROM events GROUP BY ALL) SELECT digest, count(DISTINCT path) AS n_covered, count(DISTINCT path) FILTER (WHERE mtime > saved_at) AS n_stale FROM c JOIN s ON path = prefix OR starts_with(path, prefix || '/') GROUP BY digest")
def digest_stale(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    scan = e.groupBy(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("path")).agg(F.max("ts").alias("mtime"))
    covers = e.groupBy(F.col("user_id").alias("digest"), F.col("event_type").alias("prefix")).agg(F.max("ts").alias("saved_at"))
    return memory.digest_state(scan, covers)


@query("WITH a AS (SELECT l_orderkey AS diff, l_partkey AS p, 10 * l_linenumber + l_partkey % 5 AS s, CAST(l_quantity AS BIGINT) % 6 AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) SELECT diff, 'src/' || CAST(p AS VARCHAR) || '.ts' AS path, unnest(generate_series(s, s + CASE WHEN n = 1 THEN 1 ELSE n END - 1)) AS line FROM a WHERE n > 0")
def hunk_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_quantity").cast("long") % 6
    hunk = F.concat(F.lit("@@ -1 +"), (10 * F.col("l_linenumber") + F.col("l_partkey") % 5).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))), F.lit(" @@"))
    header = F.concat(F.lit("+++ b/src/"), F.col("l_partkey").cast("string"), F.lit(".ts"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    diffs = li.select(F.col("l_orderkey").alias("diff"), order.alias("o"), F.array(header, hunk).alias("t")).groupBy("diff").agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("x"))
    patch = diffs.select("diff", F.posexplode(F.flatten(F.transform("x", lambda i: i["t"]))).alias("line_no", "text"))
    return edits.hunk_lines(patch)


_EDITS_SQL = "WITH e AS (SELECT l_orderkey AS path, l_partkey * 1000 + l_suppkey AS id, l_linenumber * 12 AS start_line, l_linenumber * 12 + CAST(l_quantity AS BIGINT) // 3 AS end_line, l_partkey % 9 AS new_len FROM lineitem)"


def _edits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 12).cast("long")
    return li.select(F.col("l_orderkey").alias("path"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id"), start.alias("start_line"), (start + F.expr("cast(l_quantity as bigint) div 3")).alias("end_line"), (F.col("l_partkey") % 9).alias("new_len"))


@query(_EDITS_SQL + " SELECT path, id, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, coalesce(max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_line, false) AS overlaps FROM e")
def edit_overlap(spark, sf_dir):
    return edits.overlaps(_edits(spark, sf_dir).drop("new_len"))


@query(_EDITS_SQL + ", n AS (SELECT path, id, start_line + coalesce(sum(new_len - (end_line - start_line + 1)) OVER (PARTITION BY path ORDER BY start_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_start, new_len FROM e) SELECT path, id, CAST(new_start AS BIGINT) AS new_start, CAST(new_start + new_len - 1 AS BIGINT) AS new_end FROM n")
def post_edit_spans(spark, sf_dir):
    return edits.new_spans(_edits(spark, sf_dir)).select("path", "id", "new_start", "new_end")
