"""The numbered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import collocations, decontamination, exact_dedup, html_extract, language_id, line_dedup, packing, prefix_trie, quality, secrets, simhash, toxicity, url_filter
from lodestone.llm.common import held_out
from lodestone.sources.tables import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify_languages(docs.select("doc_id", "text"), language_id.fit_language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def count_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count_of(kind) for kind in secrets.KINDS]
    return found.select("doc_id", *n, F.sha2(secrets.span_text("base"), 256).alias("base_sha256"), secrets.span_text("spans").alias("spans"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.fit_url_model(pages)).select("page_id", "host", "path", "rule", "verdict")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity_model(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_html_extract": op8_html_extract,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_exact_dedup": op13_exact_dedup,
}

_SPACE = r"[\x20\x09-\x0D]"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE_SQL = {
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), often AS (
  SELECT key FROM k WHERE length(key) > 0 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often ON k.key = often.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op6_quality": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id
), x AS (
  SELECT doc_id, unnest(lines) AS line FROM d
), y AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(line, '{_SPACE}+'), lambda w: w <> '') AS lw FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), z AS (
  SELECT doc_id, sum(length(regexp_replace(line, '{_SPACE}+', '', 'g'))) AS lost FROM y WHERE
    regexp_matches(line, '{quality.NO_LETTER}')
    OR len(list_filter(lw, lambda w: regexp_matches(w, '{quality.SIGN_WORD}'))) * 2 > len(lw)
    OR (len(lw) >= 4 AND NOT regexp_matches(line, '{quality.SENTENCE}'))
    OR (len(list_filter(lw, lambda w: regexp_matches(w, '{quality.SEPARATOR}'))) >= 3 AND len(list_filter(lw, lambda w: regexp_matches(w, '{quality.SEPARATOR}'))) * 4 >= len(lw))
    OR regexp_matches(line, '{_quoted(quality.MENU)}') OR regexp_matches(line, '{_quoted(quality.BOILERPLATE)}')
  GROUP BY doc_id
), u AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM y GROUP BY doc_id
), b AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * word_chars AS kept
FROM b
""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, phrase, k AS size, count(*) AS f FROM grams GROUP BY lang, phrase, k
), c AS (
  SELECT lang, phrase, size, f AS a FROM f WHERE size > 1 AND f >= 100
), inner_of AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[j:j + m - 1], ' ') AS phrase, max(a) AS most
  FROM c, (SELECT unnest(range(1, 5)) AS j), (SELECT unnest(range(2, 5)) AS m) WHERE m < size AND j + m - 1 <= size GROUP BY ALL
), alive AS (
  SELECT c.* FROM c LEFT JOIN inner_of o USING (lang, phrase) WHERE o.most IS NULL OR 100 * o.most < 100 * a
), cuts AS (
  SELECT alive.lang, alive.phrase, a, x.k, x.l, x.r, n, CAST((1000::HUGEINT * a * n) // (x.l::HUGEINT * x.r) AS BIGINT) AS score
  FROM alive JOIN totals USING (lang) JOIN (
    SELECT y.lang, y.phrase, y.k, l.f AS l, r.f AS r FROM (SELECT lang, phrase, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM alive) y
    JOIN f l ON l.lang = y.lang AND l.phrase = array_to_string(y.w[1:y.k], ' ') JOIN f r ON r.lang = y.lang AND r.phrase = array_to_string(y.w[y.k + 1:], ' ')
  ) x ON x.lang = alive.lang AND x.phrase = alive.phrase
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weakest QUALIFY rank <= 2000
""",
    "op12_conversation_trie": r"""
WITH t AS (
  SELECT conv_id, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), g AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.digest, o.bytes FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.digest, o.bytes FROM c JOIN o USING (conv_id) WHERE o.pos >= c.h
), r AS (
  SELECT conv_id, bytes, row_number() OVER s AS depth, sha256(string_agg(digest, '') OVER s) AS node FROM g WINDOW s AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c
), q AS (
  SELECT *, lag(node) OVER s AS parent, lead(node) OVER s IS NULL AS ends FROM r WINDOW s AS (PARTITION BY conv_id ORDER BY depth)
), n AS (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS value,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM q GROUP BY node
), k AS (
  SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent
), v AS (
  -- A node's numbers count once, with its smallest conversation, which passes through all that lie above it.
  SELECT q.conv_id, q.depth, q.node, CASE WHEN n.conv_id = q.conv_id THEN n.value ELSE 0 END AS value, CASE WHEN n.conv_id = q.conv_id AND k.node IS NULL THEN 1 ELSE 0 END AS leaf
  FROM q JOIN n USING (node) LEFT JOIN k ON k.node = q.node
), z AS (
  SELECT node, sum(value) OVER s AS value, sum(leaf) OVER s AS leaf FROM v WINDOW s AS (PARTITION BY conv_id ORDER BY depth DESC)
), y AS (
  SELECT node, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(value) AS BIGINT) AS saved_tokens FROM z GROUP BY node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN y USING (node) LEFT JOIN k ON k.node = n.node LEFT JOIN n p ON p.node = n.parent
""",
    "op13_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS same FROM documents
)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY same) AS group_size, row_number() OVER o = 1 AS kept, sha256(same) AS text_sha256
FROM d WINDOW o AS (PARTITION BY same ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""",
}
