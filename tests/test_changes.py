import re
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import changes, index, memory, rank, rules, search
from lodestone.sources.stores import FACTS, JOURNAL, Store, append_journal, delete_facts, get_facts, save_fact


def test_stores(spark, tmp_path):
    facts = Store(spark, str(tmp_path / "facts"), FACTS)
    assert facts.read().count() == 0
    one, level = save_fact(facts, "walk() lives in shore.py", ["code"])
    two, long = save_fact(facts, "x" * 1300, [])
    assert (level, long) == ("ok", "warn") and facts.read().count() == 2 and len(facts.versions()) == 2
    with pytest.raises(ValueError, match="refused"):
        save_fact(facts, "x" * 20_001, [])
    rows, missing = get_facts(facts, [one, "nope"])
    assert [r["id"] for r in rows.collect()] == [one] and missing == ["nope"]
    delete_facts(facts, [two])
    assert [r["id"] for r in facts.read().collect()] == [one] and facts.versions() == [1, 2, 3]
    (tmp_path / "facts" / "v99").mkdir()  # a write that never finished
    assert facts.read().count() == 1
    journal = Store(spark, str(tmp_path / "journal"), JOURNAL)
    append_journal(journal, spark.createDataFrame([(i, datetime(2024, 1, 1), "t", None) for i in range(450)], JOURNAL))
    assert journal.read().agg(F.count("*"), F.min("seq")).first() == (400, 50)


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    facts = Store(spark, str(tmp_path / "facts"), FACTS)
    with ThreadPoolExecutor(8) as pool:
        ids = [i for i, _ in pool.map(lambda k: save_fact(facts, f"fact {k}", []), range(40))]
        list(pool.map(lambda k: delete_facts(facts, [ids[k]]), range(6)))
    assert {r["id"] for r in facts.read().collect()} == set(ids[6:])
    journal = Store(spark, str(tmp_path / "journal"), JOURNAL)
    rows = [spark.createDataFrame([(k, None, "t", "h")], JOURNAL) for k in range(8)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda r: append_journal(journal, r, 5), rows))
    assert sorted(r["seq"] for r in journal.read().collect()) == [3, 4, 5, 6, 7]


@pytest.mark.parametrize(("pattern", "line"), [("a*", "baac"), (r"\b", "on the sea"), ("(?:|a)", "aa"), ("$", "x"), ("^", ""), ("x?", "xxx")])
def test_patterns_that_match_nothing(spark, pattern, line):
    expected, at = [], 0
    while at <= len(line) and (m := re.compile(pattern).search(line, at)):
        expected.append((m.start() + 1, len(m[0])))
        at = m.end() + (not m[0])
    df = spark.createDataFrame([("f", line), ("g", None)], "path string, text string")
    assert [(r["col"], r["width"]) for r in search.find_each(df, pattern, hits_a_line=None).orderBy("col").collect()] == expected
    assert search.find_each(df, pattern, hits_a_line=1).count() == min(1, len(expected))


def test_fact_mentions(spark):
    facts = spark.createDataFrame([("a", "see `tide` in src/moon.ts, rise(1) and walk:12"), ("b", "nothing here"), ("c", "gone.py has lost()")], "id string, text string")
    found = memory.mentions(facts)
    assert {tuple(r)[1:] for r in found.filter("id = 'a'").collect()} == {("symbol", "tide"), ("file", "src/moon.ts"), ("symbol", "rise"), ("symbol", "walk")}
    live = spark.createDataFrame([("file", "x/moon.ts"), ("symbol", "other")], "kind string, name string")
    assert {r["id"]: r["flag"] for r in memory.staleness(facts, found, live).collect()} == {"a": "ok", "b": "", "c": "stale"}


def test_wiring(spark):
    code = [("a/Bell.cls", "public class Bell {\n  // Tower\n  String s = 'Tower';\n}"), ("a/Ring.trigger", "trigger Ring on X (before insert) {\n  new Bell();\n}"), ("a/Tower.cls", "class Tower { Bell b; Tower t; }"), ("a/x.ts", "class Other { Bell b; }")]
    files = rules.parsed(spark.createDataFrame(code, "path string, text string"))
    xml = spark.createDataFrame([("m/r.xml", 10, "<c>Tower</c><!-- Bell -->"), ("m/big.xml", 10**6, "<c>Bell</c>")], "path string, size long, text string")
    found = {tuple(r) for r in changes.wiring_edges(rules.lines(files), rules.symbols(files), xml).collect()}
    assert found == {("a/Ring.trigger", "a/Bell.cls"), ("a/Tower.cls", "a/Bell.cls"), ("m/r.xml", "a/Tower.cls")}


def test_untracked_files_count_as_added(spark):
    counts = spark.createDataFrame([("a", 1, 2)], "path string, added long, deleted long")
    status = spark.createDataFrame([], "path string, status string")
    touched = spark.createDataFrame([], "path string, line long")
    named = spark.createDataFrame([], "path string, line long, ord int, name string, kind string")
    rows = changes.changed_files(counts, status, touched, named, spark.createDataFrame([("b", 7)], "path string, n_lines long")).collect()
    assert {(r["path"], r["status"], r["added"], r["deleted"], len(r["symbols"])) for r in rows} == {("a", "M", 1, 2, 0), ("b", "?", 7, 0, 0)}


def test_ranking_floor_and_budget(spark):
    hits = spark.createDataFrame([(i, s) for i, s in enumerate([10.0, 9.0, 1.0, 0.9, 3.0])], "id int, score double")
    assert {r["id"] for r in rank.relevant(hits).collect()} == {0, 1, 4}
    weak = spark.createDataFrame([(i, s) for i, s in enumerate([10.0, 1.0, 0.9, 0.8])], "id int, score double")
    assert {r["id"] for r in rank.relevant(weak).collect()} == {0, 1, 2}
    blocks = spark.createDataFrame([(0, 1, 900), (0, 2, 10), (0, 3, 200), (0, 4, 1)], "`group` int, ord int, chars long")
    assert [r["ord"] for r in rank.budget_prefix(blocks, 1000, 50).orderBy("ord").collect()] == [1, 2]
    assert [r["ord"] for r in rank.budget_prefix(blocks, 100, 50).orderBy("ord").collect()] == [1]


def test_brief(spark):
    tree = spark.createDataFrame([("a.ts", datetime(2024, 1, 1), 9, "function go() {\n}\n"), ("b.html", datetime(2024, 1, 1), 3, "<p>")], "path string, mtime timestamp, size long, text string")
    journal = spark.createDataFrame([(1, "search_code", "x"), (2, "stats", None), (3, "search_code", "y")], "seq long, tool string, hint string")
    found = index.brief(index.build(tree), journal)
    assert found["counts"].first() == (2, 4, 1)
    assert [tuple(r) for r in found["tools"].collect()] == [("search_code", 2, 1)]
    assert [r["hint"] for r in found["hints"].collect()] == ["y", "x"]
    assert found["markup"].first()["visual"]
