import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.operators import edits, graph, index, search
from lodestone.sources.config import load_config
from lodestone.sources.tree import contained, git_diff, hook_events, source_tree

FILES = {
    "src/tide.ts": "import { moon } from './moon.js';\nimport fs from 'fs';\nexport function riseTide(n) {\n  return moon(n);\n}\n",
    "src/moon.ts": "export function moon(n) {\n  return n + 1;\n}\n",
    "test/tide.test.ts": "import { riseTide } from '../src/tide';\ndescribe('tide', () => {\n  it('rises', () => { riseTide(1); });\n});\n",
    "lib/shore.py": "import lib.sand\ndef walk():\n    return 1\n",
    "lib/sand.py": "GRAINS = 3\n",
    "node_modules/x/y.js": "function hidden() {}\n",
    "big.js": "a" * 6000,
    "notes.md": "moon moon\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def built(spark, tree):
    files, skipped = source_tree(spark, str(tree))
    assert [tuple(r) for r in skipped.collect()] == [("big.js", "minified")]
    return index.build(files)


def test_paths(built):
    assert {r["path"] for r in built.files.collect()} == {"src/tide.ts", "src/moon.ts", "test/tide.test.ts", "lib/shore.py", "lib/sand.py"}


def test_edges(built):
    edges, external = built.edges()
    assert {tuple(r) for r in edges.collect()} == {("src/tide.ts", "src/moon.ts"), ("test/tide.test.ts", "src/tide.ts"), ("lib/shore.py", "lib/sand.py")}
    assert {tuple(r) for r in external.collect()} == {("src/tide.ts", "fs")}
    picture = graph.mermaid(edges)
    assert picture.startswith("graph LR") and picture.count("-->") == 3


def test_questions(built):
    assert [r["name"] for r in index.search_intent(built, "rise the tide").collect()][0] == "riseTide"
    found, hop, bodies = index.context_pack(built, "rise tide")
    assert "riseTide" in {r["name"] for r in found.collect()}
    assert ("src/tide.ts", "src/moon.ts") in {tuple(r) for r in hop.collect()}
    assert "return moon(n);" in {r["name"]: r["body"] for r in bodies.collect()}["riseTide"]
    context = index.get_context(built, "riseTide")
    assert [(r["path"], r["line_no"], r["symbol"]) for r in context["callers"].collect()] == [("test/tide.test.ts", 1, None), ("test/tide.test.ts", 3, "rises")]
    assert {r["src"] for r in context["dependents"].collect()} == {"test/tide.test.ts"}
    assert [r["path"] for r in index.coverage(built, "riseTide").collect()] == ["test/tide.test.ts"]
    assert search.definitions(built.symbols, "moon").count() == 1


def test_refresh_and_reload(spark, built, tree, tmp_path):
    index.save(built, str(tmp_path / "index"))
    old = index.load(spark, str(tmp_path / "index"))
    files, _ = source_tree(spark, str(tree))
    changed = files.filter(F.col("path") != "lib/sand.py").withColumn("text", F.when(F.col("path") == "src/moon.ts", "export function star() {\n}\n").otherwise(F.col("text"))).withColumn("mtime", F.when(F.col("path") == "src/moon.ts", F.col("mtime") + F.expr("interval 1 second")).otherwise(F.col("mtime")))
    new, actions = index.refresh(old, changed)
    assert {r["path"]: r["action"] for r in actions.filter("action <> 'reused'").collect()} == {"src/moon.ts": "changed", "lib/sand.py": "removed"}
    names = {r["name"] for r in new.symbols.collect()}
    assert "star" in names and "moon" not in names
    assert {r["path"] for r in new.files.collect()} == {"src/tide.ts", "src/moon.ts", "test/tide.test.ts", "lib/shore.py"}
    gone = edits.dropped_names(old.symbols, new.symbols)
    assert ("src/moon.ts", "moon") in {tuple(r) for r in gone.collect()}


def test_update_rewrites_only_touched_buckets(spark, tree, tmp_path):
    folder = str(tmp_path / "kept")
    files, _ = source_tree(spark, str(tree))
    old = index.write(files, folder, buckets=4)
    before = {r["path"]: r["f"] for r in old.rows.select("path", F.input_file_name().alias("f")).collect()}
    change = spark.createDataFrame([("src/moon.ts", "export function star() {\n}\n"), ("lib/sand.py", None), ("src/sun.ts", "class Sun {\n}\n")], "path string, text string").withColumn("mtime", F.current_timestamp())
    for _ in range(2):
        new = index.update(folder, change, buckets=4)
        after = {r["path"]: r["f"] for r in new.rows.select("path", F.input_file_name().alias("f")).collect()}
        assert set(after) == {"src/tide.ts", "src/moon.ts", "src/sun.ts", "test/tide.test.ts", "lib/shore.py"}
        assert {r["name"] for r in new.symbols.collect()} >= {"star", "Sun", "riseTide"} and "moon" not in {r["name"] for r in new.symbols.collect()}
        assert [r["name"] for r in index.search_intent(new, "star sun").collect() if r["path"] != "src/tide.ts"]
    touched = {r["b"] for r in change.select(index._bucket(F.col("path"), 4).alias("b")).collect()}
    untouched = [p for p in before if p in after and not any(f"bucket={b}/" in before[p] for b in touched)]
    assert all(before[p] == after[p] for p in untouched)
    assert [r["line"] for r in index.skeleton(new, "src/sun.ts").collect()] == [1]
    rebuilt = index.build(new.rows.select("path", "mtime", "text"))
    assert {tuple(r) for r in rebuilt.symbols.collect()} == {tuple(r) for r in new.symbols.collect()}


def test_git_diff_names_symbols(spark, tree, built):
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "first")
    (tree / "src/moon.ts").write_text("export function moon(n) {\n  return n + 2;\n}\n")
    touched = edits.hunk_lines(git_diff(spark, str(tree)))
    assert [tuple(r) for r in touched.select("path", "line").collect()] == [("src/moon.ts", 2)]
    assert [tuple(r) for r in index.changed_symbols(built, touched).collect()] == [("src/moon.ts", ["moon"])]
    (tree / "src/moon.ts").write_text(FILES["src/moon.ts"])
    with pytest.raises(ValueError, match="dash"):
        git_diff(spark, str(tree), "--output=x")


def test_hook_log_tolerates_torn_rows(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"t":"2024-01-01T00:00:00Z","tool":"Edit","fired":true}\n\n{"t":"2024-01-0')
    assert [r["tool"] for r in hook_events(spark, str(tmp_path / "h.jsonl")).collect()] == ["Edit"]


def test_containment():
    assert contained("/a/b", "c/../d") == "/a/b/d"
    assert contained("/a/b", "../x") is None
    assert contained("/a/b", "/a/bc") is None


def test_config():
    assert load_config(None)[1] == []
    config, warnings = load_config('{"ignoreDirs": ["gen", "./a/b/", ""], "extensions": ["zig"], "suffixes": [".x"], "exclude": 3, "maxFileBytes": -1, "what": 1}')
    assert "gen" in config.ignored and config.ignored_paths == ["a/b"] and "zig" in config.extensions
    assert len(warnings) == 6
    assert load_config("[1")[1][0].startswith("not JSON")
    assert load_config("[]")[1] == ["not an object"]


def test_cursor():
    at = search.cursor(40, "v1")
    assert search.read_cursor(at, "v1") == (40, False) and search.read_cursor(at, "v2") == (40, True)
    with pytest.raises(ValueError, match="not a cursor"):
        search.read_cursor("zz", "v1")


def test_normalized_paths(spark):
    df = spark.createDataFrame([("a/b/x.ts", "../c/./d"), ("x.ts", "./"), ("x.ts", "../../y")], "p string, m string")
    out = df.select(graph.normalized(F.concat(F.regexp_replace("p", r"[^/]*$", ""), "m")).alias("n")).collect()
    assert [r["n"] for r in out] == ["a/c/d", "", "../../y"]


def test_symbol_context_and_replacement(spark, built):
    rows = index.symbol_context(built, "moon").orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["export function moon(n) {", "  return n + 1;", "}", ""]
    assert index.symbol_context(built, path="src/tide.ts", line=4).count() >= 3
    with pytest.raises(ValueError, match="no such symbol"):
        index.symbol_context(built, "nowhere")
    plan = spark.createDataFrame([("src/moon.ts", 1, "export const moon = 1;"), ("lib/shore.py", 2, "def walk():\n    return 2")], "path string, line long, body string")
    found = {r["path"]: r["text"] for r in index.replace_symbols(built, plan).collect()}
    assert found == {"src/moon.ts": "export const moon = 1;\n", "lib/shore.py": "import lib.sand\ndef walk():\n    return 2\n"}


def test_recap(spark):
    from lodestone.operators import ledger

    rows = [(1, "read_lines", "a.ts"), (2, "find_definition", "go stop"), (3, "search_code", "x y"), (4, "find_definition", "go"), (5, "read_lines", "a.ts"), (6, "stats", None)]
    found = ledger.recap(spark.createDataFrame(rows, "seq long, tool string, hint string"))
    assert [tuple(r)[:2] for r in found["files"].collect()] == [("a.ts", 2)]
    assert [tuple(r)[:2] for r in found["symbols"].collect()] == [("go", 2), ("stop", 1)]
    assert [r["hint"] for r in found["searches"].collect()] == ["x y"]
    assert [r["value"] for r in found["tools"].collect()] == ["read_lines", "find_definition", "search_code", "stats"]
    line = ledger.impact_line(spark.createDataFrame([(3, 1, True)], "n_files long, n_tests long, capped boolean")).first()[0]
    assert line == "referenced in 3+ other file(s), 1 test file(s)"
