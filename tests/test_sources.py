"""Trees with links, logs, git, stores, and what an index answers beside its tables."""

import json
import os
import random
import subprocess
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import Not, StringContains, StringStartsWith

from lodestone.operators import changes, edits, index, memory, search
from lodestone.plans.activity import digest_stale
from lodestone.sources.config import Config
from lodestone.sources.stores import DIGEST, JOURNAL, Store, get_digest, save_digest
from lodestone.sources.tree import append_hook, git_changes, hook_events, source_tree
from lodestone.sources.walk import Walk, listing
from lodestone.streaming.ledger import journal_sink

FILES = {
    "src/a.ts": "export class Boat {\n  row(n) {\n    return n;\n  }\n}\n",
    "src/open.ts": "export function never(n) {\n  if (n) {\n\nexport const after = (x) => x;\n",
    "test/a.test.ts": "it('rows', () => { new Boat().row(1); });\n",
}


def _write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


@pytest.fixture()
def tree(tmp_path):
    _write(tmp_path / "tree", FILES)
    return tmp_path / "tree"


def test_links_are_recorded_and_not_followed(spark, tree, tmp_path):
    _write(tmp_path / "outside", {"far.ts": "class Far {}\n"})
    os.symlink(tmp_path / "outside", tree / "linked")
    os.symlink(tree / "src/a.ts", tree / "src/b.ts")
    files, skipped = source_tree(spark, str(tree))
    assert {r["path"] for r in files.collect()} == set(FILES)
    assert {tuple(r) for r in skipped.collect()} == {("linked", "symbolic link"), ("src/b.ts", "symbolic link")}


def test_hook_log_is_trimmed(spark, tmp_path):
    path = str(tmp_path / "hooks.jsonl")
    for n in range(60):
        append_hook(path, {"t": "2024-01-01T00:00:00Z", "tool": "Edit", "lines": n, "fired": True}, most_bytes=2000, most_lines=10)
    rows = [json.loads(x) for x in open(path)]
    assert rows[-1]["lines"] == 59 and len(rows) < 40
    assert hook_events(spark, path).count() == len(rows)


def test_git_changes(spark, tree):
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "first")
    run("mv", "src/a.ts", "src/c.ts")
    (tree / "src/open.ts").write_text(FILES["src/open.ts"] + "// more\n// and more\n")
    (tree / "src/new.ts").write_text("class Fresh {\n}\n")
    counts, status, untracked = git_changes(spark, str(tree))
    assert {tuple(r) for r in edits.name_status(status).collect()} == {("src/c.ts", "R"), ("src/open.ts", "M")}
    assert {tuple(r) for r in edits.numstat(counts).collect()} == {("src/c.ts", 0, 0), ("src/open.ts", 2, 0)}
    built = index.build(source_tree(spark, str(tree))[0])
    loose = untracked.select(F.col("text").alias("path")).join(built.files.select("path", "n_lines"), "path", "left")
    touched = spark.createDataFrame([("src/open.ts", 4)], "path string, line long")
    found = changes.changed_files(edits.numstat(counts), edits.name_status(status), touched, built.symbols, loose, limit=2).collect()
    assert [(r["path"], r["status"], r["added"], r["symbols"]) for r in found] == [("src/new.ts", "?", 3, ["class Fresh"]), ("src/open.ts", "M", 2, ["function never"])]
    with pytest.raises(ValueError, match="dash"):
        git_changes(spark, str(tree), "-x")


def test_block_that_does_not_close(spark, tree):
    built = index.build(source_tree(spark, str(tree))[0])
    rows = index.symbol_context(built, "never").orderBy("line_no").collect()
    assert [r["line_no"] for r in rows][:3] == [1, 2, 3]
    assert index.symbol_bodies(built, built.symbols.filter("name = 'never'")).first()["body"] is None


def test_pages_and_batch(spark, tree):
    built = index.cached(index.build(source_tree(spark, str(tree))[0]))
    assert [(r["path"], r["total"]) for r in index.definitions_page(built, "Boat").collect()] == [("src/a.ts", 1)]
    assert index.definitions_page(built, "Boat", kind="enum").count() == 0
    assert [r["total"] for r in index.references_page(built, "Boat", 1, 5).collect()] == [2]
    assert [r["path"] for r in index.tests_page(built, "Boat").collect()] == ["test/a.test.ts"]
    answers = index.batch(built, [("find_definition", {"name": "Boat"}), ("batch", {}), ("symbol_context", {"name": "nowhere"}), ("search", {"literal": "row", "what": 1})])
    assert answers[0].count() == 1 and answers[1] == "unknown call: batch" and "no such symbol" in answers[2] and answers[3].startswith("search:")
    with pytest.raises(ValueError, match="1 to 20"):
        index.batch(built, [])
    assert set(index.get_context(built, "Boat", sections=("callers", "imports"))) == {"callers", "imports"}


def test_search_without_hits_heals_and_hints(spark, tree):
    old = index.build(source_tree(spark, str(tree))[0].filter("path <> 'src/a.ts'"))
    now = source_tree(spark, str(tree))[0]
    find = lambda texts: search.find_literal(texts, "class Boat")
    hits, fresh = index.healed_search(old, now, find)
    assert [r["path"] for r in hits.collect()] == ["src/a.ts"] and fresh.symbols.filter("name = 'Boat'").count() == 1
    assert index.healed_search(old, now, find, first_page=False)[0].isEmpty()
    assert search.zero_hints("foo(")[0].startswith("foo looks") and len(search.zero_hints("foo(")) == 2
    assert search.zero_hints("a.b") == ["the pattern was taken literally; search by pattern if it is one"]
    assert search.zero_hints("plain") == [] == search.zero_hints("a.b", regex=True)


def test_digest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "digest"), DIGEST)
    scan = spark.createDataFrame([("src/a.ts", "2001-01-01 00:00:00"), ("src/b.ts", "2999-01-01 00:00:00"), ("lib/c.ts", "2999-01-01 00:00:00")], "path string, at string").select("path", F.col("at").cast("timestamp").alias("mtime"))
    assert get_digest(store, scan) is None
    save_digest(store, "boats", ["src/"])
    text, covers, stale = get_digest(store, scan)
    assert (text, covers, [r["path"] for r in stale.collect()]) == ("boats", ["src/"], ["src/b.ts"])
    save_digest(store, "all of it", [])
    assert {r["path"] for r in get_digest(store, scan)[2].collect()} == {"src/b.ts", "lib/c.ts"}


def test_covers_are_looked_up(spark):
    scan = spark.createDataFrame([("a/b/c", 5), ("a/bc", 5), ("a", 1), ("x/y", 9)], "path string, mtime long")
    covers = spark.createDataFrame([(1, "a", 3), (2, "a/b", 9), (3, "z", 0), (4, "x/y", 0)], "digest int, prefix string, saved_at long")
    found = memory.digest_state(scan, covers)
    assert {tuple(r) for r in found.collect()} == {(1, 3, 2), (2, 1, 0), (4, 1, 1)}
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_covers_against_every_pair(spark):
    draw = random.Random(5)
    name = lambda: "/".join(draw.choice(["a", "b", ""]) for _ in range(draw.randint(1, 4)))
    maybe = lambda x: None if draw.random() < 0.1 else x
    scan = [(maybe(name()), maybe(draw.randrange(9))) for _ in range(60)]
    covers = [(maybe(draw.randrange(25)), maybe(name()), maybe(draw.randrange(9))) for _ in range(70)]
    covered, stale = {}, {}
    for path, mtime in scan:
        for digest, prefix, saved in covers:
            if None not in (path, prefix) and (path == prefix or path.startswith(prefix + "/")):
                covered.setdefault(digest, set()).add(path)
                stale.setdefault(digest, set()).update([path] if None not in (mtime, saved) and mtime > saved else [])
    found = memory.digest_state(spark.createDataFrame(scan, "path string, mtime int"), spark.createDataFrame(covers, "digest int, prefix string, saved_at long"))
    assert found.dtypes == [("digest", "int"), ("n_covered", "bigint"), ("n_stale", "bigint")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((d, len(p), len(stale[d])) for d, p in covered.items()), key=str)


def test_many_covers_of_one_prefix_with_many_paths(spark):
    """Their pairs are 2,500 million; a path is newer than the covers with a smaller number."""
    n = 50_000
    scan = spark.range(n).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("path"), F.col("id").alias("mtime"))
    covers = spark.range(n).select(F.col("id").alias("digest"), F.lit("a").alias("prefix"), F.col("id").alias("saved_at"))
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        wrong = memory.digest_state(scan, covers).filter(~((F.col("n_covered") == n) & (F.col("n_stale") == n - 1 - F.col("digest"))))
        assert wrong.count() == 0 and memory.digest_state(scan, covers).count() == n
    finally:
        stop.cancel()


def test_events_without_a_type_or_user_lie_under_no_cover(spark, tmp_path):
    rows = [("view", 1, 5), ("view", None, 9), (None, 1, 9), ("1", 2, 1)]
    spark.createDataFrame(rows, "event_type string, user_id long, ts long").write.parquet(str(tmp_path / "events.parquet"))
    # As in the SQL: concatenation with a null is null.
    assert {tuple(r) for r in digest_stale(spark, str(tmp_path)).collect()} == {(1, 1, 0), (None, 1, 0), (2, 1, 0)}


def test_journal_sink(spark, tmp_path):
    store = Store(spark, str(tmp_path / "journal"), JOURNAL)
    rows = spark.range(20).select(F.col("id").alias("seq"), F.current_timestamp().alias("ts"), F.lit("t").alias("tool"), F.lit(None).cast("string").alias("hint"))
    rows.write.parquet(str(tmp_path / "in"))
    query = journal_sink(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "state"), most=15)
    query.processAllAvailable()
    query.stop()
    assert sorted(r["seq"] for r in store.read().collect()) == list(range(5, 20))


def test_ruled_out_folders_are_not_opened(tmp_path):
    _write(tmp_path, {"src/a.ts": "", "src/deep/b.ts": "", "lib/c.ts": "", "node_modules/x/d.ts": "", "src/gen/e.ts": "", "src/old-api/f.ts": "", "src/deep/node_modules/g.ts": ""})
    opened = []

    def scan(folder):
        opened.append(os.path.relpath(folder, tmp_path))
        return os.scandir(folder)

    def walk(*filters):
        opened.clear()
        walked = Walk(str(tmp_path), {"node_modules"}, scan)
        assert list(walked.pushFilters(list(filters))) == list(filters)
        return sorted(r[0] for p in walked.partitions() for r in walked.read(p))

    path = ("path",)
    assert walk() == ["lib/c.ts", "src/a.ts", "src/deep/b.ts", "src/gen/e.ts", "src/old-api/f.ts"]
    assert sorted(opened) == [".", "lib", "src", "src/deep", "src/gen", "src/old-api"]
    walk(StringStartsWith(path, "src/deep/"))
    assert sorted(opened) == [".", "src", "src/deep"]
    walk(Not(StringStartsWith(path, "src/gen/")), Not(StringContains(path, "old-")))
    assert sorted(opened) == [".", "lib", "src", "src/deep"]


def test_many_folders_are_dealt_and_hidden_names_are_listed(spark, tmp_path):
    names = [f"p{n % 7}/q{n}/.r{n % 3}/_f{n}.ts" for n in range(400)]
    _write(tmp_path, dict.fromkeys(names, "let a = 1;\n") | {"p0/big.ts": "x" * 50, "p1/bad.txt": ""})
    listed = listing(spark, str(tmp_path), [])
    assert sorted(r["path"] for r in listed.collect()) == sorted([*names, "p0/big.ts", "p1/bad.txt"]) and listed.rdd.getNumPartitions() > 100
    files, skipped = source_tree(spark, str(tmp_path), Config(most_bytes=40))
    assert sorted(r["path"] for r in files.collect()) == sorted(names)
    assert [tuple(r) for r in skipped.collect()] == [("p0/big.ts", "too large")]
    scoped, _ = source_tree(spark, str(tmp_path), scope="p3/q3")
    assert [r["path"] for r in scoped.collect()] == ["p3/q3/.r0/_f3.ts"]
    with pytest.raises(Exception, match="nowhere"):
        listing(spark, str(tmp_path / "nowhere"), []).count()
