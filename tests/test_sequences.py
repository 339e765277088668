"""Closed forms with windows against plain loops over random input."""

import random

from pyspark.sql import functions as F

from lodestone.operators import edits, ledger, search, spans


def test_clamped_depth(spark):
    draw = random.Random(1)
    rows = [(p, n, "".join(draw.choice("{}a") for _ in range(draw.randint(0, 4)))) for p in range(40) for n in range(1, 15)]
    found = {(r["path"], r["line_no"]): r["depth"] for r in spans.brace_depth(spark.createDataFrame(rows, "path int, line_no int, line string")).collect()}
    for p in range(40):
        depth = 0
        for q, n, line in rows:
            if q == p:
                assert found[p, n] == depth
                depth = max(0, depth + line.count("{") - line.count("}"))


def _calls(draw):
    return [(k, seq, draw.choice("ab"), draw.choice([100, 900])) for k in range(30) for seq in range(20)]


def _suppressed(rows):
    out, last = {}, {}
    for key, seq, signature, chars in rows:
        seen = last.get(key)
        if seen and seen[0] == signature and seen[1] >= 800 and seen[2]:
            out[key, seq], last[key] = True, (seen[0], seen[1], False)
        else:
            out[key, seq], last[key] = False, (signature, chars, True)
    return out


def test_repeats(spark):
    # An answer to equal arguments with an equal signature has one length.
    rows = [(k, s, g, {"a": 900, "b": 100}[g]) for k, s, g, _ in _calls(random.Random(2))]
    found = ledger.repeats(spark.createDataFrame(rows, "key int, seq int, signature string, chars int")).collect()
    assert {(r["key"], r["seq"]): r["suppressed"] for r in found} == _suppressed(rows)


def test_blind_writes_and_sessions(spark):
    draw = random.Random(4)
    rows, clock = [], 0
    for seq in range(600):
        clock += draw.choice([1, 600, 1800, 1801, 4000])
        rows.append((seq % 7, clock, seq, draw.choice(["w", "c", "x"])))
    df = spark.createDataFrame(rows, "key int, s long, seq int, tool string").withColumn("ts", F.timestamp_seconds("s"))
    blind = {r["key"]: (r["writes"], r["blind"]) for r in ledger.blind_writes(df, F.col("tool") == "w", F.col("tool") == "c").collect()}
    numbered = {(r["key"], r["seq"]): r["session"] for r in ledger.sessions(df).collect()}
    for key in range(7):
        writes = bad = session = 0
        checked, last = False, None
        for k, s, seq, tool in rows:
            if k != key:
                continue
            session += last is None or s - last > 1800
            last = s
            assert numbered[key, seq] == session
            if tool == "w":
                writes, bad, checked = writes + 1, bad + (not checked), False
            elif tool == "c":
                checked = True
        assert blind[key] == (writes, bad)


def test_attribution_takes_first_of_a_line(spark):
    symbols = spark.createDataFrame([("f", 2, 0, "a", "k"), ("f", 2, 1, "b", "k"), ("f", 5, 2, "c", "k")], "path string, line int, ord int, name string, kind string")
    hits = spark.createDataFrame([("f", 1, 1), ("f", 2, 1), ("f", 4, 1), ("f", 5, 1), ("g", 5, 1)], "path string, line_no long, col int")
    found = {(r["path"], r["line_no"]): r["symbol"] for r in search.attribute(hits, symbols).collect()}
    assert found == {("f", 1): None, ("f", 2): "a", ("f", 4): "a", ("f", 5): "c", ("g", 5): None}


def test_literal_filter_changes_nothing(spark):
    texts = spark.createDataFrame([("a", "x aa aaa\n\naa"), ("b", "nothing"), ("c", "a.a aa")], "path string, text string")
    a = {tuple(r) for r in search.find_pattern(texts, "aa", "aa").collect()}
    b = {tuple(r) for r in search.find_pattern(texts, "aa").collect()}
    c = {tuple(r) for r in search.find_literal(texts, "aa").collect()}
    assert a == b == c and ("a", 1, 3, "x aa aaa") in a and len(a) == 4


def test_splice(spark):
    texts = spark.createDataFrame([("a", "1\r\n2\r\n3\r\n4"), ("b", "1\n2\n"), ("c", "1\n2\n3"), ("d", "same")], "path string, text string")
    plan = [("a", 2, 3, "x\ny\nz"), ("a", 4, 4, "w"), ("b", 2, 1, "new"), ("c", 1, 2, "p"), ("c", 2, 3, "q")]
    found = {r["path"]: r["text"] for r in edits.splice(texts, spark.createDataFrame(plan, "path string, start_line long, end_line long, body string")).collect()}
    assert found == {"a": "1\r\nx\r\ny\r\nz\r\nw", "b": "1\nnew\n2\n", "c": None, "d": "same"}


def test_numstat(spark):
    rows = spark.createDataFrame([("3\t1\ta.ts",), ("-\t-\tp.png",), ("1\t0\tsrc/{old => new}/x.ts",), ("2\t2\told.ts => new.ts",)], "text string")
    assert {tuple(r) for r in edits.numstat(rows).collect()} == {("a.ts", 3, 1), ("p.png", 0, 0), ("src/new/x.ts", 1, 0), ("new.ts", 2, 2)}
