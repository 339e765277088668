import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from lodestone.llm import decontamination as D
from lodestone.llm.queries import QUERIES
from tests.llm.cases import awkward, empty


def _shingles(words, size):
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def _brute(docs, items, least=0.8):
    """Every window of every document with every item."""
    found = {}
    for d, text in docs:
        words = text.lower().split()
        for i, item in items:
            own = item.lower().split()
            size = min(5, len(own))
            if not own or len(words) < size:
                continue
            mine = Counter(_shingles(own, size))
            for start in range(len(words) - size + 1):
                window = Counter(_shingles(words[start : start + len(own)], size))
                shared = sum((mine & window).values())
                s = shared / (sum(mine.values()) + sum(window.values()) - shared)
                if s >= least and s > found.get((d, i), (0, 0))[0]:
                    found[d, i] = (s, start)
    return found


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in QUERIES["op7_decontamination"](spark, sf_dir).collect()}
    assert found == _brute(docs, items)


def test_items_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", 0)
    docs = spark.createDataFrame([(1, "one two three four five six seven")], "doc_id long, text string")
    found = D.contaminated(docs, spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"], r["start"]) for r in found.collect()] == [(1, 1, 0)]


@pytest.mark.parametrize("broadcast", [D.BROADCAST_SHINGLES, 0])
def test_edited_passages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", broadcast)
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(draw.choice([3, 5, 8, 20, 40, 60])))) for i in range(40)] + [(90, "a a a a a a a a b"), (91, ""), (92, None), (93, "b b b b b b b b b b b b c c c c c c c c c c c d e f g h i j k")]
    docs = []
    for d in range(250):
        own = (items[draw.choice([*range(41), 43, 43, 43, 43])][1] or "").split()
        for _ in range(draw.choice([0, 0, 1, 1, 2])):
            at = draw.randrange(len(own) + 1)
            own[at:at] = [word()] if draw.random() < 0.5 else []
            if own and draw.random() < 0.5:
                del own[draw.randrange(len(own))]
        docs.append((d, " ".join([word() for _ in range(draw.choice([0, 1, 30]))] + own + [word() for _ in range(draw.choice([0, 2, 30]))])))
    expected = _brute(docs, [(i, t or "") for i, t in items])
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in D.contaminated(df, bench).collect()}
    assert set(found) == set(expected)
    assert all(abs(found[k][0] - expected[k][0]) < 1e-9 for k in found)
    left = {r["doc_id"] for r in D.decontaminate(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in found}


def test_awkward_documents(spark):
    bench = spark.createDataFrame([(1, "a plain text of a few words, and no more."), (1, "a plain text of a few words, and no more."), (2, " "), (None, "no id here but words")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.contaminated(awkward(spark), bench).collect()}
    assert found == {(1, 1), (None, None)}
    left = D.decontaminate(awkward(spark), bench)
    assert left.count() == awkward(spark).count() - 4 and left.columns == awkward(spark).columns
    assert D.contaminated(empty(spark), bench).count() == 0
    assert D.contaminated(awkward(spark), bench.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [D.BROADCAST_SHINGLES, 0])
def test_windows_over_the_edges_of_parts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", broadcast)
    draw = random.Random(11)
    items = [(i, " ".join(draw.choice("abcdefgh") for _ in range(n))) for i, n in enumerate([5, 9, 14, 14, 30])]
    docs = [(d, " ".join(draw.choice([t, t.rsplit(" ", 1)[0], draw.choice("abcdefgh")]) for _, t in draw.choices(items, k=draw.choice([1, 2, 4, 8])))) for d in range(40)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, parted = [], []
    for starts, found in ((10_000, whole), (7, parted)):
        monkeypatch.setattr(D, "PART_STARTS", starts)
        monkeypatch.setattr(D, "PART_WORDS", 0)
        found += sorted(tuple(r) for r in D.contaminated(df, bench).collect())
    assert parted == whole
    assert {r[:2]: r[4] for r in parted} == {k: s for k, (s, _) in _brute(docs, items).items()}


_SMALL_HEAP = """
from pyspark.sql import SparkSession
from lodestone.llm import decontamination as D
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.adaptive.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
item = " ".join(f"word{i}" for i in range(20))
docs = spark.createDataFrame([(1, " ".join([item] * 600))], "doc_id long, text string")
print("FOUND", [tuple(r) for r in D.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()])
"""


def test_hits_of_a_long_document_do_not_each_hold_all_its_words():
    """12,000 words and 9,600 hits: together some 2 GB, if every hit has a copy of them."""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 700m pyspark-shell", "PYTHONPATH": f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"}
    ran = subprocess.run([sys.executable, "-c", _SMALL_HEAP], env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND [(1, 1, 0, 20, 1.0)]" in ran.stdout, ran.stderr[-1500:]
