import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup
from tests.llm.cases import awkward, empty


def plain(rows):
    """By a dictionary of whole texts: (doc_id, keep_id, group_size, sha256), and how many rows of a group are kept."""
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str), len(groups)


def check(found, rows):
    expected, n_groups = plain(rows)
    got = found.collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == expected
    kept = [r for r in got if r["kept"]]
    assert len(kept) == n_groups and all(r["doc_id"] == r["keep_id"] for r in kept)


def weak(sha):
    """Three keys for all texts: every one collides."""
    return F.pmod(F.xxhash64(sha), F.lit(3)).cast("string").cast("binary")


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, weak])
def test_awkward_rows(spark, hashed):
    docs = awkward(spark)
    check(exact_dedup.exact_duplicates(docs, hashed), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert exact_dedup.exact_duplicates(empty(spark), hashed).count() == 0


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, weak])
def test_copies_with_other_white_space(spark, hashed):
    rows = [(i, " ".join("ab" * (i % 7)) + "\n" * (i % 5)) for i in range(300)] + [(3, "same"), (3, "same"), (None, " same"), (2, "s a m e"), (9, "s ame")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(exact_dedup.exact_duplicates(docs, hashed), rows)
    assert exact_dedup.drop_duplicates(docs, hashed).count() == plain(rows)[1]


def test_shuffled_groups(spark, monkeypatch):
    """Beyond the broadcast bound the same rows come."""
    monkeypatch.setattr(exact_dedup, "broadcast_if_small", lambda df: df)
    rows = [(i, "x" * (i % 40)) for i in range(400)]
    check(exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_no_python_worker_and_no_whole_texts_moved(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text#" not in plan
