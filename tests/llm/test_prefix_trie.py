import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import prefix_trie as t

SCHEMA = "conv_id long, turn long, role string, text string, name string, above string, depth int, value long, pos string"


def plain(rows, group=5, most=8):
    """Each prefix as the tuple of its turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        whole = own.get(base, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p in members:
        value = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += p not in children
    first = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted(
        (first[p], len(p), first[p[:-1]] if p else -(10**18), len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest())
        for p, m in members.items()
    )


def check(spark, rows, **k):
    docs = spark.createDataFrame([(*r, "n", "a", 1, 2, "p") for r in rows], SCHEMA)
    found = sorted(tuple(-(10**18) if x is None else x for x in r) for r in t.conversation_trie(docs, **k).collect())
    assert found == plain(rows, k.get("group", 5), k.get("most_shared", 8))


def made(seed, convs, turns, texts):
    rng = random.Random(seed)
    return [(c, k, rng.choice(["user", "assistant"]), "é" * rng.randrange(texts)) for c in range(-3, convs) if c % 7 for k in range(rng.randrange(turns))]


@pytest.mark.parametrize("seed,convs,turns,texts", [(1, 60, 12, 2), (2, 200, 5, 3)])
def test_equals_brute_force(spark, seed, convs, turns, texts):
    check(spark, made(seed, convs, turns, texts))


def test_long_conversations(spark, monkeypatch):
    """Pieces of four turns: names and totals cross many of them."""
    monkeypatch.setattr(t, "PIECE", 2)
    rows = [(c, k, "u", "ab" if k < 30 + c else f"{c % 3}") for c in range(10, 22) for k in range(37 + 3 * c % 40)]
    check(spark, rows, most_shared=40)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(t, "IDS", 3)
    long = "goes on and on. " * 20000
    rows = [(0, 0, "u", "a"), (0, 0, "u", "a"), (0, None, None, None), (None, 1, "u", "lost"), (4, 1, "u", long), (4, 1, "v", long), (5, 0, "", "uu"), (6, 3, "u", "u"), (7, None, "u", None), (7, None, "u", None)]
    rows += [(c, 0, "u", "same") for c in range(100, 130)] + [(c, 1, "u", "same") for c in range(100, 130)]
    check(spark, rows)
    check(spark, [(1, 0, "u", "only")] * 12)
    assert t.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_numbers_of_a_conversation_across_partitions(spark):
    turns = spark.createDataFrame([(1, k, bytes([k % 250]), 1) for k in range(400)] + [(2, 0, b"x", 1)], "conv_id long, turn long, digest binary, bytes long")
    found = t._numbered(turns.repartition(4)).filter(F.col("conv_id") == 1).orderBy("pos").collect()
    assert [r["pos"] for r in found] == list(range(400)) and [r["digest"] for r in found] == [bytes([k % 250]) for k in range(400)]
