import random
from collections import defaultdict

import numpy as np
import xxhash

from lodestone.llm import components as C
from lodestone.llm import simhash as S
from lodestone.llm.queries import QUERIES
from tests.llm.cases import awkward, empty


def _slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps):
    """Smallest id reachable by links of at most 4 bits, over all pairs."""
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(fps):
        for j, b in fps[:n]:
            if (a ^ b).bit_count() <= 4:
                a_, b_ = find(i), find(j)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i, _ in fps}


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    fps = [(i, _slow_fingerprint(t or "")) for i, t in docs]
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op1_simhash"](spark, sf_dir).collect()}
    expected = _components(fps)
    assert found == {i: (f"{fp:016x}", expected[i]) for i, fp in fps}


def test_golay_code():
    high, low, leaders = S.golay()
    words = np.random.default_rng(1).integers(0, 1 << 23, 20000)
    code = words ^ leaders[high[words >> 11] ^ low[words & 0x7FF]]
    assert (np.bitwise_count(code ^ words) <= 3).all()
    assert (high[code >> 11] ^ low[code & 0x7FF] == 0).all()
    near = S.near_codewords(words)
    assert set((near >= 0).sum(axis=1)) == {1, 6}


def test_close_fingerprints_share_a_key():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in draw.choice(64, size=i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys_a, keys_b = defaultdict(set), defaultdict(set)
    for fps, keys in ((a, keys_a), (b, keys_b)):
        for rows, values in S.keys_of(fps):
            for r, v in zip(rows.tolist(), values.tolist(), strict=True):
                keys[r].add(v)
    assert all(keys_a[i] & keys_b[i] for i in range(len(a)))
    assert max(map(len, keys_a.values())) <= 136


def test_every_pattern_of_four_bits_in_the_segments():
    a = np.full(1, 0x0123456789ABCDEF, dtype=np.uint64)
    own = {int(v[0]) for _, v in S.keys_of(a) if len(v)}
    draw = random.Random(8)
    for _ in range(1500):
        bits = draw.sample(range(46, 64), draw.randint(0, 4))
        bits += draw.sample(range(46), 4 - len(bits))
        b = a ^ np.uint64(sum(1 << x for x in bits))
        assert own & {int(v[0]) for _, v in S.keys_of(b) if len(v)}, bits


def test_dense_and_long_runs(spark):
    """Many near copies with one key, and runs over the limit, are linked as all pairs would link them."""
    draw = random.Random(9)
    fps = {draw.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        core = draw.getrandbits(64)
        fps |= {core ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 3))) for _ in range(200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    expected = _components([(x, x) for x in fps])
    for limit in (S.RUN, 20):
        labels = {r["node"] % (1 << 64): r["label"] for r in C.components(S.links(df, run_limit=limit)).collect()}
        groups, found = defaultdict(set), defaultdict(set)
        for x in fps:
            groups[expected[x]].add(x)
            found[labels.get(x, ("alone", x))].add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_long_run_is_cut_by_blocks():
    draw = np.random.default_rng(3)
    run = np.unique(draw.integers(0, 1 << 63, 5000, dtype=np.uint64))
    near = np.unique(np.concatenate([run, run[:500] ^ np.uint64(1 << 40), run[:50] ^ np.uint64(3 << 60)]))
    assert len(S.forest_of(near)) == 550


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 5), (7, 7), (9, 3)] + [(1000, 1000 + i) for i in range(1, 50)]
    found = {r["node"]: r["label"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 141)} | {3: 3, 5: 3, 9: 3} | {i: 1000 for i in range(1000, 1050)}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_documents(spark):
    rows = S.near_duplicates(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    zero = {r["doc_id"]: r["component_id"] for r in rows if r["fp"] == 0}
    assert zero == {2: 2, 3: 2, 4: 2, 9: 2, None: 2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    kept = S.keep_representatives(awkward(spark)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 2, 5, 7, 8]
    assert S.near_duplicates(empty(spark)).count() == 0 and S.keep_representatives(empty(spark)).count() == 0
    plain = awkward(spark).filter("doc_id > 1")
    assert sorted(r["doc_id"] for r in S.keep_representatives(plain).collect()) == [2, 5, 7, 8]
