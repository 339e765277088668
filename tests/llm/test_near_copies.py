import random

import numpy as np

import corpus_pipeline
from lodestone.llm import near_copies as N
from lodestone.llm import simhash
from tests.llm.cases import awkward, empty


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute(rows):
    sets, parts = [_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parts[i] != i:
            i = parts[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                parts[max(find(i), find(j))] = min(find(i), find(j))
    return {d for i, (d, _) in enumerate(rows) if find(i) == i}


def _rows(seed=8):
    draw = random.Random(seed)
    rows = []
    for _ in range(25):
        words = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([3, 6, 40, 150]))]
        for _ in range(draw.randint(1, 8)):  # a chain of edits, each copy of the one before
            rows.append(" ".join(words))
            for _ in range(draw.choice([0, 1, 1, 2, len(words) // 20])):
                words[draw.randrange(len(words))] = f"e{draw.randint(0, 10**6)}"
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [f"{passage} " + " ".join(f"o{draw.randint(0, 10**6)}" for _ in range(20)) for _ in range(30)]
    rows += ["", " \n", "Same Words here", "same  words\there"]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_stage_against_brute_force(spark):
    """Edited copies lie further apart than four bits of a fingerprint."""
    rows = _rows()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert found == _brute(rows)


def _similar_pairs(draw, n):
    """Pairs of sorted sets around the threshold, of any size, with a common part that is left out of the keys."""
    none = np.empty(0, dtype=np.uint64)
    for _ in range(n):
        base = np.unique(draw.integers(0, 1 << 63, int(draw.integers(2, 700)), dtype=np.uint64) * np.uint64(2))
        stay = draw.choice([0.85, 0.9, 0.95])
        a, b = (base[draw.random(len(base)) < stay] for _ in range(2))
        a = np.unique(np.r_[a, draw.integers(0, 1 << 63, int(draw.integers(0, 3)), dtype=np.uint64)])
        common = np.sort(base[draw.random(len(base)) < draw.choice([0.1, 0.5, 1.0])]) if draw.random() < 0.5 else none
        if len(a) and len(b) and N.similar(a, b, 0.8):
            yield a, b, common, draw.integers(4, 40, len(common))


def test_similar_sets_share_a_key():
    draw = np.random.default_rng(3)
    shared = lambda f, a, b, c, o: len(np.intersect1d(f(a, 0.8, c, o), f(b, 0.8, c, o)))
    for pair in _similar_pairs(draw, 4000):
        assert shared(N.prefix, *pair) and shared(N.set_keys, *pair)


def test_sketches_never_differ_by_more_than_the_sets():
    draw = np.random.default_rng(4)
    for a, b, _, _ in _similar_pairs(draw, 300):
        apart = int(np.bitwise_count(N.sketch(a) ^ N.sketch(b)).sum())
        assert apart <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) * 0.2 / 1.8 + 1e-9
        assert N.may_be_similar(N.wide_sketch(a), N.wide_sketch(b), len(a) + len(b), 0.8)
    for n in (20, 300, 5000):
        a, b = (np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2))
        assert not N.may_be_similar(N.wide_sketch(a), N.wide_sketch(b), len(a) + len(b), 0.8)


def test_size_classes_of_similar_sets_are_neighbours():
    edges = N._edges(0.8, 1 << 14)
    at = lambda n: int(np.searchsorted(edges, n, side="right")) - 1
    for n in range(1, 12000):
        assert at(n) - at(max(1, -(-8 * n // 10))) <= 1 and n <= edges[at(n) + 1] - 1


def test_groups_of_one_key_are_compared_in_cells(spark, monkeypatch):
    """However a large group is cut into blocks, the result is that of brute force."""
    monkeypatch.setattr(N, "FEW", 2)
    monkeypatch.setattr(N, "BLOCK", 5)
    draw = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):  # copies of one text that are seldom copies of each other
        words = list(base)
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(60)] = f"e{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in N.keep_first_copies(docs).collect()} == _brute(rows)


def test_members_of_hot_keys(spark, monkeypatch):
    """Keys that half of the texts have are counted in parts, with the sums of a plain count; so are all others."""
    monkeypatch.setattr(N, "SALTS", 7)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [" ".join(base[:80] + [f"e{i}x{j}" for j in range(6)]) for i in range(40)]
    rows += [" ".join(f"o{draw.randint(0, 10**6)}" for _ in range(50)) for _ in range(38)]
    rows += [rows[0], rows[50], rows[50] + " more", "", None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    common, often, hot = N.sampled_orders(docs, 0.8, 5, 42)
    holders = {}
    for text in {r or "" for r in rows}:
        for key in N.set_keys(N.shingle_set(text), 0.8, common, often).view(np.int64).tolist():
            holders.setdefault(key, set()).add(text)
    assert len(hot) and set(hot.tolist()) == {k for k, held in holders.items() if len(held) >= N.COMMON}
    found = N.shared_keys(docs, 0.8, 5, 42).collect()
    assert len(found) == len({(r["key"], r["node"]) for r in found})
    plain = [(k, len(held)) for k, held in holders.items() if len(held) > 1 for _ in held]
    assert sorted((r["key"], r["members"]) for r in found) == sorted(plain)
    assert max(n for _, n in plain) >= 40
    assert {r["doc_id"] for r in N.keep_first_copies(docs).collect()} == _brute(list(enumerate(rows)))


def test_awkward_documents(spark):
    rows = N.keep_first_copies(awkward(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, i) for i in (1, 2, 5, 7, 8)] + [(True, 0)]
    assert N.keep_first_copies(empty(spark)).count() == 0


def test_fingerprints_come_first_and_keys_find_the_rest(spark, monkeypatch):
    """Texts within four bits are brought together by SimHash and checked; keys bring no text together with one that it is linked to."""
    draw = random.Random(31)
    rows = []
    for i in range(12):
        words = [f"w{i}x{j}" for j in range(300)]
        rows += [" ".join(words), " ".join(words[:-1]), " ".join(words).upper(), " ".join(words + ["more"])]
        for _ in range(4):  # similar, but further apart
            words[draw.randrange(300)] = f"e{draw.randint(0, 10**6)}"
        rows.append(" ".join(words))
    rows += ["", " ", "x y z", "x y q"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    text_of = {r["node"]: r["text"] for r in docs.select(N._node().alias("node"), "text").collect()}
    bits = {node: simhash.fingerprint(text) for node, text in text_of.items()}
    close = {(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= simhash.RADIUS}
    asked, verified = [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *rest: (asked.append({(r["a"], r["b"]) for r in pairs.collect()}), verified(pairs, *rest))[1])
    kept = {r["doc_id"] for r in N.keep_first_copies(docs).collect()}
    assert kept == _brute(list(enumerate(rows)))

    def joined(pairs):
        parent = {n: n for n in bits}
        for _ in bits:
            for a, b in pairs:
                parent[a] = parent[b] = min(parent[a], parent[b])
        return parent

    assert len(close) >= 30 and asked[0] <= close and joined(asked[0]) == joined(close)
    similar = {(a, b) for a, b in asked[0] if N.similar(N.shingle_set(text_of[a]), N.shingle_set(text_of[b]), 0.8)}
    linked = joined(similar)
    assert asked[1] and all(linked[a] != linked[b] for pairs in asked[1:] for a, b in pairs)
