import random
import re
from collections import Counter

import pytest

from lodestone.llm import collocations as c
from tests.llm.cases import awkward, empty


def plain(rows, least, best=2000, most_words=5, subsumed_at=100):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        scored = []
        for g, a in cand.items():
            if 100 * inside[g] >= subsumed_at * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def rows_of(found):
    return sorted(tuple(r) for r in found.collect())


def made(seed, n=300, vocab=12):
    rng = random.Random(seed)
    words = ["the", "of", "Über", "İx", "a", "É", "x\x01y", "B", "z"] + [f"w{i}" for i in range(vocab)]
    texts = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(30)):
            text += rng.choice(words[: rng.choice([3, 9, 21])]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", " ; "])
        texts.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return texts


@pytest.mark.parametrize("least,most_words,best,subsumed_at", [(5, 5, 2000, 100), (3, 4, 7, 60), (2, 2, 2000, 100), (8, 3, 2000, 100)])
def test_equals_brute_force(spark, least, most_words, best, subsumed_at):
    rows = made(least)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(c.collocations(docs, least, most_words, best, subsumed_at)) == plain(rows, least, best, most_words, subsumed_at)


def test_full_bitmaps_small_chunks_and_cut_stripes(spark, monkeypatch):
    """A bitmap of a few bits, chunks of a few texts, every prefix hot and rows of two entries give the same phrases."""
    rows = made(1)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    expected = plain(rows, 4)
    for name, value in (("CHUNK", 500), ("SHARE", 10**6), ("ENTRIES", 2), ("HELD", 20), ("MOST_BITS", 1 << 15)):
        monkeypatch.setattr(c, name, value)
    monkeypatch.setattr(c, "_bitmap", lambda *_: c.np.full(4096, 255, c.np.uint8))
    assert rows_of(c.collocations(docs, 4)) == expected


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert rows_of(c.collocations(docs)) == plain(rows, 100)
    assert rows_of(c.collocations(docs, 1)) == plain(rows, 1)
    assert c.collocations(empty(spark)).count() == 0


def test_products_beyond_64_bits(spark):
    a = 3_000_000_000_000
    row = spark.range(1).select(c._exact(c.F.lit(1000), c.F.lit(a), c.F.lit(a + 7)).alias("over"), c._exact(c.F.lit(a), c.F.lit(3)).alias("under"))
    assert row.selectExpr("over div under").first()[0] == 1000 * a * (a + 7) // (a * 3)
