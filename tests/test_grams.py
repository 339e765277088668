"""Searches over postings against full scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import grams, index, search

ALPHABET = ["ab", "Ab", "c", "_", "(", " ", "\n", "\r\n", "é", "K", "İ", "ſ", "k", "s", "i", "Σ", "ς", "😀"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    return [(f"d{n % 5}/f{n}.ts", "".join(draw.choices(ALPHABET, k=draw.randrange(0, 60)))) for n in range(300)] + [("n/none.ts", None), ("n/e.ts", ""), ("n/long.ts", "abc" * 300)]


@pytest.fixture(scope="module")
def posted(spark, texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("posted") / "index")
    tree = spark.createDataFrame(texts, "path string, text string").withColumn("mtime", F.lit(0).cast("timestamp"))
    index.write(tree, folder, buckets=3)
    index.save_grams(spark, folder)
    return folder


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("literal", ["abc", "ab(", "abab", "ékK", "kſi", "cabcab(", "zzz", "ab", "😀ab", "Σsk"])
@pytest.mark.parametrize("ignore_case", [False, True])
def test_literals_equal_a_full_scan(spark, posted, literal, ignore_case):
    built = index.load(spark, posted, 3)
    assert _rows(index.find_literal(built, literal, ignore_case)) == _rows(search.find_literal(built.texts, literal, ignore_case))


@pytest.mark.parametrize("pattern", ["abc", "ab+c", "abx*c", "abc|kkk", "(abc)?c", r"ab\(", r"\bab[ck]*_", "a{2}b", "(?i)ABC", "abck{0,2}s", "^ab.*abc$"])
def test_patterns_equal_a_full_scan(spark, posted, pattern):
    built = index.load(spark, posted, 3)
    assert _rows(index.find_pattern(built, pattern)) == _rows(search.find_pattern(built.texts, pattern))


def test_literals_of_patterns_are_in_every_match():
    assert grams.literals_of(r"foo\(bar+[a-z]*bazaar") == ["foo(bar", "bazaar"]
    assert grams.literals_of("abcd?ef") == ["abc"] and grams.literals_of("abcd{0,3}efg") == ["abc", "efg"] and grams.literals_of("abcd{2}") == ["abcd"]
    for nothing in ("abc|def", "(abc)?", "(?i)abc", r"\Qabc\E", r"\x41bc", "[a[b]]abc", "abc**", "abc*+"):
        assert grams.literals_of(nothing) == [], nothing
    draw = random.Random(3)
    for _ in range(3000):
        pattern = "".join(draw.choices(["a", "b", "c", "ab", "[bc]", "x*", "b?", "c+", "a{0,2}", "b{2}", r"\b", ".", r"\(", "^", "$"], k=draw.randrange(1, 8)))
        text = "".join(draw.choices("abc(x ", k=12))
        for m in re.finditer(pattern, text):
            assert all(x in m[0] for x in grams.literals_of(pattern)), (pattern, m[0])


def test_only_candidates_are_read(spark, posted, texts):
    built = index.load(spark, posted, 3)
    some = {r["path"] for r in index.candidate_rows(built, ["cabcab("]).collect()}
    hold = {p for p, t in texts if t and "cabcab(" in t.lower()}
    assert hold <= some and len(some) < 60
    plan = index.candidate_rows(built, ["abcabcabc"])._jdf.queryExecution().toString()
    assert "EqualTo(slot" in plan and "PartitionFilters: [" in plan


def test_updates_keep_postings_up(spark, texts, tmp_path):
    folder = str(tmp_path / "index")
    tree = spark.createDataFrame(texts[:40], "path string, text string").withColumn("mtime", F.lit(0).cast("timestamp"))
    index.write(tree, folder, buckets=3)
    index.save_grams(spark, folder)
    gone, changed = texts[0][0], texts[1][0]
    change = spark.createDataFrame([(gone, None), (changed, "fresh words"), ("new/a.ts", "fresh too")], "path string, text string").withColumn("mtime", F.lit(9).cast("timestamp"))
    for _ in range(2):
        built = index.update(folder, change, buckets=3)
        assert [r[0] for r in _rows(index.find_literal(built, "fresh"))] == sorted([changed, "new/a.ts"])
        assert _rows(index.find_literal(built, "abc")) == _rows(search.find_literal(built.texts, "abc"))
