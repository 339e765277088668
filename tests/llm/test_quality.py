import re
from collections import Counter

import pytest

from lodestone.llm import quality as Q
from lodestone.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.cases import awkward, empty
from tests.oracle import assert_same, connect

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _base(text):
    words = [w for w in SPACE.split(text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_query_equals_sql(spark, sf_dir):
    assert_same(QUERIES["op6_quality"](spark, sf_dir).toPandas(), connect(sf_dir).sql(ORACLE_SQL["op6_quality"]).df())


def test_base_counts(spark):
    docs = awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame([(20, "a b c a b c a b"), (21, "x x x x"), (22, "a b c d a b c\na b c d a b c\n")], "doc_id long, text string"), allowMissingColumns=True)
    found = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in Q.quality(docs).collect()}
    assert found == {r["doc_id"]: _base(r["text"] or "") for r in docs.collect()}


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("A sentence with words, and an end.", False),
        ("MENÚ >", True),
        ("Zurück", True),
        ("Lire la suite", True),
        ("Tous droits réservés, 2020.", True),
        ("Über uns spricht man gern, sagt er.", False),
        ("*** ### $$$", True),
        ("one*** two### three$$$ four.", True),
        ("Home | News | Sport | Weather | About", True),
        ("log in", True),
        ("© 2024 Somebody. All rights reserved.", True),
        ("no sign of any sentence", True),
        ("A title here", False),
    ],
)
def test_line_rules(spark, line, fails):
    row = Q.quality(spark.createDataFrame([(1, f"{line}\nA second line, which is kept.")], "doc_id long, text string")).first()
    assert row["clean_text"] == ("" if fails else line + "\n") + "A second line, which is kept."


def test_document_losing_too_much_is_rejected(spark):
    text = "".join(f"A good line{i}, with{i} some{i} words{i} in{i} it: number{i}.\n" for i in range(10))
    rows = [(1, text), (2, text + "menu | item | more | last | entry\n" * 1), (3, text + "".join(f"nav{i} | other{i} | more{i} | x{i} | y{i} | z{i} | {i} | w{i}\n" for i in range(60)))]
    assert {r["doc_id"]: r["kept"] for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: True, 2: True, 3: False}


def test_awkward_documents(spark):
    assert Q.quality(awkward(spark)).count() == awkward(spark).count()
    assert Q.quality(empty(spark)).count() == 0
