import itertools

import numpy as np

from lodestone.llm import language_id as L
from lodestone.llm.queries import QUERIES
from tests.llm.cases import awkward, empty


def test_forward_backward_against_all_paths():
    draw = np.random.default_rng(1)
    sizes = np.array([3, 1, 4], dtype=np.int64)
    scores, first, moves = draw.normal(size=(8, 3)), draw.normal(size=3), draw.normal(size=(3, 3))
    marginals, log_z, expected = L.forward_backward(scores, sizes, first, moves, pairs=True)
    at, total, pairs = 0, 0.0, np.zeros((3, 3))
    for n in sizes:
        weights, z = np.zeros((n, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(first[path[0]] + sum(scores[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            z += w
            for t, y in enumerate(path):
                weights[t, y] += w
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(first[path[0]] + sum(scores[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            for a, b in itertools.pairwise(path):
                pairs[a, b] += w / z
        assert np.allclose(marginals[at : at + n], weights / z)
        at, total = at + n, total + np.log(z)
    assert np.isclose(log_z, total) and np.allclose(expected, pairs)


def test_features_do_not_depend_on_the_batch():
    one = L.features(["bateau"], np.empty(0, dtype=np.uint64))
    many = L.features(["xy", "bateau", "é"], np.empty(0, dtype=np.uint64))
    assert sorted(one[1].tolist()) == sorted(many[1][many[0] == 1].tolist())


def test_code_switch_is_labelled_by_word():
    rows = [("en", "the ship sails with the wind and the tide\n" * 8), ("de", "das schiff segelt mit dem wind und der flut\n" * 8), ("en", "then they sing of the sea\n" * 8), ("de", "dann singen sie von der see\n" * 8)]
    model = L.train(rows, epochs=60)
    (m,), (words,) = model.label(["the ship sails and then das schiff segelt mit der flut"])
    langs = [model.languages[k] for k in m.argmax(axis=1)]
    assert langs[:4] == ["en"] * 4 and langs[-5:] == ["de"] * 5 and len(words) == len(langs)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op2_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert len(rows) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_documents(spark):
    docs = awkward(spark)
    found = L.identify_languages(docs, L.fit_language_model(docs), with_words=True)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == docs.count()
    assert {i: rows[i]["lang_pred"] for i in (2, 3, 4, 8)} == dict.fromkeys((2, 3, 4, 8), "und")
    assert rows[1]["lang_pred"] == "en" and rows[1]["label"] == "x" and len(rows[7]["word_langs"]) == 3
    assert L.identify_languages(empty(spark), L.fit_language_model(empty(spark))).count() == 0
