import math
import zlib

import numpy as np

from lodestone.llm import toxicity as T
from lodestone.llm.queries import QUERIES
from tests.llm.cases import awkward, empty


def _bags():
    nice = ["the sea is calm today", "a boat goes out", "they sing and row", "the tide comes in", "gulls cry above", "ropes are made fast"]
    rows = []
    for i in range(120):
        lines = [nice[(i * 7 + k * 5) % 6] for k in range(5)]
        if i % 3 == 0:
            lines[i % 5] += [" you fool", " what a knave", " foolish lot"][(i // 3) % 3]
        rows.append((int(i % 3 == 0), ". ".join(lines) + "."))
    return rows


def test_sentences_are_learned_from_documents():
    model = T.train(_bags())
    text = "The tide comes in. You fool, row. Gulls cry above."
    logits = model.sentence_logits(text)
    assert max(range(3), key=logits.__getitem__) == 1
    assert model.score(text) > 0.5 > 0.1 > model.score("The tide comes in. Gulls cry above.")
    assert model.score("") == 0.0
    assert model.score(text) >= -math.expm1(-max(model.sentence_scores(logits))) - 1e-9  # noisy-or is at least its largest part


def test_length_says_nothing():
    model = T.train(_bags())
    calm = "The tide comes in. Gulls cry above. Ropes are made fast. "
    assert model.score(calm * 4000) < 0.05
    assert model.score("Nothing known here. " * 10_000) == 0.0
    assert model.score(calm * 3000 + "You fool.") > 0.5


def test_loss_and_gradient_against_plain_sums():
    draw = np.random.default_rng(5)
    doc_of = np.sort(draw.integers(0, 6, 15))
    sentence_of, word_of, label = draw.integers(0, 15, 40), draw.integers(0, 5, 40), np.array([1, 0, 1, 0, 0, 1])
    params = draw.normal(size=6)

    def plain(w):
        total = 0.01 * sum(x * x for x in w[:-1])
        for d in range(6):
            none, calm = 1.0, 1 / (1 + math.exp(w[-1]))
            for j in np.flatnonzero(doc_of == d):
                none *= min(1.0, (1 - 1 / (1 + math.exp(-w[-1] - sum(w[f] for f in word_of[sentence_of == j])))) / calm)
            seen = 0.05 + 0.9 * (1 - none)
            total -= math.log(seen if label[d] else 1 - seen)
        return total

    value, grad = T.loss(params, doc_of, sentence_of, word_of, label, 0.05, 0.02)
    assert math.isclose(value, plain(params))
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        assert math.isclose((plain(params + step) - plain(params - step)) / 2e-6, grad[k], rel_tol=1e-4, abs_tol=1e-6)


def _plain_score(model, text):
    """Noisy-or by its definition, sentence by sentence and word by word."""
    none = 1.0
    for sentence in text.lower().replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        words = {w for w in "".join(c if c.isalpha() else " " for c in sentence).split()}
        if sentence:
            logit = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w, *(w[:n] + "-" for n in (3, 4, 5, 6) if len(w) >= n)])
            none *= min(1.0, (1 + math.exp(model.bias)) / (1 + math.exp(logit)))
    return 1 - none


def test_query_against_plain_scores(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = T.fit_toxicity_model(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in QUERIES["op10_toxicity"](spark, sf_dir).collect():
        expected = _plain_score(model, texts[r["doc_id"]])
        assert math.isclose(r["score"], expected, rel_tol=1e-6, abs_tol=1e-9) and r["predicted"] == int(expected >= 0.3)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op10_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.03 * len(clean)
    long = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").filter("length(text) - length(replace(text, '.', '')) > 100").select("doc_id").collect()}
    print([(len(x), sum(x)) for x in ([r["predicted"] for r in rows if r["toxic"] and r["doc_id"] in long], toxic, clean)])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_awkward_documents(spark):
    model = T.train(_bags())
    docs = awkward(spark).unionByName(spark.createDataFrame([(50, "É. You fool! Well.")], "doc_id long, text string"), allowMissingColumns=True)
    rows = {r["doc_id"]: r for r in T.score_toxicity(docs, model).collect()}
    assert [docs.filter("doc_id = 50").first()["text"][s["start"] : s["end"]] for s in rows[50]["offending"]] == [" You fool"]
    assert rows[3]["score"] == 0.0 and rows[2]["predicted"] == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert T.score_toxicity(empty(spark), T.fit_toxicity_model(docs, labels)).count() == 0
