"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from its words; a document is toxic if any of its
sentences is (noisy-or), so sentence scores are learned from document labels alone. What a sentence without any known word would
score is taken off each, so that many harmless sentences do not add up: a document's length says nothing. A known share of
wrong labels is part of the likelihood, so that they do not pull up the score of every sentence. The sentences that make a document toxic are
located with their score.

The model is fitted on a bounded sample of labelled documents; prediction is a map over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_sample, held_out, text_batches

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Labelled documents of each label that the model is fitted on, and their characters together.
SAMPLE, SAMPLE_CHARS = 2000, 20_000_000
THRESHOLD = 0.3


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text: what stands between line ends and full stops."""
    return [m.span() for m in SENTENCE.finditer(text)]


def word_features(word: str) -> list[str]:
    """A word and its beginnings, since insults are inflected."""
    return [word, *(f"{word[:n]}-" for n in (3, 4, 5, 6) if len(word) >= n)]


@dataclass
class ToxicityModel:
    """A logit for each feature of a word and the bias of a sentence; features that are not named count nothing."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def word_logit(self, word: str) -> float:
        if (x := self.known.get(word)) is None:
            if len(self.known) > 300_000:
                self.known.clear()
            x = self.known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return x

    def sentence_logits(self, text: str) -> list[float]:
        logit, bias = self.word_logit, self.bias
        return [bias + sum(map(logit, set(WORD.findall(s)))) for s in SENTENCE.findall(text.lower())]

    def sentence_scores(self, logits: list[float]) -> np.ndarray:
        """-log P(not toxic) of each sentence beyond that of one without known words; never below zero."""
        return np.maximum(np.logaddexp(0, np.array(logits, dtype=float)) - np.logaddexp(0, self.bias), 0)

    def noisy_or(self, logits: list[float]) -> float:
        """The score of a document from those of its sentences; 0 without any."""
        return float(-np.expm1(-self.sentence_scores(logits).sum()))

    def score(self, text: str) -> float:
        return self.noisy_or(self.sentence_logits(text))


def loss(params: np.ndarray, doc_of: np.ndarray, sentence_of: np.ndarray, word_of: np.ndarray, label: np.ndarray, flipped: float, decay: float) -> tuple[float, np.ndarray]:
    """The negative log-likelihood of the labels with its penalty, and its gradient by the parameters (logits, then the bias).

    Feature ``word_of[i]`` stands in sentence ``sentence_of[i]``; sentence j is of document ``doc_of[j]``.
    """
    logit = params[-1] + np.bincount(sentence_of, weights=params[word_of], minlength=len(doc_of))
    counts = logit >= params[-1]  # others are held at the floor
    none = np.bincount(doc_of, weights=counts * (np.logaddexp(0, logit) - np.logaddexp(0, params[-1])), minlength=len(label))  # -log P(no sentence is toxic)
    seen = flipped + (1 - 2 * flipped) * -np.expm1(-none)
    # The derivative of the loss by ``none`` is that by P(toxic), times exp(-none).
    slope = np.where(label == 1, -1 / seen, 1 / (1 - seen)) * (1 - 2 * flipped) * np.exp(-none)
    by_sentence = slope[doc_of] * counts
    by_logit = by_sentence / (1 + np.exp(-logit))
    by_floor = by_sentence.sum() / (1 + np.exp(-params[-1]))
    grad = np.append(np.bincount(word_of, weights=by_logit[sentence_of], minlength=len(params) - 1) + decay * params[:-1], by_logit.sum() - by_floor)
    return float(-np.log(np.where(label == 1, seen, 1 - seen)).sum() + decay / 2 * (params[:-1] ** 2).sum()), grad


def train(rows: list[tuple[int, str]], epochs: int = 150, rate: float = 0.1, flipped: float = 0.01, decay: float = 0.02, least: int = 6) -> ToxicityModel:
    """Fit sentence logits on (label, text) rows by Adam.

    Args:
        flipped: share of wrong labels.
        decay: weight of the squared logits against the likelihood of one document.
        least: documents that must hold a feature. Of those, features are fitted that surely a twice as large share
            of the toxic documents holds as of the others; the rest says nothing for a toxic sentence.
    """
    if not rows:
        return ToxicityModel({}, -6.0)
    bags = [[set(WORD.findall(s)) for s in SENTENCE.findall(text.lower())] for _, text in rows]
    label = np.array([y for y, _ in rows])
    toxic, clean = Counter(), Counter()
    for y, bag in zip(label, bags, strict=True):
        (toxic if y else clean).update({f for w in set().union(*bag) for f in word_features(w)})
    n_toxic, n_clean = int(label.sum()), int(len(rows) - label.sum())
    index = {f: i for i, f in enumerate(sorted(f for f, n in toxic.items() if n + clean[f] >= least and (n - 1.5 * n**0.5) * n_clean > 2 * (clean[f] + 1) * n_toxic))}
    if not index or not n_clean:
        return ToxicityModel({}, -6.0)
    doc, sentence, word, n = [], [], [], 0
    for d, bag in enumerate(bags):
        for s in bag:
            found = sorted(index[f] for w in s for f in word_features(w) if f in index)
            doc.append(d)
            sentence += [n] * len(found)
            word += found
            n += 1
    doc_of, sentence_of, word_of = (np.array(x, dtype=np.int64) for x in (doc, sentence, word))
    params = np.zeros(len(index) + 1)
    params[-1] = -5.0
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for epoch in range(1, epochs + 1):
        _, grad = loss(params, doc_of, sentence_of, word_of, label, flipped, decay)
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        params -= rate * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.99**epoch)) + 1e-10)
    return ToxicityModel({f: float(params[i]) for f, i in index.items() if abs(params[i]) > 0.02}, float(params[-1]))


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``per_label`` documents of each label that are not held out.

    They are chosen by a hash of their id; ``SAMPLE_CHARS`` bounds their length together. A document with several labels counts
    as toxic if one of them is; null labels, null ids and null texts are left out, and of texts with one id the least counts.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Labels are chosen first, three times as many as are wanted since some have no text; only their texts are looked up.
    drawn = bounded_sample(known.select("toxic", F.col("doc_id").alias("key"), F.lit("").alias("text")), "toxic", 3 * per_label, 1)
    if not drawn:
        return train([])
    chosen = docs.sparkSession.createDataFrame([(y, key) for y, key, _ in drawn], f"toxic int, key {labels.schema['doc_id'].dataType.simpleString()}")
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("key"), "text").join(F.broadcast(chosen), "key")
    return train([(y, text) for y, _, text in bounded_sample(texts, "toxic", per_label, SAMPLE_CHARS)])


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, locate: bool = True) -> DataFrame:
    """``docs`` with score, predicted (1 from ``threshold`` on) and, with ``locate``, the offending sentences.

    ``offending`` holds (start, end, score) in code points of each sentence that scores ``threshold`` or more. A null
    or empty text scores 0. Columns already so named are replaced; repeated rows score alike.
    """
    spark = docs.sparkSession
    text_batches(spark)
    extra = [("score", "double"), ("predicted", "int")] + ([("offending", "array<struct<start:long,end:long,score:double>>")] if locate else [])
    kept = [f for f in docs.schema.fields if f.name not in {n for n, _ in extra}]
    names = [f.name for f in kept]
    at = names.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in extra])
    shared = spark.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            logits = [model.sentence_logits(x) for x in texts]
            scores = [model.noisy_or(z) for z in logits]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())]
            if locate:
                spans = []
                for x, score, z in zip(texts, scores, logits, strict=True):
                    p = (-np.expm1(-model.sentence_scores(z))).tolist() if score >= threshold else []  # no sentence scores above its document
                    spans.append([{"start": a, "end": b, "score": q} for (a, b), q in zip(sentences(x), p, strict=False) if q >= threshold])
                columns.append(pa.array(spans, span_type))
            yield pa.record_batch(columns, names=[*names, *(n for n, _ in extra)])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(predict, schema)
