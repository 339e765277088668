"""Language identification by a linear-chain conditional random field.

Words of a line form a chain. A word's features are its affixes, its character n-grams and whether it stands in the
lexicon of frequent training words; transitions between languages are learned with them. Forward-backward gives every
word of a code-switched text a distribution over languages; a document's language is the one with the largest mean.

The model is fitted on a bounded sample of labelled documents. Training chains are spliced from the lines of two
documents, so that switches occur in them. Prediction is a map over whole texts: no row is shuffled, and the only
broadcast is the model, whose size is fixed by its parameters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_sample, held_out, text_batches

WORD = re.compile(r"[^\W\d_]+")
#: log2 of the number of hashed feature weights of each language.
BITS = 18
#: Words in a training chain; a longer line is several of them. Prediction takes lines whole.
CHAIN = 256
#: Labelled documents of each language that the model is fitted on, and their characters together.
SAMPLE, SAMPLE_CHARS = 100, 2_000_000
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, sizes, hash) of words with a mark set at both ends."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
    return codes, starts, sizes, np.add.reduceat(_mix(codes * _MIX + place), starts)


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of the hashed features of different words."""
    codes, starts, sizes, whole = word_hashes(words)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters from here to the word's end
    owners, found = [], []
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, 4):  # n-grams, the marks included: those at the marks are short affixes
        rolled[: len(codes) - n + 1] = _mix(rolled[: len(codes) - n + 1] * _MIX + codes[n - 1 :])
        fits = left >= n
        owners.append(owner[fits])
        found.append(rolled[fits] + np.uint64(n))
    for n in (4, 5):  # longer affixes
        long = sizes >= n + 1
        for tag, at in ((100 + n, starts[long]), (200 + n, starts[long] + sizes[long] - n)):
            h = np.full(len(at), tag, dtype=np.uint64)
            for k in range(n):
                h = _mix(h * _MIX + codes[at + k])
            owners.append(np.flatnonzero(long))
            found.append(h)
    spot = np.searchsorted(lexicon, whole)
    known = lexicon[np.minimum(spot, len(lexicon) - 1)] == whole if len(lexicon) else np.zeros(len(words), dtype=bool)
    owners.append(np.arange(len(words)))
    found.append(np.where(known, whole, np.uint64(7)))
    return np.concatenate(owners), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def chains(text: str, most: int | None = None) -> tuple[list[str], list[int]]:
    """A text's lower-cased words, and the lengths of its chains: one a line, or several of at most ``most`` words."""
    words: list[str] = []
    sizes: list[int] = []
    for line in text.lower().split("\n"):
        found = WORD.findall(line)
        words += found
        full, rest = divmod(len(found), most or max(len(found), 1))
        sizes += [most or len(found)] * full + ([rest] if rest else [])
    return words, sizes


def forward_backward(scores: np.ndarray, sizes: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Marginals of words in chains laid end to end.

    ``scores`` are log potentials of (word, language), ``first`` and ``moves`` those of the first language of a chain
    and of transitions. All chains advance together, longest first. With ``pairs``, also log Z and the expected
    transitions.
    """
    top = scores.max(axis=1, keepdims=True)
    e, start, step = np.exp(scores - top), np.exp(first), np.exp(moves)
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # chains with more than t words
    alpha, beta = np.empty_like(e), np.ones_like(e)
    scale = np.ones(len(e))
    for t in range(size[0]):
        at = begin[: alive[t]] + t
        a = start * e[at] if t == 0 else (alpha[at - 1] @ step) * e[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    expected = np.zeros_like(step)
    for t in range(size[0] - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        coming = e[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = coming @ step.T
        if pairs:
            expected += step * (alpha[at].T @ coming)
    marginals = alpha * beta
    marginals /= marginals.sum(axis=1, keepdims=True)
    return (marginals, float(np.log(scale).sum() + top.sum()), expected) if pairs else marginals


@dataclass
class LanguageModel:
    """Weights of a fitted chain: (feature, language), first language, transitions, and the lexicon's hashes."""

    languages: list[str]
    weights: np.ndarray
    first: np.ndarray
    moves: np.ndarray
    lexicon: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint64))

    def word_scores(self, words: list[str]) -> np.ndarray:
        owner, feature = features(words, self.lexicon)
        return np.stack([np.bincount(owner, weights=self.weights[feature, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)

    def label(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[str]]]:
        """Word marginals and words of each text."""
        cut = [chains(x) for x in texts]
        every = [w for words, _ in cut for w in words]
        if not every:
            return [np.zeros((0, len(self.languages)))] * len(texts), [[] for _ in texts]
        different = {w: i for i, w in enumerate(dict.fromkeys(every))}
        scores = self.word_scores(list(different))[np.fromiter(map(different.__getitem__, every), dtype=np.int64, count=len(every))]
        marginals = forward_backward(scores, np.array([n for _, sizes in cut for n in sizes], dtype=np.int64), self.first, self.moves)
        ends = np.cumsum([len(words) for words, _ in cut])
        return np.split(marginals, ends[:-1]), [words for words, _ in cut]

    def document(self, marginals: np.ndarray, words: list[str]) -> tuple[str, float, float]:
        """(language, its mean over the words, how far that is above the next language's)."""
        if not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0, 0.0
        mean = marginals.mean(axis=0)
        best = int(mean.argmax())
        score = float(min(1.0, max(0.0, mean[best])))
        return self.languages[best], score, score - float(max(0.0, np.delete(mean, best).max())) if len(mean) > 1 else score


def train(rows: list[tuple[str, str]], epochs: int = 40, rate: float = 0.1, decay: float = 1e-6, seed: int = 7) -> LanguageModel:
    """Fit the chain on (language, text) rows: Adam on the conditional likelihood of spliced chains."""
    languages = sorted({lang for lang, _ in rows})
    lines: list[tuple[int, list[str]]] = []
    for lang, text in rows:
        words, sizes = chains(text, CHAIN)
        at = 0
        for n in sizes:
            lines.append((languages.index(lang), words[at : at + n]))
            at += n
    if not lines:
        return LanguageModel(languages, np.zeros((1 << BITS, len(languages)), dtype=np.float32), np.zeros(len(languages)), np.zeros((len(languages),) * 2))
    often = Counter(w for _, words in lines for w in words)
    different = {w: i for i, w in enumerate(often)}
    frequent = [w for w, n in often.items() if n >= 5]
    lexicon = np.unique(word_hashes(frequent)[3]) if frequent else np.empty(0, dtype=np.uint64)
    # A chain is a line's piece followed by a piece of another document's line.
    draw = np.random.default_rng(seed)
    mate = draw.permutation(len(lines))
    ids, labels, sizes = [], [], []
    for i, (label, words) in enumerate(lines):
        other, more = lines[mate[i]]
        cut = int(draw.integers(1, len(words) + 1))
        more = more[: int(draw.integers(0, len(more) + 1))]
        ids += [different[w] for w in words[:cut]] + [different[w] for w in more]
        labels += [label] * cut + [other] * len(more)
        sizes.append(cut + len(more))
        if cut < len(words):  # the line's rest is a chain of its own, so that no word is left out
            ids += [different[w] for w in words[cut:]]
            labels += [label] * (len(words) - cut)
            sizes.append(len(words) - cut)
    word, gold, size = np.array(ids), np.array(labels), np.array(sizes, dtype=np.int64)
    owner, feature = features(list(different), lexicon)
    k = len(languages)
    begins = np.cumsum(size) - size
    inner = np.ones(len(word), dtype=bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    gold_moves = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k).astype(float)
    gold_first = np.bincount(gold[begins], minlength=k).astype(float)
    one = np.zeros((len(word), k))
    one[np.arange(len(word)), gold] = 1
    params = [np.zeros((1 << BITS, k)), np.zeros(k), np.zeros((k, k))]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(1, epochs + 1):
        emitted = np.stack([np.bincount(owner, weights=params[0][feature, j], minlength=len(different)) for j in range(k)], axis=1)
        marginals, _, expected = forward_backward(emitted[word], size, params[1], params[2], pairs=True)
        miss = marginals - one
        by_word = np.stack([np.bincount(word, weights=miss[:, j], minlength=len(different)) for j in range(k)], axis=1)
        grads = [np.stack([np.bincount(feature, weights=by_word[owner, j], minlength=1 << BITS) for j in range(k)], axis=1) / len(word) + decay * params[0]]
        grads += [(marginals[begins].sum(axis=0) - gold_first) / len(word), (expected - gold_moves) / len(word)]
        for p, g, m, s in zip(params, grads, mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.99**epoch)) + 1e-8)
    return LanguageModel(languages, params[0].astype(np.float32), params[1], params[2], lexicon)


def fit_language_model(docs: DataFrame, per_language: int = SAMPLE) -> LanguageModel:
    """Fit on at most ``per_language`` documents of each language that are neither held out nor without a label.

    They are chosen by a hash of their id (of the text where that is null); ``SAMPLE_CHARS`` bounds their length together.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = labelled.select("lang", F.coalesce(F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("key"), "text")
    return train([(lang, text) for lang, _, text in bounded_sample(rows, "lang", per_language, SAMPLE_CHARS)])


def identify_languages(docs: DataFrame, model: LanguageModel, with_words: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score, margin and n_letter_words; with ``with_words`` also word_langs, an array of (word, lang, p).

    Only ``text`` is read for the prediction; margin is how far the score is above the next language's mean. A null text, or one
    without a letter, is ``und`` with score 0. Columns already so named are replaced. Repeated rows are predicted alike.
    """
    spark = docs.sparkSession
    text_batches(spark)
    extra = [("lang_pred", "string"), ("score", "double"), ("margin", "double"), ("n_letter_words", "long")] + ([("word_langs", "array<struct<word:string,lang:string,p:double>>")] if with_words else [])
    kept = [f for f in docs.schema.fields if f.name not in {n for n, _ in extra}]
    names = [f.name for f in kept]
    at = names.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in extra])
    shared = spark.sparkContext.broadcast(model)
    word_type = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            marginals, words = model.label([x or "" for x in batch.column(at).to_pylist()])
            found = [model.document(m, w) for m, w in zip(marginals, words, strict=True)]
            columns = [*batch.columns, pa.array([x for x, _, _ in found], pa.string()), *(pa.array([x[k] for x in found], pa.float64()) for k in (1, 2)), pa.array(list(map(len, words)), pa.int64())]
            if with_words:
                columns.append(pa.array([[{"word": x, "lang": model.languages[int(p.argmax())], "p": float(p.max())} for x, p in zip(w, m, strict=True)] for m, w in zip(marginals, words, strict=True)], word_type))
            yield pa.record_batch(columns, names=[*names, *(n for n, _ in extra)])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(predict, schema)
