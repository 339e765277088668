"""Phrase collocations by stripes: each prefix keys an associative counter of next words.

Three scans of the texts, each combined inside tasks, in chunks, before anything is shuffled:

1. words and their counts;
2. stripes of one-word prefixes: how often each next word follows, among words that are frequent themselves;
3. stripes of two to four words, where all pairs of neighbouring words are frequent.

Stripes of one prefix are merged elementwise in a stream of sorted rows. A merged stripe gives the counts of the extensions, the
prefix's own total (next words and the rest) and the greatest extension, which decides whether the prefix is subsumed to its
right; the same entries, keyed by all words but the first, decide it to the left.

What is frequent is told to the tasks as a bitmap of hashes of at most ``MOST_BITS`` bits, however many there are: a fuller one
lets through more rows that the merge then drops, never fewer. A prefix with one in ``SHARE`` of all words is hot (so there are at most
that many); its stripes are cut by the hash of the next word into ``CUTS`` parts that are merged apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import number_batches, text_batches
from lodestone.sources.scratch import broadcast_if_small, keep, release

#: Words of the longest phrase.
MOST_WORDS = 5
#: Bytes of text that a task counts at once.
CHUNK = 8 << 20
#: Bits of a bitmap for each entry, and at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
SHARE, CUTS = 4096, 64
#: Entries of a merged stripe in one row; bytes of the rows of one stripe that are held before they are merged.
ENTRIES, HELD = 50_000, 8 << 20
#: Parts into which the candidates of a language are dealt to find the best.
PARTS = 32

_END = b"\xff"  # never part of UTF-8
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _END * 10 + b" ")

#: A stripe on its way: the words that follow, joined by spaces, which no word holds, and their counts as 32-bit numbers.
_STRIPE = pa.schema([("lang", pa.binary()), ("prefix", pa.binary()), ("part", pa.int32()), ("total", pa.int64()), ("nexts", pa.binary()), ("counts", pa.binary())])
_STRIPE_DDL = "lang binary, prefix binary, part int, total long, nexts binary, counts binary"
_MERGED = pa.schema([("lang", pa.binary()), ("prefix", pa.binary()), ("total", pa.int64()), ("best", pa.int64()), ("nexts", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])
_MERGED_DDL = "lang binary, prefix binary, total long, best long, nexts array<binary>, counts array<long>"


# ---- inside tasks


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bytes, bytes]]:
    """(language, texts of it lower-cased and joined by the end sign) of about ``most`` bytes each; a text is never cut."""
    held: dict[bytes, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs, texts = (batch.column(i).cast(pa.binary()).to_pylist() for i in (0, 1))
        for lang, text in zip(langs, texts, strict=True):
            if text:
                held.setdefault(lang, []).append(text.translate(_LOWER))
                size += len(text)
        if size >= most:
            yield from ((lang, _END.join(parts)) for lang, parts in held.items())
            held, size = {}, 0
    yield from ((lang, _END.join(parts)) for lang, parts in held.items())


def _tokens(chunk: bytes) -> tuple[np.ndarray, list[bytes], int]:
    """(word numbers in order, words, the number that stands for the end of a piece)."""
    words = pc.list_flatten(pc.split_pattern(pa.array([chunk.replace(_END, b" " + _END + b" ")], pa.large_binary()), pattern=b" "))
    words = words.filter(pc.not_equal(pc.binary_length(words), 0)).dictionary_encode()
    names = words.dictionary.to_pylist()
    return words.indices.to_numpy().astype(np.int64), names, names.index(_END) if _END in names else -1


def _hash(words: list[bytes], seed: int) -> int:
    for word in words:
        seed = xxhash.xxh64_intdigest(word, seed)
    return seed


def _lang_seed(lang: bytes) -> int:
    return xxhash.xxh64_intdigest(lang, 42)


class Bitmap:
    """Which hashes may be in a set; Spark's ``xxhash64(lang, word, ...)`` of the same values gives the same place."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.mask = data, len(data) * 8 - 1

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.mask)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _stripes_of(lang: bytes, prefixes: np.ndarray, nexts: np.ndarray, spell, words: pa.Array, parts_of) -> Iterator[pa.RecordBatch]:
    """Stripes from one chunk's (prefix number, next word or -1 for the rest) at each of its places."""
    key, count = np.unique((prefixes << 32) | (nexts + 1), return_counts=True)
    prefix, nxt = key >> 32, (key & 0xFFFFFFFF) - 1
    starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(key) else np.empty(0, np.int64)
    heads = prefix[starts]
    names = spell(heads)
    parts = parts_of(heads)  # of each prefix: 1, or CUTS
    ends = np.r_[starts[1:], len(key)]
    rest = np.where(nxt[starts] < 0, count[starts], 0)
    entry = nxt >= 0
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    hot = parts[owner] > 1
    part = np.zeros(len(key), np.int64)
    if hot.any():
        of_word = {w: 1 + xxhash.xxh64_intdigest(words[int(w)].as_py(), 1) % CUTS for w in np.unique(nxt[hot & entry])}
        part[hot & entry] = [of_word[w] for w in nxt[hot & entry]]
    order = np.lexsort((part[entry], owner[entry]))
    o, p, w, c = owner[entry][order], part[entry][order], nxt[entry][order], count[entry][order]
    cut = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1])]) if len(o) else np.empty(0, np.int64)
    row_owner, row_part, offsets = o[cut], p[cut], np.r_[cut, len(o)].astype(np.int32)
    lone = np.setdiff1d(np.arange(len(starts)), row_owner)  # prefixes that nothing follows
    first = np.r_[True, row_owner[1:] != row_owner[:-1]] if len(row_owner) else np.empty(0, bool)
    owners = np.r_[row_owner, lone]
    rests = np.r_[np.where(first, rest[row_owner], 0) if len(row_owner) else np.empty(0, np.int64), rest[lone]].astype(np.int64)
    offsets = np.r_[offsets, np.full(len(lone), offsets[-1] if len(offsets) else 0, np.int32)] if len(offsets) else np.zeros(len(lone) + 1, np.int32)
    sums = np.r_[0, np.cumsum(c)].astype(np.int64)
    total = rests + sums[offsets[1:]] - sums[offsets[:-1]]
    packed = pa.Array.from_buffers(pa.binary(), len(owners), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(c.astype("<u4"))])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(w))), b" ")
    row_parts = np.r_[row_part, parts[lone] > 1].astype(np.int32)
    table = pa.record_batch([pa.array([lang] * len(owners), pa.binary()), names.take(pa.array(owners)), pa.array(row_parts), pa.array(total), joined, packed], schema=_STRIPE)
    for at in range(0, table.num_rows, 20000):
        yield table.slice(at, 20000)


def _merge(threshold: int):
    """Merges sorted stripes elementwise: the total of a part, its greatest entry, and the entries of at least ``threshold``."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, total, counter = None, 0, {}
        words, counts, size = [], [], 0  # rows that are not in the counter yet

        def add() -> None:
            nonlocal words, counts, size
            for w, n in zip(b" ".join(words).split(b" "), np.frombuffer(b"".join(counts), "<u4").tolist(), strict=True):
                counter[w] = counter.get(w, 0) + n
            words, counts, size = [], [], 0

        def close() -> None:
            # A whole stripe of a rare prefix needs no merge; a part of a cut one (from 1) adds to a total whatever it holds.
            if now is None or (total < threshold and not now[2]):
                return
            if words:
                add()
            big = [(w, n) for w, n in counter.items() if n >= threshold]
            for at in range(0, max(len(big), 1), ENTRIES):  # the total stands in the first of a long stripe's rows
                cut = big[at : at + ENTRIES]
                out.append((now[0], now[1], 0 if at else total, max((n for _, n in cut), default=0), [w for w, _ in cut], [n for _, n in cut]))

        def batch_of() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MERGED, strict=True)], schema=_MERGED)

        for batch in batches:
            for lang, prefix, part, n, nexts, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, prefix, part) != now:
                    close()
                    now, total, counter = (lang, prefix, part), 0, {}
                    words, counts, size = [], [], 0
                    if len(out) >= 2000:
                        yield batch_of()
                        out.clear()
                total += n
                if packed:
                    words.append(nexts)
                    counts.append(packed)
                    size += len(nexts)
                    if size >= HELD:
                        add()
        close()
        if out:
            yield batch_of()

    return merged


# ---- the jobs


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n): every word's occurrences, counted in each task before they meet."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in _chunks(batches, CHUNK):
            ids, names, end = _tokens(chunk)
            n = np.bincount(ids, minlength=len(names))
            if end >= 0:
                n[end] = 0
            some = np.flatnonzero(n)
            table = pa.record_batch([pa.array([lang] * len(some), pa.binary()), pa.array(names, pa.binary()).take(pa.array(some)), pa.array(n[some].astype(np.int64))], names=["lang", "word", "n"])
            for at in range(0, table.num_rows, 50000):
                yield table.slice(at, 50000)

    found = texts.mapInArrow(counted, "lang binary, word binary, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n")).select(F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"), "n")


def _bitmap(entries: DataFrame, *columns: str) -> np.ndarray:
    """The bitmap of the hashes of ``columns``: 4 KB pieces made in the cluster, at most ``MOST_BITS`` bits in all."""
    bits = 1 << 15
    n = entries.count()
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2
    place = F.xxhash64(*columns).bitwiseAND(F.lit(bits - 1)) + 1  # Spark counts bits from one
    pieces = entries.select(F.bitmap_bucket_number(place).alias("piece"), F.bitmap_bit_position(place).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    data = np.zeros(bits // 8, np.uint8)
    for r in pieces.toLocalIterator():
        at = (r["piece"] - 1) * 4096
        data[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return data


def _stripes(texts: DataFrame, known, hot: frozenset[int], longest: int) -> DataFrame:
    """Stripes of one-word prefixes (``longest`` 1), else of prefixes of two to ``longest`` words, from one scan.

    ``known``: a broadcast bitmap of frequent words, or of frequent pairs of words. ``hot``: hashes of (lang, word), or of
    (lang, word, word), whose stripes are cut.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Bitmap(known.value)
        for lang, chunk in _chunks(batches, CHUNK):
            ids, names, end = _tokens(chunk)
            words, seed = pa.array(names, pa.binary()), _lang_seed(lang)
            if longest == 1:
                hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in names], np.uint64)
                holds = frequent.holds(hashes) if len(names) else np.empty(0, bool)
                if end >= 0:
                    holds[end] = False
                is_hot = np.array([int(h) in hot for h in hashes]) if hot else np.zeros(len(names), bool)
                at = np.flatnonzero(holds[ids])
                after = np.r_[ids, -1][at + 1]
                nexts = np.where((after >= 0) & np.r_[holds, False][after], after, -1)
                yield from _stripes_of(lang, ids[at], nexts, lambda heads, words=words: words.take(pa.array(heads)), words, lambda heads, is_hot=is_hot: np.where(is_hot[heads], CUTS, 1))
                continue
            # The pairs that may be frequent, each hashed once.
            pair = (ids[:-1] << 32) | ids[1:]
            inside = np.flatnonzero((ids[:-1] != end) & (ids[1:] != end))
            keys, number = np.unique(pair[inside], return_inverse=True)
            hashes = np.array([_hash([names[k >> 32], names[k & 0xFFFFFFFF]], seed) for k in keys.tolist()], np.uint64)
            holds = frequent.holds(hashes) if len(keys) else np.empty(0, bool)
            is_hot = np.array([int(h) in hot for h in hashes]) if hot else np.zeros(len(keys), bool)
            gram = np.full(len(ids) + 1, -1, np.int64)  # the number of the frequent pair that begins at a place
            gram[inside[holds[number]]] = number[holds[number]]
            spelt = [names[k >> 32] + b" " + names[k & 0xFFFFFFFF] for k in keys.tolist()] if len(keys) else []
            first_pair = np.arange(len(keys))
            place = np.flatnonzero(gram >= 0)
            prefix = gram[place]
            for size in range(2, longest + 1):
                # A prefix of ``size`` words meets its next word if the last of the pairs is frequent too.
                more = gram[np.minimum(place + size - 1, len(ids))] >= 0
                place, prefix = place[more], prefix[more]
                if not len(place):
                    break
                nexts = ids[place + size]
                yield from _stripes_of(lang, prefix, nexts, lambda heads, s=spelt: pa.array([s[h] for h in heads], pa.binary()), words, lambda heads, f=first_pair, is_hot=is_hot: np.where(is_hot[f[heads]], CUTS, 1))
                longer, number = np.unique((prefix << 32) | nexts, return_inverse=True)
                spelt = [spelt[k >> 32] + b" " + names[k & 0xFFFFFFFF] for k in longer.tolist()]
                first_pair, prefix = first_pair[longer >> 32], number

    return texts.mapInArrow(counted, _STRIPE_DDL)


def _hot(entries: DataFrame, n: int, *columns: str) -> frozenset[int]:
    """Hashes of what stands for one in ``SHARE`` of all ``n`` words; at most ``SHARE`` of them by their definition."""
    rows = entries.filter(F.col("n") * SHARE >= n).select(F.xxhash64(*columns).alias("h")).collect()
    return frozenset(r["h"] % (1 << 64) for r in rows)


def _joined(stripes: DataFrame, threshold: int) -> DataFrame:
    """Merged stripes (lang, prefix, total, best, nexts, counts); a cut stripe is several rows."""
    ordered = stripes.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
    found = ordered.mapInArrow(_merge(threshold), _MERGED_DDL)
    return found.select(F.col("lang").cast("string").alias("lang"), F.col("prefix").cast("string").alias("prefix"), "total", "best", F.transform("nexts", lambda w: w.cast("string")).alias("nexts"), "counts")


def phrase_counts(docs: DataFrame, least: int = 100, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, n) word occurrences, (lang, phrase, size, f, right)) of the phrases of up to ``most_words`` words with f >= ``least``.

    ``right`` is the greatest count of a phrase that goes on with one more word, or 0 below ``least``.
    """
    spark = docs.sparkSession
    text_batches(spark)
    texts = _texts(docs)
    words = keep(_word_counts(texts), "words")
    totals = keep(words.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    often = words.filter(F.col("n") >= least)
    known = spark.sparkContext.broadcast(_bitmap(often, "lang", "word"))
    with number_batches(spark, 2000):  # batches are bounded in bytes too; a row can be a long stripe
        ones = keep(_joined(_stripes(texts, known, _hot(often, n, "lang", "word"), 1), least), "merged-stripes")
    release(words)

    def extended(merged: DataFrame) -> DataFrame:
        entry = F.arrays_zip("nexts", "counts")
        return merged.select("lang", "prefix", F.explode(entry).alias("e")).select("lang", "prefix", F.col("e.nexts").alias("next"), F.col("e.counts").alias("n"))

    pairs = extended(ones)
    single = ones.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("total").alias("f"), F.max("best").alias("right")).filter(F.col("f") >= least)
    counted = [single.select("lang", "phrase", F.lit(1).alias("size"), "f", "right")]
    if most_words < 2:
        return totals, counted[0]
    longer = None
    if most_words > 2:
        paired = spark.sparkContext.broadcast(_bitmap(pairs, "lang", "prefix", "next"))
        with number_batches(spark, 2000):
            longer = keep(_joined(_stripes(texts, paired, _hot(pairs, n, "lang", "prefix", "next"), most_words - 1), least), "merged-stripes")
    entries = pairs if longer is None else pairs.unionByName(extended(longer))
    grams = entries.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "n")
    if longer is None:
        best = grams.select("lang", "phrase", F.lit(0).cast("long").alias("best")).limit(0)
    else:
        best = longer.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("best").alias("best"))
    many = grams.join(best, ["lang", "phrase"], "left")
    size = F.size(F.split("phrase", " "))
    counted.append(many.select("lang", "phrase", size.alias("size"), F.col("n").alias("f"), F.coalesce("best", F.lit(0)).cast("long").alias("right")))
    return totals, keep(counted[0].unionByName(counted[1]), "phrases")


def _exact(*columns: Column) -> Column:
    """The product as a decimal of 38 digits."""
    out = F.lit(1).cast("decimal(38,0)")
    for c in columns:
        out = (out * c.cast("decimal(20,0)")).cast("decimal(38,0)")
    return out


def collocations(docs: DataFrame, least: int = 100, most_words: int = MOST_WORDS, best: int = 2000, subsumed_at: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of each language by their weakest cut.

    Args:
        docs: has ``text`` and ``lang``; other columns are ignored.
        least: occurrences of a candidate of two to ``most_words`` words.
        subsumed_at: a candidate goes if a longer one that holds its words has so many hundredths of its occurrences.

    A-Z is lower-cased. Pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at spaces and tabs. A null text has no words, a null lang is
    ``und``; repeated rows count as often as they occur, and texts are read whole, of any length. Of cuts with one score the first
    counts. No rows give no rows. Products are exact to 38 digits. One word more decides what is subsumed: a phrase has no more
    occurrences than any part of it.
    """
    totals, phrases = phrase_counts(docs, least, most_words)
    candidates = phrases.filter(F.col("size") > 1)
    left = candidates.filter(F.col("size") > 2).groupBy("lang", F.expr("substring(phrase, locate(' ', phrase) + 1)").alias("phrase")).agg(F.max("f").alias("left"))
    alive = candidates.join(left, ["lang", "phrase"], "left").filter(100 * F.greatest("right", F.coalesce("left", F.lit(0))) < subsumed_at * F.col("f"))

    counts = phrases.select("lang", "phrase", "f")
    cuts = alive.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("second"))
    met = parts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("second"), F.col("f").alias("r")), ["lang", "second"])
    scored = met.join(broadcast_if_small(totals), "lang").withColumn("over", _exact(F.lit(1000), F.col("a"), F.col("n"))).withColumn("under", _exact(F.col("l"), F.col("r")))
    scored = scored.withColumn("score", F.expr("over div under"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = weakest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).filter(F.col("__rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
