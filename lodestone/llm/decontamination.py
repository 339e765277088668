"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check. DataFrame only.

An item of m words is compared with every window of m words of a document (shorter at the document's end) by the
weighted Jaccard similarity of their word shingles, repeats counted. Sliding a window right to the first shingle that it
shares with the item never lowers the similarity, so windows need to start at such shingles only: a join of each document's
shingles with those of the items finds them without loss, and with them the items each window can be like. Each such window
is fingerprinted; an index of radius + 1 blocks of bits, kept for each item, guarantees every item fingerprint within the
radius, and the shingles of those pairs are compared exactly. So are pairs whose fingerprints vary more: those of windows that
the document's end cuts short, and of items that repeat a shingle.

A hit carries the words of its window and not those of its document, and long documents are cut into parts, whose hits Spark
holds at once.

Tables made of the items are broadcast when their shingles, and with them the bytes, are few (checked). Beyond that, shingles
meet by shuffled joins of (document, position, hash), and only texts with a hit are read once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import broadcast_if_small, keep

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits that a window of similarity 0.8 keeps within: 9.7 are expected, 2.9 is the standard deviation.
RADIUS = 20
#: Up to so many shingles of all items, each counted as often as it stands, are broadcast: some 64 bytes each in all tables.
BROADCAST_SHINGLES = 500_000
#: Words of all windows of a part of a document, and starts in it at least.
PART_WORDS, PART_STARTS = 1 << 18, 256

_SPACE = r"[\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """Lower-cased words between white space; one empty word for a text without any."""
    return F.split(F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), _SPACE, -1)


def _hash_at(array: str, at: str, size: int) -> str:
    return "xxhash64(" + ", ".join(f"get({array}, {at} + {k})" for k in range(size)) + ")"


def _simhash(shingles: str) -> str:
    """SQL for the majority bits of an array of hashes: two 32-bit counters share a long."""
    counts = f"transform(sequence(0, 31), k -> aggregate({shingles}, 0L, (a, h) -> a + (shiftrightunsigned(h, k) & 4294967297L)))"
    bit = "if(2 * {} > size({}), 1L, 0L)"
    low, high = bit.format("(c & 4294967295L)", shingles), bit.format("shiftrightunsigned(c, 32)", shingles)
    # coalesce: a value that cannot be null needs no check of its own, which would compute it again.
    return f"coalesce(aggregate(transform({counts}, (c, k) -> shiftleft({low}, k) | shiftleft({high}, k + 32)), 0L, (f, x) -> f | x), 0L)"


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks of nearly equal width."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _block_values(fp: str, radius: int) -> str:
    return "array(" + ", ".join(f"shiftrightunsigned({fp}, {at}) & {(1 << n) - 1}L" for at, n in _blocks(radius)) + ")"


def item_windows(benchmark: DataFrame, size: int, shingle: int, radius: int) -> DataFrame:
    """Items whose shingles have ``size`` words: item_id, n_words, shingles, their distinct hashes and counts, fp."""
    items = benchmark.select("item_id", words().alias("w")).filter(F.element_at("w", 1) != "").withColumn("n_words", F.size("w"))
    items = items.filter(F.least(F.lit(shingle), F.col("n_words")) == size)
    items = items.select("item_id", "n_words", F.expr(f"transform(sequence(0, n_words - {size}), i -> {_hash_at('w', 'i', size)})").alias("item_shingles"))
    items = items.withColumn("hashes", F.array_distinct("item_shingles"))
    items = items.withColumn("counts", F.expr("transform(hashes, h -> size(filter(item_shingles, x -> x = h)))"))
    return items.withColumn("item_fp", F.expr(_simhash("item_shingles"))).withColumn("item_blocks", F.expr(_block_values("item_fp", radius)))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the most similar window of a document for each item it leaks.

    Args:
        docs: has ``doc_id`` and ``text``; other columns are ignored.
        benchmark: has ``item_id`` and ``text``.
        similarity: least weighted Jaccard similarity of the shingles.
        shingle: words in a shingle; items and windows with fewer words are one shingle.
        radius: differing fingerprint bits within which every pair is found.

    ``start`` counts words from 0, the first window wins a tie. Null or empty texts leak nothing and are leaked by
    nobody. Rows that repeat a doc_id, or an item_id, are taken as one; a null id is a value like any other.
    """
    worded = benchmark.select(words().alias("w")).filter(F.element_at("w", 1) != "")
    sizes = [r[0] for r in worded.select(F.least(F.lit(shingle), F.size("w"))).distinct().collect()]
    found = None
    for size in sorted(sizes):
        items = keep(item_windows(benchmark, size, shingle, radius), "benchmark-items")  # else computed in every use
        part = _of_size(docs, items, size, similarity, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_words int, start int, similarity double")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def parts(docs: DataFrame, size: int, longest: int) -> DataFrame:
    """(doc_id, t, at, w, n_starts): a document's words from ``at`` on that windows of at most ``longest`` words reach from so many
    starts; t is the text's hash. A document with few starts is one part."""
    starts = max(PART_STARTS, PART_WORDS // longest)
    to = f"least(p + {starts + longest - 1}, size(w)) - 1"
    cut = f"transform(sequence(0, size(w) - {size}, {starts}), p -> struct(p as at, transform(sequence(p, {to}), i -> w[i]) as w))"
    # The lambdas keep this out of generated code, which would hold all hits of a document until its last part is done.
    part = F.expr(f"inline(if(size(w) - {size} < {starts}, array(struct(0 as at, w as w)), {cut}))")
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), words().alias("w")).select("doc_id", "t", part)
    return rows.withColumn("n_starts", F.expr(f"least({starts}, greatest(size(w) - {size - 1}, 1))"))


def _of_size(docs: DataFrame, items: DataFrame, size: int, similarity: float, radius: int) -> DataFrame:
    total = items.agg(F.sum(F.size("item_shingles") + radius + 2).alias("n"), F.max("n_words").alias("longest")).first()
    small = (total["n"] or 0) <= BROADCAST_SHINGLES
    side = F.broadcast if small else (lambda df: df)
    seeds = items.select(F.explode("hashes").alias("h"), "n_words", "item_id").groupBy("h", "n_words").agg(F.collect_set(F.struct("item_id")).alias("items"))
    window = F.expr(f"transform(sequence(0, greatest(size(w) - {size}, 0)), i -> {_hash_at('w', 'i', size)})").alias("shingles")
    starts = F.explode(F.expr("sequence(0, n_starts - 1)")).alias("start")
    part = parts(docs, size, total["longest"] or size)
    if small:
        # One row for each shingle carries a reference to its part's words, not a copy, up to the join.
        hit = part.select("doc_id", "at", "w", starts).withColumn("h", F.expr(_hash_at("w", "start", size))).join(side(seeds), "h")
    else:
        hit = part.select("doc_id", "t", "at", "w", starts).select("doc_id", "t", "at", "start", F.expr(_hash_at("w", "start", size)).alias("h")).join(seeds, "h")
        hit = keep(hit.select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), F.col("at").alias("__at"), "start", "n_words", "items").distinct(), "item-hits")
        hit = part.join(hit, part["doc_id"].eqNullSafe(F.col("__d")) & (part["t"] == F.col("__t")) & (part["at"] == F.col("__at")))
    hit = hit.select("doc_id", (F.col("at") + F.col("start")).alias("start"), "n_words", "items", F.expr("slice(w, start + 1, n_words)").alias("w"))
    windows = hit.select("doc_id", "start", "n_words", "items", window).withColumn("fp", F.expr(_simhash("shingles")))
    # Block radius + 1 holds the pairs that are compared whatever their fingerprints.
    index = F.expr(f"array_append({_block_values('fp', radius)}, -1L)")
    keyed = windows.select("doc_id", "start", "n_words", "shingles", "fp", F.explode("items.item_id").alias("item_id"))
    keyed = keyed.select("*", F.posexplode(index).alias("block", "value"))
    uneven = F.size("item_shingles") > F.size("hashes")
    near = items.select(F.col("item_id").alias("near_item"), F.col("n_words").alias("near_words"), "item_fp", F.size("item_shingles").alias("item_size"), uneven.alias("uneven"), F.posexplode(F.expr("array_append(item_blocks, -1L)")).alias("near_block", "near_value"))
    met = F.col("item_id").eqNullSafe(F.col("near_item")) & (F.col("n_words") == F.col("near_words")) & (F.col("block") == F.col("near_block")) & (F.col("value") == F.col("near_value"))
    # Within the radius; a pair meets in every block that is equal and is kept in the first of them.
    close = f"bit_count(fp ^ item_fp) <= {radius} and array_position({_block_values('(fp ^ item_fp)', radius)}, 0L) = block + 1"
    other = f"block = {radius + 1} and (uneven or size(shingles) <> item_size) and bit_count(fp ^ item_fp) > {radius}"
    pair = keyed.join(side(near), met).filter(F.expr(f"if(block = {radius + 1}, {other}, {close})")).select("doc_id", "start", "item_id", "n_words", "shingles")
    whole = items.select(F.col("item_id").alias("of_item"), F.col("n_words").alias("of_words"), "item_shingles", "hashes", "counts")
    pair = pair.join(side(whole), F.col("item_id").eqNullSafe(F.col("of_item")) & (F.col("n_words") == F.col("of_words")))
    common = "aggregate(zip_with(hashes, counts, (h, c) -> least(c, size(filter(shingles, x -> x = h)))), 0, (a, x) -> a + x)"
    pair = pair.withColumn("shared", F.expr(common)).withColumn("similarity", F.expr("shared / cast(size(shingles) + size(item_shingles) - shared as double)"))
    return pair.filter(F.col("similarity") >= similarity).select("doc_id", "item_id", "n_words", "start", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """``docs`` without the documents that ``contaminated`` finds; rows with a null doc_id stay if none leaks."""
    # Written first, so that Spark knows its size: texts are only shuffled where the leaking ids are many.
    bad = broadcast_if_small(keep(contaminated(docs, benchmark, **kwargs).select(F.col("doc_id").alias("__bad")).distinct(), "leaking-ids"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad")), "left_anti")
