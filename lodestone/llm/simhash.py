"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. A 23-bit word is decoded with the perfect binary
Golay code: the word and its 23 one-bit neighbours decode to one or six codewords, and two words that differ in at most
two bits always share one of them (the word half way between is a neighbour of both). With e1, e2 and e3 differing bits
in the segments and e1 + e2 + e3 <= 4, one of these keys is shared:

    e3 = 0                    segment 3, and a codeword of segment 1 or 2 (one of them has at most 2 errors)
    e3 <= 2, e1 <= 2, e2 <= 2 codewords of segments 1 and 2, and a third of segment 3 (one of three is free of errors)
    e3 = 1, e1 or e2 = 3      the other segment is equal, and a half of segment 3
    e3 >= 3                   e1 + e2 <= 1: one segment is equal, and a codeword of the other

Only different fingerprints are keyed, so exact copies cost one row. Tasks stream the rows of a key in order, verify
distances and emit a spanning forest of the links, never all pairs. Components of the forest are found by star
contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import number_batches, text_batches
from lodestone.llm.components import components
from lodestone.sources.scratch import broadcast_if_small, keep

RADIUS = 4
#: Fingerprints of one key that a task holds at once; longer runs are dealt out again, any two blocks of them together.
RUN = 1 << 20


# ---- fingerprints


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) < shingle:
        hashes = np.array([digest(line, seed)], dtype=np.uint64)
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size).tolist()
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends.tolist()[shingle - 1 :], strict=False)], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, with_text: bool = False) -> DataFrame:
    """(doc_id, fp) of every document; fp holds the 64 bits as a signed long. With ``with_text`` also t, a hash of the text."""
    text_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x or "", shingle, seed) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", "t"][: batch.num_columns])

    extra = [F.xxhash64("text").alias("t")] if with_text else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).mapInArrow(made, "doc_id long, fp long" + (", t long" if with_text else ""))


# ---- the Golay code


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the [23, 12, 7] code: the syndrome of the high and of the low half of a word, and the coset leaders."""
    poly = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= poly << (bit - 11)
        return word

    high = np.array([remainder(x << 11) for x in range(1 << 12)], dtype=np.int64)
    low = np.arange(1 << 11, dtype=np.int64)  # a word below x^11 is its own remainder
    leaders = np.zeros(1 << 11, dtype=np.int64)
    bits = [1 << i for i in range(23)]
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                # Equal picks make patterns of weight 1 and 2 (i = j = k, or j = k); each syndrome has one leader.
                word = bits[i] | bits[j] | bits[k]
                leaders[remainder(word)] = word
    return high, low, leaders


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 information bits) of the codeword nearest to each 23-bit word."""
    high, low, leaders = golay()
    return (words ^ leaders[high[words >> 11] ^ low[words & 0x7FF]]) >> 11


def near_codewords(words: np.ndarray) -> np.ndarray:
    """(n, 6): the codeword indices to which a word and its one-bit neighbours decode; -1 where there are fewer."""
    flips = np.array([0, *(1 << i for i in range(23))], dtype=np.int64)
    found = np.sort(decode(words[:, None] ^ flips), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


def keys_of(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) for each family of keys: ``keys[i]`` belongs to ``fps[rows[i]]``."""
    fps = fps.astype(np.uint64)
    a = (fps & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (fps >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fps >> np.uint64(46)).astype(np.int64)
    index = np.arange(len(fps))
    near_a, near_b = near_codewords(a), near_codewords(b)

    def give(family: int, value: np.ndarray, valid: np.ndarray | None = None, rows: np.ndarray = index) -> tuple[np.ndarray, np.ndarray]:
        tagged = value | (family << 40)
        return (rows, tagged) if valid is None else (rows[valid], tagged[valid])

    for k in range(6):
        yield give(1, c << 12 | near_a[:, k], near_a[:, k] >= 0)
        yield give(2, c << 12 | near_b[:, k], near_b[:, k] >= 0)
        yield give(3, b << 12 | near_a[:, k], near_a[:, k] >= 0)
        yield give(4, a << 12 | near_b[:, k], near_b[:, k] >= 0)
        for j in range(6):
            both = (near_a[:, k] >= 0) & (near_b[:, j] >= 0)
            pair = near_a[:, k] << 12 | near_b[:, j]
            for third in range(3):
                yield give(5 + third, pair << 6 | (c >> (6 * third) & 0x3F), both)
    for half in range(2):
        part = c >> (9 * half) & 0x1FF
        yield give(8 + half, a << 9 | part)
        yield give(10 + half, b << 9 | part)


# ---- links


class Forest:
    """Union-find over fingerprints that lets through only links which join two trees; forgets all when it is large."""

    def __init__(self, most: int = 1 << 19) -> None:
        self.parent: dict[int, int] = {}
        self.most = most

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def joins(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if len(self.parent) > self.most:
            self.parent.clear()
        self.parent[max(x, y)] = min(x, y)
        self.parent.setdefault(min(x, y), min(x, y))
        return True


def forest_of(run: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what links of at most ``radius`` bits connect within one run of different fingerprints.

    Breadth first: a fingerprint once reached leaves the set that is searched, so a dense group costs few scans.
    Long runs are first cut by radius + 1 exact blocks, of which close fingerprints share one.
    """
    if len(run) > 4096:
        joins, links = Forest(most=1 << 62), []
        width = -(-64 // (radius + 1))
        for block in range(radius + 1):
            part = run >> np.uint64(block * width) & np.uint64((1 << width) - 1)
            order = np.argsort(part, kind="stable")
            for group in np.split(run[order], np.flatnonzero(np.diff(part[order])) + 1):
                if len(group) > 1:
                    links += [x for x in _breadth(group, radius) if joins.joins(*x)]
        return links
    return _breadth(run, radius)


def _breadth(run: np.ndarray, radius: int) -> list[tuple[int, int]]:
    left, links = run, []
    while len(left) > 1:
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            at = wave.pop()
            close = np.bitwise_count(left ^ at) <= radius
            if close.any():
                reached = left[close]
                links += [(int(at), int(x)) for x in reached]
                wave += list(reached)
                left = left[~close]
    return links


_LINK = "kind int, a long, b long"


def stream_links(radius: int, run_limit: int | None):
    """A task over rows (key, fp) sorted by both: kind 0 are links (a, b), kind 1 rows (key, fp) of runs over the limit."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        key, fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        spilling = None  # the key of a run over the limit, while it lasts

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(a):
                yield pa.record_batch([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

        def linked(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            fresh = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]
            key, fp = key[fresh], fp[fresh]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            a, b = [], []
            for step in range(1, 4):  # runs of up to four: by shifted comparison
                at = starts[(sizes > step) & (sizes <= 4)]
                for lead in range(4 - step):
                    here = at[sizes[np.searchsorted(starts, at)] > step + lead] + lead
                    x, y = fp[here], fp[here + step]
                    close = np.bitwise_count(x ^ y) <= radius
                    a.append(x[close])
                    b.append(y[close])
            pairs = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=0)
            links = [(x, y) for x, y in pairs.tolist() if forest.joins(x, y)]
            for at, n in zip(starts[sizes > 4].tolist(), sizes[sizes > 4].tolist(), strict=True):
                links += [(x, y) for x, y in forest_of(fp[at : at + n], radius) if forest.joins(x, y)]
            if links:
                pairs = np.array(links, dtype=np.uint64)
                yield from out(0, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if not len(key):
                continue
            if spilling is not None:
                n = int(np.searchsorted(key, spilling, side="right"))
                yield from out(1, key[:n], fp[:n])
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                spilling = None
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from linked(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
            if run_limit and len(key) > run_limit:
                spilling = key[0]
                yield from out(1, key, fp)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from linked(key, fp)

    return stream


def links(distinct: DataFrame, radius: int = RADIUS, run_limit: int = RUN) -> DataFrame:
    """(a, b): a forest whose components are those of all links of at most 4 bits among different fingerprints."""
    if radius > RADIUS:
        raise ValueError("the keys guarantee links of up to 4 bits")
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy()
            for at in range(0, len(whole), 4096):
                fps = whole[at : at + 4096].view(np.uint64)
                rows, keys = zip(*keys_of(fps), strict=True)
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(fps[np.concatenate(rows)].view(np.int64))], names=["key", "fp"])

    def runs(rows: DataFrame, limit: int | None) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(stream_links(radius, limit), _LINK)

    # A row gives about 110: dealt out first, since adaptive execution sizes partitions by the small table of fingerprints.
    spread = distinct.select("fp").repartition(max(distinct.sparkSession.sparkContext.defaultParallelism, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "fp")
    with number_batches(distinct.sparkSession):
        found = keep(runs(spread.mapInArrow(keyed, "key long, fp long"), run_limit), "links")
    long_runs = found.filter(F.col("kind") == 1)
    made = found.filter(F.col("kind") == 0).select("a", "b")
    if not long_runs.isEmpty():
        # An exact way for any length of run: it is cut into blocks by a hash, and each two blocks are a run of their own.
        sizes = long_runs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / (run_limit / 2)).alias("blocks"))
        cut = long_runs.select("a", "b").distinct().join(sizes, "a").withColumn("own", F.pmod(F.xxhash64("b"), "blocks"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        again = cut.select(F.xxhash64("a", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.col("b").alias("fp"))
        with number_batches(distinct.sparkSession):
            made = made.unionByName(keep(runs(again, None), "links").select("a", "b"))
    return made.distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id, label) for each row of ``docs``; ``label`` is the group's own number.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach, the row's own
    included. ``docs`` has ``doc_id`` (an integer) and ``text``; other columns are ignored. Null and empty texts
    have fingerprint zero and link like any other; a null doc_id is never chosen (null if a component has no other).
    """
    docs_fp = keep(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(distinct, radius))
    named = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = keep(named, "labels")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = keep(named.join(least, "label").select("fp", "component_id", "label"), "components")
    return docs_fp.join(of_fp, "fp").select("doc_id", "fp", "component_id", "label")


def keep_representatives(docs: DataFrame, radius: int = RADIUS, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest doc_id, a null id counting as largest.

    Rows that repeat an id are told apart by their text; of equal rows one stays. Other columns, whatever their names,
    are kept as they are.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    number, own = F.col("doc_id").cast("long"), F.xxhash64("text")
    docs_fp = keep(fingerprints(docs, shingle, seed, with_text=True), "fingerprints")
    labels = components(links(docs_fp.select("fp").distinct(), radius))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("t"))
    rows = docs_fp.join(labels, F.col("fp") == F.col("node"), "left").select(F.coalesce("label", "fp").alias("label"), rank.alias("rank"))
    rows = keep(rows, "ranked")
    first = rows.groupBy("label").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1).drop("copies")
    gone = rows.join(first, "label").filter(~F.col("rank").eqNullSafe(F.col("first"))).select(F.col("rank.d").alias("__d"), F.col("rank.t").alias("__t")).distinct()
    left = docs.join(broadcast_if_small(keep(gone, "copies")), number.eqNullSafe(F.col("__d")) & (own == F.col("__t")), "left_anti")
    if docs.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty():
        return left
    return left.withColumn("__t", own).dropDuplicates(["doc_id", "__t"]).select(*columns)
