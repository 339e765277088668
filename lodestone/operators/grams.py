"""Postings of three-character strings, so that a search reads only files that can hold what it looks for.

Within a bucket of paths a file has one of ``SLOTS`` slots, by its path's hash; a posting is the sorted slots of the bucket's files
that hold a string. Files that share a slot only make candidates more: every hit is found by reading the candidates' texts. A bucket
should hold about as many files as there are slots, so the buckets are what grows with a tree.

Characters are folded before: what is the same letter for a search that ignores case is one character. The fold goes by character
alone, so a text that holds a string holds its folded strings in the folded text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 15
#: Pairs of string and slot that a task merges before it hands them on.
CHUNK = 4_000_000
#: Candidates up to which their slots are a condition of the scan itself.
NAMED = 100
#: Capitals, and the letters outside ASCII that equal i, k or s where case is ignored (fixed values).
_FOLDED = {c: c + 32 for c in range(65, 91)} | {0x130: 105, 0x131: 105, 0x17F: 115, 0x212A: 107}


def slot(path: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(path), 24), F.lit(SLOTS)).cast("int")


def of_text(text: str) -> np.ndarray:
    """The different folded strings of three characters within the lines of a text, each as a number of 63 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    c = np.where((c >= 65) & (c <= 90), c + 32, c)
    if c.max() > 127:
        for old, new in _FOLDED.items():
            if old > 127:
                c[c == old] = new
    inside = (c != 10) & (c != 13)
    found = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.unique(found[inside[:-2] & inside[1:-1] & inside[2:]])


def postings(files: DataFrame) -> DataFrame:
    """(bucket, gram, slots) of files (bucket, slot, text). Tasks merge their own files first; a posting has at most ``SLOTS`` slots."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        n = 0
        for batch in batches:
            for bucket, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    held.append((of_text(text), bucket, at))
                    n += len(held[-1][0])
                if n >= CHUNK:
                    yield _posted(held)
                    held, n = [], 0
        if held:
            yield _posted(held)

    rows = files.select("bucket", "slot", "text").mapInArrow(merged, "bucket int, gram long, slots array<int>")
    return rows.groupBy("bucket", "gram").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("slots")))).alias("slots"))


def _posted(held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
    lengths = [len(g) for g, _, _ in held]
    gram = np.concatenate([g for g, _, _ in held])
    bucket, at = np.repeat([b for _, b, _ in held], lengths).astype(np.int32), np.repeat([s for _, _, s in held], lengths).astype(np.int32)
    order = np.lexsort((at, gram, bucket))
    gram, bucket, at = gram[order], bucket[order], at[order]
    starts = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (bucket[1:] != bucket[:-1])]) if len(gram) else np.empty(0, np.int64)
    slots = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(gram)].astype(np.int32)), pa.array(at))
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(gram[starts]), slots], names=["bucket", "gram", "slots"])


def needed(literals: list[str], ignore_case: bool = False) -> list[int]:
    """The strings that a text holds if it holds all ``literals``. Where case is ignored only those of ASCII are sure."""
    found = {int(g) for x in literals for g in of_text(x)}
    if ignore_case:
        found = {g for g in found if all((g >> k) & 0x1FFFFF < 128 for k in (0, 21, 42))}
    return sorted(found)


#: What a pattern may be made of for its literals to be told: words and blanks, escaped signs, classes without brackets inside, and
#: a sign of repetition behind one character or class. All else, groups and bars above all, tells nothing.
_PART = re.compile(r"(?P<one>[\w \"'<>=,;:/@#%&!~`-]|\\[^\w\s]|(?P<any>\\[dDwWsSbB]|\.|\[\^?[^\[\]\\&^]+\]|[$^]))(?P<times>[*?+]|\{\d+(?:,\d*)?\})?")


def literals_of(pattern: str) -> list[str]:
    """Strings that every match of a pattern holds, of Java's or Python's kind; none where the pattern is not simple enough to say."""
    found, run, at = [], "", 0
    while at < len(pattern):
        part = _PART.match(pattern, at)
        if part is None:
            return []
        at, times = part.end(), part["times"]
        if part["any"] is None and times is None:
            run += part["one"][-1]
            continue
        if part["any"] is None and (times == "+" or (times[0] == "{" and int(re.match(r"\d+", times[1:])[0]) > 0)):
            run += part["one"][-1]
        if part["any"] not in (r"\b", r"\B", "^", "$") or times:
            found, run = [*found, run], ""
    return [x for x in (*found, run) if len(x) >= 3]


def candidates(posted: DataFrame, grams: list[int]) -> DataFrame:
    """(bucket, slot) of the files that hold all of ``grams``: one row a bucket meets, with at most ``SLOTS`` slots each."""
    met = posted.filter(F.col("gram").isin(*grams)).groupBy("bucket").agg(F.collect_list("slots").alias("all"))
    both = F.aggregate(F.slice("all", 2, len(grams)), F.element_at("all", 1), F.array_intersect)
    return met.filter(F.size("all") == len(grams)).select("bucket", F.explode(both).alias("slot"))
