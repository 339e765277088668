"""Packing by minimum bin slack.

Each document is tokenized where it lies. Full windows of its ids become sequences at once; the remainder waits in the
task's buffer. When the buffer is full, windows are filled one after another: the longest waiting remainder is set,
and a bitset subset-sum over the multiset of the other lengths finds the fill closest to capacity; the counts of each
length are read back from the bitsets. A slack that is left takes the beginning of the longest remainder that waits, whose
rest waits on. No row is shuffled, and a task holds one buffer of remainders and no more. What a task has at its end, less than
one window, is cut into power-of-two sequences, which need no padding.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_batches

CAPACITY = 1024
#: Remainders that wait in a task before windows are filled from half of them.
BUFFER = 4096

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The tokens that a tokenizers file adds to its vocabulary: literals of a text that have an id of their own."""
    with open(vocabulary, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens") or []
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} is matched by more than its letters")
    return {token["content"]: token["id"] for token in found}


@lru_cache(maxsize=2)
def encoder(ranks: str, vocabulary: str | None = None) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file, with the added tokens of ``vocabulary``, the tokenizers file; gives its ids."""
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    added = added_tokens(vocabulary) if vocabulary else {}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` as closely as the multiset ``counts`` allows.

    A bitset holds the reachable sums. A length that occurs c times enters as 1, 2, 4, ... of it, so that the bitset
    takes log c steps; the steps are walked back from the best sum.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            times *= 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return dict(used)


class Packer:
    """Fills sequences of ``capacity`` from pieces (doc, start, ids, doc_tokens); gives rows of pieces."""

    def __init__(self, task: int, capacity: int = CAPACITY, buffer: int = BUFFER) -> None:
        self.capacity, self.buffer = capacity, buffer
        self.next_id = task << 40
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.n_waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """Cut one document; its full windows are sequences, its remainder waits."""
        total = len(ids)
        for start in range(0, total - total % self.capacity, self.capacity):
            self._sequence([(doc, start, ids[start : start + self.capacity], total)])
        if rest := total % self.capacity:
            self.waiting[rest].append((doc, total - rest, ids[total - rest :].copy(), total))
            self.n_waiting += 1
        if self.n_waiting >= self.buffer:
            self._fill(last=False)

    def close(self) -> None:
        self._fill(last=True)

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, ids))
            offset += len(ids)
        self.next_id += 1

    def _fill(self, last: bool) -> None:
        counts = {k: len(v) for k, v in self.waiting.items() if v}
        while counts and (last or self.n_waiting > self.buffer // 2):
            longest = max(counts)
            pieces = [self._take(counts, longest)]
            for length, n in best_fill(counts, self.capacity - longest).items():
                pieces += [self._take(counts, length) for _ in range(n)]
            slack = self.capacity - sum(len(p[2]) for p in pieces)
            if slack and not counts:
                if last:
                    self._halve(pieces)
                else:  # less than a window of short ones
                    for piece in pieces:
                        self.waiting[len(piece[2])].append(piece)
                    self.n_waiting += len(pieces)
                return
            if slack:  # every remainder that waits is longer, or the fill would have come closer with it
                doc, start, ids, total = self._take(counts, max(counts))
                pieces.append((doc, start, ids[:slack], total))
                rest = len(ids) - slack
                self.waiting[rest].append((doc, start + slack, ids[slack:], total))
                self.n_waiting += 1
                counts[rest] = counts.get(rest, 0) + 1
            self._sequence(pieces)

    def _take(self, counts: dict[int, int], length: int) -> tuple:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        self.n_waiting -= 1
        return self.waiting[length].popleft()

    def _halve(self, pieces: list[tuple]) -> None:
        """Lay pieces that fill no window end to end, one power of two after another."""
        line, left = deque(pieces), sum(len(p[2]) for p in pieces)
        while left:
            need = size = 1 << (left.bit_length() - 1)
            row = []
            while need:
                doc, start, ids, total = line.popleft()
                if len(ids) > need:
                    line.appendleft((doc, start + need, ids[need:], total))
                    ids = ids[:need]
                row.append((doc, start, ids, total))
                need -= len(ids)
            self._sequence(row)
            left -= size


def pack_documents(docs: DataFrame, ranks: str | None = None, end_id: int = 0, capacity: int = CAPACITY, buffer: int = BUFFER, with_ids: bool = True, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence.

    Args:
        docs: has ``doc_id`` (an integer) and ``text``; other columns are ignored.
        ranks: rank file of the byte-level BPE; the public 50k vocabulary unless given.
        end_id: closes every document, so an empty or null text has this one id.
        capacity: ids in a sequence.
        with_ids: add the piece's ids as array<int>.
        vocabulary: tokenizers file whose added tokens are single ids; that of the public vocabulary unless ``ranks`` is given.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). Repeated rows and rows with
    a null doc_id are packed like any other.
    """
    text_batches(docs.sparkSession)
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if vocabulary is None and ranks is None:
        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder(path, vocabulary).encode, allowed_special="all")
        packer = Packer(TaskContext.get().partitionId(), capacity, buffer)

        def rows() -> Iterator[pa.RecordBatch]:
            if packer.rows:
                columns = list(zip(*packer.rows, strict=True))
                packer.rows = []
                arrays = [pa.array(c, t) for c, (_, t) in zip(columns[:7], fields, strict=True)]
                yield pa.record_batch(arrays + ([pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32()))] if with_ids else []), schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) if text else []
                ids.append(end_id)
                packer.add(doc, np.array(ids, dtype="<u4"))
            yield from rows()
        packer.close()
        yield from rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, _PIECE + (", ids array<int>" if with_ids else ""))
