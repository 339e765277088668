"""Line dedup: range-partitioned line hashes, streamed in order, returned as a keep bitmap for each document.

Every line becomes one row (hash, document, position) of 40 bytes; texts stay where they are. The rows are range-
partitioned by (hash, document) and sorted within partitions by document and position, so a line that a third of all
documents share is cut into as many partitions as it needs. Each task streams its sorted rows once, holding the rows of
the current line until ``min_docs`` documents had it, and at most ``HELD`` of them. A line that crosses a partition's edge, or
has more rows than that in fewer documents, is not decided there but by the sum of the tasks' partial counts: two lines a
partition, and one for every ``HELD`` rows at most. The result is a compressed bitmap a document; a document without one
keeps every line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import NO_ID, number_batches, text_batches
from lodestone.sources.scratch import keep, release

SPACE = b" \t\n\x0b\x0c\r"

_LINE = "h1 long, h2 long, doc long, row long, pos long"
_EVENT = "kind int, h1 long, h2 long, doc long, row long, pos long, n long"
_EVENT_ARROW = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("h1", "h2", "doc", "row", "pos", "n"))])
#: Kinds of rows that a streaming task gives: a line to drop, one that other partitions decide, a count at an edge.
DROP, OPEN, EDGE = 0, 1, 2
#: Rows of an undecided line that a task holds.
HELD = 1 << 17


def line_key(line: bytes) -> bytes:
    """A line's key: white space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, doc, row, pos) of every line whose key has at least ``min_chars`` code points.

    ``row`` is a hash of the text, so that rows which share a doc_id but not a text keep apart.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            found, where, docs_, rows = [], [], [], []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = 0
                for pos, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line.strip(SPACE)
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        found.append(digest(key.lower()))
                        where.append(pos)
                        n += 1
                docs_ += [doc] * n
                rows += [row] * n
            pair = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.record_batch([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(docs_, pa.int64()), pa.array(rows, pa.int64()), pa.array(where, pa.int64())], names=["h1", "h2", "doc", "row", "pos"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text").mapInArrow(hashed, _LINE)


class LineStream:
    """Streams rows sorted by (h1, h2, doc, row, pos) and tells which lines to drop.

    A line (hash) is repeated when at least ``min_docs`` documents hold it. All its rows go, or with ``keep_first``
    all but the first by document and position. ``push`` takes sorted arrays, ``close`` ends the partition.
    """

    def __init__(self, min_docs: int, keep_first: bool, held: int = HELD) -> None:
        self.min_docs, self.keep_first, self.held = min_docs, keep_first, held
        self.left: tuple[int, int] | None = None  # the partition's first line, which may have begun before
        self.line: tuple[int, int] | None = None  # the current line, which may go on
        self.chunks: list[np.ndarray] = []  # its rows, while it is undecided
        self.n_rows = self.n_docs = self.doc = 0  # of the chunks; documents so far, and the last one
        self.first: np.ndarray | None = None  # its first row, if that stays
        self.going = self.told = False  # whether it is known to be repeated; whether rows of it were given out undecided

    def push(self, rows: np.ndarray) -> list[np.ndarray]:
        if not len(rows):
            return []
        out: list[np.ndarray] = []
        if self.left is None:
            self.left = (int(rows[0, 0]), int(rows[0, 1]))
        if self.line is not None:
            same = (rows[:, 0] == self.line[0]) & (rows[:, 1] == self.line[1])
            n = len(rows) if same.all() else int(np.argmin(same))
            out += self._go_on(rows[:n])
            if n == len(rows):
                return out
            out += self._end()
            rows = rows[n:]
        starts = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
        last = int(starts[-1])
        if last:
            out += self._whole(rows[:last], starts[:-1])
        self.line = (int(rows[last, 0]), int(rows[last, 1]))
        return out + self._go_on(rows[last:].copy())

    def close(self) -> list[np.ndarray]:
        if self.line is None:
            return []
        self.told = True  # the next partition may go on with it, and must know that its first occurrence is here
        return ([] if self.first is None else self._events(OPEN, self.first)) + self._end()

    def _go_on(self, rows: np.ndarray) -> list[np.ndarray]:
        """More rows of the current line."""
        if not len(rows):
            return []
        if self.going:
            return self._events(DROP, rows)
        self.n_docs += self._docs(rows) - (1 if self.n_docs and int(rows[0, 2]) == self.doc else 0)
        self.doc = int(rows[-1, 2])
        self.chunks.append(rows)
        self.n_rows += len(rows)
        if self.n_docs >= self.min_docs:
            self.going = True
            return self._repeated(np.concatenate(self._held()))
        if self.n_rows > self.held:
            self.told = True
            return self._events(OPEN, np.concatenate(self._held()))
        return []

    def _held(self) -> list[np.ndarray]:
        held, self.chunks, self.n_rows = self.chunks, [], 0
        return held

    def _end(self) -> list[np.ndarray]:
        """The current line ends, here or (``told``) perhaps in the next partition."""
        out, held = [], self._held()
        if self.going:
            if self.told or self.line == self.left:
                out = self._edge(self.line, self.n_docs)
        elif self.told or self.line == self.left:
            out = (self._events(OPEN, np.concatenate(held)) if held else []) + self._edge(self.line, self.n_docs)
        self.line, self.first, self.going, self.told, self.n_docs = None, None, False, False, 0
        return out

    @staticmethod
    def _docs(rows: np.ndarray) -> int:
        return 1 + int((rows[1:, 2] != rows[:-1, 2]).sum()) if len(rows) else 0

    def _whole(self, rows: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Lines that end in this batch; only the partition's first can have begun elsewhere."""
        out: list[np.ndarray] = []
        if (int(rows[0, 0]), int(rows[0, 1])) == self.left:
            end = int(starts[1]) if len(starts) > 1 else len(rows)
            first = rows[:end]
            if (n := self._docs(first)) >= self.min_docs:
                self.line = self.left
                out += self._repeated(first) + self._edge(self.left, n)
            else:
                out += self._undecided(first)
            rows, starts = rows[end:], starts[1:] - end
            if not len(rows):
                return out
        fresh = np.r_[True, rows[1:, 2] != rows[:-1, 2]]
        fresh[starts] = True
        often = np.add.reduceat(fresh.astype(np.int64), starts) >= self.min_docs
        go = np.repeat(often, np.diff(np.r_[starts, len(rows)]))
        if self.keep_first:
            go[starts] = False
        return out + self._events(DROP, rows[go])

    def _repeated(self, rows: np.ndarray) -> list[np.ndarray]:
        """The first rows of the current line, now that it is known to be repeated."""
        if not self.keep_first or self.told:  # the first row was given out before
            return self._events(DROP, rows)
        if self.line != self.left:
            self.first = rows[:1]
            return self._events(DROP, rows[1:])
        # Which partition holds the first occurrence is known only when all edges are.
        return self._events(OPEN, rows[:1]) + self._events(DROP, rows[1:])

    def _undecided(self, rows: np.ndarray) -> list[np.ndarray]:
        return self._events(OPEN, rows) + self._edge((int(rows[0, 0]), int(rows[0, 1])), self._docs(rows))

    @staticmethod
    def _events(kind: int, rows: np.ndarray) -> list[np.ndarray]:
        if not len(rows):
            return []
        return [np.column_stack([np.full(len(rows), kind, dtype=np.int64), rows, np.zeros(len(rows), dtype=np.int64)])]

    @staticmethod
    def _edge(line: tuple[int, int], n: int) -> list[np.ndarray]:
        return [np.array([[EDGE, *line, 0, 0, 0, n]], dtype=np.int64)]


def dropped_lines(lines: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc, row, pos) of the lines to drop, from the rows of ``line_hashes``."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = LineStream(min_docs, keep_first)

        def batch_of(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if parts:
                x = np.concatenate(parts)
                yield pa.record_batch([pa.array(np.ascontiguousarray(x[:, 0]).astype(np.int32)), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(1, 7))], schema=_EVENT_ARROW)

        for batch in batches:
            yield from batch_of(state.push(np.column_stack([c.to_numpy() for c in batch.columns]) if batch.num_rows else np.empty((0, 5), dtype=np.int64)))
        yield from batch_of(state.close())

    lines = keep(lines, "lines")  # else the sampling of the ranges hashes every text once more
    ordered = lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "row", "pos")
    with number_batches(lines.sparkSession):
        events = keep(ordered.mapInArrow(stream, _EVENT), "line-events")
    release(lines)
    edges = events.filter(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= min_docs)
    waiting = events.filter(F.col("kind") == OPEN)
    open_lines = waiting.join(edges, ["h1", "h2"])
    if keep_first:
        first = waiting.groupBy("h1", "h2").agg(F.min(F.struct("doc", "row", "pos")).alias("first"))
        open_lines = open_lines.join(first, ["h1", "h2"]).filter(F.struct("doc", "row", "pos") != F.col("first"))
    return events.filter(F.col("kind") == DROP).select("doc", "row", "pos").unionByName(open_lines.select("doc", "row", "pos"))


def pack_bitmap(dropped: list[int]) -> bytes:
    """A compressed bitmap of a document's lines up to the last dropped one: 1 keeps a line, 0 drops it."""
    bits = np.ones(max(dropped) + 1, dtype=np.uint8)
    bits[dropped] = 0
    return len(bits).to_bytes(4, "little") + zlib.compress(np.packbits(bits).tobytes(), 6)


def unpack_bitmap(bitmap: bytes | None) -> np.ndarray:
    """The positions that a bitmap drops."""
    if not bitmap:
        return np.empty(0, dtype=np.int64)
    n = int.from_bytes(bitmap[:4], "little")
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap[4:]), dtype=np.uint8))[:n] == 0)


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1) -> DataFrame:
    """(doc, row, keep_bitmap) for each document that loses a line.

    Args:
        docs: has ``doc_id`` (an integer) and ``text``; other columns are ignored.
        min_docs: a line is repeated when so many different documents hold its key.
        keep_first: leave the first occurrence, by document id and position; else every occurrence goes.
        min_chars: shorter keys are never dropped; white space alone is no key.

    A null text is one empty line; rows with a null doc_id count together as one document; repeated rows count once.
    """
    text_batches(docs.sparkSession)
    drops = dropped_lines(line_hashes(docs, min_chars), min_docs, keep_first)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps = [pack_bitmap(x) for x in batch.column("positions").to_pylist()]
            yield pa.record_batch([batch.column("doc"), batch.column("row"), pa.array(bitmaps, pa.binary())], names=["doc", "row", "keep_bitmap"])

    return drops.groupBy("doc", "row").agg(F.collect_set("pos").alias("positions")).mapInArrow(packed, "doc long, row long, keep_bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to its kept lines, and the columns n_lines and n_dropped."""
    out = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    names = [f.name for f in out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", n_lines long, n_dropped long"
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for text, bitmap in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                drop = unpack_bitmap(bitmap)
                if len(drop):
                    lines = text.split("\n")
                    totals.append(len(lines))
                    out_of = set(drop.tolist())
                    text = "\n".join(x for i, x in enumerate(lines) if i not in out_of)
                else:
                    totals.append((text or "").count("\n") + 1)
                texts.append(text)
                gone.append(len(drop))
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch([*columns, pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    left = docs.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"), F.xxhash64("text").alias("__row"))
    right = bitmaps.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("keep_bitmap").alias("__bitmap"))
    joined = left.join(right, ["__doc", "__row"], "left").select(*[F.col(f"`{n}`") for n in names], "__bitmap")
    return joined.mapInArrow(cut, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1) -> DataFrame:
    """Documents without their repeated lines, with n_lines (before) and n_dropped; see ``line_keep_bitmaps``."""
    return apply_bitmaps(docs, line_keep_bitmaps(docs, min_docs, keep_first, min_chars))


__all__ = ["apply_bitmaps", "dedup_lines", "line_hashes", "line_keep_bitmaps", "pack_bitmap", "unpack_bitmap"]
