"""Streaming forms of the ledger: sessions, running tallies, blind writes, and refresh of an index.

The watermark (one hour by default) is this library's choice: later events no longer change a closed session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from lodestone.sources.stores import Store, append_journal


def session_stream(events: DataFrame, gap_minutes: int = 30, lateness: str = "1 hour") -> DataFrame:
    """(key, started, ended, calls) of sessions of (key, ts); a gap of exactly the limit stays inside, as in batch.

    A session window ends at the gap, exclusive, so it is a microsecond longer than the gap.
    """
    gap = f"{gap_minutes * 60_000_000 + 1} microseconds"
    return events.withWatermark("ts", lateness).groupBy("key", F.session_window("ts", gap)).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("calls")).select("key", "started", "ended", "calls")


def usage_stream(calls: DataFrame) -> DataFrame:
    """Running calls, chars and largest answer of each tool; write it in update or complete mode."""
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"), F.max("chars").alias("max_chars"))


def usage_since_stream(calls: DataFrame, checkpoint: str) -> DataFrame:
    """The tallies of ``usage_stream`` beside those since a checkpoint; a new checkpoint is a new query over the same input."""
    since = F.col("ts") >= F.lit(checkpoint).cast("timestamp")
    tallies = [F.count("*").alias("calls"), F.sum("chars").alias("chars"), F.max("chars").alias("max_chars")]
    return calls.groupBy("tool").agg(*tallies, F.count_if(since).alias("calls_since"), F.coalesce(F.sum(F.when(since, F.col("chars"))), F.lit(0)).alias("chars_since"), F.max(F.when(since, F.col("chars"))).alias("max_chars_since"))


def journal_sink(rows: DataFrame, store: Store, checkpoint: str, flush_ms: int = 300, most: int = 400) -> StreamingQuery:
    """Write journal rows to a store, gathered for ``flush_ms``; what a stopped writer had not flushed is in the source still."""
    return rows.writeStream.foreachBatch(lambda batch, _: append_journal(store, batch, most)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{flush_ms} milliseconds").start()


class _InOrder(StatefulProcessor):
    """Typed state of a key: what ``step`` carries from row to row, and the rows that wait for the watermark.

    With ``hold`` a row waits until the watermark has reached its time, so rows that come late but within the lateness are
    stepped in the order of (ts, seq); an event-time timer at the earliest waiting row releases those that are due. Without it the
    rows of one micro-batch are put in order, and a row of a later batch counts after all earlier ones.
    """

    #: Columns carried for each row, the state's schema and its first value, and what leaves.
    columns: tuple[str, ...] = ()
    state = ""
    first: tuple = ()
    out = Row()

    def __init__(self, schema: StructType, hold: bool):
        self.schema, self.hold = schema, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state)
        self.waiting = handle.getListState("waiting", self.schema) if self.hold else None

    def step(self, state: tuple, row: Row) -> tuple[tuple, tuple | None]:
        """(next state, what the row gives)"""
        raise NotImplementedError

    def answer(self, key: tuple, given: list[tuple], state: tuple) -> Iterator[Row]:
        """The rows that leave for a key once ``given`` has been stepped."""
        return (self.out(*key, *g) for g in given)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        came = [Row(*(r[c] for c in self.columns)) for r in rows]
        if not self.hold:
            return self._stepped(key, came)
        self.waiting.appendList(came)
        self._wake(min(r[0] for r in came))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for r in self.waiting.get():
            (due if r[0] <= reached else later).append(Row(*r))
        if later:
            self.waiting.put(later)
            self._wake(min(r[0] for r in later))
        else:
            self.waiting.clear()
        return self._stepped(key, due) if due else iter(())

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def _stepped(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        state, given = (tuple(self.last.get()) if self.last.exists() else self.first), []
        for r in sorted(rows, key=lambda r: (r[0], r[1])):
            state, out = self.step(state, r)
            if out is not None:
                given.append(out)
        self.last.update(state)
        return self.answer(key, given, state)

    def close(self) -> None:
        pass


class _BlindWrites(_InOrder):
    columns, state, first = ("us", "seq", "tool"), "writes long, blind long, checked boolean", (0, 0, False)
    out = Row("key", "writes", "blind")

    def __init__(self, schema: StructType, hold: bool, write: str, check: str):
        super().__init__(schema, hold)
        self.write, self.check = write, check

    def step(self, state: tuple, row: Row) -> tuple[tuple, None]:
        writes, blind, checked = state
        if row[2] == self.write:
            return (writes + 1, blind + (not checked), False), None
        return (writes, blind, checked or row[2] == self.check), None

    def answer(self, key: tuple, given: list[tuple], state: tuple) -> Iterator[Row]:
        yield self.out(*key, state[0], state[1])


class _Repeats(_InOrder):
    columns, state, first = ("us", "seq", "signature", "chars"), "signature string, chars long, shown boolean", (None, 0, False)
    out = Row("key", "seq", "suppressed")

    def __init__(self, schema: StructType, hold: bool, least_chars: int):
        super().__init__(schema, hold)
        self.least_chars = least_chars

    def step(self, state: tuple, row: Row) -> tuple[tuple, tuple]:
        signature, chars, shown = state
        if shown and row[2] == signature and chars >= self.least_chars:
            return (signature, chars, False), (row[1], True)
        return (row[2], row[3], True), (row[1], False)


def _typed(rows: DataFrame, processor: partial, out: str, mode: str, lateness: str | None) -> DataFrame:
    """``rows`` (key, ts, us, ...) by key through a processor; ``ts`` carries the watermark."""
    schema = StructType([rows.schema[c] for c in processor.func.columns])
    made = processor(schema, lateness is not None)
    timed = rows.withWatermark("ts", lateness) if lateness else rows
    return timed.groupBy("key").transformWithState(made, out, mode, "EventTime" if lateness else "None")


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which typed state needs and large state wants; others are as before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def blind_write_stream(events: DataFrame, write: str, check: str, lateness: str | None = None) -> DataFrame:
    """(key, writes, blind) as they grow, from (key, ts, seq, tool): a write is blind without a check since the one before.

    With ``lateness`` rows count in the order of (ts, seq) once the watermark has reached them, and later ones are dropped; without
    it as they come. Start it within ``typed_state``.
    """
    kind = events.schema["key"].dataType.simpleString()
    rows = events.select("key", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("seq").cast("long").alias("seq"), "tool")
    return _typed(rows, partial(_BlindWrites, write=write, check=check), f"key {kind}, writes long, blind long", "update", lateness)


def repeat_stream(calls: DataFrame, least_chars: int = 800, lateness: str | None = None) -> DataFrame:
    """(key, seq, suppressed) from (key, seq, signature, chars): a long answer equal to the last one shown is suppressed once.

    ``lateness`` as in ``blind_write_stream``, which needs ``ts``; without it rows of a batch are in the order of ``seq``. Start it
    within ``typed_state``.
    """
    kind = calls.schema["key"].dataType.simpleString()
    us = F.unix_micros(F.col("ts").cast("timestamp")) if lateness else F.lit(0).cast("long")
    told = [us.alias("us"), F.col("seq").cast("long").alias("seq"), F.col("signature").cast("string").alias("signature"), F.col("chars").cast("long").alias("chars")]
    rows = calls.select("key", *(["ts"] if lateness else []), *told)
    return _typed(rows, partial(_Repeats, least_chars=least_chars), f"key {kind}, seq long, suppressed boolean", "append", lateness)


def watch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, debounce_ms: int = 400) -> StreamingQuery:
    """Hand each micro-batch of changed files to ``apply``; batches follow one another, so a refresh never overlaps the next."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=f"{debounce_ms} milliseconds").start()


def index_stream(changes: DataFrame, folder: str, checkpoint: str, buckets: int | None = None, debounce_ms: int | None = None) -> StreamingQuery:
    """Keep a saved index up with a stream of (path, mtime, text; null where a path is gone).

    A micro-batch replaces the buckets of its paths, in files and in words; one that comes again changes nothing. With
    ``debounce_ms`` changes are gathered for so long and the stream goes on, else all that is there is read.
    """
    from lodestone.operators import index

    def apply(batch: DataFrame, _: int) -> None:
        index.update(folder, batch, buckets or index.BUCKETS)

    if debounce_ms is not None:
        return watch(changes, apply, checkpoint, debounce_ms)
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
