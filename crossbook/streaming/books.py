"""Order books kept over a stream of snapshots and deltas, with state that Spark holds by level.

Messages are those of ``operators.books`` with ``us``, their time: conn, ord, us, seq, type, ticker, yes, no,
side, price, delta. Two stateful steps follow each other in one query:

1. By connection: its last number. A number that isn't one more than the last one begins an epoch and its
   message goes; what was known of the connection's books before an epoch is void.
2. By ticker: the size of each level (a map state) and the epoch they belong to. A snapshot puts all levels of
   the ticker anew, a delta adds to one; a level of 1e-9 or less after a delta goes, one of a snapshot stays.
   After a micro-batch only the levels that it has changed are written to the state.

Messages are taken by ``ord``. One whose ord isn't above the connection's last one has been seen and is left out, so
a message that comes again does nothing and one that comes in a later micro-batch than its successors makes a gap. Messages
without connection, ord or time, and other types than snapshots and deltas, are left out before the numbers are
checked; those without ticker, deltas of another side or without price and, with ``tickers``, other tickers, after it.
Messages later than the watermark's delay are left out by Spark, which their connection's numbers show as a gap.

A connection or ticker without messages for ``idle`` of event time leaves the state. The session needs the
RocksDB state store (``state_store``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEAST = 1e-9
#: A message's time may be so much before the latest one; a book without messages for so long is closed.
DELAY, IDLE_SECONDS = "10 minutes", 6 * 3600
_NUMBERED = "conn string, ord long, us long, at timestamp, ticker string, whole boolean, changes string, usable boolean, epoch long"
_BOOKS = "conn string, ticker string, ord long, us long, at timestamp, yes string, no string"


def state_store(spark: SparkSession) -> None:
    """Sets the state store that map states and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def timed(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """The rows that have a time ``us``, with ``at``, the same as a timestamp, which carries the watermark."""
    return rows.filter("us is not null").withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)


class Expiring(StatefulProcessor):
    """State of a key that goes when nothing has come for a while. A timer that comes too early is set again."""

    def __init__(self, idle_seconds: int):
        self.idle_ms = idle_seconds * 1000

    def due(self) -> int | None:
        """When the key's state is to go, in milliseconds; None if it has none."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = self.due()
        if due is not None and due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        elif due is not None:
            self.forget()
        return iter([])

    def close(self) -> None:
        pass


class _Numbers(Expiring):
    """The epochs of a connection."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "ord long, us long, seq long, epoch long")

    def due(self) -> int | None:
        seen = self.seen.get()
        return seen and seen[1] // 1000 + self.idle_ms

    def forget(self) -> None:
        self.seen.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("ord", kind="stable").drop_duplicates("ord")
        known = self.seen.get()
        if known:
            frame = frame[frame["ord"] > known[0]]
        if frame.empty:
            return
        _, us, last, epoch = known or (None, int(frame["us"].iloc[0]), None, 0)
        numbers = frame.loc[frame["numbered"], "seq"].to_numpy()
        gaps = np.zeros(len(frame), bool)
        if len(numbers):
            gaps[frame["numbered"].to_numpy()] = np.diff(numbers, prepend=numbers[0] - 1 if last is None else last) != 1
            last = int(numbers[-1])
        epochs = epoch + np.cumsum(gaps)
        if not known:
            self.handle.registerTimer(us // 1000 + self.idle_ms)
        self.seen.update((int(frame["ord"].iloc[-1]), max(us, int(frame["us"].max())), last, int(epochs[-1])))
        yield frame.assign(epoch=epochs)[~gaps & frame["usable"].to_numpy()][[c.split(" ")[0] for c in _NUMBERED.split(", ")]]


class _Levels(Expiring):
    """A ticker's book, a state entry for each level."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "side string, price string", "size double")
        self.head = handle.getValueState("head", "epoch long, us long")

    def due(self) -> int | None:
        head = self.head.get()
        return head and head[1] // 1000 + self.idle_ms

    def forget(self) -> None:
        self.head.clear()
        self.levels.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("ord", kind="stable")
        head = self.head.get()
        stored = {tuple(k): v[0] for k, v in self.levels.iterator()} if head else {}
        sizes, epoch, out = dict(stored), head and head[0], []
        for at, whole, changes in zip(frame["epoch"], frame["whole"], frame["changes"], strict=True):
            if whole or at != epoch:
                sizes, epoch = {}, int(at)
            for change in json.loads(changes):
                side, price, size = change["s"], change["p"], change.get("z", 0.0)
                total = size if whole else sizes.pop((side, price), 0.0) + size
                if whole or total > LEAST:
                    sizes[side, price] = total
            out.append([json.dumps([[p, str(z)] for (s, p), z in sorted(sizes.items()) if s == side]) for side in ("yes", "no")])
        self._write(stored, sizes)
        if not head:
            self.handle.registerTimer(int(frame["us"].iloc[0]) // 1000 + self.idle_ms)
        self.head.update((epoch, max(int(frame["us"].max()), head[1] if head else 0)))
        yield frame[["conn", "ticker", "ord", "us", "at"]].assign(yes=[y for y, _ in out], no=[n for _, n in out])

    def _write(self, stored: dict, sizes: dict) -> None:
        for level in stored.keys() - sizes.keys():
            self.levels.removeKey(level)
        for level, size in sizes.items():
            if stored.get(level) != size:
                self.levels.updateValue(level, (size,))


def _changes() -> Column:
    """The levels that a message puts or adds to, as JSON: side, price and size of each; null if it doesn't say."""
    empty = F.array().cast("array<array<string>>")
    level = lambda side: lambda x: F.struct(side.alias("s"), x[0].alias("p"), x[1].cast("double").alias("z"))
    put = F.concat(F.transform(F.coalesce("yes", empty), level(F.lit("yes"))), F.transform(F.coalesce("no", empty), level(F.lit("no"))))
    add = F.array(F.struct(F.col("side").alias("s"), F.col("price").alias("p"), F.coalesce(F.col("delta").cast("double"), F.lit(0.0)).alias("z")))
    one = F.col("side").isin("yes", "no") & F.col("price").isNotNull()
    return F.when(F.col("type") == "snapshot", F.to_json(put)).when(one, F.to_json(add))


def book_stream(messages: DataFrame, tickers: DataFrame | None = None, *, delay: str = DELAY, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """conn, ticker, ord, us, at, yes, no: the ticker's bids after each message that gives a book; for a stream.

    yes and no are arrays of [price, size] strings by price as it is written. ``tickers``: a table of those wanted.
    """
    rows = messages.filter(F.col("conn").isNotNull() & F.col("ord").isNotNull() & F.col("type").isin("snapshot", "delta"))
    rows = timed(rows.select(
        "conn", "ord", "us", "ticker", (F.col("type") == "snapshot").alias("whole"), _changes().alias("changes"),
        F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.col("seq").isNotNull().alias("numbered"),
    ), delay)
    rows = rows.withColumn("usable", F.col("ticker").isNotNull() & F.col("changes").isNotNull())
    numbered = rows.groupBy("conn").transformWithStateInPandas(_Numbers(idle_seconds), _NUMBERED, "Append", "EventTime", eventTimeColumnName="at")
    if tickers is not None:
        numbered = numbered.join(F.broadcast(tickers.select("ticker").distinct()), "ticker", "left_semi")
    books = numbered.groupBy("conn", "ticker").transformWithStateInPandas(_Levels(idle_seconds), _BOOKS, "Append", "EventTime", eventTimeColumnName="at")
    side = lambda c: F.from_json(c, "array<array<string>>").alias(c)
    return books.select("conn", "ticker", "ord", "us", "at", side("yes"), side("no"))
