"""The live path: at every update of a book, the pair's newest two books are evaluated and logged.

An update row: id, us, at (``us`` as a timestamp, with a watermark), yes_depth, no_depth (arrays of (price, size), asks,
cheapest first). ``venue_updates`` makes them of both venues' messages, so one query goes from messages to
log: numbers by connection, levels by ticker, newest legs by pair, then each micro-batch's evaluations, by the same
DataFrame code as in a batch. The log takes those that the throttle lets through, the table of latest records all.

A pair's state is the newest book of each leg. An update that is older than its leg's book is left out, one of the
same time replaces it; within a micro-batch updates of a pair are taken by time, then leg. Every update of a pair
whose two books are there and no older than the limit is evaluated. An update without id, time or known
candidate is left out; a pair without updates for ``idle`` of event time leaves the state. A batch that runs again
writes the same log folder and the same tables again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle, StreamingQueryListener

from crossbook.functions.economics import STALE_SECONDS
from crossbook.operators import depth, detector
from crossbook.sources import logs, venues
from crossbook.sources.upsert import UpsertTable
from crossbook.streaming import books as order_books
from crossbook.streaming import throttle
from crossbook.streaming.books import DELAY, IDLE_SECONDS, Expiring

PAIR = detector.PAIR
_BOOK = "struct<yes_depth:array<struct<price:double,size:double>>,no_depth:array<struct<price:double,size:double>>,updated_us:bigint>"
_MET = "a_id string, b_id string, n long, us long, question string, method string, resolution_match boolean, a string, b string"
_LAST = "a_id string, b_id string, last_us long, last_edge long"
#: Candidates that go to every executor, at most; more of them are dealt with the updates.
SENT_CANDIDATES = 1_000_000
_PART_ROWS = 20_000  # of what a pair's state gives in one go


class _Legs(Expiring):
    """A pair's newest two books."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.books = {leg: handle.getValueState(f"{leg}_book", "us long, book string") for leg in "ab"}
        self.met = handle.getValueState("met", "n long, us long")

    def due(self) -> int | None:
        met = self.met.get()
        return met and met[1] // 1000 + self.idle_ms

    def forget(self) -> None:
        for state in (*self.books.values(), self.met):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["us", "leg"], kind="stable")
        met, now = self.met.get(), {leg: state.get() for leg, state in self.books.items()}
        first, last = int(frame["us"].iloc[0]), int(frame["us"].iloc[-1])
        for leg, before in now.items():
            if before:
                frame = frame[(frame["leg"] != leg) | (frame["us"] >= before[0])]
        us, book, n = frame["us"].to_numpy(), frame["book"].to_numpy(dtype=object), met[0] if met else 0
        out = {**dict(zip(PAIR, key, strict=True)), "n": np.arange(n + 1, n + 1 + len(us)), **{c: frame[c].to_numpy() for c in ("us", "question", "method", "resolution_match")}}
        both = np.full(len(us), True)
        for leg, before in now.items():
            # The leg's newest update at each row: its place, or -1 for the book of before.
            at = np.maximum.accumulate(np.where((frame["leg"] == leg).to_numpy(), np.arange(len(us)), -1))
            both &= (at >= 0) | bool(before)
            out[leg] = np.append(book, np.array([before[1] if before else None], dtype=object))[at]
            if len(at) and at[-1] >= 0:
                self.books[leg].update((int(us[at[-1]]), book[at[-1]]))
        if not met:
            self.handle.registerTimer(first // 1000 + self.idle_ms)
        self.met.update((n + len(us), max(last, met[1] if met else 0)))
        table = pd.DataFrame(out, columns=[c.split(" ")[0] for c in _MET.split(", ")])[both]
        for i in range(0, max(len(table), 1), _PART_ROWS):
            yield table.iloc[i : i + _PART_ROWS]


def venue_updates(
    a_messages: DataFrame, b_messages: DataFrame, tickers: DataFrame | None = None, slugs: DataFrame | None = None, *,
    delay: str = DELAY, idle_seconds: int = IDLE_SECONDS,
) -> DataFrame:
    """Updates of both venues' message streams: snapshots and deltas of A, whole books (us, marketSlug, bids, offers) of B.

    ``tickers`` and ``slugs``: tables of the markets that are known; others are left out.
    """
    kept = order_books.book_stream(a_messages, tickers, delay=delay, idle_seconds=idle_seconds)
    a = venues.books_a(kept.withColumnsRenamed({"yes": "yes_dollars", "no": "no_dollars"}), keep=("us", "at"))
    b = order_books.timed(b_messages.filter("marketSlug is not null"), delay)
    if slugs is not None:
        b = b.join(F.broadcast(slugs.select(F.col("slug").alias("marketSlug")).distinct()), "marketSlug", "left_semi")
    columns = ("id", "us", "at", "yes_depth", "no_depth")
    return a.select(*columns).unionByName(venues.books_b(b, keep=("us", "at")).select(*columns))


def met(updates: DataFrame, candidates: DataFrame, *, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """A row for each update of a pair with both legs seen: the pair, us, and both newest books as JSON; for a stream.

    ``candidates`` is a static table. It counts the updates that meet one (``observe``: live.updates).
    """
    index = detector.index(candidates.select(*PAIR, F.col("a_question").alias("question"), "method", "resolution_match").dropDuplicates(PAIR))
    book = F.to_json(F.struct("yes_depth", "no_depth", F.col("us").alias("updated_us")))
    rows = updates.filter("id is not null and us is not null").select("id", "us", "at", book.alias("book"))
    few = candidates.limit(SENT_CANDIDATES + 1).count() <= SENT_CANDIDATES  # once, before the stream begins
    rows = rows.join(F.broadcast(index) if few else index, "id").observe("live", F.count(F.lit(1)).alias("updates"))
    return rows.groupBy(*PAIR).transformWithStateInPandas(_Legs(idle_seconds), _MET, "Append", "EventTime")


def evaluated(rows: DataFrame, max_seconds: float = STALE_SECONDS) -> DataFrame:
    """Evaluations of ``met`` rows that have no leg older than the limit at the time of the update."""
    # A number comes first, since texts that begin alike take long to compare.
    keys, rows = ["_key", *PAIR, "n"], rows.withColumn("_key", F.xxhash64(*PAIR, "n"))
    # As an array's element, the books are read once, not for the filter as well.
    books = F.array(F.struct(*[F.from_json(s, _BOOK).alias(f"{s}_book") for s in "ab"]))
    books = rows.select(*keys, "us", F.explode(books).alias("x")).select(*keys, "us", "x.*")
    books = books.filter(depth.fresh(F.col("us"), F.col("a_book.updated_us"), F.col("b_book.updated_us"), max_seconds))
    ladder = detector.levels(books, keys)
    out = depth.evaluate(ladder, require_edge=False, keys=keys)
    return out.join(rows.drop("a", "b"), keys).drop("_key")


def latest_table(spark: SparkSession, path: str) -> UpsertTable:
    """The table of each pair's latest record."""
    return UpsertTable(spark, path, logs.RECORD, PAIR)


class Counters(StreamingQueryListener):
    """Counts of all micro-batches so far: updates, samples (logged), windows (logged viable samples).

    They are metrics of the jobs that run anyway; none is run for them. Add it with ``spark.streams.addListener``
    for ``updates``; ``live_sinks`` adds the other two. ``tracked`` pairs are the rows of the latest table.
    """

    def __init__(self) -> None:
        self.counts = {"updates": 0, "samples": 0, "windows": 0}

    def add(self, counts: dict[str, int]) -> None:
        for name, n in counts.items():
            self.counts[name] += n or 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get("live")
        if found:
            self.add({"updates": found["updates"]})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def live_sinks(
    log: str, latest: str, last: str, names: tuple[str, str] = ("a", "b"), max_seconds: float = STALE_SECONDS, counters: Counters | None = None,
) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over ``met``: the log (a folder a batch), the table of latest records, and in ``last`` the
    table of when and at which edge each pair was logged. Both tables rewrite the buckets of the batch's pairs only."""

    def write(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()  # so that the stateful steps run once
        rows = evaluated(batch, max_seconds).withColumn("ts", F.timestamp_micros("us")).withColumn("edge", F.round(F.col("raw_top") * 10000).cast("long")).persist()
        ends = rows.groupBy(*PAIR).agg(F.max("us").alias("us")).persist()
        logged = UpsertTable(spark, last, _LAST, PAIR)
        taken = throttle.logged(rows, logged.touched(ends, number))
        seen = Observation()
        kept = rows.join(taken.select(*PAIR, "us", "n"), [*PAIR, "us", "n"], "left_semi")
        kept = kept.observe(seen, F.count(F.lit(1)).alias("samples"), F.count_if(F.col("size") > 0).alias("windows")).persist()
        logs.records(kept, names).write.mode("overwrite").json(f"{log}/batch={number}")
        # Only evaluations of a pair's last moment can be its latest record.
        few = ends.limit(SENT_CANDIDATES + 1).count() <= SENT_CANDIDATES
        newest = rows.join(F.broadcast(ends) if few else ends, [*PAIR, "us"], "left_semi")
        latest_table(spark, latest).merge(logs.records(newest, names), number, logs.latest_records)
        now = kept.groupBy(*PAIR).agg(F.max_by(F.struct(F.col("us").alias("last_us"), F.col("edge").alias("last_edge")), F.struct("us", "n")).alias("x")).select(*PAIR, "x.*")
        logged.merge(now, number, lambda both: both.groupBy(*PAIR).agg(F.max_by(F.struct("last_us", "last_edge"), "last_us").alias("x")).select(*PAIR, "x.*"))
        if counters:
            counters.add(seen.get)
        ends.unpersist(), rows.unpersist(), kept.unpersist(), batch.unpersist()

    return write
