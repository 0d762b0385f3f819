"""Which evaluations of a pair the log takes: viable ones, and changed ones of games, one in 30 seconds.

An evaluation row: a_id, b_id, us (event time), size, edge (ticks), method. The batch form reads a
sorted partition batch by batch and holds one pair's state; the stream form holds that state in Spark.

``logged_by_doubling`` gives the same for pairs whose history is too long for one task. What is logged after a row depends
on that row alone: the first one 30 seconds later or more that is viable, or a game's with another edge. So each row has one
successor, and the log is the path from the first row. A pair's history is cut into runs of some 100,000 rows. The path can
come into a run only at rows of its first 30 seconds or at the first ones after that; a task finds for each of these the row at
which a path from it leaves the run. Of such rows alone, the path from run to run is found by doubling: rows that are on the
path after k rounds lead to those that are on it 2^k runs on. Then each run is walked once from where the path comes in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from crossbook.operators.scratch import cut

HEARTBEAT_US = 30_000_000
SCHEMA = "a_id string, b_id string, us long, size long, edge long, method string"
PAIR = ["a_id", "b_id"]
_COLUMNS = ["a_id", "b_id", "us", "size", "edge", "method"]
_NONE = (None, None)


def _taken(rows: pd.DataFrame, last: tuple) -> tuple[list[bool], tuple]:
    """Whether each row (of one pair, in order) is logged, and the time and edge of the last that was."""
    keep = []
    for us, size, edge, method in zip(rows["us"], rows["size"], rows["edge"], rows["method"], strict=True):
        wanted = size > 0 or (method == "structured" and edge != last[1])
        due = last[0] is None or us - last[0] >= HEARTBEAT_US
        keep.append(bool(wanted and due))
        if wanted and due:
            last = (int(us), int(edge))
    return keep, last


def _over_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pair, last = None, _NONE
    for batch in batches:
        parts = []
        for key, rows in batch.groupby(PAIR, sort=False):
            if key != pair:
                first = rows.iloc[0]
                last = _NONE if pd.isna(first["last_us"]) else (int(first["last_us"]), int(first["last_edge"]))
            keep, last = _taken(rows, last)
            pair = key
            parts.append(rows[keep])
        if parts:
            yield pd.concat(parts)[[*_COLUMNS, "n"]]


def logged(evaluations: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The rows of a finished log, and their ``n`` (order among equals, 0 without one); a row without pair, time,
    size or edge isn't logged. ``before``: a_id, b_id, last_us, last_edge of pairs that were logged earlier."""
    ordered = evaluations if "n" in evaluations.columns else evaluations.withColumn("n", F.lit(0).cast("long"))
    rows = ordered.select(*_COLUMNS, "n").na.drop(subset=_COLUMNS[:5])
    if before is None:
        rows = rows.withColumns({"last_us": F.lit(None).cast("long"), "last_edge": F.lit(None).cast("long")})
    else:
        rows = rows.join(before, PAIR, "left")
    return rows.repartition(*PAIR).sortWithinPartitions(*PAIR, "us", "n", "edge", "size", "method").mapInPandas(_over_sorted, f"{SCHEMA}, n long")


HOUR_US = 3_600_000_000
#: Rows of a run, about; an hour with more of them is cut by time.
RUN_ROWS = 100_000
_ORDER = ["us", "n", "edge", "size", "method"]
_PLACE = "us: long, n: long, edge: long, size: long, method: string"
_ENTRIES = f"a_id string, b_id string, run long, part long, x struct<{_PLACE}>, leaves struct<{_PLACE}>"


def _place(*parts: Column) -> Column:
    """A place in a pair's order; a missing part is before all others."""
    return F.struct(*[(parts[i] if i < len(parts) else F.lit(None)).cast("string" if c == "method" else "long").alias(c) for i, c in enumerate(_ORDER)])


def _hour(place: str) -> Column:
    return F.struct("_k", F.floor(F.col(place)["us"] / HOUR_US).alias("hour"))


def _next(rows: DataFrame, probes: DataFrame, name: str) -> DataFrame:
    """The probes (_k, p, ...) with ``name``: the place and edge of the first of the rows (_k, x, edge) of their key after p.

    A task looks through an hour of a key; the first row of the hours after it is handed on by hour.
    """
    found = rows.select("_k", F.col("x").alias("p"), F.struct("x", "edge").alias("_row"))
    both = probes.withColumn("_row", F.lit(None).cast(found.schema["_row"].dataType)).unionByName(found, allowMissingColumns=True).withColumn("_at", _hour("p"))
    across = W.partitionBy("_k").orderBy(F.desc("_at.hour")).rowsBetween(W.unboundedPreceding, -1)
    handed = both.groupBy("_k", "_at").agg(F.min("_row").alias("_first")).select("_at", F.last("_first", True).over(across).alias("_later"))
    # From the last place to the first; a probe stands before a row of its own place, which isn't after it.
    back = W.partitionBy("_at").orderBy(F.desc("p"), F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = both.join(handed, "_at").withColumn(name, F.coalesce(F.last("_row", True).over(back), F.col("_later")))
    return met.filter("_row is null").select(*probes.columns, name)


def _changes(games: DataFrame) -> DataFrame:
    """Of a pair's rows those whose edge isn't that of the row before."""
    ends = games.withColumn("_at", _hour("x")).groupBy("_k", "_at").agg(F.max_by("edge", "x").alias("_end"))
    across = W.partitionBy("_k").orderBy("_at.hour")
    borders = ends.select("_at", F.lag("_end").over(across).alias("_border"))
    before = F.coalesce(F.lag("edge").over(W.partitionBy("_at").orderBy("x")), F.col("_border"))
    marked = games.withColumn("_at", _hour("x")).join(borders, "_at")
    return marked.withColumn("_new", F.coalesce(before != F.col("edge"), F.lit(True))).filter("_new").select("_k", "x", "edge")


def _successors(us: np.ndarray, edge: np.ndarray, viable: np.ndarray, game: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """What each of a run's rows (in order) is followed by, its length where by none of them, and where a path can come in."""
    n = len(us)
    at = np.arange(n)
    first = lambda which: np.append(np.minimum.accumulate(np.where(which, at, n)[::-1])[::-1], n)
    next_viable, next_game = first(viable), first(game)
    # A game's next row counts if its edge is another one; if not, the first row after it that has another edge does.
    games = np.flatnonzero(game)
    changes = np.flatnonzero(np.append(False, edge[games][1:] != edge[games][:-1])) if len(games) else games
    next_change = np.full(n + 1, n)
    next_change[games] = np.append(games[changes], n)[np.searchsorted(changes, np.arange(len(games)), "right")]
    after = np.searchsorted(us, us + HEARTBEAT_US, "left")
    met = next_game[after]
    other = np.where(np.append(edge, 0)[met] != edge, met, next_change[met])
    begun = int(np.searchsorted(us, us[0] + HEARTBEAT_US, "right"))
    later = {int(next_viable[begun]), int(next_game[begun]), int(next_change[next_game[begun]])}
    return np.minimum(next_viable[after], other), [*range(begun), *sorted(i for i in later if begun <= i < n)]


def _sorted(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[int]]:
    """A run's rows in order, with ``_successors``."""
    method = pd.factorize(rows["method"], sort=True)[0]  # null comes first
    rows = rows.iloc[np.lexsort((method, *(rows[c].to_numpy() for c in ("size", "edge", "n", "us"))))]
    return rows, *_successors(rows["us"].to_numpy(), rows["edge"].to_numpy(), rows["size"].to_numpy() > 0, (rows["method"] == "structured").to_numpy())


def _entries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Where a path can come into the run, and the row at which it then leaves."""
    rows, to, come = _sorted(rows)
    end = np.where(to < len(to), to, np.arange(len(to)))
    while (further := end[end]).tolist() != end.tolist():
        end = further
    places = lambda i: [dict(zip(_ORDER, r, strict=True)) for r in rows.iloc[i][_ORDER].astype(object).where(lambda x: x.notna(), None).itertuples(index=False)]
    out = pd.DataFrame({"x": places(come), "leaves": places(end[come])})
    return out.assign(a_id=key[0], b_id=key[1], run=key[2], part=key[3])[["a_id", "b_id", "run", "part", "x", "leaves"]]


def _walked(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The rows of a run that the path is on; it comes into a run once, if it does."""
    if rows.empty or entries.empty:
        return pd.DataFrame(columns=[*_COLUMNS, "n"])
    rows, to, _ = _sorted(rows)
    here = np.logical_and.reduce([(rows[c] == entries[c].iloc[0]).to_numpy() for c in _ORDER[:4]])
    method = entries["method"].iloc[0]
    here &= (rows["method"].isna() if pd.isna(method) else rows["method"] == method).to_numpy()
    on, i = [], int(np.flatnonzero(here)[0])
    while i < len(to):
        on.append(i)
        i = int(to[i])
    return rows.iloc[on][[*_COLUMNS, "n"]]


def _in_runs(rows: DataFrame, run_rows: int) -> DataFrame:
    """The rows with ``run`` and ``part``: hours of a pair together while they are few rows, or an hour in parts."""
    hour = F.floor(F.col("us") / HOUR_US)
    hours = rows.groupBy(*PAIR, hour.alias("hour")).agg(F.count("*").alias("many"))
    before = F.coalesce(F.sum("many").over(W.partitionBy(*PAIR).orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select(*PAIR, "hour", F.floor(before / run_rows).alias("run"), F.ceil(F.col("many") / run_rows).alias("parts"))
    part = F.floor((F.col("us") - F.col("hour") * HOUR_US) / HOUR_US * F.col("parts"))
    return rows.withColumn("hour", hour).join(hours, [*PAIR, "hour"]).withColumn("part", part).drop("hour", "parts")


def logged_by_doubling(evaluations: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """As ``logged`` of a finished log, for pairs of any length."""
    ordered = evaluations if "n" in evaluations.columns else evaluations.withColumn("n", F.lit(0).cast("long"))
    rows = ordered.select(*_COLUMNS, "n").na.drop(subset=_COLUMNS[:5])
    game = F.coalesce(F.col("method") == "structured", F.lit(False))
    # Of rows that differ in size alone only the first viable one and the first of a game can be next to any row.
    sizes = [F.min(F.when(F.col("size") > 0, F.col("size"))), F.min(F.when(game, F.col("size")))]
    rows = rows.filter((F.col("size") > 0) | game).groupBy(*PAIR, "us", "n", "edge", "method").agg(F.array_distinct(F.array_compact(F.array(*sizes))).alias("sizes"))
    rows = cut(rows.withColumn("size", F.explode("sizes")).drop("sizes"))
    runs = _in_runs(rows, run_rows)
    entries = cut(runs.groupBy(*PAIR, "run", "part").applyInPandas(_entries, _ENTRIES)).withColumn("_k", F.struct(*PAIR))
    rated = entries.select("_k", "x", "x.edge", "x.size", "x.method")
    viable, games = rated.filter("size > 0").select("_k", "x", "edge"), rated.filter("method = 'structured'").select("_k", "x", "edge")
    steps = entries.select("_k", F.col("leaves").alias("x")).distinct().select("_k", "x", "x.edge", _place(F.col("x.us") + HEARTBEAT_US).alias("p"))
    steps = _next(games, _next(viable, steps, "next_viable"), "next_game")
    # A game's next row counts if its edge is another one; if not, the first row after it that has another edge does.
    after = steps.withColumn("p", F.coalesce("next_game.x", "p"))
    steps = _next(_changes(games), after, "next_change")
    other = F.when(F.col("next_game.edge") != F.col("edge"), F.col("next_game.x")).otherwise(F.col("next_change.x"))
    steps = steps.select("_k", "x", F.least("next_viable.x", other).alias("enters"))
    steps = cut(steps.join(entries.select("_k", F.col("x").alias("enters"), F.col("leaves").alias("to")), ["_k", "enters"]))
    begin = entries.groupBy("_k").agg(F.min("x").alias("x"))
    path = cut(begin.join(entries, ["_k", "x"]).select("_k", F.col("leaves").alias("x")))
    jumps, many = steps.select("_k", "x", "to"), path.count()
    while True:
        path = cut(path.unionByName(path.join(jumps, ["_k", "x"]).select("_k", F.col("to").alias("x"))).distinct())
        before, many = many, path.count()
        if before == many:
            break
        jumps = cut(jumps.join(jumps.select("_k", F.col("x").alias("to"), F.col("to").alias("next")), ["_k", "to"]).select("_k", "x", F.col("next").alias("to")))
    met = begin.unionByName(steps.join(path, ["_k", "x"], "left_semi").select("_k", F.col("enters").alias("x")))
    met = entries.join(met, ["_k", "x"], "left_semi").select(*PAIR, "run", "part", "x.*")
    by = [*PAIR, "run", "part"]
    return runs.groupBy(*by).cogroup(met.groupBy(*by)).applyInPandas(_walked, f"{SCHEMA}, n long")


def _over_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = tuple(state.get) if state.exists else _NONE
    rows = pd.concat(list(batches)).sort_values(["us", "edge", "size", "method"], na_position="first")
    keep, last = _taken(rows, last)
    if last != _NONE:
        state.update(last)
    yield rows.loc[keep, _COLUMNS] if any(keep) else rows.head(0)[_COLUMNS]


def logged_stream(evaluations: DataFrame) -> DataFrame:
    """The same over a stream, ordered within each micro-batch; state per pair: two numbers."""
    rows = evaluations.select(*_COLUMNS).na.drop(subset=_COLUMNS[:5])
    return rows.groupBy(*PAIR).applyInPandasWithState(_over_state, SCHEMA, "us long, edge long", "append", GroupStateTimeout.NoTimeout)
