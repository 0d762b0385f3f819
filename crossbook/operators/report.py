"""The report over a log of evaluations: funnel, spreads, sizes, windows of viability.

Matches have ``ord``, their order in the file. Null ids are a pair like any other, but join no
label; repeated log rows count; ties in time are in one window; an empty log gives a row of
zeros and nulls; columns of the log with names used here (label, session, window) are replaced. A log row: a_id, b_id, us, raw_top, raw_depth, net, yes_fee, no_fee (ticks), size, question, resolution_match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crossbook.functions.economics import BUFFER, GAP_SECONDS, divided
from crossbook.operators.replay import numbered_runs

PAIR = ["a_id", "b_id"]


def viable() -> Column:
    return (F.col("net") > 0) & (F.col("size") > 0)


def percent(n: Column, d: Column) -> Column:
    """100 n / d with one place, rounded half to even; 0 of nothing."""
    return F.when(d > 0, divided(1000 * n, F.greatest(d, F.lit(1))) / 10).otherwise(0.0)


def _mean(value: Column, only: Column) -> Column:
    n = F.count_if(only)
    return F.when(n > 0, divided(F.sum(F.when(only, value)), F.greatest(n, F.lit(1))))


def current_labels(matches: DataFrame) -> DataFrame:
    """a_id, b_id and ``label`` of each pair: of several, that with the largest ``ord`` (their order in the file), even if it is null."""
    return matches.groupBy(*PAIR).agg(F.max_by(F.struct("resolution_match"), "ord").alias("x")).select(*PAIR, F.col("x.resolution_match").alias("label"))


def labelled(log: DataFrame, matches: DataFrame) -> DataFrame:
    """The log with the matches' labels, even null ones, where a pair is among them; ``label`` is the matches' own,
    in place of a column of the log that has this name."""
    of_match = current_labels(matches).select(*PAIR, F.struct("label").alias("_of_match"))
    joined = log.drop("label", "_of_match").join(of_match, PAIR, "left")
    told = F.when(F.col("_of_match").isNotNull(), F.col("_of_match.label")).otherwise(F.col("resolution_match"))
    return joined.withColumns({"resolution_match": told, "label": F.col("_of_match.label")}).drop("_of_match")


def in_scope(log: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows of pairs labelled true, or all rows if no pair is labelled."""
    reviewed = current_labels(matches).agg((F.count("label") > 0).alias("_reviewed"))
    rows = labelled(log, matches).drop("_reviewed").crossJoin(F.broadcast(reviewed))  # one row
    return rows.filter("label or not _reviewed").drop("_reviewed")


def windows(scope: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Runs of a pair's viable rows without a gap above the limit."""
    rows = numbered_runs(scope.filter(viable()), PAIR, "us", gap_seconds * 1_000_000).withColumn("window", F.col("session"))
    return rows.groupBy(*PAIR, "window").agg(*_of_window())


def _of_window() -> list[Column]:
    seconds = F.round((F.max("us") - F.min("us")) / 1e6, 1)
    return [
        F.count("*").alias("samples"), seconds.alias("seconds"), F.max("net").alias("best_net"), F.max("size").alias("best_size"),
        F.min_by("question", "us").alias("question"), F.min_by("resolution_match", "us").alias("resolution_match"),
    ]


def window_stream(log: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """The same over a stream of log rows with ``at`` (``us`` as a timestamp, with a watermark), each when it is complete.

    A window is complete when the watermark has passed its last sample by the gap; a sample that is later than the
    watermark's delay is left out. The duration is from first to last sample, not to the window's end.
    """
    at = F.session_window("at", f"{gap_seconds} seconds")
    return log.filter(viable()).groupBy(*PAIR, at.alias("_window")).agg(*_of_window()).drop("_window")


def size_quarters(scope: DataFrame) -> DataFrame:
    """median, p25, p75 of viable sizes, quartiles by the exclusive method; from counts of each size, which the cap bounds."""
    counts = scope.filter(viable()).groupBy("size").agg(F.count("*").alias("k"))
    every = W.orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("hi", F.sum("k").over(every)).withColumn("n", F.sum("k").over(W.partitionBy()))
    at = lambda j: F.max(F.when((F.col("hi") >= j) & (F.col("hi") - F.col("k") < j), F.col("size")))

    def quarter(i: int) -> Column:
        j = F.least(F.greatest(F.floor((F.col("n") + 1) * i / 4), F.lit(1)), F.col("n") - 1)
        d = F.max(i * (F.col("n") + 1) - 4 * j)
        return F.when(F.max("n") >= 4, (at(j) * (4 - d) + at(j + 1) * d) / 4)

    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2
    return ranked.agg(middle.alias("size_median"), quarter(1).alias("size_p25"), quarter(3).alias("size_p75"))


def report(log: DataFrame, matches: DataFrame, tracked: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """The report's one row. ``tracked``: pairs that were watched, logged or not. Spreads are in ticks."""
    scope = in_scope(log, matches)
    one = F.lit(1)
    seen = log.agg(
        F.count("*").alias("samples"), F.coalesce(F.round((F.max("us") - F.min("us")) / 3.6e9, 2), F.lit(0.0)).alias("span_hours"),
        F.coalesce(F.max("us") - F.min("us"), F.lit(0)).alias("span_us"),
    )
    judged = matches.agg(F.count("*").alias("candidates"), F.count_if("resolution_match").alias("t"), F.count_if(~F.col("resolution_match")).alias("f"))
    n = F.col("candidates")
    judged = judged.select("candidates", percent(F.col("t"), n).alias("true_pct"), percent(F.col("f"), n).alias("diverged_pct"), percent(n - F.col("t") - F.col("f"), n).alias("unreviewed_pct"))
    pairs = scope.groupBy(*PAIR).agg(F.bool_or(F.col("raw_top") > 0).alias("a"), F.bool_or(F.col("raw_depth") > 0).alias("b"), F.bool_or(viable()).alias("c"))
    met = pairs.agg(F.count("*").alias("pairs"), *[F.count_if(k).alias(k) for k in "abc"])
    met = met.select("pairs", *[percent(F.col(k), F.col("pairs")).alias(f"{k}_pct") for k in "abc"], F.col("c").alias("viable_pairs"))
    watched = tracked.select(*PAIR).unionByName(scope.select(*PAIR)).distinct().agg(F.count("*").alias("tracked"))
    fees = F.col("yes_fee") + F.col("no_fee")
    means = scope.agg(
        _mean(F.col("raw_top"), F.col("raw_top") > 0).alias("avg_raw_top"), _mean(F.col("raw_depth"), F.col("raw_depth") > 0).alias("avg_raw_depth"),
        _mean(F.col("net"), viable()).alias("avg_net"), (F.coalesce(_mean(fees, fees.isNotNull()), F.lit(0)) + buffer).alias("break_even"),
    )
    runs = windows(scope).agg(F.count("*").alias("windows"), F.median("seconds").alias("median_seconds"), F.count_if(F.col("samples") == 1).alias("single_sample"))
    parts = [x.withColumn("_", one) for x in (seen, judged, met, watched, means, size_quarters(scope), runs)]
    row = parts[0]
    for part in parts[1:]:
        row = row.join(part, "_")  # one row each
    hours = F.col("span_us") / 3.6e9
    row = row.withColumn("ever_viable_pct", percent(F.col("viable_pairs"), F.col("tracked"))).withColumn("windows_per_hour", F.when(hours > 0, F.round(F.col("windows") / hours, 2)))
    return row.drop("_", "span_us", "viable_pairs")
