"""Replay of quote and opportunity logs: as-of pairs, sessions, latest rows, funnel.

Rows with a null key are a key like any other; rows with a null time or number come first in
their key and begin nothing that they could be compared with; rows equal in all that orders
them are repeated rows, each counted; empty tables give empty results (the funnel a row of zeros).

A key's history may be of any length: a task orders one bucket of a key (``width`` of time, or of
values), only what the buckets hand on is ordered by key, a row for each bucket. Columns of a caller's rows that
have names used here (``_bucket``, ``_new``, ``session``, ``before`` and the like) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


HOUR_US = 3_600_000_000


def bucketed(rows: DataFrame, keys: list[str], by: str, width: int) -> DataFrame:
    """The rows with ``_k``, their key, ``_bucket``, in which ``width`` of the column's values lie (null where it is), and ``_at``, both.

    They are structs, so that a null in them is equal to another one.
    """
    cut = rows.withColumns({"_k": F.struct(*[F.col(k) for k in keys]), "_bucket": F.floor(F.col(by) / width).cast("long")})
    return cut.withColumn("_at", F.struct("_k", "_bucket"))


def as_of(quotes: DataFrame, key: str, venue: str, ts: str, ident: str, value: str, max_gap_us: int, width_us: int | None = None) -> DataFrame:
    """At every quote, the latest of both venues' values, if neither is older than the gap. A quote without a value is
    only a time to look at.

    In buckets of time no narrower than the gap, a quote meets quotes of its own bucket and the one before it only.
    """
    plain = quotes.select(F.col(key).alias("_key"), F.col(ident).alias("_i"), F.col(ts).alias("_t"), F.col(venue).alias("_side"), F.col(value).alias("_v"))
    rows = bucketed(plain.filter("_t is not null"), ["_key"], "_t", max(width_us or HOUR_US, max_gap_us, 1))
    quote = F.struct(F.col("_v").alias("v"), F.col("_t").alias("t"))
    rows = rows.withColumns({f"_q{v}": F.when((F.col("_side") == v) & F.col("_v").isNotNull(), quote) for v in (0, 1)})
    last = [F.max_by(f"_q{v}", F.when(F.col(f"_q{v}").isNotNull(), F.struct("_t", "_i"))).alias(f"_p{v}") for v in (0, 1)]
    ends = rows.groupBy("_k", "_bucket").agg(*last).select(F.struct("_k", (F.col("_bucket") + 1).alias("_bucket")).alias("_at"), "_p0", "_p1")
    seen = W.partitionBy("_at").orderBy("_t", "_i").rowsBetween(W.unboundedPreceding, 0)
    met = rows.join(ends, "_at", "left").withColumns({f"_q{v}": F.coalesce(F.last(f"_q{v}", True).over(seen), F.col(f"_p{v}")) for v in (0, 1)})
    near = (F.col("_t") - F.col("_q0.t") <= max_gap_us) & (F.col("_t") - F.col("_q1.t") <= max_gap_us)
    return met.filter(near).select(F.col("_key").alias(key), F.col("_i").alias(ident), F.col("_q0.v").alias("a"), F.col("_q1.v").alias("b"))


def numbered_runs(samples: DataFrame, keys: list[str], us: str, gap_us: int, width_us: int = HOUR_US) -> DataFrame:
    """The samples with ``session``: runs of a key with no gap above ``gap_us``, numbered from 1; rows without time are a run."""
    rows = bucketed(samples, keys, us, width_us)
    across = W.partitionBy("_k").orderBy("_bucket")
    spans = rows.groupBy("_k", "_bucket", "_at").agg(F.max(us).alias("_end"))
    borders = spans.select("_at", F.lag("_end").over(across).alias("_border"))
    order = W.partitionBy("_at").orderBy(us)
    first = F.row_number().over(order) == 1
    before = F.when(first, F.col("_border")).otherwise(F.lag(us).over(order))
    fresh = F.when(F.col(us).isNull(), first).otherwise(F.coalesce(F.col(us) - before > gap_us, F.lit(True)))
    marked = rows.join(borders, "_at").withColumn("_new", fresh.cast("int"))
    counts = marked.groupBy("_k", "_bucket", "_at").agg(F.sum("_new").alias("_n"))
    passed = counts.select("_at", F.coalesce(F.sum("_n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_passed"))
    number = F.col("_passed") + F.sum("_new").over(order.rangeBetween(W.unboundedPreceding, 0))
    return marked.join(passed, "_at").withColumn("session", number).drop("_k", "_at", "_bucket", "_border", "_new", "_passed")


def sessions(samples: DataFrame, key: str, us: str, gap_us: int, spread: str, size: str, width_us: int = HOUR_US) -> DataFrame:
    """Runs of samples of a key with no gap above ``gap_us``."""
    numbered = numbered_runs(samples, [key], us, gap_us, width_us)
    return numbered.groupBy(key, "session").agg(F.count("*").alias("samples"), (F.max(us) - F.min(us)).alias("span_us"), F.max(spread).alias("best_spread"), F.max(size).alias("best_size"))


def latest(rows: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """The last row of each key."""
    top = F.max(F.struct(*order, *cols)).alias("_top")
    return rows.groupBy(key).agg(top).select(key, *[F.col(f"_top.{c}").alias(c) for c in [*order, *cols]])


def funnel(rows: DataFrame, key: str, stages: dict[str, Column]) -> DataFrame:
    """How many keys have a row that meets each condition."""
    met = rows.groupBy(key).agg(*[F.max(c.cast("int")).alias(k) for k, c in stages.items()])
    return met.agg(F.count("*").alias("pairs"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in stages])


def sequence_gaps(rows: DataFrame, key: str, seq: str, width: int = 65_536) -> DataFrame:
    """Rows whose sequence number isn't one more than the key's previous one.

    A task orders ``width`` numbers of a key; only these buckets' borders are ordered by key.
    """
    cut = rows.withColumn("_bucket", F.floor(F.col(seq) / width))
    order = W.partitionBy(key, "_bucket").orderBy(seq)
    last = cut.groupBy(key, "_bucket").agg(F.max(seq).alias("_last"))
    borders = last.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.lag("_last").over(W.partitionBy(key).orderBy("_bucket")).alias("_border"))
    inside = cut.withColumn("_first", F.row_number().over(order) == 1).withColumn("before", F.lag(seq).over(order)).filter(F.col("_first") | (F.col(seq) - F.col("before") != 1))
    met = inside.join(borders, F.col("_first") & F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_of")), "left")
    found = met.withColumn("before", F.when(F.col("_first"), F.col("_border")).otherwise(F.col("before")))
    return found.filter(F.col(seq) - F.col("before") != 1).select(*[c for c in rows.columns if c != "before"], "before")


def order_statistics(rows: DataFrame, key: str, value: str, ranks: Column, width: int = 1024) -> DataFrame:
    """key, n (its values) and ``found``, a map from rank to value, for the ranks (array, from 1, made from ``n``) of each key.

    Values are counted by bucket; a bucket's counts say which of them hold a rank, and only their values are looked at.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    counted = bucketed(counted, ["_key"], "_v", width)
    of_key = W.partitionBy("_k")
    bins = counted.groupBy("_k", "_bucket", "_at").agg(F.sum("_c").alias("_in"))
    bins = bins.withColumns({"_to": F.sum("_in").over(of_key.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("_in").over(of_key)})

    def among(upto: str, here: str):
        return lambda r: (r > F.col(upto) - F.col(here)) & (r <= F.col(upto))

    asked = bins.withColumn("_ranks", F.filter(ranks, among("_to", "_in"))).select("_at", (F.col("_to") - F.col("_in")).alias("_before"), "_ranks").filter("size(_ranks) > 0")
    upto = F.col("_before") + F.sum("_c").over(W.partitionBy("_at").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    placed = counted.join(asked, "_at").withColumn("_upto", upto)
    each = placed.select("_k", F.explode(F.filter("_ranks", among("_upto", "_c"))).alias("_rank"), "_v")
    found = each.groupBy("_k").agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("found"))
    sizes = bins.groupBy("_k").agg(F.max("n").alias("n"))
    return sizes.join(found, "_k", "left").select(F.col("_k._key").alias(key), "n", "found")


def exclusive_quartiles(rows: DataFrame, key: str, value: str, width: int = 1024) -> DataFrame:
    """n, and 4 * first and third quartile by the exclusive method, as integers; null below four values. Null values don't count."""
    at = lambda i: F.least(F.greatest(F.floor((F.col("n") + 1) * i / 4), F.lit(1)), F.col("n") - 1).cast("long")
    ranks = F.when(F.col("n") >= 4, F.array(at(1), at(1) + 1, at(3), at(3) + 1)).otherwise(F.array().cast("array<long>"))

    def quarter(i: int) -> Column:
        d = i * (F.col("n") + 1) - 4 * at(i)
        return F.when(F.col("n") >= 4, F.col("found")[at(i)] * (4 - d) + F.col("found")[at(i) + 1] * d)

    return order_statistics(rows, key, value, ranks, width).select(key, "n", quarter(1).alias("q1_x4"), quarter(3).alias("q3_x4"))
