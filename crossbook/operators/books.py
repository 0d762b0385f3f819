"""Order books kept from a log of snapshots and deltas, without a loop over messages.

A message row: conn, ord (order within conn), seq, type (snapshot or delta), ticker, yes, no
(arrays of [price, size] strings), side, price (string), delta. Prices are keys as they are
written: "0.30" and "0.3" are two levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SIZE = "decimal(20,6)"
_LEVEL = ["conn", "epoch", "ticker", "snapshot", "side", "price"]


def epochs(messages: DataFrame, width: int = 65_536) -> DataFrame:
    """Messages of books with ``epoch``: a gap in a connection's numbers starts the next one, and its message is dropped.

    A task orders ``width`` places of a connection; only the buckets' last numbers and counts of gaps are ordered by
    connection. Messages without conn or ord are left out.
    """
    books = messages.filter(F.col("type").isin("snapshot", "delta") & F.col("conn").isNotNull() & F.col("ord").isNotNull())
    books = books.withColumn("bucket", F.floor(F.col("ord") / width))
    key, inside = ["conn", "bucket"], W.partitionBy("conn", "bucket").orderBy("ord")
    earlier = W.partitionBy("conn").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = books.groupBy(*key).agg(F.max_by("seq", F.when(F.col("seq").isNotNull(), F.col("ord"))).alias("end"))
    borders = ends.select(*key, F.last("end", True).over(earlier).alias("border"))
    before = F.coalesce(F.last("seq", True).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col("border"))
    marked = books.join(borders, key).withColumn("gap", F.coalesce(F.col("seq") != before + 1, F.lit(False)).cast("long"))
    counts = marked.groupBy(*key).agg(F.sum("gap").alias("gaps"))
    so_far = counts.select(*key, F.coalesce(F.sum("gaps").over(earlier), F.lit(0)).alias("passed"))
    epoch = F.col("passed") + F.sum("gap").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return marked.join(so_far, key).withColumn("epoch", epoch).filter("gap = 0").drop("gap", "bucket", "border", "passed")


def level_states(messages: DataFrame) -> DataFrame:
    """Size of a level after every message that touches it: conn, epoch, ticker, snapshot, side, price, ord, size.

    A snapshot (numbered within ticker and epoch, 0 before the first) replaces the book. A level
    never goes below zero, and what a delta takes beyond is forgotten: the size is the running sum
    less its lowest value so far, if that is negative. Deltas without price or of another side don't count.
    """
    order = W.partitionBy("conn", "epoch", "ticker").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = epochs(messages).withColumn("snapshot", F.sum((F.col("type") == "snapshot").cast("long")).over(order))
    empty = F.array().cast("array<array<string>>")
    levels = lambda c, side: F.transform(F.coalesce(c, empty), lambda x, i: F.struct(F.lit(side).alias("side"), x[0].alias("price"), x[1].cast(SIZE).alias("change"), i.alias("at")))
    whole = rows.filter("type = 'snapshot'").select("conn", "epoch", "ticker", "snapshot", "ord", F.explode(F.concat(levels(F.col("yes"), "yes"), levels(F.col("no"), "no"))).alias("x"))
    whole = whole.groupBy("conn", "epoch", "ticker", "snapshot", "ord", "x.side", "x.price").agg(F.max_by("x.change", "x.at").alias("change"))
    deltas = rows.filter((F.col("type") == "delta") & F.col("side").isin("yes", "no") & F.col("price").isNotNull())
    each = whole.unionByName(deltas.select(*_LEVEL, "ord", F.coalesce(F.col("delta").cast(SIZE), F.lit(0).cast(SIZE)).alias("change")))
    so_far = W.partitionBy(*_LEVEL).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    summed = each.withColumn("total", F.sum("change").over(so_far))
    size = F.col("total") - F.least(F.lit(0).cast(SIZE), F.min("total").over(so_far))
    return summed.select(*_LEVEL, "ord", size.cast("double").alias("size"))


def last_books(messages: DataFrame) -> DataFrame:
    """Levels of each ticker's newest book: conn, ticker, side, price, size; of the last epoch only.

    A level of size 0 is there if the newest snapshot gave it; one that a delta took to 0 isn't.
    """
    rows = epochs(messages).filter("ticker is not null")
    now = rows.groupBy("conn").agg(F.max("epoch").alias("epoch"))
    cleared = rows.filter("type = 'snapshot'").groupBy("conn", "epoch", "ticker").agg(F.max("ord").alias("cleared"))
    states = level_states(messages).filter("ticker is not null").join(now, ["conn", "epoch"]).join(cleared, ["conn", "epoch", "ticker"], "left")
    newest = states.filter("cleared is null or ord >= cleared").groupBy("conn", "ticker", "cleared", "side", "price").agg(F.max(F.struct("ord", "size")).alias("last"))
    return newest.filter("last.size > 0 or last.ord = cleared").select("conn", "ticker", "side", "price", F.col("last.size").alias("size"))
