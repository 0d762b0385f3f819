"""Order-book depth: ladders, fill prices and the largest viable hedge.

A ladder is rows (key, side, price, size). Prices are ticks. No loop over units:
running sums make level intervals, the two legs' intervals overlap in segments of
constant marginal cost, and in a segment the largest viable size is one division.
All of it is one deal of the ladder by key and one pass over each key's levels.

Nulls and ties: rows with a null key are a book like any other; a level without
price, side or size isn't there; levels of one price are one, repeated rows add up;
an empty ladder gives an empty result. A key's whole book is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crossbook.functions.economics import BUFFER, CAP, fee_coefficient, fee_ticks

#: What a hedge of n contracts costs: prices and fees of both legs.
TOTALS = ("py", "pn", "fy", "fn")
#: Levels that one task takes, about: the sorts of ``hedges`` need some 600 bytes for each.
TASK_ROWS = 250_000


def asks_from_bids(ladder: DataFrame) -> DataFrame:
    """Bids of one side become asks of the other at 1 - price."""
    other = F.when(F.col("side") == "YES", "NO").otherwise("YES")
    return ladder.select("key", other.alias("side"), (10000 - F.col("price")).alias("price"), "size")


def dealt(ladder: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """The ladder dealt by keys to as many tasks as its size asks for, so that one task's share stays the same.

    ``rows``: about how many levels it has; they are counted if it isn't given, which for a table's columns reads no data.
    """
    tasks = -(-(ladder.count() if rows is None else rows) // TASK_ROWS)
    # A number that is given isn't made smaller by adaptive execution, which goes by compressed bytes.
    return ladder.repartition(max(tasks, ladder.sparkSession.sparkContext.defaultParallelism), *keys) if tasks > 1 else ladder.repartition(*keys)


def average_fill(ladder: DataFrame, keys: list[str], shares: int) -> DataFrame:
    """The average price in ticks of a number of shares, cheapest levels first, fractions of a share included.

    Null for no shares and without enough depth.
    """
    levels = dealt(ladder, keys).groupBy(*keys, "price").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy(*keys).orderBy("price").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    taken = levels.withColumn("take", F.least("size", F.greatest(F.lit(float(shares)) - before, F.lit(0.0))))
    sums = taken.groupBy(*keys).agg(F.sum(F.col("take") * F.col("price")).alias("cost"), F.sum("size").alias("depth"))
    enough = (F.col("depth") >= shares) & F.lit(shares > 0)
    return sums.select(*keys, F.when(enough, F.col("cost") / max(shares, 1)).alias("average"))


def hedges(
    ladder: DataFrame, keys: list[str], yes_fee: Column, no_fee: Column, buffer: int = BUFFER, cap: int = CAP, deal: list[str] | None = None, rows: int | None = None,
) -> DataFrame:
    """Of each key: yes_best and no_best, the best prices of either side; size, the largest number of whole contracts whose average
    costs and fees clear the buffer, null without one; total_py, total_pn, total_fy, total_fn, its prices and fees.

    Sizes count up to ``cap``; fractions of each level are left out. ``deal``: the keys to deal by, if not all; ``rows`` as in ``dealt``.
    """
    priced = dealt(ladder, deal or keys, rows).filter("price is not null and side is not null and size is not null")
    levels = priced.groupBy(*keys, "side", "price").agg(F.sum(F.floor("size")).cast("long").alias("units"))
    side_order = W.partitionBy(*keys, "side").orderBy("price").rowsBetween(W.unboundedPreceding, 0)
    ends = levels.withColumn("hi", F.sum("units").over(side_order)).withColumn("whole", F.when(F.col("units") > 0, F.col("price")))
    # Every end of a level ends a segment; the level that covers it is the first of its side from there on.
    up, down = W.partitionBy(*keys).orderBy("hi", "side", "price"), W.partitionBy(*keys).orderBy(F.desc("hi"), F.desc("side"), F.desc("price"))
    covering = lambda side: F.last(F.when(F.col("side") == side, F.col("whole")), True).over(down.rowsBetween(W.unboundedPreceding, 0))
    cut = ends.withColumns({"py": covering("YES"), "pn": covering("NO"), "n0": F.lag("hi", 1, 0).over(up), "n1": F.least("hi", F.lit(cap).cast("long"))})
    there = F.col("py").isNotNull() & F.col("pn").isNotNull()
    fees = {"fy": F.when(there, fee_ticks(yes_fee, F.col("py"))), "fn": F.when(there, fee_ticks(no_fee, F.col("pn")))}
    cut = cut.withColumns(fees).withColumn("part", F.when(there & (F.col("n1") > F.col("n0")), F.col("n1") - F.col("n0")))
    so_far = up.rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumns({f"before_{c}": F.coalesce(F.sum(F.col(c) * F.col("part")).over(so_far), F.lit(0)) for c in TOTALS})
    m, c0 = sum((F.col(c) for c in TOTALS[1:]), F.col("py")), sum((F.col(f"before_{c}") for c in TOTALS[1:]), F.col("before_py"))
    # At n contracts of the segment, slope * n - least is what is left over the buffer.
    slope, least = 10000 - buffer - m, c0 - m * F.col("n0")
    falling = F.least("n1", F.floor((-least - 1) / F.greatest(-slope, F.lit(1))).cast("long"))
    size = F.when(slope < 0, F.when(least < 0, falling)).when(slope * F.col("n1") > least, F.col("n1"))
    sized = cut.withColumn("n1_viable", F.when(F.col("part").isNotNull() & (size > F.col("n0")), size))
    totals = F.struct(*[(F.col(f"before_{c}") + F.col(c) * (F.col("n1_viable") - F.col("n0"))).alias(f"total_{c}") for c in TOTALS])
    best = lambda side: F.min(F.when(F.col("side") == side, F.col("price")))
    found = sized.groupBy(*keys).agg(best("YES").alias("yes_best"), best("NO").alias("no_best"), F.max("n1_viable").alias("size"), F.max_by(totals, "n1_viable").alias("at"))
    return found.select(*keys, "yes_best", "no_best", "size", "at.*")


def largest_viable(ladder: DataFrame, keys: list[str], yes_fee: Column, no_fee: Column, buffer: int = BUFFER, cap: int = CAP) -> DataFrame:
    """keys, size and the legs' total prices and fees at the largest size that clears the buffer; no row without one."""
    return hedges(ladder, keys, yes_fee, no_fee, buffer, cap).filter("size is not null").drop("yes_best", "no_best")


def _both_ways(ladder: DataFrame, keys: list[str], buffer: int, cap: int, fees: dict[str, int] | None = None, rows: int | None = None) -> DataFrame:
    """Hedges of both directions of each pair: direction 0 buys YES at a and NO at b, 1 the other way.

    A ladder with a_platform and b_platform, one value each for a key, has their fees; without them they are a and b.
    """
    turned = ladder.withColumn("direction", F.when((F.col("leg") == "a") == (F.col("side") == "YES"), 0).otherwise(1))
    straight = F.col("direction") == 0
    named = [c for c in ("a_platform", "b_platform") if c in ladder.columns]
    at_a, at_b = (fee_coefficient(F.col(c) if c in named else F.lit(c[0]), fees) for c in ("a_platform", "b_platform"))
    yes_fee, no_fee = F.when(straight, at_a).otherwise(at_b), F.when(straight, at_b).otherwise(at_a)
    found = hedges(turned, [*keys, *named, "direction"], yes_fee, no_fee, buffer, cap, deal=keys, rows=rows).filter("yes_best is not null and no_best is not null")
    # Without a viable size, one contract on top of the book.
    tops = {"py": F.col("yes_best"), "pn": F.col("no_best"), "fy": fee_ticks(yes_fee, F.col("yes_best")), "fn": fee_ticks(no_fee, F.col("no_best"))}
    totals = {f"total_{c}": F.coalesce(F.col(f"total_{c}"), tops[c]) for c in TOTALS}
    found = found.withColumns({**totals, "contracts": F.coalesce("size", F.lit(1)), "size": F.coalesce("size", F.lit(0))})
    each = [(F.col(f"total_{c}") / F.col("contracts") / 10000).alias(name) for name, c in zip(("yes_fill", "no_fill", "yes_fee", "no_fee"), TOTALS, strict=True)]
    exact = ["contracts", *totals]
    out = found.select(
        *keys, *named, "direction", "size", (F.col("yes_best") / 10000).alias("yes_top"), (F.col("no_best") / 10000).alias("no_top"), *each,
        ((10000 - F.col("yes_best") - F.col("no_best")) / 10000).alias("raw_top"), *exact,
    )
    return out.withColumn("raw_depth", 1 - F.col("yes_fill") - F.col("no_fill")).withColumn("net", F.col("raw_depth") - F.col("yes_fee") - F.col("no_fee"))


def detect(ladder: DataFrame, keys: list[str] | None = None, buffer: int = BUFFER, cap: int = CAP, fees: dict[str, int] | None = None, rows: int | None = None) -> DataFrame:
    """The viable directions of each pair, none to two: keys, direction, size, tops, fills, fees and spreads.

    ``fees``: coefficients by platform, of those that the ladder's a_platform and b_platform name; another one is an error.
    ``rows`` as in ``dealt``.
    """
    return _both_ways(ladder, keys or ["key"], buffer, cap, fees, rows).filter("size > 0")


def evaluate(
    ladder: DataFrame, buffer: int = BUFFER, cap: int = CAP, require_edge: bool = True, keys: list[str] | None = None, fees: dict[str, int] | None = None,
) -> DataFrame:
    """The better direction of each pair: key, direction, size, tops, fills, fees and spreads.

    ``ladder``: key, leg (a or b), side, price, size; pairs with a leg too old are left out before (``fresh``).
    A direction that no size clears is taken at one contract on top of the book, with size 0. Amounts are shares of
    1, as doubles, beside them ticks of all ``contracts`` (total_py, ...); of equal directions it is 0. With ``require_edge``, pairs whose better direction has no edge on top
    are left out. ``fees`` as in ``detect``.
    """
    keys = keys or ["key"]
    out = _both_ways(ladder, keys, buffer, cap, fees)
    # The order is by whole hundredths of ticks, so that sums of doubles don't decide between equals.
    rank = F.struct(F.round(F.col("net") * 1e8).cast("long").alias("net"), (-F.col("direction")).alias("direction"))
    kept = out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in out.columns if c not in keys]), rank).alias("x")).select(*keys, "x.*")
    return kept.filter("raw_top > 0") if require_edge else kept


def fresh(now_us: Column, a_us: Column, b_us: Column, max_seconds: float) -> Column:
    """Whether neither leg is older than the limit; exactly as old is fresh, and so is one from the future."""
    limit = int(max_seconds * 1_000_000)
    return F.coalesce((now_us - a_us <= limit) & (now_us - b_us <= limit), F.lit(False))


def top_edge(ya: Column, na: Column, yb: Column, nb: Column) -> Column:
    """The better of both directions' edges on top of the books, in ticks; null if neither has both sides."""
    return F.greatest(10000 - ya - nb, 10000 - yb - na)
