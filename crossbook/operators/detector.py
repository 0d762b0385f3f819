"""The batch detector: candidates, the books of both venues, and what the pairs are worth.

A candidate row: a_id, b_id, a_question, b_question, score, method. A book row: id, yes_depth, no_depth
(arrays of (price, size), asks, cheapest first), updated_us. Ids are ``venue:key``.

Candidates with a null id meet no book; repeated candidates are worked out one by one unless
a function says otherwise; ties go by ids; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbook.operators import depth

PAIR = ["a_id", "b_id"]


def by_score(candidates: DataFrame) -> DataFrame:
    """Candidates from the best score down; ties by ids."""
    return candidates.orderBy(F.desc("score"), *PAIR)


def top_candidates(candidates: DataFrame, n: int = 500) -> DataFrame:
    """The n best candidates."""
    return by_score(candidates).limit(n)


def by_method(candidates: DataFrame) -> DataFrame:
    """method and n, how many candidates have it."""
    return candidates.groupBy("method").agg(F.count("*").alias("n"))


def venue_of(market_id: Column) -> Column:
    return F.substring_index(market_id, ":", 1)


def key_of(market_id: Column) -> Column:
    """What stands after the venue; the key may have colons itself."""
    return F.when(F.instr(market_id, ":") > 0, F.regexp_replace(market_id, "^[^:]*:", ""))


def pair_key(b_id: Column, b_market_id: Column, a_id: Column) -> Column:
    """The pair of a record, whichever of two names has the second id."""
    return F.struct(a_id.alias("a_id"), F.coalesce(b_id, b_market_id).alias("b_id"))


def distinct_keys(candidates: DataFrame) -> DataFrame:
    """How many candidates, and how many different markets of either venue they have."""
    return candidates.agg(F.count("*").alias("candidates"), F.countDistinct(key_of(F.col("a_id"))).alias("a_keys"), F.countDistinct(key_of(F.col("b_id"))).alias("b_keys"))


def needed(markets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Markets that occur in a candidate."""
    ids = candidates.select(F.col("a_id").alias("id")).unionByName(candidates.select(F.col("b_id").alias("id"))).distinct()
    return markets.join(ids, "id", "left_semi")


def index(candidates: DataFrame) -> DataFrame:
    """id, leg and the candidate's columns: a row for each market of each candidate, so a market may have several."""
    legs = F.array(F.struct(F.col("a_id").alias("id"), F.lit("a").alias("leg")), F.struct(F.col("b_id").alias("id"), F.lit("b").alias("leg")))
    return candidates.select(F.explode(legs).alias("x"), *candidates.columns).select("x.*", *candidates.columns)


def both_venues(a: DataFrame, b: DataFrame) -> DataFrame:
    """All markets, with ``venue``."""
    return a.withColumn("venue", F.lit("a")).unionByName(b.withColumn("venue", F.lit("b")))


def identified(books: DataFrame, markets: DataFrame) -> DataFrame:
    """Books with the event and futures identity that their market had when it was listed; books of unknown markets go."""
    return books.join(markets.select("id", "event", "futures").dropDuplicates(["id"]), "id")


def first_books(messages: DataFrame) -> DataFrame:
    """The first message of each id: by us, then ord."""
    cols = [c for c in messages.columns if c != "id"]
    return messages.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("us", "ord")).alias("x")).select("id", "x.*")


def paired(candidates: DataFrame, a_books: DataFrame, b_books: DataFrame) -> DataFrame:
    """Candidates whose two books are there, with ``a_book`` and ``b_book``."""
    sides = [b.select(F.col("id").alias(f"{s}_id"), F.struct(*[c for c in b.columns if c != "id"]).alias(f"{s}_book")) for s, b in (("a", a_books), ("b", b_books))]
    return candidates.join(sides[0], "a_id").join(sides[1], "b_id")


def levels(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each level of both books: keys, leg, side, price (ticks), size."""

    def side(leg: str, name: str) -> Column:
        depth = F.coalesce(F.col(f"{leg}_book.{name.lower()}_depth"), F.array().cast("array<struct<price:double,size:double>>"))
        return F.transform(
            depth,
            lambda x: F.struct(F.lit(leg).alias("leg"), F.lit(name).alias("side"), F.round(x["price"] * 10000).cast("long").alias("price"), x["size"].cast("double").alias("size")),
        )

    each = [side(leg, name) for leg in "ab" for name in ("YES", "NO")]
    return pairs.select(*keys, F.explode(F.concat(*each)).alias("x")).select(*keys, "x.*")


def ladders(pairs: DataFrame) -> DataFrame:
    """Levels of the distinct pairs."""
    return levels(pairs.dropDuplicates(PAIR), PAIR)


def edges(pairs: DataFrame) -> DataFrame:
    """a_id, b_id and edge (ticks) on top of the books, of pairs that have one."""
    top = lambda leg, side: F.round(F.get(F.col(f"{leg}_book.{side}_depth"), F.lit(0))["price"] * 10000).cast("long")
    edge = depth.top_edge(top("a", "yes"), top("a", "no"), top("b", "yes"), top("b", "no"))
    return pairs.select(*PAIR, edge.alias("edge")).filter("edge is not null")


def edge_bucket(edge: Column) -> Column:
    return F.when(edge < 0, "<0").when(edge < 200, "0-2").when(edge < 500, "2-5").when(edge < 1000, "5-10").otherwise(">=10")


def histogram(found: DataFrame) -> DataFrame:
    """bucket and n of the edges."""
    return found.groupBy(edge_bucket(F.col("edge")).alias("bucket")).agg(F.count("*").alias("n"))


def extreme_edges(found: DataFrame, n: int = 8, above: int = 1000) -> DataFrame:
    """Of the n largest edges those above the limit; ties by ids."""
    return found.orderBy(F.desc("edge"), *PAIR).limit(n).filter(F.col("edge") > above)


def opportunities(
    pairs: DataFrame, now_us: int | None = None, max_seconds: float = 0.0, fees: dict[str, int] | None = None, rows: int | None = None,
) -> DataFrame:
    """The viable directions of each pair; with ``now_us``, of pairs with two books no older than ``max_seconds``.

    With ``fees``, a leg's fee is that of the venue in its id; one that isn't named is an error.
    ``rows``: about how many levels all books of the pairs have; without it they are counted, which joins the pairs twice.
    """
    if now_us is not None:
        pairs = pairs.filter(depth.fresh(F.lit(now_us), F.col("a_book.updated_us"), F.col("b_book.updated_us"), max_seconds))
    ladder = ladders(pairs)
    if fees is not None:
        ladder = ladder.withColumns({f"{s}_platform": venue_of(F.col(f"{s}_id")) for s in "ab"})
    return depth.detect(ladder, PAIR, fees=fees, rows=rows)


def best_opportunities(found: DataFrame, n: int = 12) -> DataFrame:
    """The better opportunity of each pair, the n best of them; ties by direction, then ids."""
    ticks = F.round(F.col("net") * 1e8).cast("long")
    best = found.groupBy(*PAIR).agg(F.max_by(F.struct(*[c for c in found.columns if c not in PAIR]), F.struct(ticks.alias("net"), (-F.col("direction")).alias("d"))).alias("x")).select(*PAIR, "x.*")
    return best.orderBy(ticks.desc(), *PAIR).limit(n)
