"""Entity resolution between venues: blocking, ranking with refusal, tiers.

Null texts have no tokens and meet nothing; a null key is ranked as one key; of rows that
tie in everything the first by id stands, or none where a tie is refused; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crossbook.functions.text import jaccard_parts, tokenize


def jaccard_join(a: DataFrame, b: DataFrame, percent: int, max_df: int | None = 2000) -> DataFrame:
    """a_id, b_id, shared, total of the pairs whose token sets reach the similarity and share a token of at most ``max_df`` rows of b.

    Tokens are ordered from the rarest of b. Sets that reach the similarity share one of their first
    size - ceil(percent * size / 100) + 1 tokens, so only those meet, if the sizes allow it. The limit on
    frequent tokens is a rule of the matcher, not of the join: with ``max_df`` None nothing is left out.
    Rows without tokens or with a null id meet nothing; repeated rows give their pairs once.
    """
    sets = lambda rows, s: rows.select(F.col("id").alias(f"{s}_id"), tokenize(F.col("text")).alias("tokens")).filter(f"{s}_id is not null and size(tokens) > 0")
    left, right = sets(a, "a"), sets(b, "b")
    df = right.select("b_id", F.explode("tokens").alias("token")).distinct().groupBy("token").agg(F.count("*").alias("df"))

    def ordered(rows: DataFrame, s: str) -> DataFrame:
        each = rows.select(f"{s}_id", F.explode("tokens").alias("token")).join(df, "token", "left")
        ranked = each.groupBy(f"{s}_id").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("ranked"))
        n = F.size("ranked")
        return ranked.select(
            f"{s}_id", F.col("ranked.token").alias(f"{s}_tokens"), F.explode(F.slice("ranked", 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))).alias("x"),
        ).select(f"{s}_id", f"{s}_tokens", "x.*")

    first = [ordered(left, "a"), ordered(right, "b")]
    if max_df is not None:
        # The rarest token that a pair shares is among the first ones of both, so the pair has one below the limit if this one is.
        first = [x.filter(F.col("df") <= max_df) for x in first]
    met = first[0].join(first[1].drop("df"), "token")
    x, y = F.size("a_tokens"), F.size("b_tokens")
    met = met.filter(F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    both, total = jaccard_parts(F.col("a_tokens"), F.col("b_tokens"))
    close = met.filter(both * 100 >= total * percent)
    return close.select("a_id", "b_id", both.cast("long").alias("shared"), total.cast("long").alias("total")).dropDuplicates(["a_id", "b_id"])


def best_or_refuse(scored: DataFrame, key: str, score: Column, tie: Column, ident: str, near: float) -> DataFrame:
    """The best row of each key, none if the second best has the same score and a tie value within ``near``."""
    ranked = W.partitionBy(F.xxhash64(key), key).orderBy(score.desc(), tie.asc(), F.col(ident).asc())
    gap = lambda x: F.abs(F.lead(x).over(ranked) - x)
    unclear = F.coalesce((gap(score) <= 1e-9) & (gap(tie) <= near), F.lit(False))
    stands = (F.row_number().over(ranked) == 1) & ~unclear
    return scored.select(F.struct("*").alias("_row"), stands.alias("_stands")).filter("_stands").select("_row.*")


def tier_dedupe(tiers: list[DataFrame], pair: list[str]) -> DataFrame:
    """Union of the tiers; of a pair that several have, the row of the first."""
    both = tiers[0].withColumn("tier", F.lit(0))
    for k, t in enumerate(tiers[1:], 1):
        both = both.unionByName(t.withColumn("tier", F.lit(k)))
    first = F.row_number().over(W.partitionBy(*pair).orderBy("tier")) == 1
    return both.select(F.struct("*").alias("_row"), first.alias("_first")).filter("_first").select("_row.*")
