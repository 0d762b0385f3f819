"""Queries over the driver's tables, one for each operator, with equivalent SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbook.functions.economics import FEE_A, FEE_B, delta_days, fee_ticks
from crossbook.functions.text import NO_SUBJECT, STOPWORDS, is_entity, tokenize
from crossbook.operators import depth, detector, matching, replay


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; Python workers can import this package even if only the driver's path has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ask ladders from line items: odd line numbers are YES, even ones NO."""
    yes = F.col("l_linenumber") % 2 == 1
    price = F.when(yes, 4600 + F.round(F.col("l_discount") * 10000)).otherwise(4500 + F.round(F.col("l_tax") * 10000))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.when(yes, "YES").otherwise("NO").alias("side"), price.cast("long").alias("price"), F.col("l_quantity").alias("size"),
    )


V1 = """ladders AS (
  SELECT l_orderkey AS key, CASE WHEN l_linenumber % 2 = 1 THEN 'YES' ELSE 'NO' END AS side,
         CAST(CASE WHEN l_linenumber % 2 = 1 THEN 4600 + round(l_discount * 10000) ELSE 4500 + round(l_tax * 10000) END AS BIGINT) AS price, l_quantity AS size
  FROM lineitem)"""
FEE = "(({c} * {p} * (10000 - {p})) // 1000000 + CASE WHEN 2 * (({c} * {p} * (10000 - {p})) % 1000000) > 1000000 OR (2 * (({c} * {p} * (10000 - {p})) % 1000000) = 1000000 AND (({c} * {p} * (10000 - {p})) // 1000000) % 2 = 1) THEN 1 ELSE 0 END)"


def fee_curve(spark, sf_dir):
    p = F.col("price")
    return ladders(spark, sf_dir).select("price").distinct().select("price", fee_ticks(F.lit(FEE_A), p).alias("fee_a"), fee_ticks(F.lit(FEE_B), p).alias("fee_b"))


def bids_to_asks(spark, sf_dir):
    return depth.asks_from_bids(ladders(spark, sf_dir)).select("key", "side", "price", F.col("size").cast("long").alias("size"))


def fill_price(spark, sf_dir):
    """Average price of 10 shares, in hundredths of ticks, of books with quarters of shares."""
    book = ladders(spark, sf_dir).withColumn("size", F.col("size") / 4)
    return depth.average_fill(book, ["key", "side"], 10).select("key", "side", F.floor(F.col("average") * 100 + 0.5).cast("long").alias("average"))


def max_fillable(spark, sf_dir):
    return depth.largest_viable(ladders(spark, sf_dir), ["key"], F.lit(FEE_A), F.lit(FEE_B))


def edge_histogram(spark, sf_dir):
    top = ladders(spark, sf_dir).groupBy("key").agg(
        F.min(F.when(F.col("side") == "YES", F.col("price"))).alias("y"), F.min(F.when(F.col("side") == "NO", F.col("price"))).alias("n"),
    ).filter("y is not null and n is not null")
    return detector.histogram(top.select((10000 - F.col("y") - F.col("n")).alias("edge")))


def tokenize_df(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tokenize(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.countDistinct("item_id").alias("df"))


def jaccard_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return matching.jaccard_join(part.filter("id % 2 = 0"), part.filter("id % 2 = 1"), 75)


def entities(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(is_entity(F.col("p_name"))).select("p_partkey", "p_name")


def resolution_days(spark, sf_dir):
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    days = delta_days(F.col("o_orderdate"), F.col("l_shipdate"))
    return o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(days.alias("days")).agg(F.count("*").alias("n"))


def rank_or_refuse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("double").alias("score"),
        F.month("o_orderdate").cast("double").alias("hours"),
    )
    return matching.best_or_refuse(o, "key", F.col("score"), F.col("hours"), "id", 1.0).select("key", "id")


def tier_dedupe(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag").distinct()
    tiers = [i.filter(F.col("l_returnflag") == f).select("a", "b") for f in ("A", "N", "R")]
    return matching.tier_dedupe(tiers, ["a", "b"]).groupBy("tier").agg(F.count("*").alias("n"))


def _quotes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", "event_id", (F.col("event_id") % 2).alias("venue"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (3000 + F.floor(F.col("value") * 100).cast("long") % 4000).alias("ask"),
    )


SIX_HOURS = 6 * 3600 * 1_000_000
QUOTES = "quotes AS (SELECT user_id, event_id, event_id % 2 AS venue, epoch_us(ts) AS us, 3000 + CAST(floor(value * 100) AS BIGINT) % 4000 AS ask FROM events)"


def asof_pairs(spark, sf_dir):
    return replay.as_of(_quotes(spark, sf_dir), "user_id", "venue", "us", "event_id", "ask", SIX_HOURS)


def sessions(spark, sf_dir):
    return replay.sessions(_quotes(spark, sf_dir), "user_id", "us", SIX_HOURS, "ask", "event_id").drop("session")


def latest_per_pair(spark, sf_dir):
    return replay.latest(_quotes(spark, sf_dir), "user_id", ["us", "event_id"], ["ask"])


def funnel_abc(spark, sf_dir):
    return replay.funnel(_quotes(spark, sf_dir), "user_id", {"a": F.col("ask") > 6000, "b": F.col("ask") > 6900, "c": F.col("ask") > 6990})


def seq_gap(spark, sf_dir):
    return replay.sequence_gaps(_quotes(spark, sf_dir).withColumn("stream", F.col("user_id") % 2), "stream", "event_id").groupBy("stream").agg(F.count("*").alias("gaps"))


def size_quartiles(spark, sf_dir):
    return replay.exclusive_quartiles(_quotes(spark, sf_dir), "user_id", "ask")


def review_funnel(spark, sf_dir):
    d, r = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(r, "doc_id", "left").agg(F.count_if(F.col("quality") == 1).alias("matched"), F.count_if(F.col("quality") == 0).alias("rejected"), F.count_if(F.col("quality").isNull()).alias("open"))


QUERIES = {f.__name__: f for f in (
    fee_curve, bids_to_asks, fill_price, max_fillable, edge_histogram, tokenize_df, jaccard_join, entities, resolution_days, rank_or_refuse, tier_dedupe,
    asof_pairs, sessions, latest_per_pair, funnel_abc, seq_gap, size_quartiles, review_funnel,
)}

_LEVELS = """levels AS (SELECT key, side, price, CAST(sum(floor(size)) AS BIGINT) AS units FROM ladders GROUP BY ALL HAVING sum(floor(size)) > 0)"""
_NO_SUBJECT = "|".join(w.replace(" ", r"\s+") for w in NO_SUBJECT)
_STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"
_TOKENS = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)))"

ORACLE_SQL = {
    "fee_curve": f"WITH {V1} SELECT DISTINCT price, CAST({FEE.format(c=7, p='price')} AS BIGINT) AS fee_a, CAST({FEE.format(c=5, p='price')} AS BIGINT) AS fee_b FROM ladders",
    "bids_to_asks": f"WITH {V1} SELECT key, CASE WHEN side = 'YES' THEN 'NO' ELSE 'YES' END AS side, 10000 - price AS price, CAST(size AS BIGINT) AS size FROM ladders",
    # every quarter of a share is walked here, one row each; 40 of them are 10 shares
    "fill_price": f"""WITH {V1},
u AS (SELECT key, side, price, row_number() OVER (PARTITION BY key, side ORDER BY price) AS n FROM (SELECT key, side, price, unnest(range(CAST(size AS BIGINT))) FROM ladders))
SELECT key, side, CASE WHEN count(*) = 40 THEN CAST(floor(sum(price) / 40 * 100 + 0.5) AS BIGINT) END AS average FROM u WHERE n <= 40 GROUP BY key, side""",
    # every unit is walked here, one row each
    "max_fillable": f"""WITH {V1}, {_LEVELS},
u AS (SELECT key, side, price, row_number() OVER (PARTITION BY key, side ORDER BY price) AS n FROM (SELECT key, side, price, unnest(range(units)) FROM levels)),
z AS (SELECT y.key, y.n, y.price AS py, o.price AS pn, {FEE.format(c=7, p='y.price')} AS fy, {FEE.format(c=5, p='o.price')} AS fn
      FROM u y JOIN u o ON y.key = o.key AND y.n = o.n AND y.side = 'YES' AND o.side = 'NO' WHERE y.n <= 1000),
s AS (SELECT key, n, sum(py) OVER w AS total_py, sum(pn) OVER w AS total_pn, sum(fy) OVER w AS total_fy, sum(fn) OVER w AS total_fn FROM z WINDOW w AS (PARTITION BY key ORDER BY n))
SELECT key, CAST(n AS BIGINT) AS size, CAST(total_py AS BIGINT) AS total_py, CAST(total_pn AS BIGINT) AS total_pn, CAST(total_fy AS BIGINT) AS total_fy, CAST(total_fn AS BIGINT) AS total_fn
FROM s WHERE 10000 * n - total_py - total_pn - total_fy - total_fn > 100 * n QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""",
    "edge_histogram": f"""WITH {V1}, t AS (SELECT key, 10000 - min(price) FILTER (side = 'YES') - min(price) FILTER (side = 'NO') AS e FROM ladders GROUP BY key)
SELECT CASE WHEN e < 0 THEN '<0' WHEN e < 200 THEN '0-2' WHEN e < 500 THEN '2-5' WHEN e < 1000 THEN '5-10' ELSE '>=10' END AS bucket, count(*) AS n FROM t WHERE e IS NOT NULL GROUP BY 1""",
    "tokenize_df": f"SELECT token, count(DISTINCT item_id) AS df FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark) GROUP BY token",
    "jaccard_join": f"""WITH p AS (SELECT p_partkey AS id, {_TOKENS.format("concat_ws(' ', p_name, p_type)")} AS t FROM part),
tk AS (SELECT id, unnest(t) AS w FROM p), df AS (SELECT w FROM tk WHERE id % 2 = 1 GROUP BY w HAVING count(*) <= 2000),
c AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM tk a JOIN tk b USING (w) JOIN df USING (w) WHERE a.id % 2 = 0 AND b.id % 2 = 1),
s AS (SELECT a_id, b_id, len(list_intersect(x.t, y.t)) AS shared, len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)) AS total FROM c JOIN p x ON x.id = a_id JOIN p y ON y.id = b_id)
SELECT a_id, b_id, CAST(shared AS BIGINT) AS shared, CAST(total AS BIGINT) AS total FROM s WHERE shared * 100 >= total * 75""",
    "entities": rf"SELECT p_partkey, p_name FROM part WHERE trim(p_name) <> '' AND NOT regexp_matches(trim(p_name), '(?i)^\s*({_NO_SUBJECT}|[<>$]|\d|\+)') AND NOT contains(p_name, '%')",
    "resolution_days": "SELECT CAST(abs(floor((epoch_us(o_orderdate) - epoch_us(l_shipdate)) / 86400000000.0)) AS BIGINT) AS days, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "rank_or_refuse": """WITH s AS (SELECT o_custkey AS key, o_orderkey AS id, year(o_orderdate) AS y, month(o_orderdate) AS m, row_number() OVER w AS r, lead(year(o_orderdate)) OVER w AS y2, lead(month(o_orderdate)) OVER w AS m2
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, month(o_orderdate), o_orderkey))
SELECT key, id FROM s WHERE r = 1 AND NOT coalesce(y2 = y AND abs(m2 - m) <= 1, false)""",
    "tier_dedupe": """SELECT tier, count(*) AS n FROM (SELECT l_orderkey, l_suppkey, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS tier FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2) GROUP BY tier""",
    "asof_pairs": f"""WITH {QUOTES}, s AS (SELECT *, last_value(CASE WHEN venue = 0 THEN ask END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN venue = 1 THEN ask END IGNORE NULLS) OVER w AS b,
last_value(CASE WHEN venue = 0 THEN us END IGNORE NULLS) OVER w AS au, last_value(CASE WHEN venue = 1 THEN us END IGNORE NULLS) OVER w AS bu
FROM quotes WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, a, b FROM s WHERE us - au <= {SIX_HOURS} AND us - bu <= {SIX_HOURS}""",
    "sessions": f"""WITH {QUOTES}, g AS (SELECT *, coalesce(CAST(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > {SIX_HOURS} AS INT), 1) AS fresh FROM quotes),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS session FROM g)
SELECT user_id, count(*) AS samples, max(us) - min(us) AS span_us, max(ask) AS best_spread, max(event_id) AS best_size FROM n GROUP BY user_id, session""",
    "latest_per_pair": f"WITH {QUOTES} SELECT user_id, us, event_id, ask FROM quotes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) = 1",
    "funnel_abc": f"WITH {QUOTES} SELECT count(DISTINCT user_id) AS pairs, count(DISTINCT user_id) FILTER (ask > 6000) AS a, count(DISTINCT user_id) FILTER (ask > 6900) AS b, count(DISTINCT user_id) FILTER (ask > 6990) AS c FROM quotes",
    "seq_gap": f"WITH {QUOTES}, s AS (SELECT user_id % 2 AS stream, event_id - lag(event_id) OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS d FROM quotes) SELECT stream, count(*) AS gaps FROM s WHERE d <> 1 GROUP BY stream",
    "size_quartiles": f"""WITH {QUOTES}, s AS (SELECT user_id, list_sort(list(ask)) AS v, count(*) AS n FROM quotes GROUP BY user_id),
j AS (SELECT *, least(greatest((n + 1) // 4, 1), n - 1) AS j1, least(greatest(3 * (n + 1) // 4, 1), n - 1) AS j3 FROM s)
SELECT user_id, n, CASE WHEN n >= 4 THEN v[j1] * (4 - ((n + 1) - 4 * j1)) + v[j1 + 1] * ((n + 1) - 4 * j1) END AS q1_x4, CASE WHEN n >= 4 THEN v[j3] * (4 - (3 * (n + 1) - 4 * j3)) + v[j3 + 1] * (3 * (n + 1) - 4 * j3) END AS q3_x4 FROM j""",
    "review_funnel": "SELECT count(*) FILTER (quality = 1) AS matched, count(*) FILTER (quality = 0) AS rejected, count(*) FILTER (quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id)",
}
