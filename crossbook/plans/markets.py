"""More queries over the driver's tables: start times, names, directions, books, throttle, questions, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbook.operators import books, depth, report, resolution
from crossbook.plans.queries import table
from crossbook.sources import venues
from crossbook.streaming import throttle


def game_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    segment = F.concat(F.lit("26"), F.upper(F.date_format("o_orderdate", "MMMdd")), (10 + key % 13).cast("string"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit("HOU"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(venues.game_start(segment)).alias("us"))


def competitor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("p_partkey") % 3 == 0, F.substring_index("p_name", " ", 1)).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.col("p_type"))
    score = resolution.name_score(resolution.words(F.col("p_name")), resolution.words(other))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score * 100).cast("long").alias("score"))


def competition_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_type", F.concat(F.lit("Round "), (F.col("p_size") % 3).cast("string")), (1990 + F.col("p_size")).cast("string"))
    a = part.select(F.col("p_partkey").alias("k"), resolution.competition_tokens(text).alias("ta"))
    b = part.select((F.col("p_partkey") - 1).alias("k"), resolution.competition_tokens(text).alias("tb"))
    score = resolution.competition_score(F.col("ta"), F.col("tb"))
    return a.join(b, "k").select("k", F.floor(score * 1_000_000 + 0.5).cast("long").alias("score"))


def best_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = F.col("l_linenumber") % 2 == 1
    price = F.when(yes, 4600 + F.round(F.col("l_discount") * 10000)).otherwise(4500 + F.round(F.col("l_tax") * 10000))
    book = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.when(F.col("l_partkey") % 2 == 0, "a").otherwise("b").alias("leg"), F.when(yes, "YES").otherwise("NO").alias("side"),
        price.cast("long").alias("price"), F.col("l_quantity").alias("size"),
    )
    return depth.evaluate(book).select("key", F.col("direction").cast("long").alias("direction"), "size", F.round(F.col("raw_top") * 10000).cast("long").alias("edge"))


def book_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, none = table(spark, sf_dir, "events"), F.lit(None)
    messages = e.select(
        (F.col("user_id") % 50).cast("string").alias("conn"), F.col("event_id").alias("ord"), none.cast("long").alias("seq"), F.lit("delta").alias("type"), F.lit("t").alias("ticker"),
        none.cast("array<array<string>>").alias("yes"), none.cast("array<array<string>>").alias("no"), F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no").alias("side"),
        (F.col("event_id") % 5).cast("string").alias("price"), (F.col("event_id") % 7 - 3).cast("string").alias("delta"),
    )
    return books.level_states(messages).select("conn", "ord", "side", "price", F.col("size").cast("long").alias("size"))


def throttle_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").cast("string").alias("a_id"), F.lit("b").alias("b_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).cast("long").alias("size"), (F.col("event_id") % 4).alias("edge"),
        F.when(F.col("event_id") % 5 < 3, "structured").otherwise("lexical").alias("method"),
    )
    return throttle.logged(rows).drop("n")


def lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("question"), F.array("p_name").alias("aliases"),
        F.lit("2026-01-01").cast("timestamp").alias("resolution"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("futures"),
        F.col("p_partkey").alias("ord"),
    )
    return resolution.match_questions(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1"))


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, labels = table(spark, sf_dir, "events"), table(spark, sf_dir, "labels")
    x = F.floor(F.col("value") * 100).cast("long") % 1000
    log = e.select(
        F.col("user_id").cast("string").alias("a_id"), F.lit("b").alias("b_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (x - 300).alias("raw_top"), (x - 500).alias("raw_depth"), (x - 800).alias("net"), (F.col("event_id") % 90).alias("yes_fee"),
        (F.col("event_id") % 70).alias("no_fee"), (F.col("event_id") % 1001).alias("size"), F.lit("q").alias("question"),
        F.lit(None).cast("boolean").alias("resolution_match"),
    )
    return log, labels.select(F.col("doc_id").cast("string").alias("a_id"), F.lit("b").alias("b_id"), (F.col("quality") == 1).alias("resolution_match"), F.col("doc_id").alias("ord"))


def backtest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, matches = _log(spark, sf_dir)
    kept = "samples candidates pairs tracked windows single_sample avg_raw_top avg_raw_depth avg_net break_even".split()
    return report.report(log, matches, matches).select(*[F.col(c).cast("long").alias(c) for c in kept])


QUERIES = {f.__name__: f for f in (game_start, competitor_score, competition_score, best_direction, book_replay, throttle_heartbeat, lexical_match, backtest_report)}

_FEE = "(({c} * {p} * (10000 - {p})) // 1000000 + CASE WHEN 2 * (({c} * {p} * (10000 - {p})) % 1000000) > 1000000 OR (2 * (({c} * {p} * (10000 - {p})) % 1000000) = 1000000 AND (({c} * {p} * (10000 - {p})) // 1000000) % 2 = 1) THEN 1 ELSE 0 END)"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) > 1))"
_YES_FEE, _NO_FEE = (f"CASE WHEN direction = 0 THEN {_FEE.format(c=x, p=p)} ELSE {_FEE.format(c=y, p=p)} END" for x, y, p in ((7, 5, "py"), (5, 7, "pn")))
_FILLER = str(tuple(resolution.COMPETITION_FILLER))

ORACLE_SQL = {
    # row by row: the next row of a pair is logged or not by what was logged last
    "throttle_heartbeat": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS size, event_id % 4 AS edge, CASE WHEN event_id % 5 < 3 THEN 'structured' ELSE 'lexical' END AS method FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, edge, size) AS i FROM e),
w AS (SELECT *, size > 0 OR method = 'structured' AS taken, CASE WHEN size > 0 OR method = 'structured' THEN us END AS last_us, CASE WHEN size > 0 OR method = 'structured' THEN edge END AS last_edge FROM n WHERE i = 1
  UNION ALL SELECT user_id, us, size, edge, method, i, go, CASE WHEN go THEN us ELSE was_us END, CASE WHEN go THEN edge ELSE was_edge END
  FROM (SELECT n.*, w.last_us AS was_us, w.last_edge AS was_edge, (n.size > 0 OR (n.method = 'structured' AND (w.last_edge IS NULL OR n.edge <> w.last_edge))) AND (w.last_us IS NULL OR n.us - w.last_us >= 30000000) AS go FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1))
SELECT CAST(user_id AS VARCHAR) AS a_id, 'b' AS b_id, us, CAST(size AS BIGINT) AS size, CAST(edge AS BIGINT) AS edge, method FROM w WHERE taken""",
    # in 2026, summer time runs from March 8 to November 1
    "game_start": """WITH s AS (SELECT o_orderkey, try_strptime('2026' || strftime(o_orderdate, '%m%d') || CAST(10 + o_orderkey % 13 AS VARCHAR) || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0'), '%Y%m%d%H%M') AS t FROM orders)
SELECT o_orderkey, epoch_us(t) + CASE WHEN t >= TIMESTAMP '2026-03-08 02:00:00' AND t < TIMESTAMP '2026-11-01 02:00:00' THEN 4 ELSE 5 END * 3600000000 AS us FROM s""",
    "competitor_score": f"""WITH s AS (SELECT p_partkey, {_WORDS.format("p_name")} AS a, {_WORDS.format("CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN upper(p_name) ELSE p_type END")} AS b FROM part)
SELECT p_partkey, CAST(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 WHEN list_sort(a) = list_sort(b) THEN 100 WHEN list_has_all(a, b) OR list_has_all(b, a) THEN 85 ELSE 0 END AS BIGINT) AS score FROM s""",
    "competition_score": f"""WITH w AS (SELECT p_partkey AS k, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS t, p_size % 3 AS r FROM part),
t AS (SELECT DISTINCT k, t, r FROM w WHERE (length(t) > 1 OR regexp_full_match(t, '[0-9]')) AND t NOT IN {_FILLER}),
n AS (SELECT k, r, list(t) AS v FROM t GROUP BY k, r)
SELECT a.k AS k, CAST(CASE WHEN a.r = b.r THEN floor(len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))) * 1000000 + 0.5) ELSE 0 END AS BIGINT) AS score FROM n a JOIN n b ON b.k = a.k + 1""",
    "best_direction": f"""WITH l AS (SELECT l_orderkey AS key, CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS leg, l_linenumber % 2 = 1 AS yes,
  CAST(CASE WHEN l_linenumber % 2 = 1 THEN 4600 + round(l_discount * 10000) ELSE 4500 + round(l_tax * 10000) END AS BIGINT) AS price, CAST(floor(l_quantity) AS BIGINT) AS units FROM lineitem),
d AS (SELECT *, CASE WHEN (leg = 'a') = yes THEN 0 ELSE 1 END AS direction FROM l),
u AS (SELECT key, direction, yes, price, row_number() OVER (PARTITION BY key, direction, yes ORDER BY price) AS n FROM (SELECT *, unnest(range(units)) FROM d)),
z AS (SELECT key, direction, y.n AS n, y.price AS py, o.price AS pn FROM u y JOIN u o USING (key, direction) WHERE y.yes AND NOT o.yes AND y.n = o.n AND y.n <= 1000),
c AS (SELECT key, direction, n, sum(py + pn + {_YES_FEE} + {_NO_FEE}) OVER (PARTITION BY key, direction ORDER BY n) AS cost FROM z),
v AS (SELECT key, direction, n, cost FROM c WHERE 10000 * n - cost > 100 * n QUALIFY row_number() OVER (PARTITION BY key, direction ORDER BY n DESC) = 1),
t AS (SELECT key, direction, min(price) FILTER (yes) AS py, min(price) FILTER (NOT yes) AS pn FROM d GROUP BY ALL HAVING count(*) FILTER (yes) > 0 AND count(*) FILTER (NOT yes) > 0),
e AS (SELECT key, direction, coalesce(n, 0) AS size, 10000 - py - pn AS edge, round(coalesce((10000 * n - cost) / n, 10000 - py - pn - {_YES_FEE} - {_NO_FEE}) * 10000) AS net FROM t LEFT JOIN v USING (key, direction)),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY net DESC, direction) = 1)
SELECT key, CAST(direction AS BIGINT) AS direction, CAST(size AS BIGINT) AS size, CAST(edge AS BIGINT) AS edge FROM b WHERE edge > 0""",
    "book_replay": """WITH e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS conn, event_id AS ord, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side, CAST(event_id % 5 AS VARCHAR) AS price, event_id % 7 - 3 AS delta FROM events),
s AS (SELECT *, sum(delta) OVER w AS total FROM e WINDOW w AS (PARTITION BY conn, side, price ORDER BY ord))
SELECT conn, ord, side, price, CAST(total - least(0, min(total) OVER (PARTITION BY conn, side, price ORDER BY ord)) AS BIGINT) AS size FROM s""",
    "backtest_report": """WITH l AS (SELECT user_id AS k, epoch_us(ts) AS us, CAST(floor(value * 100) AS BIGINT) % 1000 AS x, event_id % 90 + event_id % 70 AS fee, event_id % 1001 AS size FROM events),
m AS (SELECT doc_id AS k, bool_or(quality = 1) AS label FROM labels GROUP BY doc_id),
s AS (SELECT l.* FROM l JOIN m USING (k) WHERE label),
v AS (SELECT *, us - lag(us) OVER (PARTITION BY k ORDER BY us) AS gap FROM s WHERE x > 800 AND size > 0),
w AS (SELECT k, count(*) AS n FROM (SELECT k, sum(CASE WHEN gap <= 120000000 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY us) AS w FROM v) GROUP BY k, w)
SELECT (SELECT count(*) FROM l) AS samples, (SELECT count(*) FROM labels) AS candidates, (SELECT count(DISTINCT k) FROM s) AS pairs, (SELECT count(DISTINCT doc_id) FROM labels) AS tracked,
  (SELECT count(*) FROM w) AS windows, (SELECT count(*) FROM w WHERE n = 1) AS single_sample,
  (SELECT CAST(round_even(avg(x - 300), 0) AS BIGINT) FROM s WHERE x > 300) AS avg_raw_top, (SELECT CAST(round_even(avg(x - 500), 0) AS BIGINT) FROM s WHERE x > 500) AS avg_raw_depth,
  (SELECT CAST(round_even(avg(x - 800), 0) AS BIGINT) FROM v) AS avg_net, (SELECT CAST(coalesce(round_even(avg(fee), 0), 0) + 100 AS BIGINT) FROM s) AS break_even""",
}
