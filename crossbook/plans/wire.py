"""Queries over wire rows, matchers, the batch detector and the log, made from the driver's tables, with SQL.

The SQL is written from what each operator is to give: units are walked one by one, states step by step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbook.operators import books, depth, detector, report, resolution
from crossbook.functions.text import SELECTORS
from crossbook.plans.markets import _FEE, _FILLER, _WORDS, _log
from crossbook.plans.queries import FEE, table
from crossbook.sources import logs, pages, venues


def _word(i: int):
    return F.split("p_name", " ")[i]


def _events_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    kind = k % 3
    ticker = F.when(
        kind == 0, F.concat(F.lit("KXNBAGAME-26JUL081845XY"), text, F.lit("-"), F.upper(_word(0))),
    ).when(kind == 1, F.concat(F.lit("KXOPEN-"), text, F.lit("-"), F.upper(_word(0)))).otherwise(F.concat(F.lit("KXMVE-"), text))
    market = F.struct(
        ticker.alias("ticker"), F.col("p_brand").alias("title"), F.when(k % 11 == 0, "Above 5").otherwise(_word(0)).alias("yes_sub_title"), F.col("p_type").alias("category"), F.when(
            k % 5 == 0, "2026-07-12T00:00:00Z",
        ).alias("close_time"),
        F.when(k % 5 == 0, "").when(
            k % 5 < 4, "2026-07-11T00:00:00Z",
        ).alias("expiration_time"), F.lit("0.40").alias("yes_bid_dollars"), F.when(k % 7 > 0, "0.45").alias("yes_ask_dollars"), F.lit("0.5").alias("no_bid_dollars"), F.lit("").alias("rules_primary"), F.lit("").alias("rules_secondary"),
    )
    title = F.when(kind == 0, F.concat(F.lit("Cup: "), _word(0), F.lit(" vs. "), _word(1), F.lit(" 2: Winner"))).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select(k.alias("ord"), title.alias("title"), F.array(market).alias("markets"))


def listing_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = venues.markets_a(_events_a(spark, sf_dir))
    return rows.select(
        "id", F.unix_micros("resolution").alias("until_us"), F.col("event.league").alias("league"), F.unix_micros("event.start_time").alias("start_us"),
        F.array_join("event.competitors", "/").alias("sides"), F.col("event.yes_abbrev").alias("abbrev"), F.col("futures.entity").alias("entity"),
        F.col("futures.competition").alias("competition"),
    )


def listing_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    team = lambda i: F.struct(_word(i).alias("name"), F.upper(_word(i)).alias("abbreviation"), F.when(k % 4 == 0, "T20X").otherwise("NBA").alias("league"))
    sides = F.array(*[F.struct(((k % 2) == i).alias("long"), F.lit("").alias("description"), team(i).alias("team")) for i in (0, 1)])
    rows = table(spark, sf_dir, "part").select(
        k.alias("ord"), F.when(k % 9 > 0, F.concat(F.lit("s"), text)).otherwise("").alias("slug"), _word(0).alias("title"), F.col("p_type").alias("question"),
        F.concat(
            F.lit('This market resolves to "Yes" if '), "p_name", F.lit(" wins, scheduled for July. More."),
        ).alias("description"), F.when(k % 3 == 0, "moneyline").when(k % 3 == 1, "futures").alias("marketType"),
        F.lit("2026-07-08T22:45:00Z").alias("gameStartTime"), F.lit("2026-07-22T00:00:00Z").alias("endDate"), F.lit("x").alias("category"), (k % 8 == 0).alias("closed"),
        F.when(k % 10 == 0, "no json").otherwise('["Yes","No"]').alias("outcomes"), F.lit("").alias("resolutionSource"), sides.alias("marketSides"),
    )
    out = venues.markets_b(rows)
    return out.select(
        "id", "question", F.array_join("aliases", "/").alias("aliases"), F.col("event.league").alias("league"), F.col("event.yes_competitor").alias("yes"),
        F.col("event.yes_abbrev").alias("abbrev"), F.col("futures.entity").alias("entity"), F.col("futures.competition").alias("competition"),
    )


def _two_places(x):
    return F.format_string("0.%02d", x.cast("int"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as levels: prices in whole hundredths as text, odd line numbers YES bids."""
    yes = F.col("l_linenumber") % 2 == 1
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), yes.alias("yes"),
        _two_places(F.when(yes, 40 + F.round(F.col("l_discount") * 100)).otherwise(45 + F.round(F.col("l_tax") * 100))).alias("price"),
        F.col("l_quantity").alias("size"),
    )


def book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.array("price", F.col("size").cast("string"))
    wire = _levels(spark, sf_dir).groupBy(F.col("key").cast("string").alias("ticker")).agg(
        F.collect_list(F.when(F.col("yes"), pair)).alias("yes_dollars"), F.collect_list(F.when(~F.col("yes"), pair)).alias("no_dollars"),
    )
    return _told(venues.books_a(wire))


def book_rows_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.struct(F.struct(F.col("price").alias("value"), F.lit("$").alias("currency")).alias("px"), F.col("size").cast("string").alias("qty"))
    wire = _levels(spark, sf_dir).groupBy(F.col("key").cast("string").alias("marketSlug")).agg(
        F.collect_list(F.when(F.col("yes"), level)).alias("bids"), F.collect_list(F.when(~F.col("yes"), level)).alias("offers"),
    )
    return _told(venues.books_b(wire))


def _told(rows: DataFrame) -> DataFrame:
    ticks = lambda c: F.round(c * 10000).cast("long")
    shown = lambda c: F.array_join(F.transform(c, lambda x: ticks(x["price"]).cast("string")), ",")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["size"]).cast("long")
    return rows.select(
        "id", shown(F.col("yes_depth")).alias("yes"), shown(F.col("no_depth")).alias("no"), total(F.col("yes_depth")).alias("yes_size"),
        total(F.col("no_depth")).alias("no_size"), ticks(F.col("yes_bid")).alias("yes_bid"), ticks(F.col("no_bid")).alias("no_bid"),
    )


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of venue A: a customer's orders are a run."""
    k = F.col("o_orderkey")
    market = "struct<ticker:string,title:string,yes_sub_title:string,category:string,close_time:string,expiration_time:string,yes_bid_dollars:string,yes_ask_dollars:string,no_bid_dollars:string,rules_primary:string,rules_secondary:string>"
    event = F.struct(k.cast("string").alias("title"), F.array().cast(f"array<{market}>").alias("markets"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("run"), F.expr("row_number() over (partition by o_custkey order by o_orderkey) - 1").cast("long").alias("page"),
        F.when(k % 6 == 0, "").otherwise((k % 3).cast("string")).alias("cursor"), F.when(
            k % 5 == 0, F.array().cast(f"array<struct<title:string,markets:array<{market}>>>"),
        ).otherwise(F.array(event)).alias("events"),
    )
    return pages.listing_a(rows, max_pages=7).select("run", "title")


def match_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A game for each order; venue B lists it swapped, with longer names, some hours later."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp")
    league = F.when(k % 2 == 0, "nba").otherwise("nfl")
    name = lambda s: F.concat(F.lit(s), k.cast("string"))
    game = lambda names, yes, at: F.struct(
        league.alias("league"), at.alias("start_time"), F.array(*names).alias("competitors"), yes.alias("yes_competitor"), F.lit("").alias("yes_abbrev"),
    )
    one, two = name("north"), name("south")
    a = orders.select(k, F.posexplode(F.array(one, two)).alias("at", "yes"), start.alias("start"), F.array(one, two).alias("names"), league.alias("league"))
    a = a.filter(~((k % 13 == 0) & (F.col("at") == 1))).select(
        F.concat(F.lit("a:G-"), k.cast("string"), F.lit("-"), F.col("at").cast("string")).alias("id"), F.col("yes").alias("question"), F.col("start").alias("resolution"),
        F.struct(
            "league", F.col("start").alias("start_time"), F.col("names").alias("competitors"), F.col("yes").alias("yes_competitor"),
            F.lit("").alias("yes_abbrev"),
        ).alias("event"), F.struct(k.alias("ord"), F.col("at").cast("long").alias("at")).alias("ord"),
    )
    later = F.timestamp_micros(F.unix_micros(start) + (k % 40) * 3_600_000_000)
    long_one, long_two = F.concat(one, F.lit(" stars")), F.concat(two, F.lit(" lights"))
    b = orders.select(
        F.concat(F.lit("b:"), k.cast("string")).alias("id"), F.lit("q").alias("question"), later.alias("resolution"),
        game((long_two, long_one), F.when(k % 3 == 0, long_one).otherwise(long_two), later).alias("event"),
        F.struct(k.alias("ord"), F.lit(0).cast("long").alias("at")).alias("ord"),
    )
    found = resolution.match_games(a, b)
    return found.select("a_id", "b_id", F.round(F.col("score") * 10000).cast("long").alias("score"), F.col("delta_days").cast("long").alias("delta_days"))


def match_outrights(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    side = lambda s, rest: part.filter(k % 2 == rest).select(
        F.concat(F.lit(f"{s}:"), k.cast("string")).alias("id"), F.lit("q").alias("question"),
        F.date_add(F.lit("2026-01-01"), F.col("p_size")).cast("timestamp").alias("resolution"),
        F.struct(F.col("p_name").alias("entity"), F.concat_ws(" ", "p_type", F.col("p_brand"), F.lit("2026")).alias("competition"), F.lit("").alias("entity_abbrev")).alias("futures"),
        k.alias("ord"),
    )
    found = resolution.match_outrights(side("a", 0), side("b", 1))
    return found.select("a_id", "b_id", F.round(F.col("score") * 10000).cast("long").alias("score"), F.col("delta_days").cast("long").alias("delta_days"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("a:"), k.cast("string")).alias("a_id"), F.concat(F.lit("b:x:"), (k + 3).cast("string")).alias("b_id"), F.lit("q").alias("a_question"),
        F.lit("p").alias("b_question"), ((k * 37 % 1000) / 1000).alias("score"),
        F.when(k % 3 == 0, "structured").when(k % 3 == 1, "futures").otherwise("lexical").alias("method"),
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = F.col("l_linenumber") % 2 == 1
    price = F.when(yes, 4600 + F.round(F.col("l_discount") * 10000)).otherwise(4500 + F.round(F.col("l_tax") * 10000)) / 10000
    level = F.struct(price.alias("price"), F.col("l_quantity").alias("size"))
    sides = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.when(yes, level))).alias("yes_depth"), F.array_sort(F.collect_list(F.when(~yes, level))).alias("no_depth"),
    )
    book = lambda rows, s: rows.select(F.concat(F.lit(s), F.col("l_orderkey").cast("string")).alias("id"), "yes_depth", "no_depth", F.lit(0).cast("long").alias("updated_us"))
    return detector.paired(_candidates(spark, sf_dir), book(sides, "a:"), book(sides, "b:x:"))


def _pair_levels(spark: SparkSession, sf_dir: str) -> int:
    """About how many levels the books of ``_pairs`` have: each order is in a pair at either venue."""
    return 2 * table(spark, sf_dir, "lineitem").count()


def detect_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.opportunities(_pairs(spark, sf_dir), rows=_pair_levels(spark, sf_dir)).select("a_id", "b_id", F.col("direction").cast("long").alias("direction"), "size", "total_py", "total_pn", "total_fy", "total_fn")


def best_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detector.best_opportunities(detector.opportunities(_pairs(spark, sf_dir), rows=_pair_levels(spark, sf_dir)))
    return found.select("a_id", "b_id", F.col("direction").cast("long").alias("direction"), "size")


def extreme_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.extreme_edges(detector.edges(_pairs(spark, sf_dir)), above=600)


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.top_candidates(_candidates(spark, sf_dir)).select("a_id", "b_id")


def candidates_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.by_method(_candidates(spark, sf_dir))


def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.distinct_keys(_candidates(spark, sf_dir))


def needed_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("b:x:"), F.col("p_partkey").cast("string")).alias("id"))
    return detector.needed(parts, _candidates(spark, sf_dir))


def market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.index(_candidates(spark, sf_dir)).groupBy("id", "leg").agg(F.count("*").alias("n"))


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the evaluations of each order's book against itself, in ticks."""
    yes = F.col("l_linenumber") % 2 == 1
    price = F.when(yes, 4600 + F.round(F.col("l_discount") * 10000)).otherwise(4500 + F.round(F.col("l_tax") * 10000))
    book = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.when(F.col("l_partkey") % 2 == 0, "a").otherwise("b").alias("leg"), F.when(yes, "YES").otherwise("NO").alias("side"),
        price.cast("long").alias("price"), F.col("l_quantity").alias("size"),
    )
    found = depth.evaluate(book).withColumns({
        "ts": F.timestamp_micros(F.col("key") * 500_000), "a_id": F.col("key").cast("string"), "b_id": F.lit("b"), "question": F.lit("q"), "method": F.lit("m"),
        "resolution_match": F.lit(None).cast("boolean"),
    })
    ticks = [F.round(F.col(c) * 10000).cast("long").alias(c) for c in ("yes_fill", "no_fill", "yes_fee", "no_fee", "raw_depth", "net")]
    return logs.records(found).select("a_id", "timestamp", "strategy", "size", *ticks)


def current_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    matches = d.select(
        (F.col("doc_id") % 300).cast("string").alias("a_id"), F.lit("b").alias("b_id"),
        F.when(F.col("doc_id") % 7 > 1, F.col("doc_id") % 2 == 0).alias("resolution_match"), F.col("doc_id").alias("ord"),
    )
    return report.current_labels(matches)


def top_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, matches = _log(spark, sf_dir)
    found = logs.top_windows(report.windows(report.in_scope(log, matches)).withColumn("best_net", F.col("best_net") * 1000 + F.col("a_id").cast("long") % 1000))
    return found.select("a_id", "samples", "best_net", "best_size")


def book_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with numbers and snapshots: each 29th message of a connection skips a number, each 23rd event is a snapshot."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    at = F.expr("row_number() over (partition by user_id % 20 order by event_id)")
    level = lambda p, n: F.array(F.lit(p), n.cast("string"))
    snapshot = k % 23 == 0
    messages = e.select(
        (F.col("user_id") % 20).cast("string").alias("conn"), k.alias("ord"), (at + F.floor(at / 29)).cast("long").alias("seq"), F.when(
            snapshot, "snapshot",
        ).otherwise("delta").alias("type"), (k % 2).cast("string").alias("ticker"),
        F.when(snapshot, F.array(level("0", k % 4 + 1), level("1", k % 6 + 1))).alias("yes"), F.lit(None).cast("array<array<string>>").alias("no"),
        F.when(k % 3 == 0, "no").otherwise("yes").alias("side"), (k % 3).cast("string").alias("price"), (k % 7 - 3).cast("string").alias("delta"),
    )
    return books.level_states(messages).select("conn", "epoch", "ticker", "side", "price", "ord", F.col("size").cast("long").alias("size"))


QUERIES = {f.__name__: f for f in (
    listing_a, listing_b, book_rows, book_rows_b, listing_pages, match_games, match_outrights, detect_pairs, best_opportunities, extreme_edges, top_candidates,
    candidates_by_method, distinct_keys, needed_markets, market_index, log_records, current_labels, top_windows, book_sessions,
)}

_CANDIDATES = """c AS (SELECT 'a:' || o_orderkey AS a_id, 'b:x:' || (o_orderkey + 3) AS b_id, o_orderkey AS a, o_orderkey + 3 AS b, (o_orderkey * 37 % 1000) AS score,
  CASE o_orderkey % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'futures' ELSE 'lexical' END AS method FROM orders)"""
_LINES = """l AS (SELECT l_orderkey AS k, l_linenumber % 2 = 1 AS yes, CAST(CASE WHEN l_linenumber % 2 = 1 THEN 4600 + round(l_discount * 10000) ELSE 4500 + round(l_tax * 10000) END AS BIGINT) AS price, CAST(floor(l_quantity) AS BIGINT) AS units FROM lineitem)"""
# every unit of both books is walked, for both directions
_WALKED = f"""{_CANDIDATES}, {_LINES},
u AS (SELECT k, yes, price, row_number() OVER (PARTITION BY k, yes ORDER BY price) AS n FROM (SELECT *, unnest(range(units)) FROM l)),
d AS (SELECT a_id, b_id, 0 AS direction, a AS y, b AS o FROM c UNION ALL SELECT a_id, b_id, 1, b, a FROM c),
yu AS MATERIALIZED (SELECT a_id, b_id, direction, n, price AS py FROM d JOIN u ON k = y AND yes WHERE n <= 1000),
ou AS MATERIALIZED (SELECT a_id, b_id, direction, n, price AS pn FROM d JOIN u ON k = o AND NOT yes WHERE n <= 1000),
z AS (SELECT * FROM yu JOIN ou USING (a_id, b_id, direction, n)),
f AS (SELECT *, CASE WHEN direction = 0 THEN {FEE.format(c=7, p="py")} ELSE {FEE.format(c=5, p="py")} END AS fy, CASE WHEN direction = 0 THEN {FEE.format(c=5, p="pn")} ELSE {FEE.format(c=7, p="pn")} END AS fn FROM z),
s AS (SELECT a_id, b_id, direction, n, sum(py) OVER w AS py, sum(pn) OVER w AS pn, sum(fy) OVER w AS fy, sum(fn) OVER w AS fn FROM f WINDOW w AS (PARTITION BY a_id, b_id, direction ORDER BY n)),
v AS (SELECT * FROM s WHERE 10000 * n - py - pn - fy - fn > 100 * n QUALIFY row_number() OVER (PARTITION BY a_id, b_id, direction ORDER BY n DESC) = 1)"""
_EVEN = "CAST(floor(({n}) / ({d})) + CASE WHEN 2 * (({n}) - floor(({n}) / ({d})) * ({d})) > ({d}) OR (2 * (({n}) - floor(({n}) / ({d})) * ({d})) = ({d}) AND floor(({n}) / ({d})) % 2 <> 0) THEN 1 ELSE 0 END AS BIGINT)"
_BOOK = """WITH l AS (SELECT l_orderkey AS k, l_linenumber % 2 = 1 AS yes, CASE WHEN l_linenumber % 2 = 1 THEN 40 + CAST(round(l_discount * 100) AS BIGINT) ELSE 45 + CAST(round(l_tax * 100) AS BIGINT) END AS p, l_quantity AS q FROM lineitem),
b AS (SELECT k, coalesce(list_sort(list(p * 100) FILTER (yes)), []) AS bids, coalesce(list_sort(list(p * 100) FILTER (NOT yes)), []) AS other, coalesce(sum(q) FILTER (yes), 0) AS nb, coalesce(sum(q) FILTER (NOT yes), 0) AS no FROM l GROUP BY k)
"""
_JOINED = "array_to_string({}, ',')"
_ASKS = "list_sort(list_transform({}, lambda x: 10000 - x))"

ORACLE_SQL = {
    "listing_a": """WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_partkey AS k FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 7 > 0 AND p_partkey % 5 < 4),
n AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'Above 5' ELSE w1 END AS yes FROM p)
SELECT 'a:' || CASE k % 3 WHEN 0 THEN 'KXNBAGAME-26JUL081845XY' ELSE 'KXOPEN-' END || k || '-' || upper(w1) AS id,
  epoch_us(CASE WHEN k % 5 = 0 THEN TIMESTAMP '2026-07-12' ELSE TIMESTAMP '2026-07-11' END) AS until_us,
  CASE WHEN k % 3 = 0 THEN 'nba' END AS league, CASE WHEN k % 3 = 0 THEN epoch_us(TIMESTAMP '2026-07-08 22:45:00') END AS start_us, CASE WHEN k % 3 = 0 THEN w1 || '/' || w2 END AS sides,
  CASE WHEN k % 3 = 0 THEN lower(w1) END AS abbrev, CASE WHEN k % 3 = 1 AND k % 11 > 0 THEN yes END AS entity, CASE WHEN k % 3 = 1 AND k % 11 > 0 THEN p_type END AS competition FROM n""",
    "listing_b": """WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_partkey AS k FROM part WHERE p_partkey % 9 > 0 AND p_partkey % 8 > 0 AND p_partkey % 10 > 0)
SELECT 'b:s' || k AS id, CASE WHEN k % 3 = 0 THEN 'Will ' || CASE WHEN k % 2 = 0 THEN w1 ELSE w2 END || ' win ' || w1 || ' vs. ' || w2 || '?' ELSE p_name || ' wins' END AS question, p_type AS aliases,
  CASE WHEN k % 3 = 0 THEN CASE WHEN k % 4 = 0 THEN 'cricket' ELSE 'nba' END END AS league, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN w1 ELSE w2 END END AS yes, CASE WHEN k % 3 = 0 THEN lower(CASE WHEN k % 2 = 0 THEN w1 ELSE w2 END) END AS abbrev,
  CASE WHEN k % 3 = 1 THEN w1 END AS entity, CASE WHEN k % 3 = 1 THEN p_type END AS competition FROM p""",
    "book_rows": _BOOK + f"""SELECT 'a:' || k AS id, {_JOINED.format(_ASKS.format("other"))} AS yes, {_JOINED.format(_ASKS.format("bids"))} AS no, CAST(no AS BIGINT) AS yes_size, CAST(nb AS BIGINT) AS no_size, list_max(bids) AS yes_bid, list_max(other) AS no_bid FROM b""",
    "book_rows_b": _BOOK + f"""SELECT 'b:' || k AS id, {_JOINED.format("other")} AS yes, {_JOINED.format(_ASKS.format("bids"))} AS no, CAST(no AS BIGINT) AS yes_size, CAST(nb AS BIGINT) AS no_size, list_max(bids) AS yes_bid, 10000 - list_min(other) AS no_bid FROM b""",
    "listing_pages": """WITH RECURSIVE p AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS cursor FROM orders),
walk AS (SELECT run, page, k, cursor, k % 5 = 0 OR cursor = '' AS ended FROM p WHERE page = 1
  UNION ALL SELECT p.run, p.page, p.k, p.cursor, p.k % 5 = 0 OR p.cursor = '' OR p.cursor = walk.cursor FROM walk JOIN p ON p.run = walk.run AND p.page = walk.page + 1 WHERE NOT walk.ended AND p.page <= 7)
SELECT CAST(run AS VARCHAR) AS run, CAST(k AS VARCHAR) AS title FROM walk WHERE k % 5 > 0""",
    # a name within a longer one scores 0.85; the member that pays on the team of b is missing for each 13th game
    "match_games": """SELECT 'a:G-' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '-0' ELSE '-1' END AS a_id, 'b:' || o_orderkey AS b_id, CAST(7225 AS BIGINT) AS score, CAST(ceil((o_orderkey % 40) / 24) AS BIGINT) AS delta_days
FROM orders WHERE o_orderkey % 40 <= 30 AND (o_orderkey % 3 = 0 OR o_orderkey % 13 > 0)""",
    "match_outrights": f"""WITH w AS (SELECT p_partkey AS k, unnest(regexp_extract_all(lower(p_type || ' ' || p_brand), '[a-z0-9]+')) AS t FROM part),
t AS (SELECT k, coalesce(list_sort(list(DISTINCT t) FILTER (regexp_full_match(t, '[0-9]+') OR t IN {tuple(SELECTORS)})), []) AS sel,
      coalesce(list(DISTINCT t) FILTER (NOT regexp_full_match(t, '[0-9]+') AND length(t) > 1 AND t NOT IN {tuple(SELECTORS)} AND t NOT IN {_FILLER}), []) AS word FROM w GROUP BY k),
n AS (SELECT p_partkey AS k, {_WORDS.format("p_name")} AS name, p_size AS day, sel, word FROM part JOIN t ON k = p_partkey),
m AS (SELECT a.k AS a, b.k AS b, abs(a.day - b.day) AS days, len(list_intersect(a.word, b.word)) AS i, len(list_distinct(list_concat(a.word, b.word))) AS u,
      CASE WHEN list_sort(a.name) = list_sort(b.name) THEN 100 WHEN list_has_all(a.name, b.name) OR list_has_all(b.name, a.name) THEN 85 ELSE 0 END AS e
      FROM n a JOIN n b ON a.sel = b.sel AND a.k % 2 = 0 AND b.k % 2 = 1 AND abs(a.day - b.day) <= 30),
g AS (SELECT *, e * i / (100.0 * u) AS score FROM m WHERE e >= 60 AND u > 0 AND i / u >= 0.65),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r, lead(score) OVER (PARTITION BY a ORDER BY score DESC, b) AS next FROM g)
SELECT 'a:' || a AS a_id, 'b:' || b AS b_id, CAST(round(score * 10000) AS BIGINT) AS score, CAST(days AS BIGINT) AS delta_days FROM r WHERE r = 1 AND NOT coalesce(abs(next - score) <= 1e-9, false)""",
    "detect_pairs": f"""WITH {_WALKED} SELECT a_id, b_id, CAST(direction AS BIGINT) AS direction, CAST(n AS BIGINT) AS size, CAST(py AS BIGINT) AS total_py, CAST(pn AS BIGINT) AS total_pn, CAST(fy AS BIGINT) AS total_fy, CAST(fn AS BIGINT) AS total_fn FROM v""",
    "best_opportunities": f"""WITH {_WALKED}, r AS (SELECT *, round((10000 * n - py - pn - fy - fn) / n * 10000) AS net FROM v),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY a_id, b_id ORDER BY net DESC, direction) = 1)
SELECT a_id, b_id, CAST(direction AS BIGINT) AS direction, CAST(n AS BIGINT) AS size FROM b ORDER BY net DESC, a_id, b_id LIMIT 12""",
    "extreme_edges": f"""WITH {_CANDIDATES}, {_LINES}, t AS (SELECT k, min(price) FILTER (yes) AS y, min(price) FILTER (NOT yes) AS n FROM l GROUP BY k),
e AS (SELECT a_id, b_id, greatest(10000 - x.y - z.n, 10000 - z.y - x.n) AS edge FROM c JOIN t x ON x.k = a JOIN t z ON z.k = b),
m AS (SELECT * FROM e WHERE edge IS NOT NULL ORDER BY edge DESC, a_id, b_id LIMIT 8) SELECT a_id, b_id, CAST(edge AS BIGINT) AS edge FROM m WHERE edge > 600""",
    "top_candidates": f"WITH {_CANDIDATES} SELECT a_id, b_id FROM c ORDER BY score DESC, a_id, b_id LIMIT 500",
    "candidates_by_method": f"WITH {_CANDIDATES} SELECT method, count(*) AS n FROM c GROUP BY method",
    "distinct_keys": "SELECT count(*) AS candidates, count(DISTINCT o_orderkey) AS a_keys, count(DISTINCT o_orderkey + 3) AS b_keys FROM orders",
    "needed_markets": "SELECT DISTINCT 'b:x:' || p_partkey AS id FROM part WHERE p_partkey IN (SELECT o_orderkey + 3 FROM orders)",
    "market_index": f"WITH {_CANDIDATES} SELECT a_id AS id, 'a' AS leg, count(*) AS n FROM c GROUP BY a_id UNION ALL SELECT b_id, 'b', count(*) FROM c GROUP BY b_id",
    "log_records": f"""WITH l AS (SELECT l_orderkey AS key, CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS leg, l_linenumber % 2 = 1 AS yes,
  CAST(CASE WHEN l_linenumber % 2 = 1 THEN 4600 + round(l_discount * 10000) ELSE 4500 + round(l_tax * 10000) END AS BIGINT) AS price, CAST(floor(l_quantity) AS BIGINT) AS units FROM lineitem),
d AS (SELECT *, CASE WHEN (leg = 'a') = yes THEN 0 ELSE 1 END AS direction FROM l),
u AS (SELECT key, direction, yes, price, row_number() OVER (PARTITION BY key, direction, yes ORDER BY price) AS n FROM (SELECT *, unnest(range(units)) FROM d)),
z AS (SELECT key, direction, y.n AS n, y.price AS py, o.price AS pn FROM u y JOIN u o USING (key, direction) WHERE y.yes AND NOT o.yes AND y.n = o.n AND y.n <= 1000),
f AS (SELECT *, CASE WHEN direction = 0 THEN {_FEE.format(c=7, p="py")} ELSE {_FEE.format(c=5, p="py")} END AS fy, CASE WHEN direction = 0 THEN {_FEE.format(c=5, p="pn")} ELSE {_FEE.format(c=7, p="pn")} END AS fn FROM z),
c AS (SELECT key, direction, n, sum(py) OVER w AS py, sum(pn) OVER w AS pn, sum(fy) OVER w AS fy, sum(fn) OVER w AS fn FROM f WINDOW w AS (PARTITION BY key, direction ORDER BY n)),
v AS (SELECT * FROM c WHERE 10000 * n - py - pn - fy - fn > 100 * n QUALIFY row_number() OVER (PARTITION BY key, direction ORDER BY n DESC) = 1),
t AS (SELECT key, direction, min(price) FILTER (yes) AS ty, min(price) FILTER (NOT yes) AS tn FROM d GROUP BY ALL HAVING count(*) FILTER (yes) > 0 AND count(*) FILTER (NOT yes) > 0),
g AS (SELECT t.*, {_FEE.format(c="CASE WHEN direction = 0 THEN 7 ELSE 5 END", p="ty")} AS tfy, {_FEE.format(c="CASE WHEN direction = 0 THEN 5 ELSE 7 END", p="tn")} AS tfn FROM t),
e AS (SELECT key, direction, ty, tn, coalesce(n, 0) AS size, CAST(coalesce(n, 1) AS BIGINT) AS n, CAST(coalesce(py, ty) AS BIGINT) AS py, CAST(coalesce(pn, tn) AS BIGINT) AS pn, CAST(coalesce(fy, tfy) AS BIGINT) AS fy, CAST(coalesce(fn, tfn) AS BIGINT) AS fn FROM g LEFT JOIN v USING (key, direction)),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY round((10000 * n - py - pn - fy - fn) / n * 10000) DESC, direction) = 1)
SELECT CAST(key AS VARCHAR) AS a_id, strftime(make_timestamp(CAST(key * 500000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN key % 2 = 1 THEN '.500000' ELSE '' END || '+00:00' AS timestamp,
  CASE WHEN direction = 0 THEN 'YES_A_NO_B' ELSE 'YES_B_NO_A' END AS strategy, CAST(size AS BIGINT) AS size, {_EVEN.format(n="py", d="n")} AS yes_fill, {_EVEN.format(n="pn", d="n")} AS no_fill, {_EVEN.format(n="fy", d="n")} AS yes_fee, {_EVEN.format(n="fn", d="n")} AS no_fee,
  {_EVEN.format(n="10000 * n - py - pn", d="n")} AS raw_depth, {_EVEN.format(n="10000 * n - py - pn - fy - fn", d="n")} AS net FROM b WHERE 10000 - ty - tn > 0""",
    "current_labels": "SELECT CAST(doc_id % 300 AS VARCHAR) AS a_id, 'b' AS b_id, CASE WHEN doc_id % 7 > 1 THEN doc_id % 2 = 0 END AS label FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id DESC) = 1",
    "top_windows": """WITH l AS (SELECT user_id AS k, epoch_us(ts) AS us, CAST(floor(value * 100) AS BIGINT) % 1000 - 800 AS net, event_id % 1001 AS size FROM events),
m AS (SELECT doc_id AS k FROM labels GROUP BY doc_id HAVING bool_or(quality = 1)),
v AS (SELECT *, us - lag(us) OVER (PARTITION BY k ORDER BY us) AS gap FROM l JOIN m USING (k) WHERE net > 0 AND size > 0),
w AS (SELECT *, sum(CASE WHEN gap <= 120000000 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY us) AS w FROM v)
SELECT CAST(k AS VARCHAR) AS a_id, count(*) AS samples, max(net) * 1000 + k % 1000 AS best_net, max(size) AS best_size FROM w GROUP BY k, w ORDER BY best_net DESC, a_id, w LIMIT 10""",
    # one step a message: a level's size is the last one and its change, but not below zero
    "book_sessions": """WITH RECURSIVE e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS conn, event_id AS k, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS r FROM events),
q AS (SELECT *, r + r // 29 AS seq FROM e), g AS (SELECT *, coalesce(seq <> lag(seq) OVER (PARTITION BY conn ORDER BY k) + 1, false) AS gap FROM q),
m AS (SELECT * FROM (SELECT *, CAST(sum(CAST(gap AS INT)) OVER (PARTITION BY conn ORDER BY k) AS BIGINT) AS epoch FROM g) WHERE NOT gap),
s AS (SELECT *, CAST(k % 2 AS VARCHAR) AS ticker, sum(CAST(k % 23 = 0 AS INT)) OVER (PARTITION BY conn, epoch, k % 2 ORDER BY k) AS snap FROM m),
c AS (SELECT conn, epoch, ticker, snap, k, CASE WHEN k % 3 = 0 THEN 'no' ELSE 'yes' END AS side, CAST(k % 3 AS VARCHAR) AS price, k % 7 - 3 AS change FROM s WHERE k % 23 > 0
  UNION ALL SELECT conn, epoch, ticker, snap, k, 'yes', '0', k % 4 + 1 FROM s WHERE k % 23 = 0 UNION ALL SELECT conn, epoch, ticker, snap, k, 'yes', '1', k % 6 + 1 FROM s WHERE k % 23 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conn, epoch, ticker, snap, side, price ORDER BY k) AS i FROM c),
x AS (SELECT conn, epoch, ticker, snap, side, price, k, i, greatest(change, 0) AS size FROM n WHERE i = 1
  UNION ALL SELECT n.conn, n.epoch, n.ticker, n.snap, n.side, n.price, n.k, n.i, greatest(x.size + n.change, 0) FROM x JOIN n USING (conn, epoch, ticker, snap, side, price) WHERE n.i = x.i + 1)
SELECT conn, epoch, ticker, side, price, k AS ord, CAST(size AS BIGINT) AS size FROM x""",
}
