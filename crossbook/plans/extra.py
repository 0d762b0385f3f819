"""Queries for sources, filters, fees by venue, identities, streams and tables that merge, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbook.functions.economics import maker_rebate_ticks
from crossbook.operators import books, depth, detector, replay, report, resolution
from crossbook.operators.scratch import folder
from crossbook.plans.markets import _WORDS, _log
from crossbook.plans.queries import _TOKENS, FEE, QUOTES, _quotes, ladders, table
from crossbook.plans.wire import _BOOK, _CANDIDATES, _WALKED, _candidates, _pair_levels, _pairs, book_rows
from crossbook.sources import logs, pages
from crossbook.sources.upsert import UpsertTable
from crossbook.streaming import books as book_streams
from crossbook.streaming import live, throttle

FEES = {"x": 7, "y": 5, "z": 2}


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def pages_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as venue B's pages: a customer's orders are a run, each page has none to three markets, a short one is the last."""
    k = F.col("o_orderkey")
    market = F.from_json(F.lit('{"slug": "s"}'), f"struct<{pages._MARKET}>")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("run"), F.expr("row_number() over (partition by o_custkey order by o_orderkey) - 1").cast("long").alias("page"),
        F.transform(F.sequence(F.lit(1), F.least(k % 6, F.lit(3)).cast("int") + 1), lambda i: market.withField("slug", F.concat_ws("/", k.cast("string"), i.cast("string")))).alias("all"),
        F.least(k % 6, F.lit(3)).cast("int").alias("n"),
    ).select("run", "page", F.slice("all", F.lit(1), F.col("n")).alias("markets"))
    return pages.listing_b(rows, page_size=2, max_pages=6).select("run", "slug")


def book_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book of the order with the largest key."""
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return pages.book_of(book_rows(spark, sf_dir), f"a:{last}")


def known_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("marketSlug"), "o_orderkey")
    markets = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("slug"))
    return pages.known_only(messages, markets).select("marketSlug", "o_orderkey")


def book_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to requests for books: some failed, some aren't JSON, some have no book."""
    k = F.col("o_orderkey")
    price = F.format_string("0.%02d", (k % 100).cast("int"))
    body = F.concat(F.lit('{"orderbook_fp": {"yes_dollars": [["'), price, F.lit('", "'), (k % 9).cast("string"), F.lit('"]]}}'))
    value = F.when(k % 7 == 0, None).when(k % 7 == 1, "gone").when(k % 7 == 2, '{"error": 1}').otherwise(body)
    rows = pages.replies(table(spark, sf_dir, "orders").select(k.alias("id"), value.alias("value")))
    level = F.col("book.orderbook_fp.yes_dollars")[0]
    return rows.select("id", F.col("book").isNotNull().alias("found"), level[0].alias("price"), level[1].alias("size"))


def first_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quotes(spark, sf_dir).select(F.col("user_id").alias("id"), "us", F.col("event_id").alias("ord"), "ask")
    return detector.first_books(rows).select("id", "us", "ord", "ask")


def fresh_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs both of whose books were updated less than a time before now; books of a are as many seconds old as their key's last digit."""
    key = lambda s: F.substring_index(f"{s}_id", ":", -1).cast("long")
    book = lambda s, old: F.col(f"{s}_book").withField("updated_us", F.lit(100_000_000) - old * 1_000_000)
    aged = _pairs(spark, sf_dir).withColumns({"a_book": book("a", key("a") % 10), "b_book": book("b", key("b") % 4)})
    return detector.opportunities(aged, now_us=100_000_000, max_seconds=2.0, rows=_pair_levels(spark, sf_dir)).select("a_id", "b_id", F.col("direction").cast("long").alias("direction"), "size")


def identified_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda c: F.when(k % 3 == c, F.col("p_brand"))
    markets = table(spark, sf_dir, "part").select(F.concat(F.lit("a:"), k.cast("string")).alias("id"), text(0).alias("event"), text(1).alias("futures"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a:"), (F.col("l_partkey") * 2).cast("string")).alias("id"), "l_orderkey", "l_linenumber")
    return detector.identified(rows, markets).groupBy("id", "event", "futures").agg(F.count("*").alias("books"))


def both_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return detector.both_venues(part.filter("id % 2 = 0"), part.filter("id % 3 = 0"))


def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    b, market = F.when(k % 3 > 0, F.concat(F.lit("b"), (k % 50).cast("string"))), F.when(k % 3 < 2, F.concat(F.lit("m"), (k % 20).cast("string")))
    rows = table(spark, sf_dir, "orders").select(detector.pair_key(b, market, F.col("o_custkey").cast("string")).alias("pair"))
    return rows.select("pair.*").groupBy("a_id", "b_id").agg(F.count("*").alias("n"))


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rules = lambda s, rest: part.filter(F.col("p_partkey") % 4 != rest).select(F.concat(F.lit(f"{s}:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("rules"))
    found = table(spark, sf_dir, "orders").select(F.concat(F.lit("a:"), (F.col("o_orderkey") % 3000).cast("string")).alias("a_id"), F.concat(F.lit("b:"), F.col("o_custkey").cast("string")).alias("b_id"))
    return logs.review(found, rules("a", 0), rules("b", 1)).groupBy("a_id", "b_id", "a_rules", "b_rules").agg(F.count("*").alias("n"))


def fees_by_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better direction of each order's books, whose legs are at one of three venues each."""
    yes = F.col("l_linenumber") % 2 == 1
    price = F.when(yes, 4600 + F.round(F.col("l_discount") * 10000)).otherwise(4500 + F.round(F.col("l_tax") * 10000))
    at = lambda n: F.element_at(F.array(*[F.lit(x) for x in FEES]), (F.col("l_orderkey") % n + 1).cast("int"))
    book = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.when(F.col("l_partkey") % 2 == 0, "a").otherwise("b").alias("leg"), F.when(yes, "YES").otherwise("NO").alias("side"),
        price.cast("long").alias("price"), F.col("l_quantity").alias("size"), at(3).alias("a_platform"), at(2).alias("b_platform"),
    )
    found = depth.evaluate(book, require_edge=False, fees=FEES)
    return found.select("key", "a_platform", "b_platform", F.col("direction").cast("long").alias("direction"), "size", "total_fy", "total_fn")


def maker_rebates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders(spark, sf_dir).select("price").distinct().select("price", maker_rebate_ticks(F.col("price")).alias("paid"))


def accented_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each document in four languages, accents folded, with the documents that have them counted."""
    tokens = resolution.words(resolution.unaccented(F.col("text")))
    return table(spark, sf_dir, "documents").select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def aligned_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with shared names, abbreviations that lift a score, refused ties and members of several markets.

    A game of each venue for each order; many games of a league share a team.
    """
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    team = lambda n: F.concat(F.lit("team"), n.cast("string"))
    one, two = team(k % 23), F.concat(F.lit("Club "), team(k % 29 + 30))
    start = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    league = (k % 5).cast("string")

    def event(at, names, yes, abbrev):
        return F.struct(league.alias("league"), at.alias("start_time"), F.array(*names).alias("competitors"), yes.alias("yes_competitor"), abbrev.alias("yes_abbrev"))

    members = orders.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("yes", F.when(F.col("at") == 1, two).otherwise(one))
    a = members.select(
        F.concat(F.lit("a:G-"), k.cast("string"), F.lit("-"), F.col("at").cast("string")).alias("id"), F.lit("q").alias("question"), start.alias("resolution"),
        event(start, (one, two), F.col("yes"), F.lower(F.substring(F.col("yes"), -3, 3))).alias("event"), (k * 4 + F.col("at")).alias("ord"),
    )
    long_one, long_two = F.concat(one, F.lit(" Stars")), F.concat(two, F.lit(" United"))
    later = F.timestamp_micros(F.unix_micros(start) + (k % 7) * 3_600_000_000)
    b = orders.select(
        F.concat(F.lit("b:"), k.cast("string")).alias("id"), F.lit("q").alias("question"), later.alias("resolution"),
        event(later, (long_one, long_two), F.when(k % 2 == 0, long_one).otherwise(long_two), F.when(k % 2 == 0, F.lower(F.substring(one, -3, 3))).otherwise("zzz")).alias("event"),
        k.alias("ord"),
    )
    found = resolution.match_games(a, b)
    return found.select("a_id", "b_id", F.round(F.col("score") * 10000).cast("long").alias("score"), F.col("delta_days").cast("long").alias("delta_days"))


def question_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions by tokens alone: the Jaccard part of the lexical matcher, at a threshold that the ratio can't decide."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("question"), F.array("p_name").alias("aliases"),
        F.date_add(F.lit("2026-01-01"), F.col("p_size")).cast("timestamp").alias("resolution"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("futures"),
        F.col("p_partkey").alias("ord"),
    )
    found = resolution.question_pairs(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1"), threshold=0.85, max_df=150)
    return found.filter("jaccard >= 0.8").select("a_id", "b_id", F.col("at").cast("long").alias("place"), F.round(F.col("jaccard") * 10000).cast("long").alias("jaccard"), F.col("delta_days").cast("long").alias("delta_days"))


def report_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's percentages, in tenths, its span and rate, in hundredths, its medians and quartiles, in quarters."""
    log, matches = _log(spark, sf_dir)
    row = report.report(log, matches, matches)
    scaled = {
        10: "true_pct diverged_pct unreviewed_pct a_pct b_pct c_pct ever_viable_pct median_seconds", 100: "span_hours windows_per_hour", 4: "size_median size_p25 size_p75",
    }
    return row.select(*[F.round(F.col(c) * by).cast("long").alias(c) for by, names in scaled.items() for c in names.split()])


def throttle_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The throttle by doubling, which any length of a pair's history will do for; all events are of eight pairs."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        (F.col("user_id") % 8).cast("string").alias("a_id"), F.lit("b").alias("b_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).cast("long").alias("size"), (F.col("event_id") % 4).alias("edge"),
        F.when(F.col("event_id") % 5 < 3, "structured").otherwise("lexical").alias("method"),
    )
    return throttle.logged_by_doubling(rows).drop("n")


def last_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.last_books(_messages(spark, sf_dir)).withColumn("size", F.col("size").cast("long"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_messages(table(spark, sf_dir, "events"))


def _as_messages(events: DataFrame) -> DataFrame:
    """Events as messages: every 31st one of a connection is a snapshot, every 13th has a number that shows a gap."""
    k = F.col("event_id")
    level = lambda p, n: F.array(F.lit(p), n.cast("string"))
    snapshot = k % 31 == 0
    return events.select(
        (F.col("user_id") % 20).cast("string").alias("conn"), k.alias("ord"), ((k + 1) * 1_000_000).alias("us"), F.when(k % 13 == 0, k).cast("long").alias("seq"),
        F.when(snapshot, "snapshot").otherwise("delta").alias("type"), (k % 3).cast("string").alias("ticker"),
        F.when(snapshot, F.array(level("0", k % 4), level("1", k % 6 + 1))).alias("yes"), F.lit(None).cast("array<array<string>>").alias("no"),
        F.when(k % 3 == 0, "no").otherwise("yes").alias("side"), (k % 3).cast("string").alias("price"), (k % 7 - 2).cast("string").alias("delta"),
    )


def streamed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books of a stream over the events' table, after each message: how many levels, and their sizes' sum."""
    book_streams.state_store(spark)
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque*")  # a pattern, since a stream reads folders
    messages = _as_messages(events)
    out = _new_folder(spark, "streamed-books")
    query = book_streams.book_stream(messages, idle_seconds=10**9).writeStream.format("parquet").option("path", f"{out}/books").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("conn string, ticker string, ord long, us long, at timestamp, yes array<array<string>>, no array<array<string>>").parquet(f"{out}/books")
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x[1].cast("double")).cast("long")
    return rows.select("conn", "ticker", "ord", F.size("yes").cast("long").alias("yes_levels"), size("yes").alias("yes_size"), F.size("no").cast("long").alias("no_levels"), size("no").alias("no_size"))


def upserted_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest quote of each user, merged batch by batch into a table of buckets."""
    rows = _quotes(spark, sf_dir)
    kept = UpsertTable(spark, _new_folder(spark, "latest"), "user_id long, us long, event_id long, ask long", ["user_id"], 32)
    newest = lambda both: replay.latest(both, "user_id", ["us", "event_id"], ["ask"])
    for number in range(3):
        part = rows.filter(F.col("event_id") % 3 == number).select("user_id", "us", "event_id", "ask")
        kept.merge(newest(part), number, newest)
    return kept.read()


def live_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's latest record of the live path over the events' table as a stream of updates of forty pairs' legs."""
    book_streams.state_store(spark)
    k = F.col("event_id")
    pair = F.floor(k / 4) % 40
    side = lambda price: F.array(F.struct((price / 10000).alias("price"), (k % 5 + 1).cast("double").alias("size")))
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque*")
    updates = events.select(
        F.concat(F.when(k % 2 == 0, "a:").otherwise("b:"), pair.cast("string")).alias("id"), ((k + 1) * 1_000_000).alias("us"),
        side(3000 + k * 7 % 4001).alias("yes_depth"), side(3000 + k * 11 % 4001).alias("no_depth"),
    )
    text = F.col("id").cast("string")
    candidates = spark.range(40).select(
        F.concat(F.lit("a:"), text).alias("a_id"), F.concat(F.lit("b:"), text).alias("b_id"), F.lit("q").alias("a_question"), F.lit("structured").alias("method"),
        F.lit(None).cast("boolean").alias("resolution_match"),
    )
    out = _new_folder(spark, "live")
    sinks = live.live_sinks(f"{out}/log", f"{out}/latest", f"{out}/last")
    met = live.met(book_streams.timed(updates), candidates, idle_seconds=10**9)
    met.writeStream.foreachBatch(sinks).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    ticks = lambda c: F.round(F.col(c) * 10000).cast("long").alias(c)
    rows = live.latest_table(spark, f"{out}/latest").read()
    return rows.select("a_id", "b_id", F.unix_micros(F.to_timestamp("timestamp")).alias("us"), "strategy", "size", ticks("yes_top"), ticks("no_top"), ticks("net"))


def trusted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates written as one JSON array in parts, and read again: games and outrights only."""
    out = _new_folder(spark, "candidates")
    logs.write_candidates(_candidates(spark, sf_dir), out)
    rows = logs.read_candidates(spark, out, trusted=True, by_line=True)
    return rows.select("a_id", "b_id", F.round(F.col("score") * 1000).cast("long").alias("score"), "method")


def logged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a log in two goes, and read again; the pairs that it tracks are counted."""
    out = _new_folder(spark, "log")
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("a:"), (k % 400).cast("string")).alias("a_id"), F.concat(F.lit("b:"), (k % 300).cast("string")).alias("b_id"), (k % 7).alias("size"), F.lit("t").alias("timestamp"))
    logs.append_log(rows.filter("size < 3"), out)
    logs.append_log(rows.filter("size >= 3"), out)
    counts = logs.read_log(spark, out).groupBy("a_id", "b_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return counts.join(logs.read_tracked(spark, out), ["a_id", "b_id"])


QUERIES = {f.__name__: f for f in (
    pages_by_offset, book_lookup, known_messages, book_replies, first_books, fresh_opportunities, identified_books, both_venues, pair_keys, review_rows, fees_by_venue,
    maker_rebates, accented_names, aligned_games, question_jaccard, report_rates, throttle_long, last_books, streamed_books, upserted_latest,
    live_latest, trusted_candidates, logged_rows,
)}

_FEE = "(({c}) * {p} * (10000 - {p}) // 1000000 + CASE WHEN 2 * (({c}) * {p} * (10000 - {p}) % 1000000) > 1000000 OR (2 * (({c}) * {p} * (10000 - {p}) % 1000000) = 1000000 AND (({c}) * {p} * (10000 - {p}) // 1000000) % 2 = 1) THEN 1 ELSE 0 END)"
_AT = "CASE {n} WHEN 0 THEN 7 WHEN 1 THEN 5 ELSE 2 END"
_YES, _NO = (f"CASE WHEN direction = 0 THEN {_AT.format(n=x)} ELSE {_AT.format(n=y)} END" for x, y in (("key % 3", "key % 2"), ("key % 2", "key % 3")))
_PCT = "CASE WHEN {d} > 0 THEN CAST(round_even(1000.0 * ({n}) / ({d}), 0) AS BIGINT) ELSE 0 END"
_MESSAGES = """m AS (SELECT CAST(user_id % 20 AS VARCHAR) AS conn, event_id AS k, CASE WHEN event_id % 13 = 0 THEN event_id END AS seq FROM events),
l AS (SELECT *, last_value(seq IGNORE NULLS) OVER (PARTITION BY conn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM m),
g AS (SELECT *, coalesce(seq <> was + 1, false) AS gap FROM l),
x AS (SELECT * FROM (SELECT conn, k, k % 3 AS t, k % 31 = 0 AS whole, gap, CAST(sum(CAST(gap AS INT)) OVER (PARTITION BY conn ORDER BY k) AS BIGINT) AS epoch FROM g) WHERE NOT gap),
n AS (SELECT *, row_number() OVER (PARTITION BY conn, epoch, t ORDER BY k) AS i FROM x),
w AS (
  SELECT conn, epoch, t, k, i, CASE WHEN whole THEN MAP {'yes0': k % 4, 'yes1': k % 6 + 1} WHEN k % 7 > 2 THEN MAP {(CASE WHEN k % 3 = 0 THEN 'no' ELSE 'yes' END || k % 3): k % 7 - 2} ELSE MAP {}::MAP(VARCHAR, BIGINT) END AS b FROM n WHERE i = 1
  UNION ALL
  SELECT n.conn, n.epoch, n.t, n.k, n.i, CASE WHEN n.whole THEN MAP {'yes0': n.k % 4, 'yes1': n.k % 6 + 1} ELSE
    map_from_entries(list_concat(list_filter(map_entries(w.b), lambda e: e.key <> CASE WHEN n.k % 3 = 0 THEN 'no' ELSE 'yes' END || n.k % 3),
      CASE WHEN coalesce(w.b[CASE WHEN n.k % 3 = 0 THEN 'no' ELSE 'yes' END || n.k % 3], 0) + n.k % 7 - 2 > 0
           THEN [{'key': CASE WHEN n.k % 3 = 0 THEN 'no' ELSE 'yes' END || n.k % 3, 'value': coalesce(w.b[CASE WHEN n.k % 3 = 0 THEN 'no' ELSE 'yes' END || n.k % 3], 0) + n.k % 7 - 2}] ELSE [] END)) END
  FROM w JOIN n ON n.conn = w.conn AND n.epoch = w.epoch AND n.t = w.t AND n.i = w.i + 1)"""

ORACLE_SQL = {
    "pages_by_offset": """WITH RECURSIVE p AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey AS k, least(o_orderkey % 6, 3) AS n FROM orders),
walk AS (SELECT run, page, k, n FROM p WHERE page = 1 UNION ALL SELECT p.run, p.page, p.k, p.n FROM walk JOIN p ON p.run = walk.run AND p.page = walk.page + 1 WHERE walk.n >= 2 AND p.page <= 6)
SELECT CAST(run AS VARCHAR) AS run, k || '/' || i AS slug FROM (SELECT run, k, unnest(range(1, n + 1)) AS i FROM walk)""",
    "book_lookup": _BOOK + """SELECT 'a:' || k AS id, array_to_string(list_sort(list_transform(other, lambda x: 10000 - x)), ',') AS yes, array_to_string(list_sort(list_transform(bids, lambda x: 10000 - x)), ',') AS no,
CAST(no AS BIGINT) AS yes_size, CAST(nb AS BIGINT) AS no_size, list_max(bids) AS yes_bid, list_max(other) AS no_bid FROM b WHERE k = (SELECT max(l_orderkey) FROM lineitem)""",
    "known_messages": "SELECT 's' || o_custkey AS marketSlug, o_orderkey FROM orders WHERE o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)",
    "book_replies": """SELECT o_orderkey AS id, o_orderkey % 7 > 2 AS found, CASE WHEN o_orderkey % 7 > 2 THEN '0.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') END AS price,
CASE WHEN o_orderkey % 7 > 2 THEN CAST(o_orderkey % 9 AS VARCHAR) END AS size FROM orders""",
    "first_books": f"WITH {QUOTES} SELECT user_id AS id, us, event_id AS ord, ask FROM quotes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1",
    "fresh_opportunities": f"""WITH {_WALKED} SELECT a_id, b_id, CAST(direction AS BIGINT) AS direction, CAST(n AS BIGINT) AS size FROM v
WHERE CAST(split_part(a_id, ':', 2) AS BIGINT) % 10 <= 2 AND CAST(split_part(b_id, ':', 3) AS BIGINT) % 4 <= 2""",
    "identified_books": """SELECT 'a:' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS event, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS futures, count(*) AS books
FROM lineitem JOIN part ON p_partkey = 2 * l_partkey GROUP BY ALL""",
    "both_venues": "SELECT p_partkey AS id, 'a' AS venue FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'b' FROM part WHERE p_partkey % 3 = 0",
    "pair_keys": """SELECT CAST(o_custkey AS VARCHAR) AS a_id, CASE WHEN o_orderkey % 3 > 0 THEN 'b' || o_orderkey % 50 ELSE 'm' || o_orderkey % 20 END AS b_id, count(*) AS n FROM orders GROUP BY ALL""",
    "review_rows": """SELECT 'a:' || o_orderkey % 3000 AS a_id, 'b:' || o_custkey AS b_id, x.p_name AS a_rules, y.p_name AS b_rules, count(*) AS n
FROM orders LEFT JOIN part x ON x.p_partkey = o_orderkey % 3000 AND x.p_partkey % 4 <> 0 LEFT JOIN part y ON y.p_partkey = o_custkey AND y.p_partkey % 4 <> 1 GROUP BY ALL""",
    "maker_rebates": """WITH p AS (SELECT DISTINCT CAST(CASE WHEN l_linenumber % 2 = 1 THEN 4600 + round(l_discount * 10000) ELSE 4500 + round(l_tax * 10000) END AS BIGINT) AS price FROM lineitem)
SELECT price, -CAST(round_even(125 * price * (10000 - price) / 100000000.0, 0) AS BIGINT) AS paid FROM p""",
    # units walked one by one, as for best_direction; fees are those of the venues that an order's key stands for
    "fees_by_venue": f"""WITH l AS (SELECT l_orderkey AS key, CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS leg, l_linenumber % 2 = 1 AS yes,
  CAST(CASE WHEN l_linenumber % 2 = 1 THEN 4600 + round(l_discount * 10000) ELSE 4500 + round(l_tax * 10000) END AS BIGINT) AS price, CAST(floor(l_quantity) AS BIGINT) AS units FROM lineitem),
d AS (SELECT *, CASE WHEN (leg = 'a') = yes THEN 0 ELSE 1 END AS direction FROM l),
u AS (SELECT key, direction, yes, price, row_number() OVER (PARTITION BY key, direction, yes ORDER BY price) AS n FROM (SELECT *, unnest(range(units)) FROM d)),
z AS (SELECT key, direction, y.n AS n, y.price AS py, o.price AS pn FROM u y JOIN u o USING (key, direction) WHERE y.yes AND NOT o.yes AND y.n = o.n AND y.n <= 1000),
f AS (SELECT *, {_FEE.format(c=_YES, p="py")} AS fy, {_FEE.format(c=_NO, p="pn")} AS fn FROM z),
c AS (SELECT key, direction, n, sum(py) OVER w AS py, sum(pn) OVER w AS pn, sum(fy) OVER w AS fy, sum(fn) OVER w AS fn FROM f WINDOW w AS (PARTITION BY key, direction ORDER BY n)),
v AS (SELECT * FROM c WHERE 10000 * n - py - pn - fy - fn > 100 * n QUALIFY row_number() OVER (PARTITION BY key, direction ORDER BY n DESC) = 1),
t AS (SELECT key, direction, min(price) FILTER (yes) AS ty, min(price) FILTER (NOT yes) AS tn FROM d GROUP BY ALL HAVING count(*) FILTER (yes) > 0 AND count(*) FILTER (NOT yes) > 0),
e AS (SELECT key, direction, coalesce(n, 0) AS size, coalesce(n, 1) AS n, coalesce(py, ty) AS py, coalesce(pn, tn) AS pn, coalesce(fy, {_FEE.format(c=_YES, p="ty")}) AS fy, coalesce(fn, {_FEE.format(c=_NO, p="tn")}) AS fn FROM t LEFT JOIN v USING (key, direction)),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY round((10000 * n - py - pn - fy - fn) / n * 10000) DESC, direction) = 1)
SELECT key, ['x', 'y', 'z'][key % 3 + 1] AS a_platform, ['x', 'y', 'z'][key % 2 + 1] AS b_platform, CAST(direction AS BIGINT) AS direction, CAST(size AS BIGINT) AS size, CAST(fy AS BIGINT) AS total_fy, CAST(fn AS BIGINT) AS total_fn FROM b""",
    "accented_names": f"""WITH w AS (SELECT regexp_replace(strip_accents(coalesce(text, '')), '[^\\x00-\\x7F]', '', 'g') AS name FROM documents)
SELECT token, count(*) AS n FROM (SELECT unnest({_WORDS.format("name")}) AS token FROM w) GROUP BY token""",
    # every pair of a league's games is scored; a score of a name within another is 85 hundredths, an equal abbreviation makes it 100
    "aligned_games": """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 5 AS lg, 'team' || o_orderkey % 23 AS t1, 'team' || (o_orderkey % 29 + 30) AS t2, epoch_us(date_trunc('day', o_orderdate)) AS us FROM orders),
b AS (SELECT *, us + (k % 7) * 3600000000 AS at FROM a),
p AS (SELECT a.k AS ak, b.k AS bk, abs(a.us - b.at) AS apart, a.us AS aus, b.at AS bat,
  CASE WHEN a.t1 <> b.t1 THEN 0 WHEN b.k % 2 = 0 AND right(a.t1, 3) = right(b.t1, 3) THEN 100 ELSE 85 END AS s1, CASE WHEN a.t2 = b.t2 THEN 85 ELSE 0 END AS s2
  FROM a JOIN b ON a.lg = b.lg AND abs(a.us - b.at) <= 30 * 3600000000),
g AS (SELECT *, s1 * s2 AS score, apart / 3.6e9 AS hours FROM p WHERE s1 * s2 >= 5000),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS s2nd, lead(hours) OVER w AS h2nd FROM g WINDOW w AS (PARTITION BY bk ORDER BY score DESC, hours, 'a:G-' || ak))
SELECT 'a:G-' || ak || CASE WHEN bk % 2 = 0 THEN '-2' ELSE '-1' END AS a_id, 'b:' || bk AS b_id, CAST(score AS BIGINT) AS score, CAST(abs(floor((aus - bat) / 86400000000.0)) AS BIGINT) AS delta_days
FROM r WHERE r = 1 AND NOT coalesce(s2nd = score AND abs(h2nd - hours) <= 1.0, false)""",
    "question_jaccard": f"""WITH p AS (SELECT p_partkey AS k, p_size AS day, p_name || ' ' || p_type AS q, {_TOKENS.format("p_name || ' ' || p_type")} AS t0, {_TOKENS.format("p_name")} AS t1 FROM part),
df AS (SELECT w FROM (SELECT k, unnest(list_distinct(list_concat(t0, t1))) AS w FROM p WHERE k % 2 = 1) GROUP BY w HAVING count(*) <= 150), r AS (SELECT list(w) AS ws FROM df),
s AS (SELECT a.k AS a, b.k AS b, abs(a.day - b.day) AS days, a.t0 AS ta, b.t0, b.t1, a.q AS qa, b.q AS qb FROM p a JOIN p b ON a.k % 2 = 0 AND b.k % 2 = 1 AND abs(a.day - b.day) <= 10, r
  WHERE len(list_intersect(list_intersect(a.t0, list_concat(b.t0, b.t1)), r.ws)) > 0),
e AS (SELECT a, b, days, 0 AS place, len(list_intersect(ta, t0)) AS i, len(list_distinct(list_concat(ta, t0))) AS u FROM s UNION ALL SELECT a, b, days, 1, len(list_intersect(ta, t1)), len(list_distinct(list_concat(ta, t1))) FROM s)
SELECT CAST(a AS VARCHAR) AS a_id, CAST(b AS VARCHAR) AS b_id, CAST(place AS BIGINT) AS place, CAST(round(i / u * 10000) AS BIGINT) AS jaccard, CAST(days AS BIGINT) AS delta_days FROM e WHERE i / u >= 0.8""",
    "report_rates": f"""WITH l AS (SELECT user_id AS k, epoch_us(ts) AS us, CAST(floor(value * 100) AS BIGINT) % 1000 AS x, event_id % 1001 AS size FROM events),
m AS (SELECT doc_id AS k, bool_or(quality = 1) AS label FROM labels GROUP BY doc_id), s AS (SELECT l.* FROM l JOIN m USING (k) WHERE label),
c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS t, count(*) FILTER (quality <> 1) AS f FROM labels),
k AS (SELECT k, bool_or(x > 300) AS a, bool_or(x > 500) AS b, bool_or(x > 800 AND size > 0) AS c FROM s GROUP BY k), q AS (SELECT count(*) AS n, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (c) AS c FROM k),
v AS (SELECT *, us - lag(us) OVER (PARTITION BY k ORDER BY us) AS gap FROM s WHERE x > 800 AND size > 0),
w AS (SELECT round((max(us) - min(us)) / 1e6, 1) AS sec FROM (SELECT *, sum(CASE WHEN gap <= 120000000 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY us) AS w FROM v) GROUP BY k, w),
h AS (SELECT (max(us) - min(us)) / 3.6e9 AS hours FROM l), z AS (SELECT list_sort(list(size)) AS z, count(*) AS n FROM v)
SELECT {_PCT.format(n="c.t", d="c.n")} AS true_pct, {_PCT.format(n="c.f", d="c.n")} AS diverged_pct, {_PCT.format(n="c.n - c.t - c.f", d="c.n")} AS unreviewed_pct,
  {_PCT.format(n="q.a", d="q.n")} AS a_pct, {_PCT.format(n="q.b", d="q.n")} AS b_pct, {_PCT.format(n="q.c", d="q.n")} AS c_pct, {_PCT.format(n="q.c", d="(SELECT count(DISTINCT doc_id) FROM labels)")} AS ever_viable_pct,
  (SELECT CAST(round(median(sec) * 10) AS BIGINT) FROM w) AS median_seconds, CAST(round(hours * 100) AS BIGINT) AS span_hours, CASE WHEN hours > 0 THEN CAST(round((SELECT count(*) FROM w) / hours * 100) AS BIGINT) END AS windows_per_hour,
  CAST(2 * (z[(z.n + 1) // 2] + z[z.n // 2 + 1]) AS BIGINT) AS size_median,
  CASE WHEN z.n >= 4 THEN CAST(z[least(greatest((z.n + 1) // 4, 1), z.n - 1)] * (4 - (z.n + 1 - 4 * least(greatest((z.n + 1) // 4, 1), z.n - 1))) + z[least(greatest((z.n + 1) // 4, 1), z.n - 1) + 1] * (z.n + 1 - 4 * least(greatest((z.n + 1) // 4, 1), z.n - 1)) AS BIGINT) END AS size_p25,
  CASE WHEN z.n >= 4 THEN CAST(z[least(greatest(3 * (z.n + 1) // 4, 1), z.n - 1)] * (4 - (3 * (z.n + 1) - 4 * least(greatest(3 * (z.n + 1) // 4, 1), z.n - 1))) + z[least(greatest(3 * (z.n + 1) // 4, 1), z.n - 1) + 1] * (3 * (z.n + 1) - 4 * least(greatest(3 * (z.n + 1) // 4, 1), z.n - 1)) AS BIGINT) END AS size_p75
FROM c, q, h, z""",
    "throttle_long": """WITH RECURSIVE e AS (SELECT user_id % 8 AS u, epoch_us(ts) AS us, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS size, event_id % 4 AS edge, CASE WHEN event_id % 5 < 3 THEN 'structured' ELSE 'lexical' END AS method FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY us, edge, size, method) AS i FROM e),
w AS (SELECT *, size > 0 OR method = 'structured' AS taken, CASE WHEN size > 0 OR method = 'structured' THEN us END AS last_us, CASE WHEN size > 0 OR method = 'structured' THEN edge END AS last_edge FROM n WHERE i = 1
  UNION ALL SELECT u, us, size, edge, method, i, go, CASE WHEN go THEN us ELSE was_us END, CASE WHEN go THEN edge ELSE was_edge END
  FROM (SELECT n.*, w.last_us AS was_us, w.last_edge AS was_edge, (n.size > 0 OR (n.method = 'structured' AND (w.last_edge IS NULL OR n.edge <> w.last_edge))) AND (w.last_us IS NULL OR n.us - w.last_us >= 30000000) AS go FROM w JOIN n ON n.u = w.u AND n.i = w.i + 1))
SELECT CAST(u AS VARCHAR) AS a_id, 'b' AS b_id, us, CAST(size AS BIGINT) AS size, CAST(edge AS BIGINT) AS edge, method FROM w WHERE taken""",
    # a book is a map that each message replaces or changes
    "last_books": f"""WITH RECURSIVE {_MESSAGES}, z AS (SELECT *, max(epoch) OVER (PARTITION BY conn) AS now FROM (SELECT conn, epoch, k, NULL AS t, NULL AS b FROM x UNION ALL SELECT conn, epoch, k, t, b FROM w)),
last AS (SELECT conn, t, b FROM z WHERE t IS NOT NULL AND epoch = now QUALIFY row_number() OVER (PARTITION BY conn, t ORDER BY k DESC) = 1)
SELECT conn, CAST(t AS VARCHAR) AS ticker, left(e.key, length(e.key) - 1) AS side, right(e.key, 1) AS price, CAST(e.value AS BIGINT) AS size FROM (SELECT conn, t, unnest(map_entries(b)) AS e FROM last)""",
    "streamed_books": f"""WITH RECURSIVE {_MESSAGES}
SELECT conn, CAST(t AS VARCHAR) AS ticker, k AS ord, len(list_filter(map_entries(b), lambda e: e.key[1] = 'y')) AS yes_levels, CAST(coalesce(list_sum(list_transform(list_filter(map_entries(b), lambda e: e.key[1] = 'y'), lambda e: e.value)), 0) AS BIGINT) AS yes_size,
  len(list_filter(map_entries(b), lambda e: e.key[1] = 'n')) AS no_levels, CAST(coalesce(list_sum(list_transform(list_filter(map_entries(b), lambda e: e.key[1] = 'n'), lambda e: e.value)), 0) AS BIGINT) AS no_size FROM w""",
    # of each update, the newest books of both legs, if they are two seconds old or less; both directions of books with one level
    "live_latest": f"""WITH u AS (SELECT (event_id + 1) * 1000000 AS us, event_id // 4 % 40 AS p, event_id % 2 AS leg, 3000 + event_id * 7 % 4001 AS y, 3000 + event_id * 11 % 4001 AS n, event_id % 5 + 1 AS q FROM events),
m AS (SELECT p, us, {", ".join(f"last_value(CASE WHEN leg = {leg} THEN {c} END IGNORE NULLS) OVER w AS {s}_{c}" for leg, s in enumerate("ab") for c in ("us", "y", "n", "q"))}
  FROM u WINDOW w AS (PARTITION BY p ORDER BY us ROWS UNBOUNDED PRECEDING)),
f AS (SELECT * FROM m WHERE us - a_us <= 2000000 AND us - b_us <= 2000000),
d AS (SELECT p, us, 0 AS direction, a_y AS py, b_n AS pn, least(a_q, b_q) AS q FROM f UNION ALL SELECT p, us, 1, b_y, a_n, least(a_q, b_q) FROM f),
c AS (SELECT *, 10000 - py - pn - {FEE.format(c="(CASE direction WHEN 0 THEN 7 ELSE 5 END)", p="py")} - {FEE.format(c="(CASE direction WHEN 0 THEN 5 ELSE 7 END)", p="pn")} AS net FROM d),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p ORDER BY us DESC, net DESC, direction) = 1)
SELECT 'a:' || p AS a_id, 'b:' || p AS b_id, us, CASE direction WHEN 0 THEN 'YES_A_NO_B' ELSE 'YES_B_NO_A' END AS strategy, CASE WHEN net > 100 THEN q ELSE 0 END AS size, py AS yes_top, pn AS no_top, CAST(net AS BIGINT) AS net FROM b""",
    "trusted_candidates": f"WITH {_CANDIDATES} SELECT a_id, b_id, CAST(score AS BIGINT) AS score, method FROM c WHERE method <> 'lexical'",
    "logged_rows": "SELECT 'a:' || o_orderkey % 400 AS a_id, 'b:' || o_orderkey % 300 AS b_id, count(*) AS n, CAST(sum(o_orderkey % 7) AS BIGINT) AS size FROM orders GROUP BY ALL",
    "upserted_latest": f"WITH {QUOTES} SELECT user_id, us, event_id, ask FROM quotes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) = 1",
}
