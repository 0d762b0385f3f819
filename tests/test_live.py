"""One query from both venues' messages to log and latest table, against a replay of all messages at once."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crossbook.sources import logs
from crossbook.streaming import books, live, throttle

KINDS_A = "conn string, ord long, us long, seq long, type string, ticker string, yes array<array<string>>, no array<array<string>>, side string, price string, delta string"
SIDE_B = "array<struct<px:struct<value:string,currency:string>,qty:string>>"
KINDS_B = f"us long, marketSlug string, bids {SIDE_B}, offers {SIDE_B}"
CANDIDATES = "a_id string, b_id string, a_question string, b_question string, score double, method string, resolution_match boolean"
PAIRS = [("a:x", "b:s", "structured"), ("a:y", "b:s", "futures"), ("a:x", "b:t", "structured"), ("a:w", "b:t", "structured")]


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    books.state_store(s)
    return s


def events(n, seed):
    """Messages of both venues in order of time, 0.3 s apart; of A with gaps, of B one in twenty with the time of an older one."""
    rng, out, seq = random.Random(seed), [], 0
    for i in range(n):
        us = 1_000_000 + 300_000 * i
        if rng.random() < 0.6:
            seq += 1 + (rng.random() < 0.02)
            kind = rng.choice(["snapshot", "delta", "delta", "delta"])
            level = lambda: [[f"0.{rng.choice([40, 45, 48])}", str(rng.randint(1, 40))] for _ in range(2)]
            yes, no = (level(), level()) if kind == "snapshot" else (None, None)
            out.append(("a", ("c", i, us, seq, kind, rng.choice("xyz"), yes, no, rng.choice(["yes", "no"]), rng.choice(["0.40", "0.5"]), str(rng.randint(-9, 20)))))
        else:
            side = lambda prices: [((rng.choice(prices), "USD"), str(rng.randint(1, 30))) for _ in range(2)]
            late = 40_000_000 if rng.random() < 0.05 and i > 150 else 0
            out.append(("b", (us - late, rng.choice(["s", "t", "other"]), side(["0.41", "0.46"]), side(["0.47", "0.52"]))))
    return out


def replayed(messages):
    """The rows of ``met``: of each pair, at each update, both newest books."""
    known, levels, last, newest, n, rows = {p: [] for p in PAIRS}, {}, None, {}, {}, []
    for venue, m in messages:
        if venue == "a":
            _, _, us, seq, kind, ticker, yes, no, side, price, delta = m
            gap, last = last is not None and seq != last + 1, seq
            if gap:
                levels = {}
                continue
            book = levels.setdefault(ticker, {})
            if kind == "snapshot":
                book.clear()
                book |= {("yes", p): float(z) for p, z in yes} | {("no", p): float(z) for p, z in no}
            else:
                size = book.pop((side, price), 0.0) + float(delta)
                book |= {(side, price): size} if size > 1e-9 else {}
            ask = lambda s: sorted([round(1 - float(p), 4), z] for (t, p), z in book.items() if t == s)
            leg, key, value = "a", f"a:{ticker}", (us, ask("no"), ask("yes"))
        else:
            us, slug, bids, offers = m
            leg, key = "b", f"b:{slug}"
            value = (us, sorted([float(p), float(q)] for (p, _), q in offers), sorted([round(1 - float(p), 4), float(q)] for (p, _), q in bids))
        for a, b, method in PAIRS:
            pair = (a, b)
            if key not in pair or us < newest.get((pair, leg), (0,))[0]:
                continue
            newest[pair, leg] = value
            n[pair] = n.get(pair, 0) + 1
            if (pair, "a") in newest and (pair, "b") in newest:
                rows.append((a, b, n[pair], us, "q", method, None, *(text(newest[pair, x]) for x in "ab")))
    del known
    return rows


def text(book):
    us, yes, no = book
    side = lambda levels: [{"price": p, "size": z} for p, z in levels]
    return json.dumps({"yes_depth": side(yes), "no_depth": side(no), "updated_us": us})


def start(spark, folder, candidates, **options):
    a = spark.readStream.schema(KINDS_A).option("maxFilesPerTrigger", 1).json(f"{folder}/a/*")
    b = spark.readStream.schema(KINDS_B).option("maxFilesPerTrigger", 1).json(f"{folder}/b/*")
    tickers, slugs = spark.createDataFrame([("x",), ("y",), ("w",)], "ticker string"), spark.createDataFrame([("s",), ("t",), ("u",)], "slug string")
    updates = live.venue_updates(a, b, tickers, slugs, **options)
    sinks = live.live_sinks(*(f"{folder}/{x}" for x in ("log", "latest", "last")))
    query = live.met(updates, candidates).writeStream.foreachBatch(sinks).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None


def test_from_messages_to_log(spark, tmp_path):
    messages = events(420, 11)
    candidates = spark.createDataFrame([(a, b, "q", "p", 1.0, m, None) for a, b, m in PAIRS], CANDIDATES)
    parts = [messages[:150], messages[150:300], messages[300:]]

    def land(k):
        for venue, kinds in (("a", KINDS_A), ("b", KINDS_B)):
            spark.createDataFrame([m for v, m in parts[k] if v == venue], kinds).coalesce(1).write.json(f"{tmp_path}/{venue}/k={k}")

    land(0), land(1)
    start(spark, tmp_path, candidates, delay="10 minutes")
    land(2)  # the query begins again from its checkpoint
    start(spark, tmp_path, candidates, delay="10 minutes")
    rows = spark.createDataFrame(replayed([m for p in parts for m in sorted(p, key=lambda x: x[1][2] if x[0] == "a" else x[1][0])]), live._MET)
    whole = live.evaluated(rows).withColumn("ts", F.timestamp_micros("us")).withColumn("edge", F.round(F.col("raw_top") * 10000).cast("long")).persist()
    taken = throttle.logged(whole)
    columns = ["a_id", "b_id", "timestamp", "strategy", "size", "yes_top", "no_top", "net"]
    want = logs.records(whole.join(taken.select("a_id", "b_id", "us", "n"), ["a_id", "b_id", "us", "n"], "left_semi")).select(columns).collect()
    got = spark.read.schema(logs.RECORD).json(f"{tmp_path}/log").select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 3
    latest = logs.latest_records(logs.records(whole)).select(columns).collect()
    table = live.latest_table(spark, f"{tmp_path}/latest").read().select(columns).collect()
    assert sorted(map(tuple, table)) == sorted(map(tuple, latest)) and len(table) == 3
    assert all(datetime.fromisoformat(r.timestamp) for r in table)


def test_older_books_and_closed_pairs(spark, tmp_path):
    """An older book of a later micro-batch isn't taken; a pair without updates leaves the state."""
    level = "array<struct<price:double,size:double>>"
    schema = f"id string, us long, yes_depth {level}, no_depth {level}"
    s = 1_000_000
    book = lambda p: ([(p, 5.0)], [(0.5, 3.0)])
    batches = [[("a:x", 10 * s, *book(0.4)), ("b:s", 11 * s, *book(0.3))], [("a:x", 9 * s, *book(0.1)), ("b:s", 12 * s, *book(0.2))], [("a:y", 500 * s, *book(0.4))], [("a:y", 501 * s, *book(0.4))], [("b:s", 502 * s, *book(0.25))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/k={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    candidates = spark.createDataFrame([("a:x", "b:s", "q", "p", 1.0, "structured", None)], CANDIDATES)
    rows = live.met(books.timed(stream, "5 seconds"), candidates, idle_seconds=60)
    query = rows.writeStream.format("memory").queryName("met_rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = [(r.us // s, json.loads(r.a)["yes_depth"][0]["price"], json.loads(r.b)["yes_depth"][0]["price"]) for r in spark.table("met_rows").orderBy("us").collect()]
    # The book of second 9 came after that of second 10; at 502 the pair's books of seconds 10 and 12 are gone.
    assert found == [(11, 0.4, 0.3), (12, 0.4, 0.2)]
