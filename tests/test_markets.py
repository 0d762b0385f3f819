"""Venue rows, matchers, books, evaluation, throttle and report against small cases and brute force."""

import json
import random
from collections import Counter
from datetime import UTC, datetime
from fractions import Fraction

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crossbook.functions import economics
from crossbook.operators import books, depth, detector, matching, replay, report, resolution
from crossbook.sources import logs, pages, venues
from crossbook.streaming import books as stream_books
from crossbook.streaming import live, throttle


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def listing_a(spark, *events):
    def market(ticker, yes, **more):
        return {"ticker": ticker, "title": "t " + yes, "yes_sub_title": yes, "expiration_time": "2026-07-11T00:00:00Z", "yes_bid_dollars": "0.40", "yes_ask_dollars": "0.45"} | more

    rows = [{"ord": i, "title": title, "markets": [market(*m[:2], **(m[2] if len(m) > 2 else {})) for m in members]} for i, (title, *members) in enumerate(events)]
    return venues.markets_a(spark.createDataFrame(rows, venues.LISTING_A))


def listing_b(spark, *rows):
    base = {"endDate": "2026-07-22T00:00:00Z", "outcomes": '["Yes","No"]', "closed": False}
    return venues.markets_b(spark.createDataFrame([{"ord": i} | base | r for i, r in enumerate(rows)], venues.LISTING_B))


def game_b(slug, start, first, second, league="MLB", long=0):
    sides = [{"long": i == long, "team": {"name": n, "abbreviation": a, "league": league}} for i, (n, a) in enumerate((first, second))]
    return {"slug": slug, "question": f"{first[0]} vs. {second[0]}", "marketType": "moneyline", "gameStartTime": start, "marketSides": sides}


def test_game_start(spark):
    cases = {
        "26JUL081845HARWIL": datetime(2026, 7, 8, 22, 45), "26SEP14ELKOAK": datetime(2026, 9, 14, 4), "26FEB30AB": None, "26JUL082545AB": None, "26JUL08": None,
        "x": None, None: None, "26MAR080230AB": datetime(2026, 3, 8, 7, 30), "26NOV010130AB": datetime(2026, 11, 1, 5, 30),
    }
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", venues.game_start(F.col("s")).alias("t")).collect()
    assert {r.s: r.t and r.t.astimezone(UTC).replace(tzinfo=None) for r in got} == cases


def test_listing_a(spark):
    rows = listing_a(
        spark,
        ("Finals: Harbor vs. Willow 2: Moneyline", ("KXMLBGAME-26JUL081845HARWIL-HAR", "Harbor"), ("KXMVE-1", "x"), ("KXMLBGAME-1-A", "Harbor", {"yes_ask_dollars": None})),
        ("Open Winner", ("KXPGA-OPEN-TOMO", "Tomas Orná"), ("KXPGA-OPEN-N", "Nora"), ("KXPGA-OPEN-D", "Ann", {"expiration_time": "", "close_time": None})),
    ).collect()
    assert [r.id for r in rows] == ["a:KXMLBGAME-26JUL081845HARWIL-HAR", "a:KXPGA-OPEN-TOMO", "a:KXPGA-OPEN-N"]
    assert rows[0].event.competitors == ["Harbor", "Willow"] and rows[0].event.yes_abbrev == "har" and rows[0].futures is None
    assert rows[1].event is None and rows[1].futures.entity == "Tomas Orná" and rows[1].futures.competition == "Open Winner"
    assert rows[2].futures is None and rows[2].yes_bid == 0.40


def test_listing_b(spark):
    cut = 'This market resolves to "Yes" if Spain wins the cup, scheduled for July. More.'
    rows = listing_b(
        spark, game_b("g", "2026-07-08T22:45:00Z", ("Harbor Larks", "HAR"), ("Willow Rams", "WIL"), "T20x"),
        {"slug": "f-spa", "marketType": "futures", "title": "Spain", "question": "Cup Winner", "description": cut}, {"slug": "bad", "outcomes": "no json"},
        {"slug": "shut", "closed": True}, {"slug": "q", "question": "Rain?"},
    ).collect()
    assert [r.id for r in rows] == ["b:g", "b:f-spa", "b:q"]
    assert rows[0].question == "Will Harbor Larks win Harbor Larks vs. Willow Rams?" and rows[0].event.league == "cricket" and rows[0].aliases == ["Harbor Larks vs. Willow Rams"]
    assert rows[1].question == "Spain wins the cup" and rows[1].aliases == ["Cup Winner"] and rows[1].futures.entity_abbrev == "spa"
    assert rows[2].question == "Rain?" and rows[2].aliases == []


def test_books(spark):
    a = venues.books_a(spark.createDataFrame(
        [("t", [["0.40", "5"]], [["0.50", "200"], ["0.55", "80"]]), ("e", None, None)],
        "ticker string, yes_dollars array<array<string>>, no_dollars array<array<string>>",
    )).collect()
    assert [tuple(x) for x in a[0].yes_depth] == [(0.45, 80.0), (0.5, 200.0)] and a[0].yes_bid == 0.4 and a[0].no_bid == 0.55 and a[1].yes_depth == [] and a[1].yes_bid is None
    level = "array<struct<px:struct<value:string,currency:string>,qty:string>>"
    b = venues.books_b(spark.createDataFrame([("s", [(("0.409", "$"), "62"), (("0.400", "$"), "320")], [(("0.42", "$"), "7")])], f"marketSlug string, bids {level}, offers {level}")).first()
    assert [tuple(x) for x in b.no_depth] == [(0.591, 62.0), (0.6, 320.0)] and b.yes_bid == 0.409 and b.no_bid == 0.58


def test_match_games(spark):
    a = listing_a(
        spark,
        ("Harbor vs Willow", ("KXMLBGAME-26JUL081845HARWIL-HAR", "Harbor"), ("KXMLBGAME-26JUL081845HARWIL-WIL", "Willow")),
        ("Stone vs Finch", ("KXWTAMATCH-26JUL08STOFIN-STO", "Ada Stone")),
        ("Yarn vs Yarn", ("KXNBAGAME-26JUL08YARYAR-YAR", "Yarn")),
    )
    b = listing_b(
        spark,
        game_b("swapped", "2026-07-08T22:45:00Z", ("Willow Rams", "WIL"), ("Harbor Larks", "HAR"), long=1),
        game_b("late", "2026-07-12T22:45:00Z", ("Willow Rams", "WIL"), ("Harbor Larks", "HAR")),
        game_b("unlisted", "2026-07-08T15:00:00Z", ("Bea Finch", "FIN"), ("Ada Stone", "STO"), "WTA"),
        game_b("peg", "2026-07-08T15:00:00Z", ("Bea Finch", "FIN"), ("Ada Stone", "STO"), "WTA", 1),
        game_b("derby", "2026-07-08T15:00:00Z", ("Yarn", "Y1"), ("Yarn City", "Y2"), "NBA"),
        game_b("other", "2026-07-08T22:45:00Z", ("Old Town Jays", "OTJ"), ("Harbor Larks", "HAR")),
    )
    got = {(r.a_id, r.b_id): (r.score, r.delta_days) for r in resolution.match_games(a, b).collect()}
    assert got == {("a:KXMLBGAME-26JUL081845HARWIL-HAR", "b:swapped"): (0.85, 11), ("a:KXWTAMATCH-26JUL08STOFIN-STO", "b:peg"): (0.85, 11)}


def test_match_outrights_and_tiers(spark):
    a = listing_a(spark, ("2026 Lake Open Winner", ("KXPGA-1-TOM", "Tomas Orná"), ("KXPGA-1-KV", "Kim Vale")), ("Tour Stage 9 Winner", ("KXT-9-OR", "Ono Reef")))
    future = lambda slug, who, where, **k: {"slug": slug, "title": who, "question": where, "marketType": "futures"} | k
    b = listing_b(
        spark, future("x-tom", "Tomas Orna", "Lake Open Winner"), future("y-kv", "Kim Vale", "Lake Open Winner"), future("z-kv", "Kim Vale", "Lake Open Winner"),
        future("t", "Ono Reef", "Tour Winner"), future("far", "Tomas Orna", "Lake Open Winner", endDate="2027-07-22T00:00:00Z"),
    )
    assert {(r.a_id, r.b_id, r.score) for r in resolution.match_outrights(a, b).collect()} == {("a:KXPGA-1-TOM", "b:x-tom", 1.0)}
    assert [(r.a_id, r.tier, r.method) for r in resolution.match_all(a, b).collect()] == [("a:KXPGA-1-TOM", 1, "futures")]


def test_match_questions(spark):
    a = listing_a(spark, (None, ("R-1", "x", {"title": "Will hail in Marl exceed 40 mm in July?"}), ("R-2", "x", {"title": "Will snow fall?"})))
    b = listing_b(
        spark, {"slug": "p", "question": "Will hail in Marl exceed 40 mm in July"}, {"slug": "q", "question": "Marl hail"},
        {"slug": "r", "question": "Hail in Marl?", "description": "Will hail in Marl exceed 40 mm in July? Yes."},
        {"slug": "s", "question": "Will hail in Marl exceed 40 mm in July", "endDate": "2027-01-01"},
    )
    got = {r.b_id: r for r in resolution.match_questions(a, b, days=11).collect()}
    assert set(got) == {"b:p", "b:r"} and got["b:r"].score == 1.0 and got["b:r"].delta_days == 11 and got["b:p"].score == round(0.5 + 0.5 * 76 / 77, 4)


def test_match_questions_by_brute_force(spark):
    import difflib
    import re

    rng = random.Random(15)
    words = "rain snow frost hail wind storm marl dover june july exceed reach".split()
    ask = lambda: "Will " + " ".join(rng.sample(words, rng.randrange(2, 6))) + rng.choice(["?", ".", ""])
    row = lambda i, n: (f"k{i}", ask() if i % 17 else "", [ask() for _ in range(n)], datetime(2026, 1, 1 + i % 25), None, None, i)
    left, right = [row(i, 0) for i in range(60)], [row(i, rng.randrange(3)) for i in range(60)]
    right[5] = (*right[5][:3], None, *right[5][4:])
    tokens = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 1 and w != "will"}
    count = Counter(w for r in right for w in set().union(*(tokens(t) for t in [r[1], *r[2]])))
    want = {}
    for a in left:
        for b in right:
            texts = [t for t in [b[1], *b[2]] if t]
            if b[3] is None or abs((a[3] - b[3]).days) > 10 or not any(count[w] <= 30 for t in texts for w in tokens(a[1]) & tokens(t)):
                continue
            found = []
            for at, t in enumerate(texts):
                x, y = tokens(a[1]), tokens(t)
                jaccard = len(x & y) / len(x | y) if x | y else 0.0
                if jaccard >= 0.3:
                    found.append((-(0.5 * jaccard + 0.5 * difflib.SequenceMatcher(None, a[1].lower(), t.lower()).ratio()), at, t))
            if found and -min(found)[0] >= 0.65:
                want[a[0], b[0]] = (round(-min(found)[0], 4), min(found)[2], abs((a[3] - b[3]).days))
    kinds = "id string, question string, aliases array<string>, resolution timestamp, event string, futures string, ord long"
    got = resolution.match_questions(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds), threshold=0.65, max_df=30)
    assert {(r.a_id, r.b_id): (r.score, r.b_question, r.delta_days) for r in got.collect()} == want and len(want) > 10


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.75, 0.8, 0.9])
def test_match_questions_without_a_limit(spark, monkeypatch, threshold):
    """No word is too frequent to meet by, whatever rows have a text and however far their days lie apart."""
    import difflib
    import re

    monkeypatch.setattr(resolution, "BLOCK", 3)
    rng = random.Random(round(threshold * 100))
    words = "rain snow frost hail wind storm marl dover".split()
    asked = ["Will " + " ".join(rng.sample(words, rng.randrange(1, 6))) + rng.choice(["?", ".", ""]) for _ in range(30)] + ["Will it?", "", None]
    row = lambda i, n: (f"k{i}", rng.choice(asked), rng.sample(asked[:-1], n), rng.choice([None, *[datetime(2026, 1, 1 + d, h) for d in (0, 3, 14, 27) for h in (0, 9)]]), None, None, i)
    left, right = [row(i, 0) for i in range(120)], [row(i, rng.randrange(3)) for i in range(60)]
    right += [(f"s{i}", asked[0], [], datetime(2026, 1, 4), None, None, i) for i in range(20)]
    tokens = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1 and w not in ("will", "it")}
    want = Counter()
    for a in left:
        for b in right:
            texts = [t for t in [b[1], *b[2]] if t]
            x = tokens(a[1])
            if a[3] is None or b[3] is None or abs((a[3] - b[3]).days) > 10 or not any(x & tokens(t) for t in texts):
                continue
            found = []
            for at, t in enumerate(texts):
                jaccard = len(x & tokens(t)) / len(x | tokens(t))
                found.append((-(0.5 * jaccard + 0.5 * difflib.SequenceMatcher(None, a[1].lower(), t.lower()).ratio()), at, t))
            if -min(found)[0] >= threshold:
                want[a[0], b[0], a[1], min(found)[2], round(-min(found)[0], 4), abs((a[3] - b[3]).days)] += 1
    kinds = "id string, question string, aliases array<string>, resolution timestamp, event string, futures string, ord long"
    got = resolution.match_questions(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds), threshold=threshold)
    assert Counter((r.a_id, r.b_id, r.a_question, r.b_question, r.score, r.delta_days) for r in got.collect()) == want and len(want) > 20


def test_questions_of_frequent_words(spark):
    """Words that more than 2,000 markets have are words to meet by."""
    rows = spark.range(2_600).select(
        F.concat(F.lit("k"), F.col("id")).alias("id"), F.when(F.col("id") % 2 == 0, "Will rain reach Marl?").otherwise("Will snow reach Dover?").alias("question"), F.array().cast("array<string>").alias("aliases"),
        F.timestamp_micros(F.lit(0)).alias("resolution"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("futures"), F.col("id").alias("ord"),
    )
    rows = rows.unionByName(rows.withColumn("id", F.concat(F.lit("l"), "ord")))
    got = resolution.match_questions(rows.filter("ord < 3 and id like 'k%'"), rows).collect()
    assert Counter((r.a_id, r.b_question, r.score) for r in got) == {("k0", "Will rain reach Marl?", 1.0): 2600, ("k1", "Will snow reach Dover?", 1.0): 2600, ("k2", "Will rain reach Marl?", 1.0): 2600}


def test_level_states(spark):
    rng = random.Random(1)
    rows, want, book, last, on = [], {}, {}, None, 0
    for i in range(400):
        on += 1 + (rng.random() < 0.01)
        kind = rng.choice(["snapshot", *["delta"] * 20, "ack"])
        ticker, side, price = rng.choice("xy"), rng.choice(["yes", "no", "odd"]), rng.choice(["0.3", "0.30", "0.4", None])
        levels = [["0.3", str(rng.randint(1, 9))], ["0.4", "2.5"]] if kind == "snapshot" else None
        change = str(rng.randint(-6, 6))
        rows.append(("c", i, on, kind, ticker, levels, None, side, price, change))
        if kind == "ack":
            on -= 1
            rows[-1] = ("c", i, None, *rows[-1][3:])
            continue
        if last is not None and on != last + 1:
            book, last = {}, on
            continue
        last = on
        if kind == "snapshot":
            book = {k: v for k, v in book.items() if k[0] != ticker} | {(ticker, "yes", p): float(s) for p, s in levels}
        elif side != "odd" and price:
            size = book.get((ticker, side, price), 0.0) + float(change)
            book[ticker, side, price] = size
            if size <= 1e-9:
                del book[ticker, side, price]
            want[i] = max(size, 0.0)
    kinds = "conn string, ord long, seq long, type string, ticker string, yes array<array<string>>, no array<array<string>>, side string, price string, delta string"
    messages = spark.createDataFrame(rows, kinds)
    states = {r.ord: r.size for r in books.level_states(messages).collect() if rows[r.ord][3] == "delta"}
    assert states == want
    narrow = sorted(map(tuple, books.epochs(messages, 7).select("ord", "epoch").collect()))
    assert narrow == sorted(map(tuple, books.epochs(messages).select("ord", "epoch").collect())) and narrow[-1][1] > 0
    assert {(r.ticker, r.side, r.price): r.size for r in books.last_books(messages).collect()} == book


def test_evaluate(spark):
    level = lambda key, leg, side, p, n: (key, leg, side, p, float(n))
    rows = [level(1, "a", "YES", 4000, 100), level(1, "b", "NO", 5500, 100), level(1, "b", "YES", 9000, 1), level(1, "a", "NO", 9000, 1)]
    rows += [level(2, "a", "YES", 4900, 10), level(2, "b", "NO", 5000, 10), level(3, "a", "YES", 6000, 5), level(3, "b", "NO", 5000, 5), level(4, "a", "YES", 100, 5)]
    df = spark.createDataFrame(rows, "key int, leg string, side string, price long, size double")
    got = {r.key: r for r in depth.evaluate(df).collect()}
    assert set(got) == {1, 2}
    assert (got[1].direction, got[1].size, round(got[1].net, 4)) == (0, 100, round(1 - 0.4 - 0.55 - 0.0168 - 0.0124, 4))
    assert got[2].size == 0 and round(got[2].raw_top, 4) == 0.01 == round(got[2].raw_depth, 4) and got[2].net < 0
    assert {r.key for r in depth.evaluate(df, require_edge=False).collect()} == {1, 2, 3}


def heartbeat(rows):
    last, out = {}, []
    for a, b, us, size, edge, method in sorted(rows, key=lambda r: (r[:3], r[4], r[3])):
        t, e = last.get((a, b), (None, None))
        if (size > 0 or (method == "structured" and edge != e)) and (t is None or us - t >= throttle.HEARTBEAT_US):
            out.append((a, b, us, size, edge, method))
            last[a, b] = us, edge
    return sorted(out)


def evaluations(n):
    rng = random.Random(2)
    return [(rng.choice("uvw"), "b", 1_000_000 * i, rng.choice([0, 0, 5]), rng.choice([10, 20]), rng.choice(["structured", "lexical"])) for i in range(n)]


def test_average_fill(spark):
    rows = [(1, 4000, 50.0), (1, 4500, 100.0), (2, 4000, 0.5), (2, 4500, 0.5), (3, 4000, 50.0), (None, 100, 90.0), (3, 4000, 30.5)]
    df = spark.createDataFrame(rows, "key int, price long, size double")
    at = lambda n: {r.key: r.average for r in depth.average_fill(df, ["key"], n).collect()}
    assert at(80) == {1: 4187.5, 2: None, 3: 4000.0, None: 100.0}
    assert at(1)[2] == 4250.0 and set(at(0).values()) == {None}
    assert depth.average_fill(df.limit(0), ["key"], 1).count() == 0


def units(levels):
    return [p for p, n in sorted(levels) for _ in range(int(n))]


def ticks_fee(c, p):
    n = c * p * (10000 - p)
    q, r = divmod(n, 1_000_000)
    return q + (2 * r > 1_000_000 or (2 * r == 1_000_000 and q % 2 == 1))


def test_hedges_by_walking_units(spark):
    rng, rows = random.Random(3), []
    for key in range(150):
        for side in ("YES", "NO"):
            rows += [(key, side, rng.choice([rng.randrange(3000, 5600), 4000, 5000]), rng.choice([0.0, 0.4, 1.0, 2.5, 7.0, 40.0])) for _ in range(rng.randrange(6))]
    rows += [(200, "YES", 3000, 2000.0), (200, "NO", 3000, 2000.0), (201, "YES", None, 5.0), (201, "NO", 100, 5.0)]
    want = {}
    for key in {r[0] for r in rows}:
        legs = [[(p, n) for k, s, p, n in rows if k == key and s == side and p is not None] for side in ("YES", "NO")]
        sums = [0, 0, 0, 0]
        for n, (y, x) in enumerate(zip(*map(units, legs), strict=False), 1):
            if n > 1000:
                break
            sums = [a + b for a, b in zip(sums, (y, x, ticks_fee(7, y), ticks_fee(5, x)), strict=True)]
            if 10000 * n - sum(sums) > 100 * n:
                want[key] = (n, *sums)
    df = spark.createDataFrame(rows, "key int, side string, price long, size double")
    got = {r.key: tuple(r)[1:] for r in depth.largest_viable(df, ["key"], F.lit(7), F.lit(5)).collect()}
    assert got == want and got[200][0] == 1000 and len(want) > 30


def test_fees_by_platform(spark):
    fees = spark.createDataFrame([("a", 5000), ("b", 5000), ("b", 4200)], "platform string, p long").select(
        economics.taker_fee_ticks(F.col("platform"), F.col("p")).alias("f"), economics.maker_rebate_ticks(F.col("p")).alias("m"),
    )
    assert [tuple(r) for r in fees.collect()] == [(175, -31), (125, -31), (122, -30)]
    for bad in ("c", None):
        with pytest.raises(Exception, match="no fee for platform"):
            spark.createDataFrame([(bad, 1)], "platform string, p long").select(economics.taker_fee_ticks(F.col("platform"), F.col("p"))).collect()
    n = [(a, b) for a in (-7, -5, -3, -1, 0, 1, 3, 5, 15, 25) for b in (2, 3, 10)]
    got = spark.createDataFrame(n, "n long, d long").select("n", "d", economics.divided(F.col("n"), F.col("d")).alias("q")).collect()
    assert all(r.q == round(Fraction(r.n, r.d)) for r in got)


def test_pages(spark, tmp_path):
    market = {"ticker": "T"}
    page = lambda run, n, cursor, k: {"run": run, "page": n, "cursor": cursor, "events": [{"title": f"{n}.{i}", "markets": [market]} for i in range(k)]}
    found = [
        page("r", 0, "c1", 2), page("r", 1, "c2", 1), page("r", 2, "", 1), page("r", 3, "c4", 1), page("stuck", 0, "c", 1), page("stuck", 1, "c", 1),
        page("stuck", 2, "d", 1), page("bare", 0, "x", 0), page("bare", 1, "y", 1), page("end", 0, None, 1), page("end", 1, "y", 1),
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, found)) + "\nno json\n")
    rows = pages.listing_a(pages.read_pages(spark, str(tmp_path / "a.json"), pages.PAGE_A)).orderBy("run", "ord").collect()
    assert [(r.run, r.title) for r in rows] == [("end", "0.0"), ("r", "0.0"), ("r", "0.1"), ("r", "1.0"), ("r", "2.0"), ("stuck", "0.0"), ("stuck", "1.0")]
    assert rows[2].ord == 1 and rows[3].ord == 1 << 32 and rows[0].markets[0].ticker == "T"
    found = [{"run": "r", "page": n, "markets": [{"slug": f"{n}.{i}"} for i in range(k)]} for n, k in enumerate((3, 3, 2, 3))]
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, found)))
    rows = pages.listing_b(pages.read_pages(spark, str(tmp_path / "b.json"), pages.PAGE_B), page_size=3)
    assert sorted(r.slug for r in rows.collect()) == ["0.0", "0.1", "0.2", "1.0", "1.1", "1.2", "2.0", "2.1"]
    assert venues.markets_b(rows).count() == 0
    lines = spark.createDataFrame([("t", '{"orderbook_fp": {"yes_dollars": [["0.4", "5"]]}}'), ("u", "<html>"), ("v", None), ("w", "{}")], "id string, value string")
    assert {r.id: r.book and r.book.orderbook_fp.yes_dollars for r in pages.replies(lines).collect()} == {"t": [["0.4", "5"]], "u": None, "v": None, "w": None}
    messages = spark.createDataFrame([("x", 1), ("y", 2)], "marketSlug string, us long")
    assert [r.marketSlug for r in pages.known_only(messages, spark.createDataFrame([("y",), ("y",)], "slug string")).collect()] == ["y"]
    assert pages.book_of(lines, "u").count() == 1 and pages.book_of(lines, "none").count() == 0


def test_detector(spark):
    c = spark.createDataFrame(
        [("a:1", "b:x:1", "q", "p", 0.9, "lexical"), ("a:2", "b:y", "q", "p", 0.8, "futures"), ("a:3", "b:y", "q", "p", 0.8, "lexical"), ("a:4", "b:none", "q", "p", 0.7, None)],
        "a_id string, b_id string, a_question string, b_question string, score double, method string",
    )
    level = "array<struct<price:double,size:double>>"
    book = lambda i, y, n, us=0: (i, [(y, 10.0)], [(n, 10.0)], us)
    a = spark.createDataFrame(
        [book("a:1", 0.4, 0.9), book("a:2", 0.5, 0.6), book("a:3", 0.2, 0.2, -5_000_000), book("a:4", 0.1, 0.1)],
        f"id string, yes_depth {level}, no_depth {level}, updated_us long",
    )
    b = spark.createDataFrame([book("b:x:1", 0.9, 0.5), book("b:y", 0.3, 0.4)], a.schema)
    pairs = detector.paired(c, a, b)
    assert {(r.a_id, r.edge) for r in detector.edges(pairs).collect()} == {("a:1", 1000), ("a:2", 1000), ("a:3", 5000)}
    assert [r.edge for r in detector.extreme_edges(detector.edges(pairs), 2).collect()] == [5000]
    found = detector.opportunities(pairs)
    assert sorted((r.a_id, r.direction, r.size) for r in found.collect()) == [("a:1", 0, 10), ("a:2", 0, 10), ("a:2", 1, 10), ("a:3", 0, 10), ("a:3", 1, 10)]
    assert {r.a_id for r in detector.opportunities(pairs, now_us=0, max_seconds=2.0).collect()} <= {"a:1", "a:2"}
    assert [r.a_id for r in detector.best_opportunities(found, 2).collect()][0] == "a:3"
    assert tuple(detector.distinct_keys(c).first()) == (4, 4, 3)
    assert {r.method: r.n for r in detector.by_method(c).collect()} == {"lexical": 2, "futures": 1, None: 1}
    assert [r.a_id for r in detector.top_candidates(c, 3).collect()] == ["a:1", "a:2", "a:3"]
    assert sorted((r.id, r.leg, r.a_id) for r in detector.index(c).filter("id = 'b:y'").collect()) == [("b:y", "b", "a:2"), ("b:y", "b", "a:3")]
    assert detector.needed(b, c).count() == 2 and detector.both_venues(a, b).count() == 6
    assert [r.us for r in detector.first_books(spark.createDataFrame([("s", 5, 0), ("s", 3, 1), ("s", 3, 0)], "id string, us long, ord long")).collect()] == [3]
    assert detector.opportunities(pairs.limit(0)).count() == 0
    keys = spark.createDataFrame([("a:x:y",), ("none",), (None,)], "i string").select(detector.key_of(F.col("i")).alias("k"), detector.venue_of(F.col("i")).alias("v")).collect()
    assert [r.k for r in keys] == ["x:y", None, None] and keys[0].v == "a"


def test_replay_of_null_keys_ties_and_empty_tables(spark):
    rows = [(None, 0, 5, 1, 10), (None, 1, 5, 2, 20), (1, 0, None, 3, 30), (1, 0, 7, 4, 40), (1, 1, 8, 5, 50), (1, 1, 8, 5, 50)]
    df = spark.createDataFrame(rows, "k long, venue int, us long, id long, v long")
    pairs = {(r.k, r.id): (r.a, r.b) for r in replay.as_of(df, "k", "venue", "us", "id", "v", 10).collect()}
    assert pairs == {(None, 2): (10, 20), (1, 5): (40, 50)}
    assert sorted((r.k or 0, r.samples) for r in replay.sessions(df.filter("us is not null"), "k", "us", 10, "v", "id").collect()) == [(0, 2), (1, 3)]
    assert {r.k: r.v for r in replay.latest(df, "k", ["us", "id"], ["v"]).collect()} == {None: 20, 1: 50}
    assert tuple(replay.funnel(df, "k", {"a": F.col("v") > 20}).first()) == (2, 1)
    assert {r.k: (r.n, r.q1_x4) for r in replay.exclusive_quartiles(df, "k", "v").collect()} == {None: (2, None), 1: (4, 130)}
    none = df.limit(0)
    assert replay.as_of(none, "k", "venue", "us", "id", "v", 10).count() == replay.sequence_gaps(none, "k", "us").count() == replay.exclusive_quartiles(none, "k", "v").count() == 0
    assert tuple(replay.funnel(none, "k", {"a": F.col("v") > 20}).first()) == (0, 0)
    best = lambda t: matching.best_or_refuse(t, "k", F.col("v"), F.lit(0.0), "id", 0.0)
    assert [(r.k, r.id) for r in best(df.dropDuplicates()).collect()] in ([(None, 2), (1, 5)], [(1, 5), (None, 2)]) and best(none).count() == 0


KINDS = "conn string, ord long, us long, seq long, type string, ticker string, yes array<array<string>>, no array<array<string>>, side string, price string, delta string"


def random_messages(n, seed=5, conns="pq"):
    """Messages of several connections in order of time: gaps, snapshots, unusable deltas, tickers that are null."""
    rng, rows, on = random.Random(seed), [], dict.fromkeys(conns, 0)
    for i in range(n):
        for conn in conns:
            on[conn] += 1 + (rng.random() < 0.03)
            kind = rng.choice(["snapshot", *["delta"] * 9])
            levels = [["0.30", str(rng.randint(0, 9))], ["0.4", "2.5"]][: rng.randint(0, 2)] if kind == "snapshot" else None
            rows.append((conn, i, 1_000_000 * (i + 1), on[conn], kind, rng.choice(["x", "y", "y", None]), levels, None, rng.choice(["yes", "no", "odd"]), rng.choice(["0.3", "0.30", None]), str(rng.randint(-6, 6))))
    return rows


def kept_books(rows):
    """(conn, ord) to ticker and sides after each message that gives a book, and the last books of each connection."""
    want, books, last = {}, {}, {}
    for conn, ord_, _, seq, kind, ticker, yes, _, side, price, delta in rows:
        gap = conn in last and seq != last[conn] + 1
        last[conn] = seq
        if gap:
            books[conn] = {}
        elif ticker and (kind == "snapshot" or (side != "odd" and price)):
            book = books.setdefault(conn, {}).setdefault(ticker, {})
            if kind == "snapshot":
                book.clear()
                book |= {("yes", p): float(z) for p, z in yes}
            else:
                size = book.pop((side, price), 0.0) + float(delta)
                book |= {(side, price): size} if size > 1e-9 else {}
            want[conn, ord_] = (ticker, *({p: z for (s, p), z in book.items() if s == side} for side in ("yes", "no")))
    return want, {(c, t, s, p): z for c, of in books.items() for t, book in of.items() for (s, p), z in book.items()}


def in_files(spark, rows, schema, folder, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("overwrite").json(f"{folder}/k={k}")


def run_books(spark, tmp_path, name, **options):
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    books_ = stream_books.book_stream(stream, **options)
    query = books_.writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    read = spark.read.schema("conn string, ticker string, ord long, us long, at timestamp, yes array<array<string>>, no array<array<string>>").json(f"{tmp_path}/out")
    return query, {(r.conn, r.ord): (r.ticker, {p: float(z) for p, z in r.yes}, {p: float(z) for p, z in r.no}) for r in read.collect()}


def test_book_stream(spark, tmp_path):
    """Equal to a replay, over micro-batches and a restart; messages that come again do nothing."""
    stream_books.state_store(spark)
    rows = random_messages(120)
    want, newest = kept_books(rows)
    cuts = [range(0, 80), range(60, 160)]
    in_files(spark, rows, KINDS, tmp_path / "in", cuts)
    run_books(spark, tmp_path, "first")
    spark.createDataFrame(rows[160:], KINDS).coalesce(1).write.json(f"{tmp_path}/in/k=2")
    query, got = run_books(spark, tmp_path, "again")
    assert got == want and len(want) > 80
    messages = spark.createDataFrame(rows, KINDS)
    assert {(r.conn, r.ticker, r.side, r.price): r.size for r in books.last_books(messages).collect()} == newest
    # The state holds a row for each level and one head a book, and one row a connection.
    progress = [p.numRowsTotal for p in query.lastProgress.stateOperators]
    levels = spark.read.format("statestore").option("stateVarName", "levels").option("operatorId", 0).load(f"{tmp_path}/state")
    assert levels.count() <= len(newest) + 4 and len(progress) == 2


def test_book_stream_writes_changed_levels_only(spark, tmp_path):
    stream_books.state_store(spark)
    wide = [[f"0.{i:03}", "5"] for i in range(1, 400)]
    rows = [("c", 0, 1, 1, "snapshot", "x", wide, None, None, None, None)] + [("c", i, i + 1, i + 1, "delta", "x", None, None, "yes", "0.007", "1") for i in range(1, 6)]
    in_files(spark, rows, KINDS, tmp_path / "in", [range(0, 1), range(1, 6)])
    query, got = run_books(spark, tmp_path, "levels")
    assert got["c", 5][1]["0.007"] == 10 and len(got["c", 5][1]) == 399
    updated = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.numInputRows]
    assert updated[0] > 390 and updated[1] < 10


def test_book_stream_of_closed_and_late_markets(spark, tmp_path):
    """A book without messages leaves the state; a message behind the watermark is a gap of its connection."""
    stream_books.state_store(spark)
    second = 1_000_000
    rows = [("c", 0, 1, 1, "snapshot", "x", [["0.3", "5"]], None, None, None, None), ("d", 0, 1, 1, "snapshot", "y", [["0.4", "6"]], None, None, None, None)]
    rows += [("c", 10 + i, (100 * i + 1) * second, 2 + i, "delta", "z", None, None, "yes", "0.5", "1") for i in range(12)]
    # Too late: it is left out, and the next number of d shows the gap.
    rows += [("d", 1, second, 2, "delta", "y", None, None, "yes", "0.4", "1"), ("d", 2, 1200 * second, 3, "delta", "y", None, None, "yes", "0.4", "1")]
    rows += [("d", 3, 1201 * second, 4, "delta", "y", None, None, "yes", "0.4", "2"), ("c", 90, 1201 * second, 14, "delta", "x", None, None, "no", "0.1", "3")]
    in_files(spark, rows, KINDS, tmp_path / "in", [range(0, 2), range(2, 8), range(8, 14), range(14, 16), range(16, 18)])
    query, got = run_books(spark, tmp_path, "closed", delay="10 seconds", idle_seconds=300)
    # x went after 300 s without messages, so its last delta starts from nothing; d's state went as well, so number 3 is its first.
    assert got["c", 90] == ("x", {}, {"0.1": 3.0}) and got["c", 21][1] == {"0.5": 12.0}
    assert ("d", 1) not in got and got["d", 3] == ("y", {"0.4": 3.0}, {})
    only = stream_books.book_stream(spark.readStream.schema(KINDS).json(f"{tmp_path}/in/*"), spark.createDataFrame([("z",)], "ticker string"))
    query = only.writeStream.format("memory").queryName("only_z").option("checkpointLocation", f"{tmp_path}/only").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.ticker for r in spark.table("only_z").collect()} == {"z"}


def test_live_path(spark, tmp_path):
    rng, rows = random.Random(7), []
    for i in range(240):
        leg = rng.choice("ab")
        key = rng.choice(["a:1", "a:2", "a:3"]) if leg == "a" else rng.choice(["b:1", "b:2", "b:9"])
        rows.append((key, 700_000 * (i + 1), [(rng.choice([0.40, 0.45, 0.50]), 5.0)], [(rng.choice([0.45, 0.50, 0.60]), 3.0)]))
    level = "array<struct<price:double,size:double>>"
    schema = f"id string, us long, yes_depth {level}, no_depth {level}"
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], schema).coalesce(1).write.json(str(tmp_path / "in" / f"k={k}"))
    pairs = [("a:1", "b:1", "structured"), ("a:2", "b:2", "futures"), ("a:3", "b:2", "structured")]
    candidates = spark.createDataFrame(
        [(a, b, "q", "p", 1.0, m, None) for a, b, m in pairs],
        "a_id string, b_id string, a_question string, b_question string, score double, method string, resolution_match boolean",
    )
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    stream_books.state_store(spark)
    counters = live.Counters()
    spark.streams.addListener(counters)
    sinks = live.live_sinks(*(str(tmp_path / x) for x in ("log", "latest", "last")), counters=counters)
    query = live.met(stream_books.timed(stream), candidates).writeStream.foreachBatch(sinks).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    books, last, want, newest = {}, {}, [], {}
    for key, us, yes, no in rows:
        books[key] = (us, yes[0][0], no[0][0])
        for a, b, method in pairs:
            if key not in (a, b) or a not in books or b not in books or abs(books[a][0] - books[b][0]) > 2_000_000:
                continue
            best = None
            for d, (y, n, cy, cn) in enumerate(((books[a][1], books[b][2], 7, 5), (books[b][1], books[a][2], 5, 7))):
                y, n = round(y * 10000), round(n * 10000)
                net = 10000 - y - n - ticks_fee(cy, y) - ticks_fee(cn, n)
                if best is None or net > best[0]:
                    best = (net, d, 3 if net > 100 else 0, 10000 - y - n)
            newest[a, b] = (us, best[2], best[1])
            t, e = last.get((a, b), (None, None))
            if (best[2] > 0 or (method == "structured" and best[3] != e)) and (t is None or us - t >= throttle.HEARTBEAT_US):
                want.append((a, b, us, best[2]))
                last[a, b] = us, best[3]
    when = lambda r: round(datetime.fromisoformat(r.timestamp).timestamp() * 1e6)
    got = [(r.a_id, r.b_id, when(r), r.size) for r in spark.read.schema(logs.RECORD).json(str(tmp_path / "log")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 4
    latest = {(r.a_id, r.b_id): (when(r), r.size, int(r.strategy == "YES_B_NO_A")) for r in live.latest_table(spark, str(tmp_path / "latest")).read().collect()}
    assert latest == newest
    spark.streams.removeListener(counters)
    met_ = sum(key in pair for key, *_ in rows for pair in pairs)
    assert counters.counts == {"updates": met_, "samples": len(want), "windows": sum(w[3] > 0 for w in want)}


def test_jaccard_join_by_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.sample(words[: rng.choice((6, 12, 30))], rng.randrange(0, 7)))) for i in range(200)] + [(None, "w1 w2"), (500, None), (501, "w1 w2"), (501, "w1 w2")]
    df = spark.createDataFrame(rows, "id long, text string")
    a, b = df.filter("id % 2 = 0 or id is null"), df.filter("id % 2 = 1 or id is null")
    sets = {i: set((t or "").split()) for i, t in rows}
    count = Counter(w for i in sets if i is not None and i % 2 for w in sets[i])
    for limit in (None, 25):
        want = set()
        for x in (i for i in sets if i is not None and i % 2 == 0):
            for y in (i for i in sets if i is not None and i % 2):
                both = sets[x] & sets[y]
                if both and len(both) * 100 >= 75 * len(sets[x] | sets[y]) and (limit is None or any(count[w] <= limit for w in both)):
                    want.add((x, y, len(both), len(sets[x] | sets[y])))
        assert {tuple(r) for r in matching.jaccard_join(a, b, 75, limit).collect()} == want and want
    assert matching.jaccard_join(a, b.limit(0), 75).count() == 0


def test_throttle(spark):
    rows = evaluations(600)
    assert sorted(map(tuple, throttle.logged(spark.createDataFrame(rows, throttle.SCHEMA)).drop("n").collect())) == heartbeat(rows)
    assert throttle.logged(spark.createDataFrame([(None, "b", 1, 1, 1, "x")], throttle.SCHEMA)).count() == 0


def plain_runs(rows, gap):
    """Samples and span of each run of a key, in order."""
    out, last = {}, {}
    for k, us in sorted(rows, key=lambda r: (r[0], r[1])):
        if k not in last or us - last[k] > gap:
            out.setdefault(k, []).append([0, us])
        out[k][-1] = [out[k][-1][0] + 1, out[k][-1][1], us]
        last[k] = us
    return sorted((k, i + 1, n, b - a) for k, runs in out.items() for i, (n, a, b) in enumerate(runs))


@pytest.mark.parametrize("width", [1, 50, 10**9])
def test_long_keys_in_buckets(spark, width):
    """As-of pairs, runs and order statistics are the same whatever buckets a key is cut into."""
    rng, rows = random.Random(width), []
    for i in range(400):
        rows.append((rng.choice(["hot", "hot", "hot", "b"]), rng.randint(0, 1), rng.randint(0, 3000), i, rng.choice([None, *range(40)]), "x"))
    df = spark.createDataFrame(rows, "k string, venue int, us long, id long, v long, _bucket string")
    got = replay.as_of(df, "k", "venue", "us", "id", "v", 40, width_us=width)
    want = []
    for k, _, us, i, _, _ in rows:
        seen = {}
        for k2, side, us2, i2, v, _ in rows:
            if k2 == k and v is not None and (us2, i2) <= (us, i):
                seen[side] = max(seen.get(side, (-1, -1, 0)), (us2, i2, v))
        if len(seen) == 2 and all(us - x[0] <= 40 for x in seen.values()):
            want.append((k, i, seen[0][2], seen[1][2]))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30
    runs = replay.sessions(df, "k", "us", 20, "v", "id", width_us=width).select("k", "session", "samples", "span_us")
    assert sorted(map(tuple, runs.collect())) == plain_runs([(r[0], r[2]) for r in rows], 20)
    stats = {r.k: (r.n, r.q1_x4, r.q3_x4) for r in replay.exclusive_quartiles(df, "k", "v", width=min(width, 50)).collect()}
    for k in ("hot", "b"):
        v = sorted(r[4] for r in rows if r[0] == k and r[4] is not None)
        n, at = len(v), lambda i: min(max((len(v) + 1) * i // 4, 1), len(v) - 1)  # noqa: B023
        quarter = lambda i: v[at(i) - 1] * (4 - (i * (n + 1) - 4 * at(i))) + v[at(i)] * (i * (n + 1) - 4 * at(i))  # noqa: B023, E731
        assert stats[k] == (n, quarter(1), quarter(3))


def test_a_long_key_is_many_tasks_work(spark):
    """No task orders more than a bucket of one key's rows."""
    df = spark.range(40_000).select(F.lit("one").alias("k"), (F.col("id") % 2).cast("int").alias("venue"), (F.col("id") * 1_000_000).alias("us"), "id", "id")
    df = df.toDF("k", "venue", "us", "id", "v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be put together again
    try:
        runs = replay.numbered_runs(df, ["k"], "us", 2_000_000).groupBy(F.spark_partition_id().alias("part")).count()
        counts = [r["count"] for r in runs.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) > 1 and max(counts) < 0.7 * sum(counts)


def test_windows_as_a_stream(spark, tmp_path):
    s, kind = 1_000_000, "a_id string, b_id string, us long, net long, size long, question string, resolution_match boolean"
    rows = [("a", "x", t * s, 5 + t % 3, 4, f"q{t}", None) for t in (1, 121, 242, 362, 1000, 1001)]
    rows += [("a", "y", 700 * s, 5, 0, "not viable", None), ("a", "y", 701 * s, -5, 4, "nor this", None), ("b", "x", 100 * s, 5, 4, "q", True), ("z", "z", 9000 * s, 1, 1, "closes all", None)]
    in_files(spark, sorted(rows, key=lambda r: r[2]), kind, tmp_path / "in", [range(0, 5), range(5, 9), range(9, 10)])
    log = stream_books.timed(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*"), "10 minutes")
    query = report.window_stream(log).writeStream.format("memory").queryName("windows_out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [tuple(r) for r in spark.table("windows_out").collect()]
    want = report.windows(spark.createDataFrame(rows[:-1], kind)).drop("window")
    # Samples exactly 120 s apart are of one window; the last window is open until the watermark has passed it.
    assert Counter(got) == Counter(map(tuple, want.collect())) and sorted(r[2] for r in got) == [1, 2, 2, 2]


def test_clashing_columns(spark):
    """Rows may have columns whose names are used inside the operators."""
    kind = "a_id string, b_id string, us long, raw_top long, raw_depth long, net long, yes_fee long, no_fee long, size long, question string, resolution_match boolean"
    log = spark.createDataFrame([("a", "x", 1, 1, 1, 1, 1, 1, 1, "q", None), ("a", "y", 2, 1, 1, 1, 1, 1, 1, "q", True)], kind)
    log = log.withColumns({c: F.lit("mine") for c in ("label", "known", "reviewed", "_reviewed", "_of_match", "fresh", "window", "session", "_bucket", "_at", "_k")})
    matches = spark.createDataFrame([("a", "x", True, 0, "l")], "a_id string, b_id string, resolution_match boolean, ord long, label string")
    [scoped] = report.in_scope(log, matches).collect()
    assert (scoped.b_id, scoped.label, scoped.resolution_match, scoped.known) == ("x", True, True, "mine")
    assert report.windows(log).count() == 2 and report.report(log, matches, matches).first().pairs == 1
    scored = spark.createDataFrame([(1, 2.0, 0.1, "mine", "r")], "k int, _score double, _tie double, _rank string, _row string")
    assert tuple(matching.best_or_refuse(scored, "k", F.col("_score"), F.col("_tie"), "k", 1.0).first()) == (1, 2.0, 0.1, "mine", "r")
    tier = spark.createDataFrame([("a", "b", 7, "x")], "a_id string, b_id string, _n int, _first string")
    assert tuple(matching.tier_dedupe([tier, tier], ["a_id", "b_id"]).first()) == ("a", "b", 7, "x", 0)
    gaps = spark.createDataFrame([("s", 1, "mine"), ("s", 3, "mine")], "k string, seq long, before string")
    assert [r.before for r in replay.sequence_gaps(gaps, "k", "seq").collect()] == [1]
    books_ = spark.createDataFrame([("a", "YES", 4000, 9.0, "mine"), ("a", "NO", 5000, 9.0, "mine")], "key string, side string, price long, size double, units string")
    assert depth.largest_viable(books_, ["key"], F.lit(7), F.lit(5)).count() == 1
    candidates = spark.createDataFrame([("a:1", "b:1", "x", "mine")], "a_id string, b_id string, id string, leg string")
    assert {(r[0], r[1]) for r in detector.index(candidates.drop("id", "leg")).collect()} == {("a:1", "a"), ("b:1", "b")}


def test_throttle_by_doubling(spark):
    """The path from the first row, for a pair over many hours, ties and equal rows."""
    rng, rows = random.Random(21), evaluations(400)
    us = 1
    for _ in range(500):
        us += rng.choice([0, 0, 1_000_000, 7_000_000, 29_000_000, 30_000_000, 31_000_000, 5_000_000_000])
        rows.append(("a:long", "b:long", us, rng.choice([0, 0, 0, 5]), rng.randint(1, 3), rng.choice(["structured", "structured", "lexical", None])))
    rows += [("a:one", "b", 5, 0, 1, "lexical"), ("a:two", "b", 5, 1, 1, "lexical"), (None, "b", 1, 1, 1, "x")]
    table = spark.createDataFrame(rows, throttle.SCHEMA)
    want = Counter(map(tuple, throttle.logged(table).collect()))
    assert Counter(map(tuple, throttle.logged_by_doubling(table).collect())) == want and want.total() > 60
    assert throttle.logged_by_doubling(table.limit(0)).count() == 0


def test_throttle_stream_and_sinks(spark, tmp_path):
    rows = evaluations(300)
    for i in range(3):
        spark.createDataFrame(rows[100 * i : 100 * i + 100], throttle.SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"k={i}"))
    stream = spark.readStream.schema(throttle.SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    out = throttle.logged_stream(stream).withColumn("timestamp", F.col("us").cast("string"))
    query = out.writeStream.foreachBatch(logs.stream_sinks(str(tmp_path / "log"), str(tmp_path / "latest"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.schema(throttle.SCHEMA).json(str(tmp_path / "log"))
    assert sorted(tuple(r)[:6] for r in got.collect()) == heartbeat(rows)


def test_files(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"a_id": "a:1", "b_id": "b:1", "method": m} for m in ("structured", "lexical")], indent=1))
    assert logs.read_candidates(spark, str(path)).count() == 2 and logs.read_candidates(spark, str(path), trusted=True).count() == 1
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.json").write_text("\n")
    with pytest.raises(ValueError):
        logs.read_log(spark, str(tmp_path / "l"))
    found = spark.sql("SELECT timestamp'2026-07-08 22:45:00.5' ts, 2L contracts, 8000L total_py, 10000L total_pn, 201L total_fy, 401L total_fn, 'a:1' a_id, 'b:1' b_id, 'q' question, 'structured' method, 0 direction, 3L size, 0.40001D yes_top, 0.5D no_top, 0.4D yes_fill, 0.5D no_fill, 0.1D raw_top, 0.1D raw_depth, 0.01D yes_fee, 0.02D no_fee, 0.07D net, true resolution_match")
    rows = logs.records(found, ("x", "y"))
    assert rows.columns == spark.createDataFrame([], logs.RECORD).columns
    logs.append_log(rows, str(tmp_path / "log"))
    got = logs.read_log(spark, str(tmp_path / "log")).first()
    assert (got.strategy, got.yes_top, got.timestamp) == ("YES_X_NO_Y", 0.4, "2026-07-08T22:45:00.500000+00:00")
    # 100.5 and 200.5 ticks go to the even ones, 1,398 / 2 is whole.
    assert (got.yes_fill, got.yes_fee, got.no_fee, got.raw_depth, got.net) == (0.4, 0.01, 0.02, 0.1, 0.0699)
    whole = logs.records(found.withColumn("ts", F.expr("timestamp'2026-01-01 00:00:00'"))).first()
    assert whole.timestamp == "2026-01-01T00:00:00+00:00"
    assert logs.read_candidates(spark, str(tmp_path / "none")).count() == logs.read_tracked(spark, str(tmp_path / "none")).count() == 0
    found = [{"a_id": f"a:{i}", "b_id": "b", "score": i / 4, "method": "lexical"} for i in (1, 3, 2)]
    logs.write_candidates(spark.createDataFrame(found, logs.CANDIDATE), str(tmp_path / "array"))
    whole = lambda name: json.loads("".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))))
    assert [x["a_id"] for x in whole("array")] == ["a:3", "a:2", "a:1"]
    many = [{"a_id": f"a:{i % 90}", "b_id": "b,", "score": i % 40 / 40, "method": "structured" if i % 2 else "x"} for i in range(500)]
    logs.write_candidates(spark.createDataFrame(many, logs.CANDIDATE).repartition(7), str(tmp_path / "many"))
    assert len(list((tmp_path / "many").glob("part-*"))) > 1
    assert [(x["a_id"], x["score"]) for x in whole("many")] == [(x["a_id"], x["score"]) for x in sorted(many, key=lambda x: (-x["score"], x["a_id"]))]
    back = logs.read_candidates(spark, str(tmp_path / "many"), trusted=True, by_line=True)
    assert Counter((r.a_id, r.score) for r in back.collect()) == Counter((x["a_id"], x["score"]) for x in many if x["method"] == "structured")
    logs.write_candidates(spark.createDataFrame([], logs.CANDIDATE), str(tmp_path / "no"))
    assert whole("no") == [] and logs.read_candidates(spark, str(tmp_path / "no"), by_line=True).count() == logs.read_candidates(spark, str(tmp_path / "nowhere"), by_line=True).count() == 0
    logs.write_latest(rows.union(rows), str(tmp_path / "latest"))
    assert spark.read.json(str(tmp_path / "latest")).count() == 1


def test_report(spark, tmp_path):
    s = 1_000_000
    log = [("a", "x", t * s, 100, 90, net, 5, 6, size, "q", None) for t, net, size in ((0, 10, 4), (120, 20, 8), (241, 30, 6), (400, -5, 0), (7200, 7, 10))]
    log += [("a", "y", 0, 50, -10, -20, 5, 7, 0, "r", True), ("a", "z", 9, -50, -60, -70, 5, 7, 0, "s", None)]
    rows = spark.createDataFrame(log, "a_id string, b_id string, us long, raw_top long, raw_depth long, net long, yes_fee long, no_fee long, size long, question string, resolution_match boolean")
    kind = "a_id string, b_id string, resolution_match boolean, ord long"
    none = spark.createDataFrame([("a", "x", None, 0), ("a", "w", None, 1)], kind)
    r = report.report(rows, none, none).first()
    assert (r.samples, r.span_hours, r.pairs, r.a_pct, r.b_pct, r.c_pct, r.tracked, r.ever_viable_pct) == (7, 2.0, 3, 66.7, 33.3, 33.3, 4, 25.0)
    assert (r.windows, r.single_sample, r.median_seconds, r.windows_per_hour) == (3, 2, 0.0, 1.5)
    assert (r.size_median, r.size_p25, r.size_p75) == (7.0, 4.5, 9.5)
    assert (r.avg_raw_top, r.avg_net, r.break_even, r.unreviewed_pct) == (92, 17, 111, 100.0)
    judged = spark.createDataFrame([("a", "x", False, 2), ("a", "y", True, 1), ("a", "v", None, 0)], kind)
    r = report.report(rows, judged, none).first()
    assert (r.pairs, r.a_pct, r.b_pct, r.windows, r.size_median, r.true_pct, r.diverged_pct) == (1, 100.0, 0.0, 0, None, 33.3, 33.3)
    # Of several labels the last one counts, even a null one.
    again = spark.createDataFrame([("a", "x", True, 0), ("a", "x", False, 1), ("a", "y", False, 2), ("a", "y", True, 3), ("a", "z", True, 4), ("a", "z", None, 5)], kind)
    assert {(x.b_id, x.label) for x in report.current_labels(again).collect()} == {("x", False), ("y", True), ("z", None)}
    assert {(x.b_id, x.resolution_match) for x in report.in_scope(rows, again).collect()} == {("y", True)}
    assert report.report(rows.limit(0), none.limit(0), none.limit(0)).first().samples == 0
    logs.write_report(report.report(rows, judged, none), report.windows(rows), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/report").count() == 1
    assert [x.best_net for x in logs.top_windows(report.windows(rows), 2).collect()] == [30, 20]
    assert [(w.samples, w.seconds) for w in sorted(report.windows(rows).collect(), key=lambda w: w.window)] == [(2, 120.0), (1, 0.0), (1, 0.0)]
