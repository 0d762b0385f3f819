"""What grows with copies and with size: rows that meet, rows of one task."""

import random
import time
from itertools import product

import pandas as pd
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crossbook.operators import depth, resolution
from crossbook.sources import logs
from crossbook.streaming import live, throttle


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.fixture
def ranked(monkeypatch):
    """How many pairs a matcher ranks."""
    seen, rank = [], resolution.best_or_refuse

    def counted(scored, *rest):
        seen.append(scored.count())
        return rank(scored, *rest)

    monkeypatch.setattr(resolution, "best_or_refuse", counted)
    return seen


_EVENT = "struct<league:string,start_time:timestamp,competitors:array<string>,yes_competitor:string,yes_abbrev:string>"


def games(spark, rows):
    """Rows: id, hour, two names, the market's name, its abbreviation."""
    table = spark.createDataFrame([(i, h, [x, y], yes, ab, n) for n, (i, h, x, y, yes, ab) in enumerate(rows)], "id string, h long, names array<string>, yes string, ab string, ord long")
    at = F.timestamp_micros(F.col("h") * 3_600_000_000)
    event = F.struct(F.lit("l").alias("league"), at.alias("start_time"), F.col("names").alias("competitors"), F.col("yes").alias("yes_competitor"), F.col("ab").alias("yes_abbrev")).cast(_EVENT)
    return table.select("id", F.lit("q").alias("question"), at.alias("resolution"), event.alias("event"), "ord")


def test_games_by_brute_force(spark):
    rng = random.Random(3)
    name = lambda: " ".join(rng.sample(["club", "red", "blue", "fox", "owl"], rng.randint(0, 3)))
    a, b = [], []
    for k in range(60):
        x, y = name(), name()
        a += [(f"a:G{k}-{i}", k % 3 * 24, x, y, (x, y)[i], rng.choice(["", "fx"])) for i in range(2)]
    for k in range(60):
        x, y = name(), name()
        b.append((f"b:{k}", rng.randint(0, 60), x, y, rng.choice([x, y]), rng.choice(["fx", "zz"])))

    def score(s, t):
        s, t = set(s.split()), set(t.split())
        return 0.0 if not s or not t else 1.0 if s == t else 0.85 if s <= t or t <= s else 0.0

    want = {}
    for i, h, x, y, yes, ab in b:
        found = []
        for k in range(60):
            one, two = a[2 * k], a[2 * k + 1]
            names, paid = one[2:4], {}
            for m in (one, two):
                fit = [score(n, m[4]) for n in names]
                if max(fit) >= 0.6:
                    paid[0 if fit[0] >= fit[1] else 1] = m
            s = {}
            for u, p in product((0, 1), (0, 1)):
                v, ours = score(names[u], (x, y)[p]), paid[u][5] if u in paid else ""
                s[u, p] = 1.0 if v > 0 and ours and (x, y)[p] == yes and ours == ab else v
            straight, swapped = s[0, 0] * s[1, 1], s[0, 1] * s[1, 0]
            if abs(one[1] - h) > 30 or max(straight, swapped) < 0.5 or abs(straight - swapped) <= 1e-9:
                continue
            found.append((-max(straight, swapped), abs(one[1] - h), f"a:G{k}", paid.get(0 if (straight >= swapped) == (x == yes) else 1)))
        found.sort(key=lambda f: f[:3])
        if found and not (len(found) > 1 and abs(found[0][0] - found[1][0]) <= 1e-9 and abs(found[0][1] - found[1][1]) <= 1) and found[0][3]:
            want[i] = found[0][3][0]
    got = {r.b_id: r.a_id for r in resolution.match_games(games(spark, a), games(spark, b)).collect()}
    assert got == want and len(want) > 3


def test_games_of_the_same_names_meet_once(spark, ranked):
    a = games(spark, [(f"a:G{k}-0", 0, "club red", "club fox", "club red", "") for k in range(40)] + [(f"a:H{k}-0", 0, f"club t{k}", f"club s{k}", f"club t{k}", "") for k in range(40)])
    b = games(spark, [(f"b:{k}", 1, "club red", "club fox", "club red", "") for k in range(40)] + [(f"b:h{k}", 1, f"club t{k}", f"club s{k}", f"club t{k}", "") for k in range(40)])
    got = {(r.a_id, r.b_id) for r in resolution.match_games(a, b).collect()}
    assert got == {(f"a:H{k}-0", f"b:h{k}") for k in range(40)}  # forty equal games can't be told apart
    assert ranked == [80]


def test_games_run_compiled_and_sort_by_numbers(spark):
    """Functions that Spark interprets for each row, and texts that begin alike as first keys, made a game cost 500 microseconds."""
    a = games(spark, [("a:G-0", 0, "club red", "club fox", "club red", "")])
    plan = resolution.match_games(a, a)._jdf.queryExecution().executedPlan().toString()
    assert "array_sort(" not in plan
    joins = [line for line in plan.splitlines() if "Join [" in line and "league" in line]
    assert joins and all("Join [_key" in line for line in joins)


def test_outrights_that_are_alike_are_ranked_once(spark, ranked):
    def side(s, rows):
        table = spark.createDataFrame([(f"{s}:{n}", *r, n) for n, r in enumerate(rows)], "id string, who string, what string, ord long")
        futures = F.struct(F.col("who").alias("entity"), F.col("what").alias("competition"))
        return table.select("id", F.lit("q").alias("question"), F.timestamp_micros(F.lit(0)).alias("resolution"), futures.alias("futures"), "ord")

    a = side("a", [("Kim Vale", "Lake Open")] * 30 + [("Tom Orn", "Lake Open")] * 30 + [(f"Club p{k}", "Hill Cup") for k in range(30)])
    b = side("b", [("Kim Vale", "Lake Open")] * 30 + [("Orn Tom", "Lake Open")] + [(f"Club p{k} Jr", "Hill Cup") for k in range(30)])
    got = {(r.a_id, r.b_id, r.score) for r in resolution.match_outrights(a, b).collect()}
    assert got == {(f"a:{30 + k}", "b:30", 1.0) for k in range(30)} | {(f"a:{60 + k}", f"b:{31 + k}", 0.85) for k in range(30)}
    assert ranked == [32]
    # Without a limit on names, markets meet by their tokens.
    assert resolution.match_outrights(a, b, entity_min=0.0).count() == 60


def test_a_task_takes_no_more_of_a_larger_ladder(spark, monkeypatch):
    monkeypatch.setattr(depth, "TASK_ROWS", 500)
    side = F.when(F.col("id") % 2 == 0, "YES").otherwise("NO")
    ladder = lambda n: spark.range(n).select((F.col("id") % (n // 10)).alias("key"), side.alias("side"), (4000 + F.col("id") % 7).alias("price"), F.lit(5.0).alias("size"))
    for n in (5_000, 20_000):
        for dealt in (depth.average_fill(ladder(n), ["key", "side"], 3), depth.hedges(ladder(n), ["key"], F.lit(7), F.lit(5))):
            tasks = dealt.groupBy(F.spark_partition_id()).agg(F.countDistinct("key").alias("n"))
            assert tasks.count() > 0.9 * n / 500 and tasks.agg(F.max("n")).first()[0] <= 250
    told = depth.hedges(ladder(5_000), ["key"], F.lit(7), F.lit(5), rows=20_000)
    assert told.select(F.spark_partition_id()).distinct().count() > 30


def test_folding_long_texts(spark):
    """Letters that stay one sign or go cost no look through all those that become several."""
    text = F.concat(F.repeat(F.lit("é plain text ñ и "), 20_000), F.col("id").cast("string"), F.lit(" ½…ﬁ½"))
    rows = spark.range(8).repartition(4).select(text.alias("text")).cache()
    assert {r[0] for r in rows.select(F.right(resolution.unaccented(F.col("text")), F.lit(12))).collect()} == {f"  {i} 12...fi12"[-12:] for i in range(8)} and rows.count() == 8

    def seconds(column):
        took = []
        for _ in range(3):
            began = time.time()
            rows.select(F.max(F.length(column))).collect()
            took.append(time.time() - began)
        return min(took)

    assert seconds(resolution.unaccented(F.col("text"))) < 15 * seconds(F.regexp_replace("text", "[^a-z]", ""))
    rows.unpersist()


def test_questions_are_not_sent_to_the_driver(spark):
    text = F.concat(F.lit("rain "), F.col("id").cast("string"))
    rows = spark.range(20).select(
        F.col("id").cast("string").alias("id"), text.alias("question"), F.array(text).alias("aliases"), F.timestamp_micros(F.lit(0)).alias("resolution"), F.lit(None).cast("string").alias("event"),
        F.lit(None).cast("string").alias("futures"), F.col("id").alias("ord"),
    )
    found = resolution.question_pairs(rows, rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [a_key" in plan and "SortMergeJoin [b_key" in plan
    assert found.filter("a_id = b_id").count() == 40  # the question and its alias


@pytest.mark.parametrize("run_rows", [3, 40, 100_000])
def test_throttle_goes_from_run_to_run(spark, monkeypatch, run_rows):
    """Not every row of a long pair is doubled: what is kept between rounds is little, and there are few rounds."""
    rng, us, rows = random.Random(run_rows), 1, []
    for k in range(1500):
        us += rng.choice([0, 0, 500_000, 7_000_000, 29_000_000, 30_000_000, 31_000_000, *([400_000_000_000] if k % 300 == 0 else [])])
        rows.append(("a:long", "b", us, rng.choice([0, 0, 0, 5, 6]), rng.randint(1, 3), rng.choice(["structured", "structured", "lexical", None])))
    rows += [("a:tied", "b", 9, rng.choice([0, 1]), rng.randint(1, 3), rng.choice(["structured", None])) for _ in range(300)]
    table = spark.createDataFrame(rows, throttle.SCHEMA)
    kept, cut = [], throttle.cut

    def counted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(throttle, "cut", counted)
    want = sorted(map(repr, throttle.logged(table).collect()))
    assert sorted(map(repr, throttle.logged_by_doubling(table, run_rows).collect())) == want and len(want) > 100
    if run_rows > 1000:
        assert sum(kept[1:]) < 100 and len(kept) < 8


class _State:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_legs_of_a_long_batch(monkeypatch):
    """A pair's rows come in parts, and are those that a loop over the updates gives."""
    monkeypatch.setattr(live, "_PART_ROWS", 50, raising=False)
    rng, legs = random.Random(8), live._Legs(10)
    states, timers = {}, []
    handle = type("Handle", (), {"getValueState": lambda _, name, schema: states.setdefault(name, _State()), "registerTimer": lambda _, ms: timers.append(ms)})()
    legs.init(handle)
    now, n = {}, 0
    for batch in range(4):
        rows = [(rng.choice("ab") if batch else "b", batch * 400 + rng.randint(0, 600), f"{batch}-{i}", "q", "m", None) for i in range(300)]
        frame = pd.DataFrame(rows, columns=["leg", "us", "book", "question", "method", "resolution_match"])
        parts = list(legs.handleInputRows(("x", "y"), iter([frame[:120], frame[120:]]), None))
        want = []
        for leg, us, book, *rest in sorted(rows, key=lambda r: (r[1], r[0])):
            if leg in now and us < now[leg][0]:
                continue
            now[leg] = us, book
            n += 1
            if len(now) == 2:
                want.append(("x", "y", n, us, *rest, now["a"][1], now["b"][1]))
        assert [tuple(r) for part in parts for r in part.itertuples(index=False)] == want and (want or not batch)
        assert max(map(len, parts)) <= 50 and len(timers) == 1


def test_latest_records_of_last_moments_only(spark, tmp_path, monkeypatch):
    rng, rows = random.Random(9), []
    book = lambda us: f'{{"yes_depth":[{{"price":{rng.choice([0.3, 0.4])},"size":5.0}}],"no_depth":[{{"price":{rng.choice([0.4, 0.5])},"size":3.0}}],"updated_us":{us}}}'
    for i in range(200):
        us = 1_000_000 * (i // 2)
        rows.append((f"a:{i % 3}", "b", i + 1, us, "q", "structured", None, book(us), book(us)))
    batch = spark.createDataFrame(rows, live._MET)
    evaluated = live.evaluated(batch).withColumn("ts", F.timestamp_micros("us"))
    want = {tuple(r) for r in logs.latest_records(logs.records(evaluated)).collect()}
    seen, latest = [], logs.latest_records
    monkeypatch.setattr(logs, "latest_records", lambda rows: (seen.append(rows.count()), latest(rows))[1])
    live.live_sinks(*(str(tmp_path / x) for x in ("log", "latest", "last")))(batch, 0)
    assert {tuple(r) for r in live.latest_table(spark, str(tmp_path / "latest")).read().collect()} == want and len(want) == 3
    assert seen and seen[0] <= 6
