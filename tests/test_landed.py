"""Landed pages and messages as data sources: partitions, offsets, replay after failure, archive."""

import json

import pytest
from pyspark.sql import SparkSession

from crossbook.sources import landed, pages, venues
from crossbook.streaming import books, live


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    landed.register(s)
    books.state_store(s)
    return s


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_pages(spark, tmp_path):
    event = lambda k: {"title": f"t{k}", "markets": [{"ticker": f"T-{k}", "title": "x"}]}
    for run in "pq":
        # Page 2 answers with the cursor that it was asked by, so page 3 isn't a part of the run.
        for page, cursor in enumerate(("c1", "c2", "c2", "c3")):
            write(tmp_path / f"run={run}" / f"page={page}.json", json.dumps({"cursor": cursor, "events": [event(f"{run}{page}"), event(f"{run}{page}+")]}))
    write(tmp_path / "run=r" / "page=0.json", "not JSON")
    write(tmp_path / "run=r" / "_hidden", "x")
    rows = spark.read.format("landed_pages").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    found = pages.listing_a(pages.parsed(rows, pages.PAGE_A))
    assert sorted((r.run, r.title) for r in found.collect()) == [(r, f"t{r}{p}{x}") for r in "pq" for p in range(3) for x in ("", "+")]
    assert spark.read.format("landed_pages").load(f"{tmp_path}/none").count() == 0
    market = lambda k: {"slug": f"s{k}", "question": "q"}
    for page in range(3):
        write(tmp_path / "b" / "run=z" / f"page={page}.json", json.dumps({"markets": [market(f"{page}{k}") for k in range(2 if page < 1 else 1)]}))
    short = pages.listing_b(pages.parsed(spark.read.format("landed_pages").load(f"{tmp_path}/b"), pages.PAGE_B), page_size=2)
    assert sorted(r.slug for r in short.collect()) == ["s00", "s01", "s10"]


def lines(folder, name, values):
    # A file is whole when it appears.
    write(folder / f".{name}", "\n".join(values) + "\n\n")
    (folder / f".{name}").rename(folder / name)


def run(spark, folder, out, fail=()):
    """All messages that are there, each batch in a folder of its own; fails in a batch after it has written half of it."""

    def put(batch, number):
        (batch.limit(1) if number in fail else batch).write.mode("overwrite").json(f"{out}/batch={number}")
        if number in fail:
            raise RuntimeError("lost")

    reader = spark.readStream.format("landed_messages").option("archive", f"{folder}-archive") if "archived" in str(folder) else spark.readStream.format("landed_messages")
    query = reader.load(str(folder)).writeStream.foreachBatch(put).option("checkpointLocation", f"{out}-state").trigger(once=True).start()
    try:
        query.awaitTermination(120)
    except Exception as e:  # noqa: BLE001
        assert fail and "lost" in str(e)


@pytest.mark.parametrize("name", ["in", "archived"])
def test_messages_after_failures(spark, tmp_path, name):
    folder, out = tmp_path / name, tmp_path / "out"
    want = []

    def land(k, n):
        lines(folder, f"m{k:03}", [f"{k}-{i}" for i in range(n)])
        want.extend((f"m{k:03}", k << 32 | i, f"{k}-{i}") for i in range(n))

    land(0, 3), land(1, 2500)
    run(spark, folder, out)
    land(2, 4)
    run(spark, folder, out, fail=(1,))
    land(3, 5)  # it comes before the failed batch runs again, and isn't a part of it
    run(spark, folder, out)
    run(spark, folder, out)
    land(4, 1)
    run(spark, folder, out)
    got = spark.read.schema("file string, ord long, value string").json(str(out))
    assert sorted(map(tuple, got.select("file", "ord", "value").collect())) == sorted(want)
    if name == "archived":
        # What is committed has moved.
        assert {p.name for p in (tmp_path / "archived-archive").iterdir()} >= {"m000", "m001", "m002"}
    else:
        assert spark.read.format("landed_messages").load(str(folder)).count() == len(want)


def test_messages_to_books(spark, tmp_path):
    """Both venues' own messages, from landed files to the pair's newest books."""
    second = 1_000_000

    def a(us, seq, kind, **body):
        return json.dumps({"conn": "c", "us": us, "message": {"type": kind, "seq": seq, "msg": {"market_ticker": "X-1", **body}}})

    def b(us, slug, bid, offer):
        level = lambda p: [{"px": {"value": p, "currency": "USD"}, "qty": "10"}]
        return json.dumps({"us": us, "message": {"marketData": {"marketSlug": slug, "bids": level(bid), "offers": level(offer)}}})

    lines(tmp_path / "a", "1", [a(second, None, "subscribed"), a(2 * second, 1, "orderbook_snapshot", yes_dollars_fp=[["0.40", "7"]], no_dollars_fp=[["0.30", "200"]]), "not JSON"])
    lines(tmp_path / "a", "2", [a(3 * second, 2, "orderbook_delta", side="no", price_dollars="0.30", delta_fp="-50"), a(5 * second, 9, "orderbook_delta", side="no", price_dollars="0.30", delta_fp="-50")])
    lines(tmp_path / "b", "1", [b(4 * second, "s-1", "0.41", "0.47"), b(4 * second, "unknown", "0.1", "0.2"), json.dumps({"us": 1, "message": {"heartbeat": {}}})])
    read = lambda venue: spark.readStream.format("landed_messages").load(f"{tmp_path}/{venue}")
    updates = live.venue_updates(venues.messages_a(read("a")), venues.messages_b(read("b")), slugs=spark.createDataFrame([("s-1",)], "slug string"))
    query = updates.writeStream.format("memory").queryName("updates_out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.id, r.us // second): ([tuple(x) for x in r.yes_depth], [tuple(x) for x in r.no_depth]) for r in spark.table("updates_out").collect()}
    # The message with number 9 shows a gap and gives no book.
    assert got == {
        ("a:X-1", 2): ([(0.7, 200.0)], [(0.6, 7.0)]), ("a:X-1", 3): ([(0.7, 150.0)], [(0.6, 7.0)]), ("b:s-1", 4): ([(0.47, 10.0)], [(0.59, 10.0)]),
    }
