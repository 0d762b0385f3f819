"""The upsert table against a dictionary, with merges that run again or break off."""

import random
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crossbook.sources.upsert import UpsertTable

SCHEMA = "a string, b string, us long, value string"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def newest(rows):
    return rows.groupBy("a", "b").agg(F.max_by(F.struct("us", "value"), F.struct("us", "value")).alias("x")).select("a", "b", "x.*")


def batch(rng, n, at):
    key = lambda: rng.choice([*map(str, range(12)), None])
    return [(key(), key(), at + rng.randint(0, 3), f"v{rng.random()}") for _ in range(n)]


def merged(want, rows):
    for a, b, us, value in rows:
        want[a, b] = max(want.get((a, b), (us, value)), (us, value))


def content(table, before=None):
    return {(r.a, r.b): (r.us, r.value) for r in table.read(before).collect()}


def test_merges_are_a_dictionary(spark, tmp_path):
    rng, want = random.Random(3), {}
    table = UpsertTable(spark, str(tmp_path), SCHEMA, ["a", "b"], 8)
    assert content(table) == {}
    for number in (0, 1, 2, 5, 6):
        rows, old = batch(rng, rng.randint(1, 30), number), dict(want)
        table.merge(spark.createDataFrame(rows, SCHEMA), number, newest)
        merged(want, rows)
        assert content(table) == want and content(table, number) == old
        # Again, with the same rows: the same table, from the one before it.
        table.merge(spark.createDataFrame(rows, SCHEMA), number, newest)
        assert content(table) == want and content(table, number) == old
    table.merge(spark.createDataFrame([], SCHEMA), 7, newest)
    assert content(table) == want and content(UpsertTable(spark, str(tmp_path), SCHEMA, ["a", "b"], 8)) == want


def test_a_merge_that_breaks_off_is_not_seen(spark, tmp_path):
    rng, want = random.Random(4), {}
    table = UpsertTable(spark, str(tmp_path), SCHEMA, ["a", "b"], 4)
    for number in (0, 1):
        rows = batch(rng, 20, number)
        table.merge(spark.createDataFrame(rows, SCHEMA), number, newest)
        merged(want, rows)
    rows = batch(rng, 20, 2)
    whole = table.spark

    class Broken:
        """A session that fails at the manifest."""

        read = whole.read

        def createDataFrame(self, lines, schema):  # noqa: N802
            if "number" in schema:
                raise OSError("lost")
            return whole.createDataFrame(lines, schema)

    table.spark = Broken()
    with pytest.raises(OSError):
        table.merge(spark.createDataFrame(rows, SCHEMA), 2, newest)
    table.spark = whole
    assert content(table) == want
    table.merge(spark.createDataFrame(rows, SCHEMA), 2, newest)
    merged(want, rows)
    assert content(table) == want


def test_a_merge_writes_its_buckets_only_and_old_files_go(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path), SCHEMA, ["a", "b"], 64)
    many = [(str(i), "x", 1, "v" * 50) for i in range(5000)]
    table.merge(spark.createDataFrame(many, SCHEMA), 0, newest)
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(tmp_path, "data").rglob("*.parquet")}
    size = sum(p.stat().st_size for p in files())
    assert len(files()) == 64
    for number in range(1, 6):
        before = files()
        table.merge(spark.createDataFrame([("7", "x", number, "new"), ("8", "x", number, "new")], SCHEMA), number, newest)
        written = [p for p, t in files().items() if before.get(p) != t]
        assert 1 <= len(written) <= 2 and sum(p.stat().st_size for p in written) < size / 16
    # However many merges there are, a bucket has two slots at most.
    assert len(files()) <= 66 and table.read().count() == 5000
