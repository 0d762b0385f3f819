"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    found = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == cols
    want = sorted(map(repr, found.select(*[f'"{c}"' for c in cols]).fetchall()))
    assert got == want


def test_sequence_gaps_by_buckets(spark):
    from pyspark.sql import functions as F

    from crossbook.operators import replay

    table = [(k, s) for k in (0, 1, None) for s in [1, 2, 4, 5, 5, 9, 10, 11, 12, 30, 31, -7, None] if (s or 0) % 2 or k != 1]
    df = spark.createDataFrame(table, "k long, s long")
    want, last = [], {}
    for k, s in sorted((r for r in table if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        if k in last and s - last[k] != 1:
            want.append((k, s, last[k]))
        last[k] = s
    for width in (1, 3, 1000):
        gaps = replay.sequence_gaps(df, "k", "s", width)
        assert sorted(map(repr, (tuple(r) for r in gaps.collect()))) == sorted(map(repr, want))
    # All of a stream's numbers are not one group.
    big = replay.sequence_gaps(spark.range(100_000).select(F.lit(0).alias("k"), F.col("id").alias("s")), "k", "s", 1000)
    assert "_bucket" in big._jdf.queryExecution().executedPlan().toString() and big.count() == 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
