"""Files of candidates and opportunity logs, read and written by Spark.

Missing columns of a file are null; a line that isn't JSON is a row of nulls; repeated records stay,
but for the latest of a pair. Null ids are a pair like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbook.functions.economics import divided
from crossbook.sources.upsert import UpsertTable

CANDIDATE = "a_id string, b_id string, a_question string, b_question string, score double, delta_days int, resolution_match boolean, resolution_notes string, verified_by string, method string"
RECORD = """timestamp string, a_id string, b_id string, question string, method string, strategy string, yes_platform string, no_platform string, size long,
  yes_top double, no_top double, yes_fill double, no_fill double, raw_top double, raw_depth double, yes_fee double, no_fee double, net double, resolution_match boolean"""
_ROUNDED = ("yes_top", "no_top", "yes_fill", "no_fill", "raw_top", "raw_depth", "yes_fee", "no_fee", "net")
TRUSTED = ("structured", "futures")


def _there(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """What is read; no rows if nothing is there."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _read(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    return _there(lambda: spark.read.schema(schema).options(**options).json(path), spark, schema)


def _read_text(spark: SparkSession, path: str) -> DataFrame:
    return _there(lambda: spark.read.text(path), spark, "value string")


def read_candidates(spark: SparkSession, path: str, trusted: bool = False, by_line: bool = False) -> DataFrame:
    """A JSON array of candidates, none without the file; with ``trusted`` only games and outrights.

    ``by_line``: the array has a candidate a line, as ``write_candidates`` writes it, so that many tasks read it.
    """
    if by_line:
        lines = _read_text(spark, path).select(F.regexp_replace("value", ",$", "").alias("value")).filter("value not in ('[', ']', '[]', '')")
        rows = lines.select(F.from_json("value", CANDIDATE).alias("x")).select("x.*")
    else:
        rows = _read(spark, path, CANDIDATE, multiLine=True)
    return rows.filter(F.col("method").isin(*TRUSTED)) if trusted else rows


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records, one a line; an empty log is an error."""
    rows = spark.read.schema(RECORD).json(path)
    if rows.isEmpty():
        raise ValueError(f"{path} is empty")
    return rows


def read_tracked(spark: SparkSession, path: str) -> DataFrame:
    """a_id and b_id of the pairs in a file of latest records; none without the file."""
    return _read(spark, path, RECORD).select("a_id", "b_id").distinct()


def records(evaluated: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Log records of evaluations (with ts, a_id, b_id, question, method, resolution_match): four places, names of the legs.

    Amounts are rounded half to even from whole ticks. The time is UTC; without microseconds it has no fraction.
    """
    legs = [F.lit(n) for n in names]
    yes, no = F.when(F.col("direction") == 0, legs[0]).otherwise(legs[1]), F.when(F.col("direction") == 0, legs[1]).otherwise(legs[0])
    utc = F.to_utc_timestamp("ts", F.current_timezone())
    fraction = F.when(F.unix_micros("ts") % 1_000_000 != 0, F.date_format(utc, ".SSSSSS")).otherwise("")
    at = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
    n, py, pn, fy, fn = (F.col(c) for c in ("contracts", "total_py", "total_pn", "total_fy", "total_fn"))
    ticks = {"yes_fill": py, "no_fill": pn, "yes_fee": fy, "no_fee": fn, "raw_depth": 10000 * n - py - pn, "net": 10000 * n - py - pn - fy - fn}
    rounded = {c: divided(v, n) / 10000 for c, v in ticks.items()} | {c: F.round(c, 4) for c in ("yes_top", "no_top", "raw_top")}
    named = evaluated.withColumns({"timestamp": at, "yes_platform": yes, "no_platform": no, "strategy": F.upper(F.concat(F.lit("YES_"), yes, F.lit("_NO_"), no)), **rounded})
    return named.select("timestamp", "a_id", "b_id", "question", "method", "strategy", "yes_platform", "no_platform", "size", *_ROUNDED, "resolution_match")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest_records(rows: DataFrame) -> DataFrame:
    """The last record of each pair: by time, of equal times the largest record."""
    moment = F.struct(F.try_to_timestamp("timestamp"), "timestamp")
    return rows.groupBy("a_id", "b_id").agg(F.max_by(F.struct(*rows.columns), F.struct(moment, F.to_json(F.struct(*rows.columns)))).alias("x")).select("x.*")


def write_latest(rows: DataFrame, path: str) -> None:
    """The last record of each pair."""
    latest_records(rows).write.mode("overwrite").json(path)


def stream_sinks(log: str, latest: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every record goes to the log in a folder of its batch, so a batch that runs again replaces
    what it wrote, and the latest record of each pair into a table (``UpsertTable``) by ``a_id`` and ``b_id``."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").json(f"{log}/batch={number}")
        schema = ", ".join(f"`{n}` {t}" for n, t in batch.dtypes)
        UpsertTable(batch.sparkSession, latest, schema, ["a_id", "b_id"]).merge(batch, number, latest_records)
        batch.unpersist()

    return write


def write_candidates(candidates: DataFrame, path: str) -> None:
    """One JSON array in the order of scores, a candidate a line, in as many part files as there are ranges of scores.

    The parts one after the other, in the order of their names, are the array. Each task knows from the counts of
    rows by part whether it has the first or the last one.
    """
    kept = candidates.select(F.struct("*").alias("_row")).orderBy(F.desc("_row.score"), "_row.a_id", "_row.b_id").persist()
    ordered = kept.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = dict(ordered.groupBy("_part").count().collect())  # a row for each part
    if not sizes:
        kept.unpersist()
        candidates.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    first, last = min(sizes), max(sizes)
    begins = F.when((F.col("_part") == first) & (F.col("_at") == 0), "[\n").otherwise("")
    ends = F.when((F.col("_part") == last) & (F.col("_at") == sizes[last] - 1), "\n]").otherwise(",")
    ordered.select(F.concat(begins, F.to_json("_row"), ends).alias("value")).write.mode("overwrite").text(path)
    kept.unpersist()


def write_report(report: DataFrame, windows: DataFrame, path: str) -> None:
    """The report's row as JSON, and beside it all windows by best spread."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    by_spread(windows).write.mode("overwrite").json(f"{path}/windows")


def by_spread(windows: DataFrame) -> DataFrame:
    """Windows from the best spread down; ties by pair and window."""
    return windows.orderBy(F.desc("best_net"), "a_id", "b_id", "window")


def top_windows(windows: DataFrame, n: int = 10) -> DataFrame:
    return by_spread(windows).limit(n)


def review(candidates: DataFrame, a_rules: DataFrame, b_rules: DataFrame) -> DataFrame:
    """Candidates with the rules of both sides (id, rules), for people to judge; without rules, null."""
    left, right = (r.select(F.col("id").alias(f"{s}_id"), F.col("rules").alias(f"{s}_rules")) for r, s in ((a_rules, "a"), (b_rules, "b")))
    return candidates.join(left, "a_id", "left").join(right, "b_id", "left")
