"""What the text operators share: scratch tables, worker paths, text input."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Tables of at most so many rows may be sent to every executor. All of them
#: have narrow rows, so this bounds the bytes as well (about 64 MB).
BROADCAST_ROWS = 2_000_000


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package even if only the driver's path has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


#: Rows that go to a Python worker at a time, unless the session says otherwise: texts can be long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Memory that this process no longer uses goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function over Arrow batches that gives its memory back when its task is done: Python workers stay for the next stages."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster that is an error, since executors wouldn't see each other's files.
    """
    sc = spark.sparkContext
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    Cuts the lineage, pins generated ids, and gives the planner a true size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table has at most ``rows`` rows (a metadata count)."""
    return df.count() <= rows


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column as a string, null as the empty string."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    workers_find_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def narrowed(rows: DataFrame, ids: DataFrame, how: str = "left_semi", key: bool = False) -> DataFrame:
    """The rows whose doc_id (and, with ``key``, hash of the text) is in ``ids``, or isn't with left_anti.

    ``ids`` is a stored table; it goes to the rows if it is small, else both are dealt by key.
    """
    match = rows["doc_id"].eqNullSafe(ids["doc_id"])
    if key:
        match = match & (F.xxhash64(text_of(rows)) == ids["key"])
    return rows.join(F.broadcast(ids) if small(ids) else ids, match, how)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], sent: int = BROADCAST_ROWS) -> DataFrame:
    """Rows with the columns of the (stored) table, which has one row for each value of the keys.

    Its ``n``, how many rows look, isn't given out. A table too large to send goes in two
    parts: the rows that most look up are sent, so none of them is dealt by its key; the
    others are dealt with those that look them up.
    """
    if small(table, sent):
        return rows.join(F.broadcast(table), keys).drop("n")
    hot = stored(table.orderBy(F.desc("n")).limit(sent), "looked-up")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest).drop("n")
