"""A table with one row for each key, into which micro-batches are merged.

Rows lie in buckets by a hash of the key. A merge rewrites the buckets that its rows are in and no others. Each
bucket has two slots: a merge writes the slot that isn't in use and then commits a manifest, which says what slot each
bucket is in and is small (a row for each bucket). There are two manifests as well, written in turn. So nothing that
the last committed merge says is touched by the next one, what is older is written over, and the table never takes more
than twice its size.

A merge has a number that grows. One that runs again, after it failed or was committed, starts from the
manifest before it and gives the same table. A reader takes the newest manifest; it sees the files of one merge as long
as not two more are committed while it reads.

Null keys are keys like any other. Only Spark reads and writes, so any store that it knows will do; one merge
at a time. Columns may have any name but ``_bucket`` and ``_slot``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
_MANIFEST = "number long, bucket int, slot int"


class UpsertTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _read(self, path: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _manifest(self, before: int | None) -> tuple[int, dict[int, int]]:
        """Where the newest manifest (of those before a number) stands, and each bucket's slot. A bucket's row is all that is collected."""
        found = []
        for at in (0, 1):
            rows = self._read(f"{self.path}/manifest/{at}", _MANIFEST)
            rows = rows.collect() if rows is not None else []
            if rows and (before is None or rows[0].number < before):
                found.append((rows[0].number, at, {r.bucket: r.slot for r in rows if r.bucket is not None}))
        return max(found, default=(None, 1, {}))[1:]

    def _of(self, slots: dict[int, int]) -> DataFrame:
        """The rows of these buckets."""
        if not slots:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/_bucket={b}/_slot={s}" for b, s in sorted(slots.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, before: int | None = None) -> DataFrame:
        """The table after the newest merge, or after the newest one before a number."""
        return self._of(self._manifest(before)[1])

    def touched(self, rows: DataFrame, before: int) -> DataFrame:
        """The table's rows in the buckets of these rows, as they were before a merge."""
        _, slots = self._manifest(before)
        return self._of({b: slots[b] for b in self._buckets(rows) if b in slots})

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _buckets(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # as many as there are buckets, at most

    def merge(self, rows: DataFrame, number: int, newest: Callable[[DataFrame], DataFrame]) -> None:
        """Merges rows: ``newest`` makes one row of each key of those that were there and those that come."""
        at, slots = self._manifest(number)
        hit = self._buckets(rows)
        if hit:
            before = self._of({b: slots[b] for b in hit if b in slots})
            merged = newest(before.unionByName(rows)).withColumn("_bucket", self._bucket())
            target = F.map_from_arrays(F.array(*[F.lit(b) for b in hit]), F.array(*[F.lit(1 - slots.get(b, 1)) for b in hit]))
            merged = merged.withColumn("_slot", target[F.col("_bucket")]).repartition("_bucket")
            merged.write.partitionBy("_bucket", "_slot").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/data")
        now = slots | {b: 1 - slots.get(b, 1) for b in hit}
        lines = [(number, b, s) for b, s in sorted(now.items())] or [(number, None, None)]
        self.spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{1 - at}")
