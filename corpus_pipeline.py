"""The corpus pipeline: documents in, tokens of the clean ones out.

Each stage reads all that the one before kept. A row is named by its id and its
text's hash, so null ids and repeated rows go through every stage; rows that are
the same in both share their fate.

Defined results: null and empty texts are no copies of a row with words, no leaks and
not toxic, and of several one stays; empty tables give an empty result, and without
labels or items nothing is toxic or leaked; texts of any length go through whole; other
columns of documents go along to the last stage, whatever their names, and a column
``key`` of theirs is not the hash. ``spark.checkpoint.dir`` must be a folder that all
executors share; workers need this package on their path (on a cluster, ship it as for
any PySpark job, for example with ``--py-files``).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbook.llm import byte_bpe, decontamination, exact_dedup, minhash_dedup, toxicity
from crossbook.llm._common import give_back, narrowed, stored, workers_find_package


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return narrowed(docs, stored(dropped.select("doc_id", "key").distinct(), "dropped"), "left_anti", key=True)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.scored(docs, labels)
    give_back()  # what training took in the driver
    return _without(docs, scored.filter(F.col("score") >= toxicity.THRESHOLD))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, exact_dedup.exact_dedup(docs).filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, minhash_dedup.near_dedup(docs).filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontamination.passages(docs, benchmark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL has neither the classifier nor the tokenizer; tests/llm/test_bounds.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"stage-{at}")
    return docs
