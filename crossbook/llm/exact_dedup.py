"""Exact dedup by deterministic block naming.

Every text is cut into fixed-size blocks. Distinct blocks are sorted and numbered,
then adjacent pairs of numbers are sorted and numbered, again and again, until
one integer is left for each text. Two texts get the same integer exactly if
they are equal: no step relies on a hash being free of collisions.

A 64-bit hash only routes a block to its number, so that its bytes move once: blocks
are dealt and ordered by hash first, and those that share one are told apart by their
bytes. The largest groups' numbers are sent to the rows that look them up.

Defined results: a null text counts as empty; a row with null id is a row like
any other and stays only if all its equals have null ids; repeated rows are
members of their group, and of rows with the same largest id all are "kept";
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crossbook.llm._common import looked_up, narrowed, small, stored, text_of

#: Bytes of a block.
BLOCK_BYTES = 4096


def _lowered(texts: pa.Array) -> list[bytes]:
    """Lower case of A-Z only."""
    return pc.ascii_lower(texts).cast(pa.binary()).to_pylist()


def _blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, max(len(data), 1), size)]


def _route(bits: int):
    import xxhash

    return lambda block: (xxhash.xxh3_64_intdigest(block) >> (64 - bits)) - (1 << (bits - 1))


def _printed(size: int, bits: int):
    def run(batches):
        route = _route(bits)
        for batch in batches:
            raw = _lowered(batch.column("text"))
            cols = [batch.column("doc_id"), batch.column("key"), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([[route(b) for b in _blocks(x, size)] for x in raw], pa.list_(pa.int64()))], names=["doc_id", "key", "text_sha256", "routes"])

    return run


def _counted(size: int, bits: int):
    """(h, block, n): the distinct blocks of a batch."""

    def run(batches):
        route = _route(bits)
        for batch in batches:
            n = Counter(b for x in _lowered(batch.column("text")) for b in _blocks(x, size))
            yield pa.RecordBatch.from_arrays([pa.array(map(route, n), pa.int64()), pa.array(n, pa.binary()), pa.array(n.values(), pa.int64())], names=["h", "block", "n"])

    return run


def _placed(size: int, bits: int):
    """(doc_id, key, at, h, block): all blocks."""

    def run(batches):
        route = _route(bits)
        for batch in batches:
            ids, keys = (batch.column(c).to_pylist() for c in ("doc_id", "key"))
            found = [(i, k, at, route(b), b) for i, k, x in zip(ids, keys, _lowered(batch.column("text")), strict=True) for at, b in enumerate(_blocks(x, size))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["doc_id", "key", "at", "h", "block"])

    return run


def _named_blocks(rows: DataFrame, blocks: DataFrame, size: int, bits: int) -> DataFrame:
    """(row, at, name) of the blocks (row, doc_id, key, at, h): an integer for each distinct block, in the order of hash and bytes."""
    counted = rows.select("text").mapInArrow(_counted(size, bits), "h long, block binary, n long").groupBy("h", "block").agg(F.sum("n").alias("n"))
    ordered = counted.repartitionByRange("h").sortWithinPartitions("h", "block").withColumn("name", F.monotonically_increasing_id())
    # Bytes are kept only where two blocks share a hash.
    alone = F.count("*").over(W.partitionBy("h")) == 1
    names = stored(ordered.select("h", "name", "n", alone.alias("alone"), F.when(~alone, F.col("block")).alias("block")), "block-names")
    plain = looked_up(blocks.select("row", "at", "h"), names.filter("alone").select("h", "name", "n"), ["h"]).drop("h")
    shared = names.filter("not alone").select("h", "block", "name")
    if shared.isEmpty():
        return plain
    hashes = stored(shared.select("h").distinct(), "shared-hashes")
    ids = stored(blocks.join(hashes, "h").select("doc_id", "key").distinct(), "shared-ids")
    cut = narrowed(rows, ids, key=True).select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_placed(size, bits), "doc_id long, key long, at int, h long, block binary")
    told = cut.join(shared, ["h", "block"]).select("doc_id", "key", "at", "name").distinct().alias("b")
    a = blocks.join(hashes, "h").alias("a")
    met = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.at") == F.col("b.at"))
    return plain.unionByName(a.join(told, met).select("a.row", "a.at", "b.name"))


def _named_texts(left: DataFrame) -> DataFrame:
    """(row, at, name) of blocks -> (row, level, name): one integer for each distinct text."""
    level, done = 0, []
    while True:
        sized = left.groupBy("row").agg(F.count("*").alias("n"), F.max("name").alias("top"))
        done.append(sized.filter("n = 1").select("row", F.lit(level).alias("level"), F.col("top").alias("name")))
        pairs = (
            left.groupBy("row", F.expr("at div 2").alias("at"))
            .agg(F.max(F.expr("if(at % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(at % 2 = 1, name, null)")), F.lit(-1)).alias("b"), F.max("at").alias("most"))
        )
        # A text with one name left is the lone pair at place 0 without a partner.
        pairs = stored(pairs.filter("most > 0"), f"pairs-{level}")
        if pairs.isEmpty():
            break
        level += 1
        ordered = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).repartitionByRange("a", "b").sortWithinPartitions("a", "b")
        names = stored(ordered.withColumn("name", F.monotonically_increasing_id()), f"pair-names-{level}")
        left = stored(looked_up(pairs, names, ["a", "b"]).select("row", "at", "name"), f"names-{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def identities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """Each row's doc_id, key, text_sha256 and identity (level, name), the same for equal texts only.

    bits: of the hash that routes blocks; the result is the same for any.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    printed = rows.withColumn("key", F.xxhash64("text")).mapInArrow(_printed(block_bytes, bits), "doc_id long, key long, text_sha256 string, routes array<long>")
    prints = stored(printed.withColumn("row", F.monotonically_increasing_id()), "prints")
    blocks = prints.select("row", "doc_id", "key", F.posexplode("routes").alias("at", "h"))
    named = _named_texts(stored(_named_blocks(rows, blocks, block_bytes, bits), "names-0"))
    return prints.drop("routes").join(named, "row").drop("row")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, key.

    Of equal texts (after lower-casing A-Z) the row with the largest id stays.
    key is xxhash64 of the text as it is: with doc_id it names the row.
    """
    rows = stored(identities(docs, id_col=id_col, text_col=text_col, block_bytes=block_bytes, bits=bits), "identities")
    groups = rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # A text without an equal needs no look-up; a large group meets one row, which is sent.
    groups = stored(groups.filter("group_size > 1").withColumn("n", F.col("group_size")), "groups")
    alone = F.lit(1).cast("long")
    copies = looked_up(rows, groups, ["level", "name"])
    single = rows.join(F.broadcast(groups.select("level", "name")), ["level", "name"], "left_anti") if small(groups) else rows.join(groups.select("level", "name"), ["level", "name"], "left_anti")
    both = copies.unionByName(single.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", alone))
    return both.select("doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", "key")
