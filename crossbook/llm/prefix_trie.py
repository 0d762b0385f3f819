"""The trie of conversations' common prefixes, rolled up by pointer jumping.

A node is a distinct sequence of first turns; it is named by a digest, and an edge
leads from it to the digest of the sequence without its last turn. What a subtree
holds is added up in rounds: after the k-th, every node has the sums of its
descendants fewer than 2^k below it and an edge to its ancestor 2^k above it, so
the rounds are logarithmic in the longest conversation.

No group is larger than a task can hold. Turns are numbered by a sort over ranges (a
conversation may fill many ranges, whose counts are carried on), digests are chained
in segments of ``SEGMENT`` turns, and segments are chained by doubling. Edges to a
node with very many children are looked up, not dealt by that node. The ids that end
at one node are written as sorted parts, and one task hashes the parts of a node one
after the other, as SHA-256 has no other order; it holds one part at a time.

Defined results: rows without a conversation's id are left out; null role and text are
empty; rows with the same turn come in the order of their roles, then of the digests
of role and text, so that repeated rows are repeated turns; an empty table has no
nodes, not even a root; other columns are ignored. Texts of any length count whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossbook.llm._common import looked_up, stored

#: Turns that are chained in one group.
SEGMENT = 64
#: Bytes of a part of a list of ids, about.
PART = 1 << 16
#: Rows of a table of ancestors that are sent to every task, at most: two digests each.
SENT = 400_000
WORD = r"[^\x20\x09-\x0D]+"
ROOT = b""


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, part, at, digest, words), stored in order, and where each conversation lies.

    A place is (conv, part, first, before, total): the turns of a conversation in one range begin at
    ``first``, ``before`` of its turns are in earlier ranges. A turn's number is at - first + before + 1.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = _sha(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(turns["conv_id"].cast("long").alias("conv"), turns["turn"].alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    # The row's own number lets a range end among rows that are all the same.
    rows = rows.filter("conv IS NOT NULL").withColumn("own", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "own").sortWithinPartitions(*order).select("conv", F.monotonically_increasing_id().alias("at"), "digest", "words")
    rows = stored(rows, "turns").withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy("conv")  # a row for each range
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, counts.select("conv", "part", "first", before.alias("before"), F.sum("n").over(of).alias("total"))


def own_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, digest, words, size) of every turn, and (conv, size) of every conversation."""
    rows, places = numbered(turns)
    places = stored(places, "places")
    ranked = rows.join(places, ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "digest", "words", F.col("total").alias("size"))
    return ranked, places.filter("before = 0").select("conv", F.col("total").alias("size"))


def rebuilt_turns(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """As ``own_turns``, each conversation's first turns taken from the first one of its family.

    Conversation c takes as many as crc32(c) mod ``most`` says from conversation c - c mod ``family``
    (fewer if that has fewer) in place of as many of its own.
    """
    rows, places = numbered(turns)
    places = stored(places.withColumns({"base": F.col("conv") - F.col("conv") % family, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % most}), "places")
    sizes = places.filter("before = 0").select(F.col("conv").alias("base"), F.least("total", F.lit(most - 1)).alias("has")).filter(F.col("base") % family == 0)
    taken = F.least("h", F.coalesce("has", F.lit(0)))
    places = places.join(sizes, "base", "left").withColumns({"taken": taken, "size": taken + F.greatest(F.col("total") - F.col("h"), F.lit(0))})
    places = stored(places.drop("has", "total"), "places")
    ranked = rows.join(places, ["conv", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    own = ranked.filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words", "size")
    heads = ranked.filter(f"base = conv AND pos < {most}").groupBy("base").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("heads"))
    convs = places.filter("before = 0")
    first = convs.filter("taken > 0").join(heads, "base").select("conv", "size", F.explode(F.slice("heads", F.lit(1), F.col("taken").cast("int"))).alias("t"))
    return own.unionByName(first.select("conv", "t.pos", "t.digest", "t.words", "size")), convs.select("conv", "size")


def paths(turns: DataFrame, deepest: int) -> DataFrame:
    """(conv, depth, node, parent, words, ends) of every turn of every conversation."""
    seg = F.floor((F.col("pos") - 1) / SEGMENT).cast("int")
    groups = turns.groupBy("conv", seg.alias("seg")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"), F.max("size").alias("size"))
    chain = F.aggregate("turns", F.lit(None).cast("array<binary>"), lambda done, t: F.when(done.isNull(), F.array(_sha(t["digest"]))).otherwise(F.concat(done, F.array(_sha(F.element_at(done, -1), t["digest"])))))
    groups = groups.withColumn("chain", chain)
    keys, above = F.col("chain"), F.lit(ROOT)
    if deepest > SEGMENT:
        groups = stored(groups, "segments")
        done = groups.filter(f"size > {SEGMENT}").select("conv", "seg", F.element_at("chain", -1).alias("own")).withColumn("all", F.col("own"))
        step = 1
        while step * SEGMENT < deepest:
            # all: the digest of the segment and the step - 1 before it, twice as many after each round.
            back = done.select("conv", (F.col("seg") + step).alias("seg"), F.col("all").alias("back"))
            done = stored(done.join(back, ["conv", "seg"], "left").select("conv", "seg", "own", F.when(F.col("back").isNull(), F.col("all")).otherwise(_sha("back", "all")).alias("all")), "chained")
            step *= 2
        last = done.select("conv", (F.col("seg") + 1).alias("seg"), F.col("own").alias("last"), F.col("all").alias("before"))
        older = done.select("conv", (F.col("seg") + 2).alias("seg"), F.col("all").alias("older"))
        carried = last.join(older, ["conv", "seg"], "left").select("conv", "seg", "before", F.when(F.col("older").isNull(), F.col("last")).otherwise(_sha("older", "last")).alias("above"))
        groups = groups.join(carried, ["conv", "seg"], "left")
        keys = F.when(F.col("before").isNull(), F.col("chain")).otherwise(F.transform("chain", lambda x: _sha(F.col("before"), x)))
        above = F.coalesce("above", F.lit(ROOT))
    groups = groups.withColumns({"keys": keys, "above": above})
    parents = F.concat(F.array("above"), F.slice("keys", F.lit(1), F.size("keys") - 1))
    rows = groups.select("conv", "size", F.explode(F.arrays_zip(F.col("turns").alias("turn"), F.col("keys").alias("node"), parents.alias("parent"))).alias("t"))
    return rows.select("conv", F.col("t.turn.pos").alias("depth"), "t.node", "t.parent", F.col("t.turn.words").alias("words"), (F.col("t.turn.pos") == F.col("size")).alias("ends"))


def _parts(batches):
    """Consecutive ids of one node, comma-joined, in parts of about ``PART`` bytes."""
    node, first, ids, size = None, None, [], 0
    schema = ["node", "first", "ids"]

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=schema)

    for batch in batches:
        found = []
        for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if ids and (key != node or size > PART):
                found.append((node, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                node, first = key, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if found:
            yield out(found)
    if ids:
        yield out([(node, first, ",".join(ids))])


def _hashes(batches):
    """One hash for each node's parts, which come one after the other."""
    node, sha = None, None
    for batch in batches:
        found = []
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if sha is not None and key == node:
                sha.update(b",")
            else:
                if sha is not None:
                    found.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256()
            sha.update(ids.encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], names=["node", "ends_sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """The SHA-256 of each node's ids (node, conv), ascending and comma-joined."""
    parts = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_parts, "node binary, first long, ids string")
    return parts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashes, "node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """(node, leaves, saved): sums over each node's subtree of the node's own ``leaves`` and ``saved``.

    ``nodes`` is a stored table: node, anc (its parent; the root's is null), depth, leaves, saved.
    """
    step, state = 1, nodes.select("node", "anc", "depth", "leaves", "saved")
    while step <= deepest:
        sums = state.filter("anc IS NOT NULL").groupBy(F.col("anc").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("n"))
        more = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
        state = stored(state.join(sums, "node", "left").withColumns(more).select("node", "anc", "depth", "leaves", "saved", "n"), "rolled-up")
        step *= 2
        if step <= deepest:
            jumps = state.filter("n IS NOT NULL AND anc IS NOT NULL").select(F.col("node").alias("anc"), F.col("anc").alias("next"), "n")
            state = state.drop("n")
            far = looked_up(state.filter(F.col("depth") >= step), jumps, ["anc"], SENT).withColumn("anc", F.col("next")).drop("next")
            state = far.unionByName(state.filter(F.col("depth") < step).withColumn("anc", F.lit(None).cast("binary")))
    return state.select("node", "leaves", "saved")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations, from ``own_turns`` or ``rebuilt_turns``.

    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    most = convs.agg(F.max("size")).first()[0]
    if most is None:
        most, turns = 0, turns.limit(0)
    along = stored(paths(turns, most), "paths")
    nodes = along.groupBy("node").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("anc"), F.min("depth").alias("depth"), F.max("words").alias("words"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("anc"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"))
    nodes = stored(nodes.unionByName(root), "nodes")
    kids = nodes.filter("anc IS NOT NULL").groupBy(F.col("anc").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "node", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    nodes = stored(nodes.drop("words"), "nodes")
    above = nodes.filter("n_children > 0").select(F.col("node").alias("anc"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    named = looked_up(nodes.filter("anc IS NOT NULL"), above, ["anc"], SENT).unionByName(nodes.filter("anc IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    sums = rolled_up(nodes, most).select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = along.filter("ends").select("node", "conv").unionByName(convs.filter("size = 0").select(F.lit(ROOT).alias("node"), "conv"))
    out = named.drop("leaves", "saved").join(sums, "node").join(ends_hashes(ends), "node", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, family: int | None = 20) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), rebuilt by families unless ``family`` is None."""
    return trie(*(rebuilt_turns(conversations, family) if family else own_turns(conversations)))


ORACLE_SQL = """
WITH tab AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i::BIGINT], range(0, 8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS tab
), src AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY r) AS own FROM src GROUP BY c
), hs AS (
  SELECT c, own, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                                 lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 AS h FROM conv, tab
), built AS (
  SELECT a.c, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS turns FROM hs a LEFT JOIN hs b ON b.c = a.c - a.c % 20
), path AS (
  SELECT c, d, len(turns) AS size, sha256(turns[1:d]::JSON::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(turns[1:d - 1]::JSON::VARCHAR) END AS parent,
         CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = size), '')) AS ends_sha256
  FROM path GROUP BY node
), kids AS (
  SELECT parent, count(*) AS n FROM nodes GROUP BY parent
), below AS (
  SELECT p.node, count(*) FILTER (k.n IS NULL) AS n_leaves, sum(x.saved) AS saved_tokens
  FROM nodes x JOIN path p ON p.c = x.conv_id AND p.d <= x.depth LEFT JOIN kids k ON k.parent = x.node GROUP BY p.node
)
SELECT x.conv_id, x.depth, up.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN below b USING (node) LEFT JOIN kids k ON k.parent = x.node LEFT JOIN nodes up ON up.node = x.parent
"""
