"""Benchmark decontamination with SimHash windows and Hamming blocks.

Benchmark items are cut into shingles of five words (shorter items are one
shingle). A window of a document is as many words as an item has, fewer at the
document's end. Every window and item has a 64-bit SimHash over its shingles,
weighted by how often each occurs. The fingerprint is cut into ``BLOCKS`` blocks
that share the radius out among them: fingerprints within the radius differ in at
least one block by no more bits than its share. An item is filed under all values
so near to each of its blocks, a window looks up its own, so all pairs of a size within
the radius meet, whatever item a window's words come from. They are verified by the
exact weighted similarity: sum of the smaller counts over sum of the larger.

Windows that can't be similar to any item of their size aren't fingerprinted: those
with too few shingles of such items in them to reach the threshold. Of the others,
those count that begin with such a shingle: a window that begins with another word
is moved on to the next one without losing anything that it shares with an item.

The radius is wide, since at a similarity of 0.75 the expected distance is 11
bits and its deviation 3: at 22, a window at the threshold is lost with a chance
of about 1e-4, an exact copy never. A third of all bits is far for any index: five
blocks of 13 bits with shares of 4 meet half of the pairs of a size, where 23 blocks
without a share meet each pair several times, and longer fingerprints gain little.

Only DataFrame functions. Hot passages: shingles meet the benchmark table where
the documents are read, equal fingerprints are looked up once, and what many windows
look up is sent to them (``looked_up``), so nothing is dealt by passage.

Defined results: null and empty texts have no windows; an item that is null or
blank matches nothing; items with null id are named "null"; repeated items and
documents are handled row by row; an empty table on either side finds nothing;
other columns of either table are ignored. Words are lower-cased (letters beyond
A-Z too) and split at x20 and x09-x0D.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbook.llm._common import BROADCAST_ROWS, looked_up, narrowed, stored, text_of

WIDTH, RADIUS, BITS, BLOCKS = 5, 22, 64, 5
#: Rows with a list of items (of one size) that are sent to every task, at most.
SENT = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[ \\t-\\r]+"), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def shingles(words: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words; none if there are fewer words."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
    return bound(words, lambda w: F.when(F.size(w) >= width, cut(w)).otherwise(F.array().cast("array<long>")))


def simhash(hashes: Column) -> Column:
    """Bit i is 1 if more of the hashes have it than not; repeated hashes count again."""
    start = F.array_repeat(F.lit(0), BITS)
    votes = F.aggregate(hashes, start, lambda acc, h: F.zip_with(acc, F.sequence(F.lit(0), F.lit(BITS - 1)), lambda v, i: v + F.when(F.call_function("getbit", h, i) == 1, 1).otherwise(-1)))
    powers = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(BITS)])
    return F.aggregate(F.zip_with(votes, powers, lambda v, p: F.when(v > 0, p).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def shares(radius: int, n_blocks: int = BLOCKS) -> list[int]:
    """How far each block may differ: at distance ``radius`` not all blocks can differ by more."""
    left = radius + 1
    each = -(-left // n_blocks)
    out = []
    for _ in range(n_blocks):
        out.append(min(each, left) - 1)
        left -= out[-1] + 1
    return out  # -1: a block that isn't needed


def _cut(n_blocks: int) -> list[tuple[int, int]]:
    edges = [BITS * k // n_blocks for k in range(n_blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def blocks(fingerprint: Column, radius: int, n_blocks: int = BLOCKS) -> Column:
    """Structs (block, bits) of the blocks that have a share of the radius."""
    return F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
        for k, ((a, b), share) in enumerate(zip(_cut(n_blocks), shares(radius, n_blocks), strict=True)) if share >= 0
    ])


def near_blocks(fingerprint: Column, radius: int, n_blocks: int = BLOCKS) -> Column:
    """Structs (block, bits) of all values that differ from a block by its share or less."""
    own = blocks(fingerprint, radius, n_blocks)

    def near(k: int, width: int, share: int) -> Column:
        masks = [sum(1 << i for i in flips) for t in range(min(share, width) + 1) for flips in combinations(range(width), t)]
        return F.transform(F.lit(masks).cast("array<long>"), lambda m: F.struct(F.lit(k).alias("block"), own[k]["bits"].bitwiseXOR(m).alias("bits")))

    parts = zip(_cut(n_blocks), shares(radius, n_blocks), strict=True)
    return F.concat(*[near(k, b - a, share) for k, ((a, b), share) in enumerate(parts) if share >= 0])


def marked(hashes: Column) -> Column:
    """A set with an element for each occurrence: the hash with how many of the same are before it."""
    return bound(F.array_sort(hashes), lambda s: F.transform(s, lambda h, i: F.xxhash64(h, i - F.array_position(s, h))))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, n, width, hashes, fingerprint) of each item with words."""
    words = benchmark.select(benchmark[id_col].cast("string").alias("item_id"), words_of(text_of(benchmark, text_col)).alias("words")).filter("size(words) > 0")
    sized = words.withColumn("n", F.size("words")).withColumn("width", F.least("n", F.lit(WIDTH)))
    hashes = F.when(F.col("n") < WIDTH, F.array(F.xxhash64("words"))).otherwise(shingles(F.col("words"), WIDTH))
    return stored(sized.withColumn("hashes", hashes).withColumn("fingerprint", simhash(F.col("hashes"))).withColumns({"item": F.monotonically_increasing_id(), "marks": marked(F.col("hashes"))}).drop("words"), "items")


def passages(
    docs: DataFrame, benchmark: DataFrame, *, percent: int = 75, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, key, item_id, start, n_words, shared, total): each fingerprinted window that repeats an item; start counts words.

    key is xxhash64 of the document's text; shared / total is the similarity.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    items = _items(benchmark, item_id_col, item_text_col)
    index = stored(items.select("width", "n", F.explode("hashes").alias("h")).distinct(), "item-shingles")
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    seeds = None
    for width in sorted(r[0] for r in items.select("width").distinct().collect()) or [WIDTH]:  # WIDTH values at most
        cut = rows.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(shingles(words_of(F.col("text")), width)).alias("pos", "h"))
        found = cut.join(index.filter(F.col("width") == width), "h").select("doc_id", "key", "n", "pos")
        seeds = found if seeds is None else seeds.unionByName(found)
    placed = seeds.groupBy("doc_id", "key", "n").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    placed = placed.withColumn("size", F.greatest(F.col("n") - (WIDTH - 1), F.lit(1)))
    placed = placed.withColumn("least", F.greatest(F.ceil(F.col("size") * percent / 100), F.lit(1)).cast("int"))
    # What a window shares with an item is at most its places, and at least this share of the item.
    starts = F.filter("places", lambda p, i: F.get("places", i + F.col("least") - 1) < p + F.col("size"))
    seeds = stored(placed.select("doc_id", "key", "n", F.explode(starts).alias("start")), "seeds")

    # Once more over the texts, of documents with a seed only: their windows' own shingles.
    hit = narrowed(rows, stored(seeds.select("doc_id").distinct(), "seed-ids")).dropDuplicates(["doc_id", "text"])
    worded = hit.select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    per_doc = seeds.groupBy("doc_id", "key").agg(F.collect_list(F.struct("n", "start")).alias("seeds"))
    a, b = worded.alias("a"), per_doc.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))).select("a.doc_id", "a.key", "a.words", F.explode("b.seeds").alias("s"))
    cut = both.select("doc_id", "key", "s.start", "s.n", F.slice("words", F.col("s.start") + 1, F.col("s.n")).alias("window"))
    hashes = F.when(F.size("window") < WIDTH, F.array(F.xxhash64("window"))).otherwise(shingles(F.col("window"), WIDTH))
    cut = cut.withColumn("hashes", hashes).drop("window")
    windows = stored(cut.select("doc_id", "key", "start", "n", simhash(F.col("hashes")).alias("fingerprint"), marked(F.col("hashes")).alias("marks")), "windows")

    prints = stored(windows.groupBy("n", "fingerprint").agg(F.count("*").alias("windows")), "fingerprints")
    filed = items.select("item", "n", F.col("fingerprint").alias("of"), F.explode(near_blocks(F.col("fingerprint"), radius)).alias("b"))
    filed = filed.groupBy(F.col("n").alias("size"), "b.block", "b.bits").agg(F.collect_list(F.struct("item", "of")).alias("items"), F.count("*").alias("n"))
    asked = prints.select(F.col("n").alias("size"), "fingerprint", F.explode(blocks(F.col("fingerprint"), radius)).alias("b")).select("size", "fingerprint", "b.*")
    met = looked_up(asked, stored(filed, "filed"), ["size", "block", "bits"], SENT)
    near = met.select("size", "fingerprint", F.explode(F.filter("items", lambda i: F.bit_count(i["of"].bitwiseXOR(F.col("fingerprint"))) <= radius)["item"]).alias("item"))
    near = near.distinct().groupBy(F.col("size").alias("n"), "fingerprint").agg(F.collect_list("item").alias("items"))
    near = stored(near.join(prints, ["n", "fingerprint"]).select(F.col("n").alias("size"), "fingerprint", "items", F.col("windows").alias("n")), "near")
    pairs = looked_up(windows.withColumnRenamed("n", "size"), near, ["size", "fingerprint"], SENT).withColumn("item", F.explode("items")).drop("items")
    wanted = near.select(F.explode("items").alias("item"), F.col("n").alias("windows")).groupBy("item").agg(F.sum("windows").alias("n"))
    named = stored(items.select("item", "item_id", F.col("marks").alias("of_item")).join(wanted, "item"), "items-met")
    pairs = looked_up(pairs, named, ["item"], 20_000)
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("of_item", "marks")))
    pairs = pairs.withColumn("total", F.size("of_item") + F.size("marks") - F.col("shared"))
    return pairs.filter(F.col("shared") * 100 >= F.col("total") * percent).select("doc_id", "key", "item_id", "start", F.col("size").alias("n_words"), "shared", "total")


def decontamination(
    docs: DataFrame, benchmark: DataFrame, *, percent: int = 75, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row for each document: doc_id, key, contaminated, n_items, item_ids (sorted, comma-joined), similarity (largest, 4 places)."""
    found = passages(docs, benchmark, percent=percent, radius=radius, id_col=id_col, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col)
    named = found.withColumn("item_id", F.coalesce("item_id", F.lit("null")))
    per_doc = named.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item_id")).alias("ids"), F.max(F.col("shared") / F.col("total")).alias("best"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text_of(docs, text_col)).alias("key"))
    a, b = rows.alias("a"), stored(per_doc, "contaminated").alias("b")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    return out.select(
        "a.doc_id", "a.key", F.col("b.key").isNotNull().alias("contaminated"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("item_ids"), F.round(F.coalesce("best", F.lit(0.0)), 4).alias("similarity"),
    )
