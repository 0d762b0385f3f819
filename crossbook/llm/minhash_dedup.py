"""Near-duplicates by MinHash bands with sequential Bayesian verification.

1. Every text becomes a set of shingles (64-bit hashes), a MinHash signature and
   one key for each band of it. Texts with equal sets are one class from here on.
2. In each band bucket, every class is a candidate with the bucket's first class,
   so a bucket of a thousand copies gives a thousand pairs, not half a million.
3. Candidates compare signatures batch by batch. A pair goes as soon as the
   posterior chance that its similarity reaches the threshold is under ``MISS``.
4. Each class keeps its best candidate; the pair is verified on the full sets.
   Verified pairs join classes into components.
5. Where many pairs of different components share buckets, buckets are dealt into
   parts of about ``PART`` classes, differently each time, and 3 and 4 run again
   with a leader in each part, until such pairs are few or a round no longer
   settles a good share of them (they are truly different, or nearly all are).
6. What is left, exactly: classes that share a bucket and are still in different
   components are compared by size and by a parity mask of their shingles, inside
   the join, which only gives out pairs that may still be linked. Two sets differ
   in at least as many shingles as their masks in bits, so no link is lost. Only
   these pairs run through 3 and the verification; pairs within a component never do.
7. Components of all links.

The comparison in 6 still looks at every two unsettled classes of a bucket, in
blocks of about ``BLOCK`` classes; what it gives out grows with the links.

Recall: a pair at the threshold shares no band with a chance of
``(1 - 0.75**ROWS) ** BANDS``, about 5e-6.

Defined results: null, empty and blank texts have no shingles and are linked
with nothing; repeated rows are copies of one another; rows without id are in
their class but never name a component (a component of such rows only has null);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.llm._common import narrowed, stored, text_of, tidy

WIDTH, BANDS, ROWS, BATCH, MISS = 5, 32, 4, 32, 1e-6
#: Classes of a part of a bucket; open pairs for each member up to which they are all verified.
PART, DIRECT = 16, 3
#: Classes of a block of a bucket's unsettled members; 64-bit words of a mask.
BLOCK, MASK = 1024, 16
#: Share of the open pairs that a round must settle for another one to follow; the rest is verified pair by pair.
PAYS = 0.25
_SEED = np.random.default_rng(20240501)
_XOR = _SEED.integers(0, 1 << 32, BANDS * ROWS, dtype="u8").astype("u4")
_MUL = _SEED.integers(0, 1 << 31, BANDS * ROWS, dtype="u8").astype("u4") * np.uint32(2) + np.uint32(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a task remembers; then it starts afresh.
REMEMBERED = 200_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Texts to sorted sets of 64-bit shingle hashes."""

    def __init__(self):
        import xxhash

        self._hash, self._known = xxhash.xxh3_64_intdigest, {}

    def words(self, text: str) -> np.ndarray:
        # bytes.lower changes A-Z only, bytes.split takes x20 and x09-x0D for white space.
        words, known = text.encode().lower().split(), self._known
        try:
            return np.fromiter(map(known.__getitem__, words), "u8", len(words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            known.update((w, self._hash(w)) for w in set(words).difference(known))
            return np.fromiter(map(known.__getitem__, words), "u8", len(words))

    def set(self, text: str) -> np.ndarray:
        w = self.words(text)
        width = min(WIDTH, len(w))
        if not width:
            return w
        h = np.full(len(w) - width + 1, width, "u8")
        for k in range(width):
            h = _mix(h * _ODD + w[k : len(w) - width + 1 + k])
        return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    x, least = (shingles >> np.uint64(32)).astype("u4"), np.full(BANDS * ROWS, 0xFFFFFFFF, "u4")
    for at in range(0, len(x), 2048):
        np.minimum(least, ((x[at : at + 2048, None] ^ _XOR) * _MUL).min(0), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype="u8")
    for k in range(ROWS):
        h = _mix(h * _ODD + sig.reshape(BANDS, ROWS)[:, k])
    return h.view("i8")


def mask(shingles: np.ndarray) -> list[int]:
    """Parity of how many shingles fall on each of 64 * MASK bits."""
    odd = np.bincount(_mix(shingles) >> np.uint64(64 - (64 * MASK).bit_length() + 1), minlength=64 * MASK) & 1
    return np.packbits(odd.astype("u1")).view("i8").tolist()


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "i8").tolist())


def _signed(batches):
    shingler = Shingler()
    for batch in batches:
        n, lo, hi, sigs, bands, masks = [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingler.set(text)
            n.append(len(s))
            a, b = _digest(s) if len(s) else (None, None)
            lo.append(a)
            hi.append(b)
            sig = signature(s) if len(s) else None
            sigs.append(None if sig is None else sig.astype("u2").tobytes())
            bands.append(None if sig is None else band_keys(sig))
            masks.append(None if sig is None else mask(s))
        cols = [
            batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
            pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(masks, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n", "lo", "hi", "sig", "bands", "mask"])


def _sets(batches):
    shingler = Shingler()
    for batch in batches:
        sets = [shingler.set(t) for t in batch.column("text").to_pylist()]
        digests = [_digest(s) if len(s) else (None, None) for s in sets]
        cols = [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["lo", "hi", "set"])


def least_matches(threshold: float, seen: int, miss: float) -> int:
    """The fewest of ``seen`` equal hashes at which a pair may still reach the threshold.

    With a uniform prior, P(similarity >= t | m of k) = P(Binomial(k + 1, t) <= m).
    """
    total = 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if total >= miss:
            return m
    return seen + 1


def _pruner(threshold: float):
    least = [(k, least_matches(threshold, k, MISS)) for k in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u2").reshape(-1, BANDS * ROWS) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(len(x)), np.zeros(len(x), "i4")
            for k, need in least:
                part = slice(k - BATCH, k)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(1, dtype="i4")
                alive = alive[matches[alive] >= need]
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(matches[alive], pa.int32())], names=["a", "b", "matches"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the smallest node that each one can reach.

    Each node points to its smallest neighbour; pointers are followed by doubling;
    then every tree becomes one node, until no link is left between trees.
    """
    links = stored(links.select("a", "b").distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            higher = stored(parent.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")), "parents")
            parent = higher.select("node", "root")
            if higher.filter("moved").isEmpty():
                break
        tops = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = parent if found is None else stored(found.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        ends = links.join(parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(parent.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        links = stored(ends.filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _both(pairs: DataFrame, table: DataFrame, col: str) -> DataFrame:
    """Column ``col`` of both classes of each pair."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("cid").alias(side), F.col(col).alias(f"{col}_{side}")), side)
    return pairs


def _pruned(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    sized = _both(_both(pairs, classes, "n").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b"), classes, "sig")
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(_pruner(percent / 100)), "a long, b long, matches int")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold; sets are made again for the classes in question."""
    ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = stored(classes.select("cid", "lo", "hi", "rep").join(ids, "cid", "left_semi"), "wanted")
    texts = narrowed(rows, stored(wanted.select(F.col("rep").alias("doc_id")).distinct(), "wanted-ids")).select("text")
    sets = stored(texts.mapInArrow(tidy(_sets), "lo long, hi long, set array<long>").join(wanted, ["lo", "hi"]).dropDuplicates(["cid"]).select("cid", "set"), "sets")
    met = _both(pairs, sets, "set").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return met.filter(F.col("both") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("both")) * percent).select("a", "b")


def _sorted(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))


def _unsettled(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, int, int]:
    """Members of the buckets with several components; how many pairs of different components these have, and how many members."""
    rooted = members.filter("size > 2").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("in_bucket"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    mixed = stored(sizes.withColumn("pairs", (F.col("in_bucket") * F.col("in_bucket") - F.col("squares")) / 2).filter("pairs > 0"), "mixed")
    total = mixed.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("in_bucket"), F.lit(0))).first()
    return stored(rooted.join(mixed.select("key", "in_bucket"), "key"), "unsettled"), int(total[0]), int(total[1])


def _may_link(rooted: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in a bucket whose sizes and masks leave the similarity open.

    A pair reaches it only if the sets differ in at most (100 - percent) / (100 + percent) of both sizes.
    """
    sized = rooted.join(classes.select("cid", "n", "mask"), "cid").withColumn("parts", F.ceil(F.col("in_bucket") / BLOCK))
    sized = sized.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))
    cells = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other"))
    cells = cells.select("key", "x", "y", "cid", "root", "n", "part", *[F.col("mask")[k].alias(f"m{k}") for k in range(MASK)])
    a, b = cells.alias("a"), cells.alias("b")
    col = lambda side, c: F.col(f"{side}.{c}")
    met = [col("a", c) == col("b", c) for c in ("key", "x", "y")] + [col("a", "cid") < col("b", "cid"), col("a", "root") != col("b", "root")]
    met.append((col("a", "x") == col("a", "y")) | (col("a", "part") != col("b", "part")))
    met.append(F.least(col("a", "n"), col("b", "n")) * 100 >= F.greatest(col("a", "n"), col("b", "n")) * percent)
    differ = sum((F.bit_count(col("a", f"m{k}").bitwiseXOR(col("b", f"m{k}"))) for k in range(1, MASK)), F.bit_count(col("a", "m0").bitwiseXOR(col("b", "m0"))))
    met.append(differ * (100 + percent) <= (col("a", "n") + col("b", "n")) * (100 - percent))
    return a.join(b, met).select(col("a", "cid").alias("a"), col("b", "cid").alias("b"))


def near_dedup(docs: DataFrame, *, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, key (xxhash64 of the text; with doc_id it names the row)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    signed = stored(rows.withColumn("key", F.xxhash64("text")).mapInArrow(tidy(_signed), "doc_id long, key long, n long, lo long, hi long, sig binary, bands array<long>, mask array<long>"), "signed")
    classes = signed.filter("n > 0").groupBy("lo", "hi").agg(
        F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"),
        F.any_value("mask").alias("mask"),
    )
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = classes.select("cid", F.explode("bands").alias("key"))
    buckets = stored(members.groupBy("key").agg(F.min("cid").alias("first"), F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = stored(members.join(buckets, "key").select("key", "cid", "first", "size"), "members")

    stars = stored(_pruned(members.filter("cid != first").select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct(), classes, percent), "stars")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")).select("a", "b")
    links = stored(_verified(stored(best, "best"), classes, rows, percent), "links")

    tried, at, before = best, 0, None
    while True:
        at += 1
        roots = components(links)
        rooted, open_pairs, size = _unsettled(members, roots)
        if open_pairs <= DIRECT * size or (before is not None and open_pairs > (1 - PAYS) * before):
            break
        before = open_pairs
        parts = rooted.withColumn("part", F.pmod(F.xxhash64("cid", F.lit(at)), F.ceil(F.col("in_bucket") / PART)))
        leads = parts.groupBy("key", "part").agg(F.min_by(F.struct("cid", "root"), F.xxhash64("cid", F.lit(-at))).alias("lead"))
        stars2 = parts.join(leads, ["key", "part"]).filter("root != lead.root").select(F.col("lead.cid").alias("a"), F.col("cid").alias("b")).distinct()
        close = _pruned(stars2.join(_sorted(tried), [F.least("a", "b") == F.col("x"), F.greatest("a", "b") == F.col("y")], "left_anti"), classes, percent)
        picked = stored(close.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")).select("a", "b"), "picked")
        new = stored(_verified(picked, classes, rows, percent), "links")
        tried, links = tried.unionByName(picked), links.unionByName(new)
        if new.isEmpty():
            break
    pairs = stored(_may_link(rooted, classes, percent).distinct(), "open")
    fresh = pairs.unionByName(stars.select("a", "b")).distinct().join(_sorted(tried), [F.col("a") == F.col("x"), F.col("b") == F.col("y")], "left_anti")
    rest = _pruned(fresh, classes, percent)
    for side in "ab":
        rest = rest.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    rest = stored(rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "rest")
    more = _verified(rest, classes, rows, percent)
    final = components(links.unionByName(more))

    named = classes.select("lo", "hi", "rep", "cid").join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("lo", "hi", "component_id")
    out = signed.select("doc_id", "key", "n", "lo", "hi").join(named, ["lo", "hi"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "key")
