"""Line dedup by a suffix array over line ids, built by prefix doubling.

Every line becomes an integer, its place among all lines that occur twice or
more (a line that occurs once ends every repeated run, so it needs none). Then
runs of 2, 4, 8, ... lines are named by doubling: a run of 2h lines is the pair of
the names of its halves, and sorting the distinct pairs gives the next names. A
name that occurs once drops out, so rounds end at the longest repeat. Suffixes
with one name are an interval of the suffix array, whose longest common prefix is
at least that long; the first of them is the copy that stays.

The longest prefix that a suffix shares with an earlier one follows by descent:
from its deepest such interval of 2**k lines, half as much, a quarter as much, ...
is added while the longer interval still has an earlier suffix. A run of any
length up to 2**(k + 1) is named by two runs of 2**k lines that cover it. Runs that
no longer run contains are the maximal repeated ones.

A run counts if it has ``min_lines`` lines, or fewer with ``min_words`` words
together. The first occurrence (by doc_id, then row, then line) stays; every
later one is deleted, whole runs at their full length.

Only DataFrame functions. Rows look a name up in a table with one row for each:
it is sent to them, in part if it is large. The names with most rows are in that
part, so a line that a third of all rows are is never dealt by its name.

Defined results: null and empty texts are one empty line; rows without id come
last; repeated rows are copies of each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crossbook.llm._common import looked_up, stored, text_of

MIN_LINES, MIN_WORDS = 3, 50


def _place() -> Column:
    return F.struct("doc", "row", "line")


def _named(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows whose keys occur more than once, with ``name``, the integer of the keys in their order, and ``first``, their first place."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(_place()).alias("first")).filter("n > 1")
    ordered = again.repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = stored(ordered.withColumn("name", F.monotonically_increasing_id()), label)
    return looked_up(rows, names, keys).drop(*keys)


def _ahead(rows: DataFrame, by: int) -> DataFrame:
    """Rows with ``a``, their name, and ``b``, the name ``by`` lines further on in the document, if it has one."""
    there = W.partitionBy("row").orderBy("line").rangeBetween(by, by)
    return rows.select("row", "doc", "line", F.col("name").alias("a"), F.max("name").over(there).alias("b")).filter("b is not null")


def intervals(lines: DataFrame) -> DataFrame:
    """(k, row, doc, line, name, first): each run of 2**k lines that occurs more than once; lines: row, doc, line, h1, h2."""
    level, found = stored(_named(lines, ["h1", "h2"], "line-names"), "runs-0"), []
    while not level.isEmpty():
        found.append(level.withColumn("k", F.lit(len(found))))
        level = stored(_named(_ahead(level, 1 << (len(found) - 1)), ["a", "b"], f"run-names-{len(found)}"), f"runs-{len(found)}")
    out = found[0] if found else level.withColumn("k", F.lit(0))
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def longest_earlier(levels: DataFrame) -> DataFrame:
    """(row, line, size): lines of the longest run from there on that occurs at an earlier place too; none if it has no line."""
    deepest = levels.filter(_place() > F.col("first")).groupBy("row", "line").agg(F.max(F.struct("k", "name")).alias("x"))
    state = stored(deepest.select("row", "line", "x.*", F.expr("shiftleft(1, x.k)").alias("size")), "deepest")
    most = state.agg(F.max("k")).first()[0] or 0
    for j in reversed(range(most)):
        step = state.filter(F.col("k") > j).withColumn("long", F.col("size") + (1 << j))
        asked = stored(step.groupBy("k", "name", "long").agg(F.count("*").alias("n")), "asked")
        members = looked_up(levels.filter(F.col("k") > j).drop("first"), asked, ["k", "name"])
        members = members.withColumn("at", F.col("line") + F.col("long") - F.expr("shiftleft(1, k)"))
        ends = levels.select("k", "row", F.col("line").alias("at"), F.col("name").alias("end"))
        members = stored(members.join(ends, ["k", "row", "at"]).drop("at"), "members")
        keys = ["k", "name", "long", "end"]
        first = members.groupBy(*keys).agg(F.count("*").alias("n"), F.min(_place()).alias("first")).filter("n > 1")
        later = looked_up(members, stored(first, "intervals"), keys).filter(_place() > F.col("first")).select("row", "line", "k", "long", F.lit(True).alias("more"))
        longer = step.join(later, ["row", "line", "k", "long"], "left").select("row", "line", "k", "name", F.when(F.col("more"), F.col("long")).otherwise(F.col("size")).alias("size"))
        state = stored(longer.unionByName(state.filter(F.col("k") <= j)), "deepest")
    return state.select("row", "line", "size")


def repeated_lines(docs: DataFrame, *, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, key, n_lines, n_deleted, deleted ("first:count" of each maximal run, from 0; runs may overlap).

    key is xxhash64 of the text: with doc_id it names the row.
    """
    lines = F.split(text_of(docs, text_col), "\n", -1)
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.size(F.filter(F.split(x, " "), lambda w: w != "")).alias("words")))
    table = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text_of(docs, text_col)).alias("key"), hashed.alias("lines"))
    table = stored(table.withColumn("row", F.monotonically_increasing_id()), "lines")
    each = table.select("row", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.posexplode("lines").alias("line", "x")).select("row", "doc", "line", "x.h1", "x.h2")

    found = longest_earlier(stored(intervals(each), "intervals"))
    per_row = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line", "size"))).alias("runs"))
    # A run that the one a line before contains isn't maximal.
    inside = lambda r, i: F.coalesce((F.get("runs", i - 1)["line"] == r["line"] - 1) & (F.get("runs", i - 1)["size"] == r["size"] + 1), F.lit(False))
    words = lambda r: F.aggregate(F.slice("lines", r["line"] + 1, r["size"]), F.lit(0), lambda s, x: s + x["words"])
    maximal = F.filter(F.filter("runs", lambda r, i: ~inside(r, i)), lambda r: (r["size"] >= min_lines) | (words(r) >= min_words))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    ending = lambda r: r["line"] + r["size"]
    n = F.aggregate("runs", none, lambda acc, r: F.struct(ending(r).alias("end"), (acc["n"] + ending(r) - F.greatest(r["line"], acc["end"])).alias("n")), lambda acc: acc["n"])
    named = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["line"].cast("string"), r["size"].cast("string"))), ",")
    out = table.join(per_row, "row", "left").withColumn("runs", maximal)
    return out.select("doc_id", "key", F.size("lines").cast("long").alias("n_lines"), F.coalesce(n, F.lit(0)).cast("long").alias("n_deleted"), F.coalesce(named, F.lit("")).alias("deleted"))


def line_dedup(docs: DataFrame, *, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text without the deleted lines, of each document."""
    found = stored(repeated_lines(docs, min_lines=min_lines, min_words=min_words, id_col=id_col, text_col=text_col), "deleted")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    # Of repeated rows the first keeps its lines; they can't be told apart here, so all keep them.
    # The smallest count decides before rows without deletions are left out.
    found = found.groupBy("doc_id", "key").agg(F.min_by("deleted", "n_deleted").alias("deleted")).filter("deleted <> ''")
    a, b = rows.alias("a"), found.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.text") == F.col("b.key")), "left")
    runs = F.transform(F.split(F.coalesce("deleted", F.lit("")), ","), lambda r: F.split(r, ":"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.exists(runs, lambda r: (i >= r[0].cast("int")) & (i < r[0].cast("int") + r[1].cast("int"))))
    return both.select("a.doc_id", F.when(F.col("deleted").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
