"""Fill-in-the-middle: documents cut in three and put in another order.

Everything is an expression over one row: a regular expression makes the array of
units, parts of a SHA-256 make the two cuts, slices of the array joined again make
the arrangement. Nothing is shuffled and no Python runs.

A text is first cut in blocks of ``BLOCK`` units, and only the blocks that a cut
falls into are cut in single units, so the array of a very long text stays short.
Slices by place in this array are the same as slices of the array of all units.

Defined results: a null or empty text is plain and gives empty output; a text that
contains a sentinel is plain; a null id counts as an empty one in the hash; rows are
handled one by one, repeated rows and repeated ids included; an empty table gives an
empty result; other columns are ignored. Texts of any length are arranged whole.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbook.llm._common import text_of

#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Units of a block; a block is one match of a bounded repetition.
BLOCK = 1024


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Parsing is unique if no sentinel can begin inside another one or run over its end."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a, b in product(sentinels, sentinels):
        if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError(f"sentinels overlap: {a!r}, {b!r}")


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def draws(key: Column, salt: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers of a row, by the hash of its key."""
    hexes = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexes, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def arrange(
    docs: DataFrame, *, sentinels: tuple[str, str, str] = SENTINELS, plain_pct: int = 10, spm_pct: int = 20, salt: str = "1",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars and output of each document.

    ``plain_pct`` of 100 documents stay as they are; of the others ``spm_pct`` of 100 get the
    suffix first (form spm), the rest the prefix (psm).
    """
    check_sentinels(sentinels)
    p, s, m = map(F.lit, sentinels)
    h1, h2, h3, h4 = draws(docs[id_col], salt)
    text = text_of(docs, text_col)
    held = text.rlike("|".join(map(_literal, sentinels)))
    # Columns that others use more than once are steps of their own, so that each is worked out once.
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"), F.char_length(text).cast("long").alias("n"), held.alias("held"))
    form = F.when((F.col("n") == 0) | F.col("held") | (F.col("h3") % 100 >= 100 - plain_pct), "plain").when(F.col("h4") % 100 < spm_pct, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    rows = rows.withColumns({"a_block": (F.col("a") / BLOCK).cast("int"), "b_block": (F.col("b") / BLOCK).cast("int")})
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), 0)
    units = F.flatten(F.transform(blocks, lambda x, i: F.when((i == F.col("a_block")) | (i == F.col("b_block")), F.regexp_extract_all(x, F.lit("(?s)."), 0)).otherwise(F.array(x))))
    rows = rows.withColumn("units", F.when(F.col("form") != "plain", units))
    # A cut's place: the blocks before it, BLOCK - 1 more if one of them is cut up, and its place in its own.
    a_at = (F.col("a_block") + F.col("a") % BLOCK).cast("int")
    b_at = (F.col("b_block") + F.col("b") % BLOCK + F.when(F.col("a_block") < F.col("b_block"), BLOCK - 1).otherwise(0)).cast("int")
    rows = rows.withColumns({"a_at": a_at, "b_at": b_at})

    def joined(begin, size) -> Column:
        return F.array_join(F.slice("units", begin, size), "")

    prefix, middle, suffix = joined(F.lit(1), F.col("a_at")), joined(F.col("a_at") + 1, F.col("b_at") - F.col("a_at")), joined(F.col("b_at") + 1, F.greatest(F.size("units") - F.col("b_at"), F.lit(0)))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(arranged: DataFrame, *, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows with ``restored``: the text, from output and form alone."""
    check_sentinels(sentinels)
    parts = F.split("output", "|".join(map(_literal, sentinels)), -1)
    rows = arranged.withColumn("_parts", F.when(F.col("form") != "plain", parts))
    part = [F.col("_parts")[k] for k in range(4)]
    text = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
    return rows.withColumn("restored", text).drop("_parts")


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sentinels = options.get("sentinels", SENTINELS)
    rows = restore(arrange(docs, **options), sentinels=sentinels)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM n
), f AS (
  SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
