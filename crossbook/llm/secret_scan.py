"""Secret scan with corpus-wide ownership frequency.

Base spans come from three patterns. Further candidates, outside the base spans, are
values given to other names of credentials, and long tokens of letters and digits whose
characters have an entropy of ``ENTROPY`` bits or more. The hash of every candidate's
value is counted over the corpus by distinct repositories and distinct owners: a value
that several owners have, or many repositories of one owner, is a widely copied
example; one that a single owner has in a few repositories looks live. A document
is a repository of its own, and documents with the same text are one; its source
is the owner. Every live value, of a base span or a further candidate, adds a span of
kind ``owner`` for the value itself; base spans stay whatever their frequency.

Only DataFrame functions. A value is counted after its (repository, owner) pairs
are made distinct where they are read, so a value that a third of all documents
hold moves few rows; rows look frequencies up in a table with one row per value, of
which the most frequent values are sent.

Defined results: null and empty texts have no spans; a null repository or owner
counts as one more, unnamed; rows with null ids and repeated rows are scanned one
by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbook.llm._common import looked_up, stored, text_of

KINDS = ("assign", "access", "hex", "owner")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A longest run is long enough or not, whatever the repetition's lower bound.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
KEYED = r"""(?i:auth|bearer|credentials?|pwd|passphrase|(?:private|access|client|signing|encryption)[_-]?(?:key|id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})"""
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
ENTROPY = 3.0
#: A single owner's value in more repositories than this is copied.
MAX_REPOS = 2
_SPANS = "array<struct<start:int,kind:int,end:int,hash:string,value:int>>"


def _spans(text: Column, pattern: str, kind: int, fits, group: int = 0) -> Column:
    """Spans of the pattern's matches for which ``fits(match, value)``; code points.

    Matches and the text between them alternate, so lengths give positions.
    """
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )

    def placed(p: Column) -> Column:
        sizes = F.zip_with(p["gaps"], p["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(
            F.slice(sizes, 1, F.size(p["hits"])), zero, lambda acc,
            s: F.struct((acc["at"] + s["gap"] + s["hit"]).alias("at"), F.array_append(acc["starts"], acc["at"] + s["gap"]).alias("starts")),
            lambda acc: acc["starts"],
        )
        rows = F.arrays_zip(starts.alias("start"), p["hits"].alias("hit"), p["values"].alias("value"))
        kept = F.filter(rows, lambda r: fits(r["hit"], r["value"]))
        end = lambda r: r["start"] + F.length(r["hit"])
        # A value ends where its match does.
        return F.transform(
            kept,
            lambda r: F.struct(r["start"].alias("start"), F.lit(kind).alias("kind"), end(r).alias("end"), F.md5(r["value"]).alias("hash"), (end(r) - F.length(r["value"])).alias("value")),
        )

    found = F.transform(F.array(parts), placed)[0]  # parts are worked out once
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(_SPANS)


def _entropy(value: Column) -> Column:
    """Bits a character, of the string's own characters."""
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
    return F.aggregate(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))), F.lit(0.0), lambda bits, c: bits - share(c) * F.log2(share(c)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scanned(docs: DataFrame, id_col: str, text_col: str, repo_col: str | None, owner_col: str) -> DataFrame:
    repo = F.coalesce(docs[repo_col].cast("string"), F.lit("")) if repo_col else F.md5(text_of(docs, text_col))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"), repo.alias("repo"), F.coalesce(docs[owner_col].cast("string"), F.lit("")).alias("owner"))
    t = F.col("text")
    always = lambda hit, value: F.lit(True)
    mixed = lambda hit, value: hit.rlike("[0-9].*[0-9]") & hit.rlike("[A-Za-z]") & (_entropy(hit) >= ENTROPY)
    # A further candidate is its value, whatever names it.
    bare = lambda spans: F.transform(
        spans, lambda m: F.struct(m["value"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["hash"].alias("hash"), m["value"].alias("value")),
    )
    base = F.concat(_spans(t, ASSIGN, 0, lambda hit, value: F.length(value) >= 6, 1), _spans(t, ACCESS, 1, always), _spans(t, HEX, 2, always))
    more = F.array_distinct(F.concat(bare(_spans(t, KEYED, 3, always, 1)), _spans(t, TOKEN, 3, mixed)))
    found = rows.select("doc_id", "repo", "owner", base.alias("base"), more.alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    return found.select("doc_id", "repo", "owner", "base", apart.alias("more"))


def secret_scan(
    docs: DataFrame, *, max_owners: int = 1, max_repos: int = MAX_REPOS, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None,
    owner_col: str = "source",
) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    n_live and n_copied: candidates, base ones included, whose value at most
    ``max_owners`` owners and ``max_repos`` repositories have, and those that more
    have. Without ``repo_col`` the digest of the text is the repository.
    """
    scanned = stored(_scanned(docs, id_col, text_col, repo_col, owner_col).withColumn("at", F.monotonically_increasing_id()), "secrets")
    each = scanned.select("at", "repo", "owner", F.explode(F.concat("base", "more")).alias("s")).select("at", "repo", "owner", "s")
    owned = each.select(F.col("s.hash").alias("hash"), "repo", "owner").distinct().groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))
    owned = stored(owned.withColumn("n", F.col("repos")), "owned")
    told = looked_up(each.withColumn("hash", F.col("s.hash")), owned, ["hash"]).withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    per_doc = told.groupBy("at").agg(
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"),
        F.collect_set(F.when(
            F.col("live"),
            F.struct(F.col("s.value").alias("start"), F.lit(3).alias("kind"), F.col("s.end").alias("end"), F.lit("").alias("hash"), F.col("s.value").alias("value")),
        )).alias("added"),
    )
    out = scanned.join(per_doc, "at", "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
