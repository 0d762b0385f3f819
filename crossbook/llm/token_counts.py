"""Token counts without token ids.

A piece model never merges across the start of a run of spaces, so a text
splits into pre-tokens (spaces, then non-spaces) whose pieces can be counted
apart. Each distinct pre-token of the corpus is encoded once; a document's
count is the sum over its pre-tokens of frequency times pieces.

The most frequent pre-tokens (``hot``, a fixed number) go to every task, which
adds them up on the spot; the others are joined by key, so what is shuffled is
the tail of the frequency distribution only.

Defined results: a null or empty text has no tokens; rows are counted one by
one, repeated ids and null ids included; an empty table gives an empty result;
other columns are ignored. Texts of any length are counted whole.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.llm._common import stored, text_of

#: Pre-tokens that are sent to every task, at most.
HOT = 200_000
#: Pre-tokens longer than this are counted where they stand, never sent about.
LONG = 256
#: Distinct pre-tokens that a task gathers before it passes them on.
HELD = 400_000
_PRE = re.compile(r"▁+[^▁]*")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, spaces as U+2581, without the first space that each begins with."""
    if not text:
        return []
    if "▁" not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _PRE.findall("▁" + text.replace(" ", "▁"))]


class PieceCounter:
    """Counts the pieces of pre-tokens with the tokenizer's own library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if "▁" in p.lstrip("▁")]
        if inner:
            raise ValueError(f"pieces go across spaces: {inner[:3]}")

    def count(self, pre: list[str]) -> list[int]:
        # The library puts the first space back, but not before nothing: a space alone is one piece.
        return [len(x) if p else 1 for p, x in zip(pre, self.model.encode(pre, num_threads=1), strict=True)] if pre else []


def _corpus_counts(batches):
    """(pre, n) of the task's rows; gathered in a dictionary of bounded size."""
    held: Counter = Counter()

    def out():
        keys = iter(list(held.items()))
        while part := list(islice(keys, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["pre", "n"])
        held.clear()

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(x for x in pre_tokens(text) if len(x) <= LONG)
            if len(held) > HELD:
                yield from out()
    yield from out()


def _pieces(path: str):
    def run(batches):
        counter = PieceCounter(path)
        for batch in batches:
            pre = batch.column("pre").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("pre"), batch.column("n"), pa.array(counter.count(pre), pa.int32())], names=["pre", "n", "pieces"])

    return run


def _frequencies(path: str, hot):
    """A document's tail pre-tokens as rows; the first one carries what the task has summed itself."""

    def run(batches):
        known: dict[str, int] = hot.value
        spread, counter, at = list(known), PieceCounter(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, ids, bases, sizes, pres, ns = [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, tail = 0, []
                for pre, n in Counter(pre_tokens(text)).items():
                    if (k := known.get(pre)) is not None:
                        base += n * k
                    elif len(pre) <= LONG:
                        tail.append((pre, n))
                    else:
                        base += n * counter.count([pre])[0]
                if not tail:  # any known key will do; at varies, so that no key gets all of these
                    tail = [(spread[at * 2654435761 % len(spread)] if spread else None, 0)]
                rows += [at] * len(tail)
                ids += [doc] * len(tail)
                pres += [x for x, _ in tail]
                ns += [n for _, n in tail]
                bases += [base] + [0] * (len(tail) - 1)
                sizes += [len(text.encode())] + [0] * (len(tail) - 1)
                at += 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((rows, ids, pres, ns, bases, sizes), kinds, strict=True)], names=["row", "doc_id", "pre", "n", "base", "n_bytes"])

    return run


def token_counts(docs: DataFrame, path: str, *, limit: int = 4096, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    counts = rows.select("text").mapInArrow(_corpus_counts, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    table = stored(counts.mapInArrow(_pieces(path), "pre string, n long, pieces int"), "pre-tokens")
    first = table.orderBy(F.desc("n"), "pre").limit(hot).select("pre", "pieces").toArrow()
    known = dict(zip(first.column("pre").to_pylist(), first.column("pieces").to_pylist(), strict=True))
    sent = spark.sparkContext.broadcast(known)
    tail = rows.mapInArrow(_frequencies(path, sent), "row long, doc_id long, pre string, n long, base long, n_bytes long")
    # Each pre-token of a row is in the table; rows without any have a null key and come through the left join.
    joined = tail.join(table.select("pre", "pieces"), "pre", "left")
    sums = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("base") + F.col("n") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
