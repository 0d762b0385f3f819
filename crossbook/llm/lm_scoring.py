"""Language-model scoring by cross-entropy difference.

Two bigram models with the same vocabulary, order and smoothing: one of the
target documents, one of all documents. A document's score is the mean over its
tokens of target loss minus background loss (in nats): the lower, the more the
document is like the target.

Counts cover every token of every document, every word and every bigram; nothing
is pruned on either side. Words and bigrams are named by 62-bit hashes: at 10^9
bigrams about 0.1 pairs of them share a name.

1. Texts become chunks of about ``CHUNK`` tokens: numbers of the chunk's own words,
   and these words' hashes. A long text goes on in the next chunk.
2. A chunk asks for the counts of its words and bigrams: its sorted hashes with its
   own counts are cut by ranges of hashes, so a row holds many of them.
3. For each range, the chunks' counts are added up; every chunk gets the sums
   in the order in which it asked.
4. Each chunk is scored with these sums, and a text's pieces are added up.

A bigram that is frequent everywhere is one number a chunk, one that occurs once
moves once; no table of counts is sent to the tasks, at any size.

Defined results: a null or empty text has no tokens, losses and score 0; target
ids that are null or unknown are ignored; repeated rows count and are scored one
by one; without target documents the target model is the uniform prior over the
background's unigrams; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.llm._common import small, stored, text_of

PRIOR = 2.0
#: Tokens of a chunk; hashes of a range, on average.
CHUNK, RANGE = 400_000, 1_000_000
#: Hashes have so many bits; the words' ranges are by this many bits wider than the bigrams'.
BITS, WIDER = 62, 3
#: Bytes of a text that are cut into words at a time.
PART = 1 << 20
_START = np.uint64(1)
_BLANK = re.compile(rb"[\x09-\x0d\x20]")
_ENCODED = "chunk long, doc_ids array<long>, rows binary, sizes binary, targets binary, before binary, words binary, ids binary, n long, t long, texts long, target_texts long"


def planes(values: np.ndarray, kind: str) -> bytes:
    """The numbers' first bytes, then their second ones and so on, compressed: high ones are mostly 0."""
    parts = np.ascontiguousarray(values.astype(kind).view("u1").reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(parts.tobytes())


def from_planes(data: bytes, kind: str) -> np.ndarray:
    parts = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1")
    return np.ascontiguousarray(parts.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Words(dict):
    """Numbers for a chunk's words, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _cut(text: str):
    """The text's words, part by part."""
    data = text.encode().lower()
    at = 0
    while at < len(data):
        end = _BLANK.search(data, at + PART)
        end = end.start() if end else len(data)
        yield data[at:end].split()
        at = end


def _encoded(chunk_tokens: int):
    def run(batches):
        import xxhash

        base = TaskContext.get().partitionId() << 33
        row, chunk = base, base
        words, pieces, parts, size = _Words(), [], [], 0

        def out():
            nonlocal words, chunk, size
            doc_ids, rows, sizes, targets, before, begun = zip(*pieces, strict=True)
            sizes, targets, begun = np.array(sizes, "i8"), np.array(targets, "i1"), np.array(begun, "i8")
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
            blobs = [
                np.array(rows, "i8").tobytes(), sizes.tobytes(), targets.tobytes(), np.array(before, "i8").tobytes(), hashes.tobytes(),
                planes(np.concatenate(parts) if parts else np.zeros(0, "u4"), "u4"),
            ]
            sums = [int(sizes.sum()), int((sizes * targets).sum()), int(begun.sum()), int((begun * targets).sum())]
            cols = [pa.array([chunk], pa.int64()), pa.array([list(doc_ids)], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in blobs), *(pa.array([s], pa.int64()) for s in sums)]
            words, chunk, size = _Words(), chunk + 1, 0
            pieces.clear(), parts.clear()
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "doc_ids", "rows", "sizes", "targets", "before", "words", "ids", "n", "t", "texts", "target_texts"])

        for batch in batches:
            texts = batch.column("text")
            for i, (doc, target) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("target").to_pylist(), strict=True)):
                first, last = True, None
                for found in _cut(texts[i].as_py()):
                    for at in range(0, len(found), chunk_tokens):
                        some = found[at : at + chunk_tokens]
                        # The word before a piece is one of the chunk's words, though it isn't counted in it.
                        pieces.append((doc, row, len(some), target, -1 if last is None else words[last], first))
                        parts.append(np.fromiter(map(words.__getitem__, some), "u4", len(some)))
                        first, last, size = False, some[-1], size + len(some)
                        if size >= chunk_tokens:
                            yield out()
                if first:
                    pieces.append((doc, row, 0, target, -1, True))
                row += 1
        if pieces:
            yield out()

    return run


class Chunk:
    """A chunk's words and bigrams: sorted hashes, and the places of its tokens among them."""

    def __init__(self, sizes: bytes, targets: bytes, before: bytes, words: bytes, ids: bytes):
        self.sizes, self.targets, self.before = np.frombuffer(sizes, "i8"), np.frombuffer(targets, "i1"), np.frombuffer(before, "i8")
        hashes, self.ids = np.frombuffer(words, "u8"), from_planes(ids, "u4").astype("i8")
        self.target = np.repeat(self.targets, self.sizes)
        # The number of the word before each token, -1 at the start of a text.
        self.previous = np.concatenate([[-1], self.ids[:-1]])[: len(self.ids)]
        some = self.sizes > 0
        self.previous[(np.cumsum(self.sizes) - self.sizes)[some]] = self.before[some]
        x = np.where(self.previous < 0, _START, hashes[self.previous] if len(hashes) else _START)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + hashes[self.ids]
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(32)) >> np.uint64(64 - BITS)
        self.pairs, self.first, self.place, n = np.unique(x.view("i8"), return_index=True, return_inverse=True, return_counts=True)
        keys = (hashes >> np.uint64(64 - BITS)).view("i8")
        self.order = np.argsort(keys, kind="stable")
        self.words = keys[self.order]
        own = lambda at, k, size: np.bincount(at, None if k is None else k, size).astype("i8")
        self.n = np.concatenate([own(self.ids, None, len(keys))[self.order], n])
        self.t = np.concatenate([own(self.ids, self.target, len(keys))[self.order], own(self.place, self.target, len(n))])


_PARTS = ["sizes", "targets", "before", "words", "ids"]


def _asked(bits: int):
    """(range, chunk, keys, n, t): sorted hashes as differences, and the chunk's own counts."""
    wide = max(0, bits - WIDER)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, rows = Chunk(*(batch.column(c)[i].as_py() for c in _PARTS)), []
                for keys, at, of_kind, first in ((chunk.words, 0, wide, 0), (chunk.pairs, len(chunk.words), bits, 1 << wide)):
                    ranges = keys >> (BITS - of_kind)
                    begins = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(keys) else []
                    for a, b in zip(begins, [*begins[1:], len(keys)], strict=True):
                        n, t = chunk.n[at + a : at + b], chunk.t[at + a : at + b]
                        rows.append((first + int(ranges[a]), batch.column("chunk")[i].as_py(), planes(np.diff(keys[a:b], prepend=0), "i8"), planes(n, "u4"), planes(t, "u4") if t.any() else b""))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["range", "chunk", "keys", "n", "t"])

    return run


def _answered(bits: int):
    """(range, chunk, n, t, words): the sums over all chunks, in the order in which each asked; words of the range in one row."""
    words_end = 1 << max(0, bits - WIDER)

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(from_planes(k, "i8")) for k in table.column("keys").to_pylist()]
        n = [from_planes(k, "u4") for k in table.column("n").to_pylist()]
        t = [from_planes(k, "u4") if k else np.zeros(len(m), "u4") for k, m in zip(table.column("t").to_pylist(), n, strict=True)]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        n, t = (np.bincount(place, np.concatenate(c), len(distinct)).astype("i8")[place] for c in (n, t))
        blobs = [(planes(a, "i8"), planes(b, "i8") if b.any() else b"") for a, b in zip(np.split(n, ends), np.split(t, ends), strict=True)]
        word = table.column("range")[0].as_py() < words_end
        words = [len(distinct) * word] + [0] * (len(blobs) - 1)
        return pa.table({
            "range": table.column("range"), "chunk": table.column("chunk"), "n": pa.array([b[0] for b in blobs], pa.binary()),
            "t": pa.array([b[1] for b in blobs], pa.binary()), "words": pa.array(words, pa.int64()),
        })

    return run


class Models:
    """Both models: what a bigram adds to a loss, from its counts and those of its words."""

    def __init__(self, size: int, n: int, t: int, texts: int, targets: int):
        # One more word and the start of a text are in the vocabulary.
        self.size, self.n, self.t, self.texts, self.targets = size + 2, n + texts, t + targets, texts, targets

    def tops(self, n, t, wn, wt) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the numerators: (target, background)."""
        pn = (wn + 1) / (self.n + self.size)
        pt = (wt + pn * self.size) / (self.t + self.size)
        return np.log(t + PRIOR * pt), np.log(n + PRIOR * pn)


def _scored(models: Models):
    """(row, doc_id, times, target, background): losses of each piece of a text."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(*(chunks.column(c)[0].as_py() for c in _PARTS))
        answers = answers.sort_by("range")
        n = [from_planes(x, "i8") for x in answers.column("n").to_pylist()]
        t = [from_planes(x, "i8") if x else np.zeros(len(k), "i8") for x, k in zip(answers.column("t").to_pylist(), n, strict=True)]
        n, t = (np.concatenate([*c, np.zeros(0, "i8")]).astype("i8") for c in (n, t))
        words = len(chunk.words)
        wn, wt = np.zeros(words, "i8"), np.zeros(words, "i8")
        wn[chunk.order], wt[chunk.order] = n[:words], t[:words]
        of_pair = chunk.ids[chunk.first]
        tops = models.tops(n[words:], t[words:], wn[of_pair], wt[of_pair])
        piece = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
        sums = []
        for counts, start, top in ((wt, models.targets, tops[0]), (wn, models.texts, tops[1])):
            below = np.log(np.concatenate([counts, [start]]) + PRIOR)  # the last is the start of a text
            sums.append(np.bincount(piece, below[chunk.previous] - top[chunk.place], len(chunk.sizes)))
        rows = np.frombuffer(chunks.column("rows")[0].as_py(), "i8")
        doc_ids = pa.array(chunks.column("doc_ids")[0].as_py(), pa.int64())
        return pa.table({"row": pa.array(rows), "doc_id": doc_ids, "times": pa.array(chunk.sizes), "target": pa.array(sums[0]), "background": pa.array(sums[1])})

    return run


def lm_scoring(docs: DataFrame, target_ids: DataFrame, *, chunk_tokens: int = CHUNK, range_size: int = RANGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, target_loss, background_loss, score (losses per token).

    target_ids: a table with a column doc_id. The result is the same for any size of chunks and ranges.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    wanted = stored(target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("target", F.lit(1)), "targets")
    marked = rows.join(F.broadcast(wanted) if small(wanted) else wanted, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(0)).alias("target"))
    chunks = stored(marked.mapInArrow(_encoded(chunk_tokens), _ENCODED), "chunks")
    total = [x or 0 for x in chunks.agg(*map(F.sum, ("n", "t", "texts", "target_texts"))).first()]

    bits = max(0, total[0] // range_size).bit_length()
    asked = chunks.select("chunk", *_PARTS).mapInArrow(_asked(bits), "range long, chunk long, keys binary, n binary, t binary")
    answers = asked.groupBy("range").applyInArrow(_answered(bits), "range long, chunk long, n binary, t binary, words long")
    answers = stored(answers, "answers")
    models = Models(answers.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0], *total)

    both = chunks.select("chunk", "doc_ids", "rows", *_PARTS).groupBy("chunk").cogroup(answers.select("chunk", "range", "n", "t").groupBy("chunk"))
    each = both.applyInArrow(_scored(models), "row long, doc_id long, times long, target double, background double")
    sums = each.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("times").alias("n_tokens"), F.sum("target").alias("target_loss"), F.sum("background").alias("background_loss"))
    n = F.greatest("n_tokens", F.lit(1))
    return sums.select(
        "doc_id", "n_tokens", (F.col("target_loss") / n).alias("target_loss"), (F.col("background_loss") / n).alias("background_loss"),
        ((F.col("target_loss") - F.col("background_loss")) / n).alias("score"),
    )
