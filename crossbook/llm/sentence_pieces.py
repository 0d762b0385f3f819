"""SentencePiece ids by a table of distinct chunks.

No piece goes across the start of a run of spaces, so a text is a sequence of chunks
(spaces, then other characters) that are segmented apart. The documents come in
blocks of bounded text. A block asks for each of its chunks once; all that ask for a
chunk ask in the same bucket, which segments it once and answers every block; a
block joins the answers back by the chunks' positions. What travels are lists: the
chunks of a block that belong to a bucket, sorted and compressed, and their ids in
the same order.

A chunk that every document has is asked for once a block, so no bucket gets more for
it than there are blocks. A block is named by what is in it. It is made once for the
questions and once for the texts; should the rows come in another order then, its
name differs and its chunks, without answers, are segmented where they stand.

Defined results: a null or empty text has no ids but the end; ids and null ids of rows
are passed through, repeated rows included; an empty table gives an empty result;
other columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from crossbook.llm._common import small_batches, text_of

#: Characters of text after which a block ends; one longer text is a block of its own.
BLOCK_CHARS = 16_000_000
#: Chunks whose ids a bucket's task remembers; then it starts afresh.
REMEMBERED = 1_000_000
#: Buckets for each shuffle partition: a partition gets several, of about one size in all.
BUCKETS = 4
#: Rows of a batch that a task gives out.
ROWS = 200
_CHUNK = re.compile(r"▁+[^▁]*")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, spaces as U+2581, without the first space that each begins with."""
    if not text:
        return []
    if "▁" not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _CHUNK.findall("▁" + text.replace(" ", "▁"))]


class Pieces:
    """The vocabulary's own segmentation of single chunks, and its decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if "▁" in p.lstrip("▁")]
        if inner:
            raise ValueError(f"pieces go across spaces: {inner[:3]}")
        self.end, self.space = self.model.eos_id(), self.model.piece_to_id("▁")

    def segment(self, chunks: list[str]) -> list[str]:
        """The ids of each chunk, as decimal numbers joined by spaces."""
        # The library puts the first space back, but not before nothing: a space alone is one piece.
        found = self.model.encode(chunks, num_threads=1) if chunks else []
        return [" ".join(map(str, ids if chunk else [self.space])) for chunk, ids in zip(chunks, found, strict=True)]


def _squeezed(items: list[str], mark: str) -> bytes:
    return zlib.compress(mark.join(items).encode(), 3)


def _opened(data: bytes, mark: str) -> list[str]:
    return zlib.decompress(data).decode().split(mark)


def wanted(texts: list[str], buckets: int) -> dict[int, list[str]]:
    """The distinct chunks of a block by bucket, sorted."""
    distinct: set[str] = set()
    for text in texts:
        distinct.update(chunks_of(text))
    out: dict[int, list[str]] = {}
    for chunk in sorted(distinct):
        out.setdefault(zlib.crc32(chunk.encode()) % buckets, []).append(chunk)
    return out


def blocks(batches, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[bytes, list[int | None], list[str]]]:
    """Name, ids and texts of the blocks of a task's rows."""
    ids: list[int | None] = []
    texts: list[str] = []
    chars, name = 0, hashlib.blake2b(digest_size=16)
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if texts and chars + len(text) > block_chars:
                yield name.digest(), ids, texts
                ids, texts, chars, name = [], [], 0, hashlib.blake2b(digest_size=16)
            ids.append(doc)
            texts.append(text)
            chars += len(text) + 64
            data = text.encode()
            name.update(struct.pack("<?qq", doc is None, doc or 0, len(data)))
            name.update(data)
    if texts:
        yield name.digest(), ids, texts


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: Questions and answers have a bucket; texts come under bucket ``TEXTS``, after all answers of their block.
_SENT = pa.schema([("block", pa.binary()), ("bucket", pa.int32()), ("data", pa.binary())])
_SENT_DDL = "block binary, bucket int, data binary"
TEXTS = 1 << 30


def _ask(buckets: int, block_chars: int):
    def run(batches):
        for name, _, texts in blocks(batches, block_chars):
            if asked := [(name, bucket, _squeezed(chunks, " ")) for bucket, chunks in wanted(texts, buckets).items()]:
                yield _batch(_SENT, asked)

    return run


def _answer(path: str):
    """Each distinct chunk of the task's buckets is segmented once, whoever asks for it."""

    def run(batches):
        pieces, known = Pieces(path), {}
        for batch in batches:
            found = []
            for name, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "data")), strict=True):
                chunks = _opened(data, " ")
                fresh = [c for c in chunks if c not in known]
                if len(known) + len(fresh) > REMEMBERED:
                    known.clear()
                    fresh = chunks
                known.update(zip(fresh, pieces.segment(fresh), strict=True))
                found.append((name, bucket, _squeezed([known[c] for c in chunks], "\n")))
            if found:
                yield _batch(_SENT, found)

    return run


def _texts(block_chars: int):
    def run(batches):
        for name, ids, texts in blocks(batches, block_chars):
            table = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], names=["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table)
            yield _batch(_SENT, [(name, TEXTS, sink.getvalue().to_pybytes())])

    return run


def _joined(path: str, buckets: int, make, schema: pa.Schema):
    """The ids of every document of a block, by the positions of its chunks."""

    def run(batches):
        pieces, answers, last = Pieces(path), {}, None
        for batch in batches:
            for name, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "data")), strict=True):
                if name != last:
                    answers, last = {}, name
                if bucket != TEXTS:
                    answers[bucket] = data
                    continue
                table = pa.ipc.open_stream(data).read_all()
                ids, texts, known = table.column("doc_id").to_pylist(), table.column("text").to_pylist(), {}
                for at, chunks in wanted(texts, buckets).items():
                    found = _opened(answers[at], "\n") if at in answers else pieces.segment(chunks)
                    known.update(zip(chunks, found, strict=True))
                end = str(pieces.end)
                for at in range(0, len(ids), ROWS):
                    joined = [" ".join([*map(known.__getitem__, chunks_of(t)), end]) for t in texts[at : at + ROWS]]  # decimal ids
                    yield _batch(schema, make(pieces, ids[at : at + ROWS], joined))

    return run


def _encoded(docs: DataFrame, path: str, make, schema: pa.Schema, ddl: str, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    answers = rows.mapInArrow(_ask(buckets, block_chars), _SENT_DDL).repartition("bucket").mapInArrow(_answer(path), _SENT_DDL)
    sent = answers.unionByName(rows.mapInArrow(_texts(block_chars), _SENT_DDL))
    return sent.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(_joined(path, buckets, make, schema), ddl)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids (array of int, the end id last) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def make(_, ids, joined):
        return [(doc, list(map(int, x.split(" ")))) for doc, x in zip(ids, joined, strict=True)]

    return _encoded(docs, path, make, schema, "doc_id long, ids array<int>", id_col, text_col, block_chars)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        pieces = Pieces(path)
        for batch in batches:
            texts = [pieces.model.decode(ids or []) or "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def _digests(pieces: Pieces, ids: list[int | None], joined: list[str]) -> list[tuple]:
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    back = pieces.model.decode([list(map(int, x.split(" "))) for x in joined])
    return [(doc, x.count(" ") + 1, sha(x), sha(text)) for doc, x, text in zip(ids, joined, back, strict=True)]


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _encoded(docs, path, _digests, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col, block_chars)
