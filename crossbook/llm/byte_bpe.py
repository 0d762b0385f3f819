"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its
encoding. With that token stored for each prefix, the encoding of any prefix is
read off backwards; bytes can be appended without touching what is stored, and
after an edit only the places up to where the stored tokens agree again are
worked out anew.

A token ends prefix ``i`` exactly if it and the last token of the prefix before
it are what merging gives for their joined bytes.

Defined results: a null or empty text has no ids; ids and null ids of rows are
passed through, repeated rows included; an empty table gives an empty result;
other columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from crossbook.llm._common import text_of

#: Pieces, and words, whose ids a worker remembers before it forgets those that haven't come since it last did so:
#: frequent words stay, and a worker, which goes on to the next stages, holds twice as many at most.
REMEMBERED = 150_000
#: White space other than spaces and line feeds.
_RARE_SPACE = re.compile(r"[^\S \n]").search


def _uneven(text: str) -> bool:
    """Whether white space may stand beside a space or at an end of the text."""
    return not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or _RARE_SPACE(text) is not None


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class BytePairs:
    """The vocabulary: which tokens end where, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()
        self._valid: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of an array of ids, gathered from one buffer of all tokens."""
        if self._flat is None:
            tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
            sizes = np.array([len(t) for t in tokens], "i8")
            self._flat = np.frombuffer(b"".join(tokens), "u1"), sizes, np.cumsum(sizes) - sizes
        flat, sizes, starts = self._flat
        n = sizes[ids]
        shift = starts[ids] - (np.cumsum(n) - n)
        return flat[np.repeat(shift, n) + np.arange(n.sum())].tobytes()

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """Ids by repeatedly merging the adjacent pair of lowest rank, down to ``stop`` parts; for short data."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > stop:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is the token; None for a single byte."""
        if token not in self._halves:
            parts = self.merged(self.bytes_of[token], 2)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def alone(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if (known := self._valid.get(~token)) is None:
            known = self._valid[~token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def together(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two again."""
        if (known := self._valid.get(a << 32 | b)) is None:
            if len(self._valid) > 1_000_000:
                self._valid.clear()
            known = self._valid[a << 32 | b] = self.alone(a) and self.alone(b) and self._apart(a, b)
        return known

    def _apart(self, x: int, y: int) -> bool:
        """Walk back in time along the tokens on both sides of the border.

        x and y stand at the border until a merge away from it takes one of
        them. They would have merged with each other if that merge comes before
        x's own and not after y's own (of equal ranks the left one is first).
        """
        never = 1 << 62
        x_goes, y_goes, bytes_of, get = never, never, self.bytes_of, self.ranks.get
        while True:
            joined = get(bytes_of[x] + bytes_of[y])
            if joined is not None and joined < x_goes and joined <= y_goes:
                return False
            left, right = self.halves(x), self.halves(y)
            if left and (not right or x > y):
                x_goes, x = x, left[1]
            elif right:
                y_goes, y = y, right[0]
            else:
                return True


class Prefixes:
    """A piece with the last token of each of its prefixes."""

    def __init__(self, pairs: BytePairs, data: bytes = b""):
        self.pairs, self.data, self.last = pairs, bytearray(), []
        self.append(data)

    def _fill(self):
        """The last tokens that are missing, one by one, each from those before it."""
        last, together = self.last, self.pairs.together
        base = max(0, len(last) + 1 - self.pairs.longest)
        for at, (size, token) in self.pairs.ends.iter(self.data[base:].decode("latin-1")):
            end = base + at + 1
            if end != len(last) + 1:
                continue
            if together(last[end - size - 1], token) if end > size else self.pairs.alone(token):
                last.append(token)
                yield end
        if len(last) < len(self.data):
            raise ValueError(f"no token ends at byte {len(last) + 1}")

    def append(self, data: bytes) -> None:
        """Longer by these bytes; nothing stored changes."""
        if self.data:
            self.data += data
            for _ in self._fill():
                pass
            return
        self.data += data  # the same as _fill, for a piece from its start
        last, valid, pairs, need = self.last, self.pairs._valid.get, self.pairs, 0
        for at, (size, token) in pairs.ends.iter(data.decode("latin-1")):
            if at != need:
                continue
            if at < size:
                fits = pairs.alone(token)
            elif (fits := valid(last[at - size] << 32 | token)) is None:
                fits = pairs.together(last[at - size], token)
            if fits:
                last.append(token)
                need += 1
        if need < len(data):
            raise ValueError(f"no token ends at byte {need + 1}")

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Bytes start to stop become ``data``. Returns how many places were worked out anew.

        Once the stored tokens agree with the new ones over as many places as
        the longest token has bytes, all later ones agree as well.
        """
        tail, self.data = self.last[stop:], self.data[:start] + data + self.data[stop:]
        del self.last[start:]
        agreed, fresh = 0, 0
        for end in self._fill():
            fresh += 1
            old = end - 1 - start - len(data)
            agreed = agreed + 1 if old >= 0 and tail[old] == self.last[-1] else 0
            if agreed >= self.pairs.longest:
                self.last += tail[old + 1 :]
                break
        return fresh

    def ids(self, end: int | None = None) -> list[int]:
        """The ids of the first ``end`` bytes (all of them by default)."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.pairs.bytes_of[out[-1]])
        return out[::-1]


class Codec:
    """Texts to ids and back; pieces are the matches of ``pattern``.

    Where every run of white space at a space is that one space, a text is
    looked up word by word (a word with the space before it): with
    ``space_leads``, the pattern's matches have a space at their start only, so
    a word's matches don't depend on its neighbours. Other texts are split whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, space_leads: bool = True):
        import regex

        self.pairs, self.split, self.space_leads = BytePairs(ranks), regex.compile(pattern).findall, space_leads
        self._pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._older: list[dict[str, bytes]] = [{}, {}]

    def piece(self, text: str) -> list[int]:
        data = text.encode()
        whole = self.pairs.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self.pairs, data).ids()

    def _joined(self, text: str) -> bytes:
        known, out = self._pieces, []
        for p in self.split(text):
            if (ids := known.get(p)) is None:
                if (ids := self._older[0].get(p)) is None:
                    ids = np.asarray(self.piece(p), "<u4").tobytes()
                if len(p) <= 64:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """All ids of the text as little-endian 32-bit integers."""
        if len(self._pieces) > REMEMBERED:
            self._older[0], self._pieces = self._pieces, {}
        if len(self._words) > REMEMBERED:
            self._older[1], self._words = self._words, {}
        if not self.space_leads or _uneven(text):
            return self._joined(text)
        first, *words = text.split(" ")
        known = self._words
        try:
            return self._joined(first) + b"".join(map(known.__getitem__, words))
        except KeyError:
            for w in set(words).difference(known):
                ids = self._older[1].get(w)
                known[w] = self._joined(" " + w) if ids is None else ids
            return self._joined(first) + b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, packed: bytes) -> bytes:
        return self.pairs.decode(np.frombuffer(packed, "<u4"))


#: A worker process keeps the codec it used last, with what that remembers.
_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(ranks: dict[bytes, int], pattern: str, name: str) -> Codec:
    if (name, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[name, pattern] = Codec(ranks, pattern)
    return _CODECS[name, pattern]


def _run(sent, pattern: str, make):
    name = hashlib.sha256(repr(sorted(sent.value.items())).encode()).hexdigest()

    def run(batches):
        codec = _codec(sent.value, pattern, name)
        for batch in batches:
            packed = [codec.packed(x) for x in batch.column("text").to_pylist()]
            yield make(codec, batch, packed)

    return run


def _digests(codec, batch, packed):
    hexes = [hashlib.sha256(x).hexdigest() for x in packed]
    back = [hashlib.sha256(codec.decode(x)).hexdigest() for x in packed]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(hexes, pa.string()), pa.array(back, pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _ids(codec, batch, packed):
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.frombuffer(x, "<u4").astype("i4") for x in packed], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))


def _sent(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load_ranks(path))  # one vocabulary, whatever the corpus


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each document."""
    return _input(docs, id_col, text_col).mapInArrow(_run(_sent(docs.sparkSession, path), pattern, _ids), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and data (binary) of each row of ids; null ids give no bytes."""
    sent = _sent(encoded.sparkSession, path)

    def run(batches):
        back = {r: t for t, r in sent.value.items()}
        for batch in batches:
            data = [b"".join(back[i] for i in ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _input(docs, id_col, text_col).mapInArrow(_run(_sent(docs.sparkSession, path), pattern, _digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
