"""Fill-in-the-middle, the prefix trie and SentencePiece ids against brute force or the library."""

import hashlib
import math
import random
import re
import zlib

import public_tokenizers as P
import pytest

from crossbook.llm import fill_in_middle, prefix_trie, sentence_pieces

from .conftest import TEXTS
from .test_operators import odd_texts, rows

PIECES = P.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def arranged(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return i, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_fill_in_middle(spark, docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(fill_in_middle, "BLOCK", block)
    rng = random.Random(5)
    more = [(100 + k, "".join(rng.choice("ab\n\r\x00é😀𝒳 <PSM>") for _ in range(rng.randint(0, 12)))) for k in range(300)]
    more += [(500, "x<P>y"), (501, "<S>"), (502, "<M"), (503, "P><S<P"), (-4, "negative id"), (505, "long 😀" * 20_000)]
    table = docs.select("doc_id", "text", "key", "name").unionByName(spark.createDataFrame(more, "doc_id long, text string"), True)
    want = [arranged(i, t) for i, t in [*TEXTS, *more]]
    got = fill_in_middle.restore(fill_in_middle.arrange(table)).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.restored == r.text for r in got)
    digests = [(*x[:5], sha(x[5]), sha(t or "")) for x, (_, t) in zip(want, [*TEXTS, *more], strict=True)]
    assert rows(fill_in_middle.fill_in_middle(table)) == sorted(digests, key=repr)
    assert fill_in_middle.fill_in_middle(no_docs).count() == 0


def test_fill_in_middle_runs_no_python_and_no_shuffle(docs):
    plan = fill_in_middle.fill_in_middle(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "ba", "x"), ("aba", "c", "d"), ("ab", "xaby", "z")])
def test_sentinels_that_overlap_are_refused(bad):
    with pytest.raises(ValueError):
        fill_in_middle.check_sentinels(bad)


def test_sentinels_of_other_kinds(docs):
    marks = ("<|pre\\E|>", "[suf.*]", "(mid)$")
    assert all(r.restored == r.text for r in fill_in_middle.restore(fill_in_middle.arrange(docs, sentinels=marks, plain_pct=0), sentinels=marks).collect())


def brute_trie(turns, family=20, most=4):
    """Nodes of (conv_id, turn, role, text) rows, written from the contract."""
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append(((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()), role, text))
    own = {c: [x[1:] for x in sorted(rows_)] for c, rows_ in own.items()}
    built = dict(own)
    if family:
        for c, mine in own.items():
            h = zlib.crc32(str(c).encode()) % most
            built[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + mine[h:]  # as SQL has it
    members = {}
    for c, mine in built.items():
        for d in range(len(mine) + 1):
            members.setdefault(tuple(mine[:d]), []).append(c)
    own_saved = {k: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k, m in members.items()}
    kids, leaves, saved = {}, {}, {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k in members:
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + own_saved[k]
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
    out = []
    for k, m in members.items():
        ends = sorted(c for c in m if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], sha(",".join(map(str, ends)))))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, node string, anc int, n int"


def conversations(spark, turns):
    return spark.createDataFrame([(*t, "x", 1, 2) for t in turns], SCHEMA).repartition(3)


def random_turns(seed, convs=60, words=("a b", "a  b c", "", None, "d\x0be", "é\x1cf")):
    rng = random.Random(seed)
    turns = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]) if rng.random() < 0.3 else "user", rng.choice(words)) for c in range(convs) for t in range(rng.randint(1, 7))]
    turns += [(None, 1, "user", "no conversation"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "bot", "tie"), (-7, 0, "user", "negative"), (1005, 0, "user", "one turn, no base")]
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize("seed,family", [(1, 20), (2, 5), (3, None)])
def test_prefix_trie(spark, seed, family):
    turns = random_turns(seed)
    assert rows(prefix_trie.prefix_trie(conversations(spark, turns), family)) == sorted(brute_trie(turns, family), key=repr)


def test_prefix_trie_of_long_conversations(spark, monkeypatch):
    """Segments are chained, parts of lists are hashed one after the other, ancestors are looked up in two ways."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    monkeypatch.setattr(prefix_trie, "PART", 5)
    monkeypatch.setattr(prefix_trie, "SENT", 2)
    rng = random.Random(9)
    turns = [(c, t, "user", f"w{t}" if t < cut else f"w{t} {c % 4}") for c in range(40) for cut in [rng.randint(0, 25)] for t in range(rng.choice([2, 9, 10, 26]))]
    turns += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(3)]
    assert rows(prefix_trie.prefix_trie(conversations(spark, turns))) == sorted(brute_trie(turns), key=repr)


def test_prefix_trie_of_one_huge_conversation(spark):
    """Most rows are one conversation's, many of them the same row."""
    turns = [(20, t // 2, "user", "again") for t in range(150)] + [(20, None, "user", "again")] * 50 + [(21, 0, "user", "x"), (22, 0, "user", "again"), (60, 0, "user", "y " * 10_000)]
    assert rows(prefix_trie.prefix_trie(conversations(spark, turns))) == sorted(brute_trie(turns), key=repr)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "user", "x")])).count() == 0
    # Without a base, a short conversation can lose all of its turns: it is a member of the root only.
    lone = next(c for c in range(1001, 1020) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert rows(prefix_trie.prefix_trie(conversations(spark, [(lone, 0, "user", "x")]))) == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]


@pytest.mark.parametrize("block_chars", [1, 500, 16_000_000])
def test_sentence_pieces_are_the_library(spark, docs, no_docs, block_chars):
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    more = [(1000 + k, t) for k, t in enumerate(odd_texts(400, 8))] + [(2000, "</s> <s> <unk> <0x41>"), (2001, "x" * 50_000), (2002, " "), (2003, "▁"), (2004, "a\u0000b ﻿​é")]
    table = docs.select("doc_id", "text", "key", "name").unionByName(spark.createDataFrame(more, "doc_id long, text string"), True)
    want = []
    for i, t in [*TEXTS, *more]:
        ids = real.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(real.decode(ids))))
    assert rows(sentence_pieces.round_trip(table, PIECES, block_chars=block_chars)) == sorted(want, key=repr)
    assert sentence_pieces.round_trip(no_docs, PIECES).count() == 0
    back = sentence_pieces.decode(sentence_pieces.encode(docs, PIECES), PIECES)
    assert rows(back) == sorted(((i, real.decode(real.encode(t or ""))) for i, t in TEXTS), key=repr)


def test_sentence_pieces_segment_a_chunk_once(spark):
    """A bucket answers all blocks from one segmentation; a block without answers makes its own."""
    from unittest import mock

    import pyarrow as pa

    texts = ["same words in all", "same words here", "words"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    asked = list(sentence_pieces._ask(1, 1)([batch]))
    with mock.patch.object(sentence_pieces.Pieces, "segment", autospec=True, side_effect=sentence_pieces.Pieces.segment) as calls:
        answers = list(sentence_pieces._answer(PIECES)(asked))
    sent = [c for call in calls.call_args_list for c in call.args[1]]
    assert sorted(sent) == sorted({w for t in texts for w in t.split()})
    sent_texts = list(sentence_pieces._texts(1)([batch]))
    schema = pa.schema([("doc_id", pa.int64()), ("joined", pa.string())])

    def joined(parts):
        merged = pa.concat_batches([b.cast(sentence_pieces._SENT) for b in parts]).to_pylist()
        merged.sort(key=lambda r: (r["block"], r["bucket"]))
        made = sentence_pieces._joined(PIECES, 1, lambda _, ids, x: list(zip(ids, x, strict=True)), schema)([pa.RecordBatch.from_pylist(merged, schema=sentence_pieces._SENT)])
        return sorted(tuple(r.values()) for b in made for r in b.to_pylist())

    assert joined(answers + sent_texts) == joined(sent_texts)
