"""Bounds that must not lose anything, and the whole pipeline against brute force."""

import random
from collections import Counter

import public_tokenizers as P

from crossbook.llm import byte_bpe, decontamination, html_extraction, toxicity
from crossbook.llm._common import documents

from .test_operators import BPE, low, near, rows, shingle_set


def test_toxicity_sample_goes_on_after_a_long_document(spark):
    ids = range(200)
    texts = [(i, "word " * (5_000 if i % 3 == 0 else 20)) for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got, y, _ = toxicity.sample(spark.createDataFrame(texts, "doc_id long, text string"), labels, 1000, 1000, 10_000)
    # No document over 200 characters, whatever its place; of each class 100 or fewer that fit in 10,000 characters together.
    assert max(map(len, got)) <= 200 and min(Counter(y).values()) > 20
    trained, _, _ = toxicity.sample(spark.createDataFrame(texts, "doc_id long, text string"), labels, 5, 7, 10**9)
    assert len(trained) == 12


def test_blocks_share_the_radius_out():
    for radius in range(0, 40):
        for n in range(1, 9):
            parts = decontamination.shares(radius, n)
            # However radius bits are spread, one block differs by its share or less.
            assert sum(p + 1 for p in parts) == radius + 1 and min(parts) >= -1
    assert decontamination.shares(22) == [4, 4, 4, 4, 2]


def test_all_fingerprints_within_the_radius_meet(spark):
    rng, pairs = random.Random(4), []
    for k in range(300):
        x = rng.getrandbits(64)
        flips = rng.sample(range(64), k % 23)
        y = x ^ sum(1 << i for i in flips)
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    table = spark.createDataFrame(pairs, "x long, y long")
    from pyspark.sql import functions as F

    met = table.select(F.arrays_overlap(decontamination.blocks(F.col("x"), 22), decontamination.near_blocks(F.col("y"), 22)).alias("met"))
    assert met.filter("met").count() == 300


def test_marked_sets_count_occurrences(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    table = [([rng.randrange(5) for _ in range(rng.randrange(9))], [rng.randrange(5) for _ in range(rng.randrange(9))]) for _ in range(200)]
    got = spark.createDataFrame(table, "x array<long>, y array<long>").select("x", "y", F.size(F.array_intersect(decontamination.marked(F.col("x")), decontamination.marked(F.col("y")))).alias("n"))
    assert all(r.n == (Counter(r.x) & Counter(r.y)).total() for r in got.collect())


def test_html_references_end_at_a_tag():
    text = lambda page: html_extraction.walk(page)[0]
    assert text("<p>a &<b>amp;</b>lt; x</p>") == ["a &amp;lt; x"]
    assert text("<p>&am<b>p;</b></p>") == ["&amp;"]
    assert text("<p>1 < 2 &amp;lt; &eacute;<i>t&eacute;</i> &#x41;&nbsp;b</p>") == ["1 < 2 &lt; été A b"]


def test_html_hosts_in_two_ways(spark, monkeypatch):
    """Templates that are sent and those that are dealt by host give the same texts."""
    pages = []
    for i in range(90):
        host = ("large", "middle", "small")[(i % 9 > 4) + (i % 9 > 7)]
        pages.append((i, f"https://{host}.example/{i}" if i % 10 else None, f"<body><p>Own text of {i}</p><div><p>All of {host}</p></div></body>"))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole = rows(html_extraction.html_extraction(table, min_pages=3))
    assert any("All of" not in r[2] for r in whole)
    for hosts, trees in ((1, 100), (2, 100), (20, 2), (20, 0)):
        monkeypatch.setattr(html_extraction, "SENT_HOSTS", hosts)
        monkeypatch.setattr(html_extraction, "SENT_TREES", trees)
        assert rows(html_extraction.html_extraction(table, min_pages=3)) == whole


def repeats(words, item):
    """Whether a window as long as the item is at 0.75 or more to it, by counts of shingles."""
    cut = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    of_item = cut(item)
    if len(item) >= 5 and not of_item.keys() & cut(words).keys():
        return False
    return any((x & of_item).total() * 4 >= 3 * (x | of_item).total() for x in (cut(words[s : s + len(item)]) for s in range(len(words))))


def test_pipeline_by_brute_force(spark):
    import re

    import tiktoken

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    scores = toxicity.scored(docs, documents(spark, sf, "labels"))
    toxic = {r.doc_id for r in scores.filter(f"score >= {toxicity.THRESHOLD}").collect()}
    table = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect() if r.doc_id not in toxic}
    last = {}
    for i, t in table.items():
        last[low(t)] = max(i, last.get(low(t), i))
    table = {i: table[i] for i in sorted(last.values())}
    kept = {x[0] for x in near(list(table.items())) if x[3]}
    assert len(kept) < len(table) and shingle_set("a b") == {(b"a", b"b")}
    words = lambda t: [w for w in re.split("[ \t-\r]+", t.lower()) if w]
    items = [w for r in documents(spark, sf, "benchmark").collect() if (w := words(r.text or ""))]
    table = {i: t for i, t in table.items() if i in kept and not any(repeats(words(t), x) for x in items)}
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BPE), special_tokens={})
    want = sorted((i, len(real.encode_ordinary(t))) for i, t in table.items())
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and 50 < len(want) < 200
