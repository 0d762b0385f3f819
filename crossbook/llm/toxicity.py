"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the average of the embeddings of its character n-grams (hashed) and
of itself; a bag of words is the average of its words; a linear softmax reads
the bag. Embeddings and softmax are trained together in numpy. As a misspelt
word shares most n-grams with the word it comes from, it gets nearly its score.

A document's label says that something in it is toxic, not where. So training
begins with whole documents as bags, then goes over to windows of a few words:
of a toxic document the window that the model finds worst, of a clean one its
worst windows and some others. A document scores as its worst window does.

Training uses at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents, taken
in the order of a hash of their id, and of each class those that together have at
most ``MAX_CHARS`` characters. Scoring covers all documents and whole texts, a few
documents at a time; a word of over ``LONG`` characters is taken as several.

Defined results: a null or empty text has the score of an empty bag; labels
that are null or without an id are left out, of several labels for one id the
largest counts; without both classes every score is 0; rows with null id are
scored and never held out; repeated rows are scored one by one; an empty table
gives an empty result; other columns of either table are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crossbook.llm._common import stored, text_of, tidy

#: Labelled documents that are trained on, at most, and characters of each class.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2000, 4000, 16_000_000
#: A document longer than this part of a class's characters isn't trained on, so no single one can use them up.
DOC_PART = 50
THRESHOLD = 0.3
BUCKETS_BITS, DIM, NGRAMS, WINDOW = 18, 4, (3, 4, 5), 5
#: Pull of the embeddings towards zero, in the unit of the mean gradient. Chosen of 1e-6 to 1e-3
#: by the log loss on a quarter of the ids, fitted on two others; the held-out quarter took no part.
DECAY = 1e-5
RATE = 0.1
#: Documents of the sample that an n-gram must be in to be trained at all.
LEAST_DOCS = 4
#: Words whose scores a task remembers; then it starts afresh.
REMEMBERED = 200_000
#: Words whose n-grams are made at a time.
CHUNK = 20_000
LONG = 65_536
_WORDS = re.compile(rf"\w{{1,{LONG}}}").findall


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of each word, and each whole word: the bucket and the word's place."""
    if not words:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "u4").astype("u8")
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(chars)) - np.repeat(starts, sizes)
    power = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, "u8"))
    buckets, owners = [_mix(_mix(np.add.reduceat(chars * power[place], starts)) + np.uint64(1))], [np.arange(len(words))]
    rolled = np.zeros(len(chars), "u8")
    for n in range(1, max(NGRAMS) + 1):
        if len(chars) < n:
            break
        rolled = rolled[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        if n in NGRAMS:
            inside = owner[: len(chars) - n + 1] == owner[n - 1 :]
            buckets.append(_mix(_mix(rolled[inside]) + np.uint64(n)))
            owners.append(owner[: len(chars) - n + 1][inside])
    return (np.concatenate(buckets) >> np.uint64(64 - BUCKETS_BITS)).astype("i8"), np.concatenate(owners)


def _places(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, all under n, in order; for each number under n its place there or -1."""
    distinct = np.flatnonzero(np.bincount(values, minlength=n))
    places = np.full(n, -1, "i4")
    places[distinct] = np.arange(len(distinct))
    return distinct, places


def _sums(places: np.ndarray, values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of values[index] by places under n, a part at a time."""
    out = np.zeros(n)
    for at in range(0, len(places), 1 << 20):
        part = slice(at, at + (1 << 20))
        out += np.bincount(places[part], values[index[part]], n)
    return out


def trained_grams(vocabulary: list[str], in_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and words of the n-grams in at least LEAST_DOCS documents, and how many n-grams each word has.

    Made ``CHUNK`` words at a time, twice, so the n-grams that aren't kept are never held together.
    """
    seen, sizes = np.zeros(1 << BUCKETS_BITS), np.zeros(len(vocabulary), "i4")
    for at in range(0, len(vocabulary), CHUNK):
        bucket, owner = ngrams(vocabulary[at : at + CHUNK])
        seen += np.bincount(bucket, in_docs[at + owner], len(seen))
        sizes[at : at + CHUNK] = np.bincount(owner, minlength=len(vocabulary[at : at + CHUNK]))
    kept = [], []
    for at in range(0, len(vocabulary), CHUNK):
        bucket, owner = ngrams(vocabulary[at : at + CHUNK])
        enough = seen[bucket] >= LEAST_DOCS
        kept[0].append(bucket[enough].astype("i4"))
        kept[1].append((at + owner[enough]).astype("i4"))
    return np.concatenate(kept[0]), np.concatenate(kept[1]), sizes


class Model:
    """Embeddings and softmax; ``margin`` is what an n-gram adds to the logit of "toxic"."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = np.zeros((1 << BUCKETS_BITS, DIM))
        self.out = rng.normal(0, DIM**-0.5, (2, DIM))
        self.bias = np.zeros(2)
        self._adam: dict[str, list] = {}

    def _step(self, name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        state = self._adam.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        state[2] += 1
        state[0] += 0.1 * (grad - state[0])
        state[1] += 0.01 * (grad * grad - state[1])
        value -= rate * (state[0] / (1 - 0.9 ** state[2])) / (np.sqrt(state[1] / (1 - 0.99 ** state[2])) + 1e-8)

    def margin(self) -> np.ndarray:
        return self.embed @ (self.out[1] - self.out[0])

    def logit_bias(self) -> float:
        return float(self.bias[1] - self.bias[0])

    def fit(self, bag: np.ndarray, word: np.ndarray, y: np.ndarray, grams: tuple[np.ndarray, np.ndarray, np.ndarray], steps: int, rate: float = RATE) -> None:
        """Full-batch steps; entry i says that bag[i] holds word[i]; y: the bags' labels; classes weigh the same. grams: buckets, words, and the words' counts of n-grams, those left out included."""
        used, place = _places(word, len(grams[2]))
        word = place[word]
        mine = place[grams[1]] >= 0
        gram, owner = grams[0][mine], place[grams[1][mine]]
        n_words, n_bags, per_word, per_bag = len(used), len(y), grams[2][used], np.bincount(bag, minlength=len(y))
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        touched, at = _places(gram, len(self.embed))
        gram = at[gram]
        for _ in range(steps):
            embed = self.embed[touched]
            words = np.stack([_sums(owner, embed[:, k], gram, n_words) for k in range(DIM)], 1) / per_word[:, None]
            bags = np.stack([np.bincount(bag, words[word, k], n_bags) for k in range(DIM)], 1) / np.maximum(per_bag, 1)[:, None]
            logits = bags @ self.out.T + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n_bags), y] -= 1
            p *= weight[:, None]  # the gradient at the logits
            at_bag = p @ self.out / np.maximum(per_bag, 1)[:, None]
            at_gram = np.zeros_like(self.embed)
            for k in range(DIM):
                at_word = np.bincount(word, at_bag[bag, k], n_words) / per_word
                at_gram[touched, k] = _sums(gram, at_word, owner, len(touched))
            at_gram += DECAY * self.embed  # an n-gram moves as far as its evidence goes
            self._step("embed", self.embed, at_gram, rate)
            self._step("out", self.out, p.T @ bags, rate)
            self._step("bias", self.bias, p.sum(0), rate)


def word_logits(words: list[str], margin: np.ndarray) -> np.ndarray:
    """What each word adds, before averaging over its window."""
    gram, owner = ngrams(words)
    return np.bincount(owner, margin[gram], len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)


def windows(values: np.ndarray) -> np.ndarray:
    """The mean of each run of WINDOW values; of all, if there are fewer."""
    if len(values) <= WINDOW:
        return values.mean(keepdims=True) if len(values) else np.zeros(1)
    sums = np.cumsum(np.concatenate([[0.0], values]))
    return (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW


def calibrated(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift that turn logits of documents that weren't fitted into log odds, the classes weighed as in the labels."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    slope, shift = 1.0, 0.0
    for _ in range(2000):
        miss = (1 / (1 + np.exp(-np.clip(slope * z + shift, -50, 50))) - y) * weight
        slope -= 0.5 * ((miss * z).sum() + 2e-3 * (slope - 1))
        shift -= 0.5 * (miss.sum() + 2e-3 * shift)
    return slope, shift


def train(texts: list[str], labels: list[int], share: float | None = None, seed: int = 7) -> tuple[np.ndarray, float] | None:
    """The margin of each n-gram and the bias; None without both classes.

    Each fifth document is kept from the fit, to calibrate the scores; share: of
    toxic documents among all labelled ones.
    """
    y = np.array(labels, "i8")
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = []
    for at, text in enumerate(texts):
        docs.append(np.array([index.setdefault(w, len(index)) for w in _WORDS(text.lower())], "i4"))
        texts[at] = ""  # its words are all that is needed from here on
    aside = np.zeros(len(docs), bool)
    for label in (0, 1):
        aside[np.flatnonzero(y == label)[4::5]] = True
    fitted = [i for i in range(len(docs)) if not aside[i] and len(docs[i])]
    vocabulary = list(index)
    model = Model(seed)
    bags = [np.unique(docs[i]) for i in fitted]
    if not bags:
        return None
    in_docs = np.bincount(np.concatenate(bags), minlength=len(vocabulary))
    grams = trained_grams(vocabulary, in_docs)
    n_words = len(vocabulary)
    del index, vocabulary, in_docs  # numbers are enough from here on
    sizes = grams[2]
    model.fit(np.repeat(np.arange(len(bags), dtype="i4"), [len(b) for b in bags]), np.concatenate(bags), y[fitted], grams, 20)
    for _ in range(4):
        scores = _sums(grams[1], model.margin(), grams[0], n_words) / sizes
        entries, bag_of, kinds = [], [], []
        for i in fitted:
            found = windows(scores[docs[i]])
            picked = [int(found.argmax())] if y[i] else {*np.argsort(found)[-2:].tolist(), *rng.integers(0, len(found), 4).tolist()}
            for at in picked:
                entries.append(docs[i][at : at + WINDOW])
                bag_of.append(len(kinds))
                kinds.append(int(y[i]))
        model.fit(np.repeat(bag_of, [len(e) for e in entries]), np.concatenate(entries), np.array(kinds), grams, 20)
    scores = _sums(grams[1], model.margin(), grams[0], n_words) / sizes
    z = np.array([windows(scores[d]).max() for d in docs]) + model.logit_bias()
    slope, shift = calibrated(z[aside], y[aside], float(y.mean()) if share is None else share) if len(set(y[aside])) == 2 else (1.0, 0.0)
    return (slope * model.margin()).astype("f4"), slope * model.logit_bias() + shift


class Scorer:
    """Scores of texts by a trained model; without one every score is 0."""

    def __init__(self, model: tuple[np.ndarray, float] | None):
        self.model, self.known = model, {}

    def _learn(self, group: list[list[str]]) -> None:
        fresh = list({w for words in group for w in words}.difference(self.known))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list({w for words in group for w in words})
        for at in range(0, len(fresh), CHUNK):
            part = fresh[at : at + CHUNK]
            self.known.update(zip(part, word_logits(part, self.model[0]).tolist(), strict=True))

    def scores(self, group: list[list[str]]) -> list[float]:
        if self.model is None:
            return [0.0] * len(group)
        self._learn(group)
        found = (windows(np.fromiter(map(self.known.__getitem__, words), "f8", len(words))).max() for words in group)
        return [float(1 / (1 + np.exp(-np.clip(z + self.model[1], -50, 50)))) for z in found]


def _score(sent):
    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            scores, group, size, texts = [], [], 0, batch.column("text")
            for i in range(len(texts)):
                group.append(_WORDS(texts[i].as_py().lower()))
                size += len(group[-1])
                if size > CHUNK:
                    scores += scorer.scores(group)
                    group, size = [], 0
            scores += scorer.scores(group)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(scores, pa.float64())], names=["doc_id", "key", "score"])

    return run


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_chars: int) -> tuple[list[str], list[int], float]:
    """Texts and labels to train on, a bounded number and size and none that is held out, and the share of toxic labels.

    Of each class, by a hash of the id: at most so many documents, none longer than max_chars / DOC_PART, and the first
    of these that have at most max_chars together: DOC_PART of them fit, however long they are.
    """
    named = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    named = named.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    share = named.agg(F.avg("y")).first()[0]
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = named.filter("y = 1").orderBy(*order).limit(max_toxic).unionByName(named.filter("y = 0").orderBy(*order).limit(max_clean))
    # max_toxic + max_clean rows at most from here on.
    fits = F.length("text") <= max_chars // DOC_PART
    found = stored(docs.join(F.broadcast(picked), "doc_id").filter(fits).dropDuplicates(["doc_id"]).select("doc_id", "y", "text"), "toxicity-sample")
    so_far = F.sum(F.length("text")).over(W.partitionBy("y").orderBy(*order))
    kept = found.select("doc_id", so_far.alias("chars")).filter(F.col("chars") <= max_chars).select("doc_id")
    rows = found.join(F.broadcast(kept), "doc_id", "left_semi").orderBy(*order).select("text", "y").toArrow()
    return rows.column("text").to_pylist(), rows.column("y").to_pylist(), share or 0.0


def scored(docs: DataFrame, labels: DataFrame, *, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, key, score (0 to 1). key is xxhash64 of the text: with doc_id it names the row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(*sample(rows, labels, max_toxic, max_clean, max_chars)))
    return rows.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(tidy(_score(sent)), "doc_id long, key long, score double")


def toxicity(
    docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    out = scored(docs, labels, max_toxic=max_toxic, max_clean=max_clean, max_chars=max_chars, id_col=id_col, text_col=text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
