"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is a bias plus the weights of its words, a
word's weight the sum of the weights of hashed features of its UTF-8 bytes: the word, its first 3 to
6 bytes, its last 4, and every 4 bytes in it. A document is toxic if any sentence is (noisy-or):
p = 1 - prod(1 - p_s). Only document labels are learnt from; the sentences they come from are found
by the model, and the worst sentence of a document is located in its text.

The model is fitted in numpy on a bounded sample: at most ``positives`` toxic and ``negatives`` other
labelled documents of at most ``longest`` code points, drawn by a hash of the id. Every text is scored
whole.

Defined cases: a null or empty text, or one without letters, has one empty sentence and gets the
bias' score. Repeated rows get equal scores. Labels that repeat an id count once, toxic if any is.
Null labels are not learnt from. With nothing to learn from every score is 0. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusledger.llm.common import in_small_batches

BUCKETS = 1 << 18
LONGEST_WORD = 24
THRESHOLD = 0.7
WORD = re.compile(rb"[a-z\x80-\xff]+")
#: ASCII ends, and in UTF-8 the ideographic and full-width full stop, exclamation and question mark.
SENTENCE_END = re.compile(rb"(?:[.!?\n]|\xe3\x80\x82|\xef\xbc[\x81\x8e\x9f]|\xef\xbd\xa1)+")


def pieces(word: bytes) -> list[bytes]:
    """A word; if it is longer than ``LONGEST_WORD``, parts that together have every feature of the whole word, each once.

    ``W`` is followed by the first 6 bytes, the last 4 and a hash of the word, ``I`` by a part of it that counts
    for its inner 4 bytes only. No word has capitals.
    """
    if len(word) <= LONGEST_WORD:
        return [word]
    from xxhash import xxh64_digest

    inner = [b"I" + word[at : at + LONGEST_WORD] for at in range(0, len(word) - 3, LONGEST_WORD - 3)]
    return [b"W" + word[:6] + word[-4:] + xxh64_digest(word), *inner]


def features(words: list[bytes]) -> np.ndarray:
    """(words, kinds) bucket numbers of words or :func:`pieces`; -1 where a word is too short for a kind or a piece has it not."""
    width = LONGEST_WORD
    mark = np.array([b"WI".find(w[:1]) if w else -1 for w in words], np.int64)
    bodies = [w if k < 0 else w[1:11] if k == 0 else w[1:] for w, k in zip(words, mark.tolist(), strict=True)]
    chars = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in bodies), np.uint8).reshape(-1, width).astype(np.uint64)
    lengths = np.array([len(w) for w in bodies], np.int64)
    mult = np.uint64(0x9E3779B97F4A7C15)

    def bucket(salt: int, columns: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(chars), salt + 1, np.uint64) * mult
        for c in columns:
            h = (h ^ c) * mult
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(64 - 18)).astype(np.int64)

    out, ends = [], mark != 1
    for size in (3, 4, 5, 6):
        out.append(np.where(ends & (lengths >= size), bucket(size, [chars[:, i] for i in range(size)]), -1))
    last = np.maximum(lengths - 4, 0)
    row = np.arange(len(chars))
    out.append(np.where(ends & (lengths >= 4), bucket(7, [chars[row, np.minimum(last + i, width - 1)] for i in range(4)]), -1))
    whole = np.where(ends, bucket(8, [chars[:, i] for i in range(width)]), -1)
    for i in np.flatnonzero(mark == 0):
        whole[i] = int.from_bytes(words[i][11:], "big") >> (64 - 18)
    out.append(whole)
    for at in range(width - 3):
        inner = bucket(9, [chars[:, at + i] for i in range(4)])
        out.append(np.where((mark != 0) & (lengths >= at + 4), inner, -1))
    return np.stack(out, axis=1)


def split(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in the UTF-8 bytes of the lower-cased text; one empty one if there is none."""
    low = (text or "").lower().encode("utf-8", "replace")
    spans, at = [], 0
    for m in SENTENCE_END.finditer(low):
        if m.start() > at:
            spans.append((at, m.start()))
        at = m.end()
    if at < len(low) or not spans:
        spans.append((at, len(low)))
    return spans


class Bags:
    """Texts as words by sentence by document, flat."""

    def __init__(self, texts: list[str | None]):
        self.words: list[bytes] = []
        sentence_sizes, doc_sizes = [], []
        for text in texts:
            parts = [s for s in SENTENCE_END.split((text or "").lower().encode("utf-8", "replace")) if s] or [b""]
            doc_sizes.append(len(parts))
            for part in parts:
                found = WORD.findall(part)
                if max(map(len, found), default=0) > LONGEST_WORD:
                    found = [x for w in found for x in pieces(w)]
                self.words += found
                sentence_sizes.append(len(found))
        self.sentence = np.repeat(np.arange(len(sentence_sizes)), sentence_sizes)
        self.document = np.repeat(np.arange(len(doc_sizes)), doc_sizes)


#: The log-odds of one in a hundred: a sentence below says next to nothing, however often a long text repeats it.
FLOOR = float(np.log(0.01 / 0.99))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias
        self.known: dict[bytes, float] = {}

    def word_weights(self, words: list[bytes], memory: int = 500_000) -> np.ndarray:
        known = self.known
        found = list(map(known.get, words))
        fresh = list({w for w, x in zip(words, found, strict=True) if x is None})
        made = {}
        for at in range(0, len(fresh), 20_000):
            ids = features(fresh[at : at + 20_000])
            sums = np.where(ids >= 0, self.weights[ids], 0).sum(1)
            made.update(zip(fresh[at : at + 20_000], sums.tolist(), strict=True))
        if made:
            found = [made[w] if x is None else x for w, x in zip(words, found, strict=True)]
            if len(known) + len(made) <= memory:
                known.update(made)
        return np.array(found, np.float32)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Document scores, scores of the worst sentences, and which sentence each is."""
        bags = Bags(texts)
        n = len(bags.document)
        logits = np.bincount(bags.sentence, self.word_weights(bags.words), n) + self.bias
        soft = np.logaddexp(0, logits)
        starts = np.searchsorted(bags.document, np.arange(len(texts)))
        # Sentences that say next to nothing do not add up: the strongest of them counts, and only where no other sentence does.
        total = np.add.reduceat(np.where(logits > FLOOR, soft, 0), starts)
        scores = -np.expm1(-np.where(total > 0, total, np.maximum.reduceat(soft, starts)))
        worst = [int(np.argmax(part)) for part in np.split(logits, starts[1:])]
        tops = np.maximum.reduceat(logits, starts)
        return np.clip(scores, 0, 1), 1 / (1 + np.exp(-np.clip(tops, -60, 60))), worst


def distinct_bags(texts: list[str], labels: list[int], most: float = 0.3) -> tuple[list[str], list[int]]:
    """Without near copies: a text of which more than ``most`` of the sentences came before is left out."""
    seen: set[bytes] = set()
    kept: list[int] = []
    for i, text in enumerate(texts):
        parts = {s.strip() for s in SENTENCE_END.split(text.lower().encode("utf-8", "replace"))}
        if len(parts & seen) <= most * len(parts):
            kept.append(i)
            seen |= parts
    return [texts[i] for i in kept], [labels[i] for i in kept]


def telling(ids: np.ndarray, bags: Bags, word: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-odds of the buckets that toxic documents hold more often than chance would have it, else 0.

    Chance is the likelihood ratio that one bucket of so many would reach.
    """
    starts = np.searchsorted(bags.document[bags.sentence], np.arange(len(y) + 1))
    held = np.zeros((2, BUCKETS + 1), np.int64)
    for d in range(len(y)):
        own = np.unique(ids[np.unique(word[starts[d] : starts[d + 1]])])
        held[int(y[d]), own] += 1
    held = held[:, :BUCKETS].astype(float)
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    a, b = held[1], held[0]
    rest = lambda x, n: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum((a + b) * n / (n0 + n1), 1e-9)), 0)
    ratio = 2 * (rest(a, n1) + rest(b, n0))
    ok = (ratio > 2 * np.log(max((a + b > 0).sum(), 2))) & (a / n1 > b / n0)
    return np.where(ok, np.log((a + 0.5) / (b + 0.5) * n0 / n1), 0)


def noisy_or(w, bias, compact, token, sentence, document, starts, n: int, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of documents that are toxic if any of their sentences is, and its gradient by the weights and the bias.

    ``compact``: buckets of each word, as places in ``w``; ``token`` and ``sentence``: the words of the ``n`` sentences;
    ``document`` of each sentence, ``starts`` of each document.
    """
    s = w[compact].sum(1)
    z = np.clip(np.bincount(sentence, s[token], n) + bias, -50, 50)
    total = np.add.reduceat(np.logaddexp(0, z), starts)
    loss = float(np.mean(np.where(y == 1, -np.log(np.maximum(-np.expm1(-total), 1e-300)), total)))
    # d(-log p)/d(total) = -1 / (exp(total) - 1); for label 0 it is 1.
    slope = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-4), 1.0) / len(y)
    dz = slope[document] / (1 + np.exp(-z))
    ds = np.bincount(token, dz[sentence], len(compact))
    g = np.zeros(len(w))
    for k in range(compact.shape[1]):
        g += np.bincount(compact[:, k], ds, len(w))
    return loss, np.append(g, dz.sum())


def fit(texts: list[str], labels: list[int], steps: int = 200, rate: float = 0.05) -> Model:
    """Full-batch Adam on the cross-entropy of the noisy-or, over telling buckets, with weights of at least 0.

    Weights start from log-odds: a document with many toxic sentences would stop teaching before each
    of its words is known.
    """
    texts, labels = distinct_bags(texts, labels)
    bags, y = Bags(texts), np.asarray(labels, np.float64)
    number: dict[bytes, int] = {}
    word = np.array([number.setdefault(w, len(number)) for w in bags.words], np.int64)
    words = list(number)
    parts = [features(words[at : at + 20_000]) for at in range(0, len(words), 20_000)]
    ids = np.concatenate([np.where(x >= 0, x, BUCKETS).astype(np.int32) for x in parts]) if parts else np.empty((0, 27), np.int32)
    odds = telling(ids, bags, word, y)
    chosen = np.append(odds > 0, False)
    used = np.flatnonzero(chosen)
    place = np.full(BUCKETS + 1, len(used))
    place[used] = np.arange(len(used))
    touched = np.flatnonzero(chosen[ids].any(1)) if len(ids) else np.empty(0, np.int64)
    compact = place[ids[touched]]
    which = np.full(len(words) + 1, -1)
    which[touched] = np.arange(len(touched))
    at = np.flatnonzero(which[word] >= 0) if len(word) else np.empty(0, np.int64)
    token, sentence = which[word[at]] if len(at) else at, bags.sentence[at] if len(at) else at
    w, bias = np.append(np.minimum(odds[used] / 2, 2.5), 0), -6.0
    m, v = np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    n, starts = len(bags.document), np.searchsorted(bags.document, np.arange(len(texts)))
    for step in range(1, steps + 1):
        _, g = noisy_or(w, bias, compact, token, sentence, bags.document, starts, n, y)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w = np.maximum(w - change[:-1], 0)
        w[-1] = 0
        bias = min(bias - change[-1], -4.0)
    weights = np.zeros(BUCKETS)
    weights[used] = w[:-1]
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = 1500, negatives: int = 2500, longest: int = 20_000) -> Model | None:
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).cast("long").alias("_id"))
    marked = marked.agg(F.max(label_col).cast("int").alias("_y"))
    # Twice as many ids as rows are wanted, as some have no text or a longer one.
    some = [marked.filter(f"_y = {y}").orderBy(F.xxhash64("_id"), "_id").limit(2 * n) for y, n in ((1, positives), (0, negatives))]
    ids = F.broadcast(some[0].unionByName(some[1]))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).filter(F.length("_text") <= longest)
    rows = rows.join(ids, F.col("_doc") == F.col("_id")).select("_y", "_id", "_text")
    found = []
    for y, n in ((1, positives), (0, negatives)):
        found += rows.filter(f"_y = {y}").orderBy(F.xxhash64("_id"), "_id", "_text").limit(n).collect()
    if not found:
        return None
    return fit([r["_text"] for r in found], [r["_y"] for r in found])


def predict(docs: DataFrame, model: Model | None, keep: list[Column], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns with score, predicted, worst_sentence, worst_score, worst_start, worst_end.

    The span is in bytes of the lower-cased text's UTF-8; the sentence is its lower-cased text, null if not toxic.
    """
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    more = {"score": "double", "predicted": "integer", "worst_score": "double", "worst_start": "long", "worst_end": "long", "worst_sentence": "string"}
    schema = rows.drop("_text").schema
    for name, kind in more.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, tops, spans, said = [], [], [], []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(batch.num_columns - 1).slice(at, 256).to_pylist()
                if model is None:
                    found, top, worst = np.zeros(len(texts)), np.zeros(len(texts)), [0] * len(texts)
                else:
                    found, top, worst = model.score(texts)
                scores.append(found)
                tops.append(top)
                for text, p, k in zip(texts, found, worst, strict=True):
                    start, end = split(text)[k] if p >= threshold else (None, None)
                    spans.append((start, end))
                    said.append(None if start is None else text.lower().encode("utf-8", "replace")[start:end].decode("utf-8", "replace"))
            score = np.concatenate(scores) if scores else np.zeros(0)
            columns = [
                *batch.columns[:-1],
                pa.array(score, pa.float64()),
                pa.array((score >= threshold).astype(np.int32)),
                pa.array(np.concatenate(tops) if tops else np.zeros(0), pa.float64()),
                pa.array([s for s, _ in spans], pa.int64()),
                pa.array([e for _, e in spans], pa.int64()),
                pa.array(said, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return in_small_batches(rows).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out and the prediction: labels of the held-out fold are never learnt from."""
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(False))
    model = train(docs, labels, ~out, id_col, text_col)
    return predict(docs, model, [F.col(id_col).alias("doc_id"), out.alias("held_out")], text_col)
