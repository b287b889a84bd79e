"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, fitted to document labels.

A document's chance is 1 - (1 - leak) * prod(1 - p_s) over its sentences, with p_s a logistic score of the sentence's words. Fitting
needs document labels only; the sentence scores then say where the offence is.

The fit takes a bounded sample (`MAX_FIT_DOCS` labelled documents, at most half of them of either label, those with the smallest hashes of their ids; each
label's documents are weighted back to its share), of these the first in hash order with `MAX_FIT_WORDS` words, and a bounded vocabulary (`MAX_FEATURES` hashed words and
beginnings of words); each bound is a parameter; scoring covers every
document and every word of it. Inputs of a score are the words alone.

Edge cases: a null or empty text, or one without letters, scores the leak; a null label is left out; documents labelled twice are toxic if
any label says so; without labelled rows of both kinds every score is the leak; sentences are cut at `.!?` and line ends, and after 60 words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Bounds of the fit: documents, words and sentences of these, hash buckets of words, and words that get a weight.
MAX_FIT_DOCS = 12_000
MAX_FIT_WORDS = 12_000_000
BUCKETS = 1 << 20
MAX_FEATURES = 4_096
#: Words also count by their first letters, so that a stem is known with endings not seen before.
STEMS = (4, 5, 6)
#: The weights' prior: the larger, the less a word that few documents have can weigh.
PRIOR = 0.2
THRESHOLD = 0.3
LEAK = 1e-3
SENTENCE_WORDS = 60

_END = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> Iterator[list[str]]:
    for part in _END.split(text.lower()):
        words = _WORD.findall(part)
        for i in range(0, len(words), SENTENCE_WORDS):
            yield words[i : i + SENTENCE_WORDS]


def buckets(word: str) -> list[int]:
    """The hash buckets of a word and of its beginnings."""
    return [zlib.crc32(x.encode()) & (BUCKETS - 1) for x in (word, *[f"^{word[:n]}" for n in STEMS if len(word) > n - 2])]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class NoisyOr:
    """Weights of hashed words; a word without one weighs nothing."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "words": {}}

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            if len(self.words) > 300_000:
                self.words.clear()
            w = self.words[word] = sum(self.weights.get(b, 0.0) for b in buckets(word))
        return w

    def sentence_scores(self, text: str) -> list[float]:
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(map(self.weight, words)))))) for words in sentences(text)]

    def score(self, text: str) -> float:
        clean = 1 - LEAK
        for p in self.sentence_scores(text):
            clean *= 1 - p
        return min(1.0, max(0.0, 1 - clean))


def gradient(w: np.ndarray, b: float, labels: np.ndarray, weight: np.ndarray, doc_of: np.ndarray, sent_of: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the mean weighted log loss of the labels under the noisy-or, by the words' weights and the bias."""
    z = np.clip(b + np.bincount(sent_of, weights=w[column], minlength=len(doc_of)), -30, 30)
    p = 1 / (1 + np.exp(-z))
    log_clean = np.bincount(doc_of, weights=np.log1p(-p), minlength=len(labels)) + math.log(1 - LEAK)
    pull = weight * np.where(labels > 0, -np.exp(log_clean) / -np.expm1(log_clean), 1.0)  # of the loss on -log_clean
    g = p * pull[doc_of]
    return np.bincount(column, weights=g[sent_of], minlength=len(w)) / len(labels), g.sum() / len(labels)


def fit_arrays(labels: np.ndarray, weight: np.ndarray, doc_of: np.ndarray, sent_of: np.ndarray, column: np.ndarray, chosen: np.ndarray, rounds: int = 150) -> NoisyOr:
    """Fit on flat rows: label and weight of each document, the document of each sentence, the sentence and column of each word; `chosen` are the columns' buckets."""
    n_docs = len(labels)
    share = float((weight * labels).sum() / weight.sum())
    weight = weight / weight.mean()
    w, b = np.zeros(len(chosen)), math.log(share / max(1, len(doc_of) / n_docs) / 4)
    step_w, step_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(rounds):
        gw, gb = gradient(w, b, labels, weight, doc_of, sent_of, column)
        gw = gw + PRIOR / n_docs * w
        step_w += gw * gw
        step_b += gb * gb
        w -= 0.5 * gw / np.sqrt(step_w)
        b -= 0.3 * gb / math.sqrt(step_b)
    keep = np.abs(w) > 0.05
    return NoisyOr(dict(zip(chosen[keep].tolist(), w[keep].tolist(), strict=True)), float(b))


def _distinct_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 200):
            part = b.slice(i, 200)
            found = [sorted({x for s in sentences(t) for w in set(s) for x in buckets(w)}) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS, max_words: int = MAX_FIT_WORDS, max_features: int | None = MAX_FEATURES) -> NoisyOr:
    """Fit to the labelled documents outside the held-out fold.

    At most `max_docs` ids are chosen. Tasks turn their texts into word buckets, Spark counts documents per bucket, and the `max_features` buckets (None: all) whose
    counts in the two labels are furthest from chance are kept; a second pass sends only the words in these to the fit, of documents with `max_words` such words
    and sentences in all, so long texts don't fill the driver either.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = lambda label: usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2)
    sample = cut(few(0).unionByName(few(1)).select(F.col("doc_id").alias("__id"), "toxic"))
    # the sample is bounded by max_docs, so it may be broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("toxic", "text", F.xxhash64("__id").alias("place"))

    sizes = {label: min(n, max_docs // 2) for label, n in totals.items()}
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    counts = texts.select("toxic", "text").mapInArrow(_distinct_buckets, "toxic int, words array<int>").select("toxic", F.explode("words").alias("word"))
    counts = counts.groupBy("word").agg(F.count("*").alias("found"), F.sum("toxic").alias("toxic"))
    far = F.abs(F.col("toxic") - F.col("found") * rate) / F.sqrt(F.col("found") * rate * (1 - rate) + 1)
    top = counts.select("word", far.alias("far")).filter("far > 1.5").orderBy(F.desc("far"), "word")
    top = (top if max_features is None else top.limit(max_features)).collect()  # there are no more words than buckets
    if not 0 < rate < 1 or not top:
        return NoisyOr({}, -30.0 if not 0 < rate < 1 else math.log(1e-4))
    chosen = np.array([r["word"] for r in top])
    column = {w: i for i, w in enumerate(chosen.tolist())}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                split = [[[column[x] for w in s for x in buckets(w) if x in column] for s in sentences(t)] for t in part.column(1).to_pylist()]
                sizes = pa.array([[len(s) for s in t] for t in split], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), sizes, pa.array([[x for s in t for x in s] for t in split], pa.list_(pa.int32()))], ["toxic", "place", "sizes", "words"])

    read = cut(texts.mapInArrow(words, "toxic int, place long, sizes array<int>, words array<int>"))  # max_docs rows
    so_far = F.sum(F.size("words") + F.size("sizes")).over(W.partitionBy("toxic").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    rows = read.withColumn("so_far", so_far).filter(F.col("so_far") <= max_words // 2).select("toxic", "sizes", "words").toArrow()
    flat = lambda name: np.concatenate([np.asarray(c.flatten()) for c in rows[name].chunks] or [np.zeros(0, np.int32)])
    y, n_sents, per_sent = np.asarray(rows["toxic"], dtype=np.float64), np.concatenate([np.asarray(c.value_lengths()) for c in rows["sizes"].chunks]), flat("sizes")
    doc_of, sent_of = np.repeat(np.arange(len(y)), n_sents), np.repeat(np.arange(len(per_sent)), per_sent)
    weight = np.where(y > 0, totals.get(1, 0) / max(1, y.sum()), totals.get(0, 0) / max(1, len(y) - y.sum()))
    return fit_arrays(y, weight, doc_of, sent_of, flat("words"), chosen)


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """(doc_id, score, worst): the document's score and its worst sentence, as (number, score). One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, worst = [], []
            for text in b.column(1).to_pylist():
                parts = model.sentence_scores(text)
                clean = 1 - LEAK
                for p in parts:
                    clean *= 1 - p
                scores.append(min(1.0, max(0.0, 1 - clean)))
                at = max(range(len(parts)), key=parts.__getitem__, default=None)
                worst.append(None if at is None else {"sentence": at, "score": parts[at]})
            kind = pa.struct([("sentence", pa.int32()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(worst, kind)], ["doc_id", "score", "worst"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double, worst struct<sentence: int, score: double>")


def offending(text: str, model: NoisyOr, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """The sentences of one text at or over the threshold: (number, score)."""
    return [(i, p) for i, p in enumerate(model.sentence_scores(text)) if p >= threshold]
