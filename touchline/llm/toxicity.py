"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. A sentence's
probability is a logistic model of its words; the document's is their noisy-or,
1 - prod(1 - p): one offending sentence is enough. The gradient of the
document's likelihood flows mostly to the sentences that explain its label, so
trained on documents the model locates sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import prepare, texts

#: Hashed weights: words and their first 4 and 5 letters.
BUCKETS = 1 << 18
MEMO = 400_000
_EDGES = re.compile(r"^\W+|\W+$")


def features(word: str) -> tuple[int, ...]:
    """Buckets of a word's features; marks about a word don't count."""
    bare = _EDGES.sub("", word.lower())
    if not bare:
        return ()
    return tuple(xxhash.xxh64_intdigest(f.encode()) % BUCKETS for f in (f"w{bare}", *(f"{n}{bare[:n]}" for n in (4, 5) if len(bare) > n)))


def ends(word: str) -> bool:
    """Whether a sentence ends with this word."""
    last = word.rstrip("\"')]»”")[-1:]
    return last != "" and last in ".!?…"


class Weights(dict):
    """word -> its weight, and 1j if a sentence ends with it."""

    def __init__(self, w: np.ndarray):
        self.w = w

    def __missing__(self, word: str) -> complex:
        out = complex(sum(self.w[f] for f in features(word)), ends(word))
        if len(self) > MEMO:
            self.clear()
        self[word] = out
        return out


def sentence_logits(words: list[str], weights: Weights, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """(logit of each sentence, its first word); a text has one sentence at
    least, which may be empty. A word that repeats the one before it counts
    once, so a long run of one word is no evidence."""
    if not words:
        return np.full(1, bias), np.zeros(1, np.int64)
    values = np.fromiter(map(weights.__getitem__, words), complex, len(words))
    starts = np.concatenate([[0], np.flatnonzero(values.imag[:-1]) + 1])
    own = values.real.copy()
    own[1:][values[1:] == values[:-1]] = 0
    return np.add.reduceat(own, starts) + bias, starts.astype(np.int64)


def noisy_or(logits: np.ndarray, shift: float = 0.0) -> float:
    """1 - prod(1 - p), its log-odds moved by `shift`."""
    total = float(np.logaddexp(0, logits).sum())  # minus the log probability that no sentence offends
    odds = (np.log(np.expm1(total)) if total < 30 else total) + shift if total > 0 else -np.inf
    return float(0.5 * (1 + np.tanh(odds / 2)))


class Model:
    def __init__(self, w: np.ndarray, bias: float, shift: float = 0.0):
        at = np.flatnonzero(w)
        self.at, self.values, self.bias, self.shift = at, w[at], bias, shift

    def weights(self) -> Weights:
        w = np.zeros(BUCKETS)
        w[self.at] = self.values
        return Weights(w)


class Bags:
    """Training documents as arrays: the words (token), sentence and document
    of each occurrence, and the feature buckets of each distinct word."""

    def __init__(self, bodies: list[str]):
        self.words: dict[str, int] = {}
        tokens, sentences, docs, count = [], [], [], 0
        for d, text in enumerate(bodies):
            own = text.split()
            token = np.fromiter((self.words.setdefault(w, len(self.words)) for w in own), np.int64, len(own))
            stops = np.fromiter(map(ends, own), bool, len(own))
            sentence = np.zeros(len(own), np.int64)
            sentence[1:] = np.cumsum(stops[:-1])
            fresh = np.ones(len(own), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (sentence[1:] != sentence[:-1])
            tokens.append(token[fresh])
            sentences.append(sentence[fresh] + count)
            n = int(sentence[-1]) + 1 if len(own) else 1
            docs.append(np.full(n, d))
            count += n
        self.token, self.sentence, self.doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, sentences, docs))
        self.n_sentences, self.n_docs = count, len(bodies)
        pairs = [(i, f) for w, i in self.words.items() for f in features(w)]
        self.word, self.bucket = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2

    def document_counts(self, of: np.ndarray) -> np.ndarray:
        """In how many documents of the mask `of` each bucket occurs."""
        first = np.searchsorted(self.word, np.arange(len(self.words) + 1))
        doc = self.doc[self.sentence]
        pairs = np.unique(self.token[of[doc]] * self.n_docs + doc[of[doc]])
        token, doc = pairs // max(1, self.n_docs), pairs % max(1, self.n_docs)
        n = first[token + 1] - first[token]
        at = np.repeat(first[token] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        both = np.unique(self.bucket[at] * self.n_docs + np.repeat(doc, n))
        return np.bincount(both // max(1, self.n_docs), minlength=BUCKETS).astype(float)


def loss_and_gradient(bags: Bags, y: np.ndarray, weight: np.ndarray, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
    """The weighted negative log-likelihood of the documents' labels, and its
    gradient by the weights and by the bias."""
    value = np.bincount(bags.word, w[bags.bucket], len(bags.words))
    z = np.bincount(bags.sentence, value[bags.token], bags.n_sentences) + bias
    # the log probability that no sentence offends
    log_clean = -np.bincount(bags.doc, np.logaddexp(0, z), len(y))
    toxic = np.maximum(-np.expm1(log_clean), 1e-12)
    pull = np.where(y, -np.exp(log_clean) / toxic, 1.0) * weight
    grad_z = pull[bags.doc] * 0.5 * (1 + np.tanh(z / 2))
    by_word = np.bincount(bags.token, grad_z[bags.sentence], len(bags.words))
    loss = -float(np.where(y, np.log(toxic), log_clean) @ weight)
    return loss, np.bincount(bags.bucket, by_word[bags.word], BUCKETS), float(grad_z.sum())


def fit(bodies: list[str], toxic: np.ndarray, rounds: int = 100, rate: float = 0.3, least: int = 3) -> Model:
    """Gradient descent on the documents' log-likelihood, either label with
    half of the weight. It starts at smoothed log-odds of the features' document
    counts; features that fewer than `least` toxic documents share (and few
    clean ones) stay at zero, so no document is explained by words of its own."""
    bags, y = Bags(bodies), toxic.astype(bool)
    if not y.any() or y.all():
        return Model(np.zeros(BUCKETS), -20.0 if not y.any() else 20.0)
    hot, cold = bags.document_counts(y), bags.document_counts(~y)
    used = (hot >= least) | (cold >= 20)
    share = np.array([y.mean(), 1 - y.mean()])
    odds = np.log((hot + 2 * share[0]) / y.sum()) - np.log((cold + 2 * share[1]) / (~y).sum())
    w, bias = np.where(used, np.maximum(odds, -1) * 0.7, 0), -6.0
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    # large first sums: weak gradients take small steps
    seen, seen_bias = np.full(BUCKETS, 1e-4), 1e-4
    for _ in range(rounds):
        _, grad, g = loss_and_gradient(bags, y, weight, w, bias)
        grad = np.where(used, grad, 0)
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
        seen_bias += g * g
        bias -= rate * g / np.sqrt(seen_bias)
    return Model(w, bias)


def calibration(bodies: list[str], toxic: np.ndarray, threshold: float, clean_share: float = 0.985) -> float:
    """The shift of log-odds that puts `threshold` where a model learnt from
    other documents leaves `clean_share` of the clean ones below it (two folds
    of the sample), but never above that: scores of whole texts grow with their
    sentences, and this sees clean texts of all lengths that it didn't learn
    from. None of either label: no shift."""
    y, fold = toxic.astype(bool), np.arange(len(toxic)) % 2
    if min(y.sum(), (~y).sum()) < 4:
        return 0.0
    odds = []
    for k in (0, 1):
        model = fit([b for b, f in zip(bodies, fold, strict=True) if f != k], toxic[fold != k])
        weights = model.weights()
        for i in np.flatnonzero((fold == k) & ~y):
            p = noisy_or(sentence_logits(bodies[i].split(), weights, model.bias)[0])
            odds.append(np.log(max(p, 1e-12) / max(1 - p, 1e-12)))
    at, least = float(np.quantile(odds, clean_share)), np.log(0.1 / 0.9)
    asked = np.log(threshold / (1 - threshold))
    return float(asked - min(max(at, least), asked))


def training_sample(docs: DataFrame, labels: DataFrame, each: int, most_bytes: int, seed: int) -> tuple[list[str], np.ndarray]:
    """At most `each` documents of either label, in order of a hash of doc_id,
    until `most_bytes` of text are reached; those of over a 64th of that come
    after all others, so a long text never keeps shorter ones out, and a label
    has one document at least. Of rows of one doc_id the smallest text is
    taken, so that reruns agree; null texts count as empty."""
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(seed))
    drawn = [marked.where(F.col("toxic") == v).orderBy(order, "doc_id").limit(each) for v in (0, 1)]
    # at most 2 * each ids
    found = texts(docs).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    size = F.octet_length("text").cast("long")
    before = Window.partitionBy("toxic").orderBy(size > most_bytes // 64, order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.withColumn("_bytes", F.coalesce(F.sum(size).over(before), F.lit(0)))
    kept = sized.where(F.col("_bytes") < most_bytes).orderBy("doc_id").select("text", "toxic").collect()
    return [r["text"] for r in kept], np.array([r["toxic"] for r in kept], np.int64)


def score(docs: DataFrame, labels: DataFrame, each: int = 3_000, most_bytes: int = 64 << 20, threshold: float = 0.7, seed: int = 5) -> DataFrame:
    """doc_id, score, predicted, offending for each row of docs.

    score is the noisy-or over all sentences of the whole text, calibrated so
    that about 1.5 % of clean documents at most reach `threshold`; predicted is
    1 from there on. offending lists the sentences whose own probability is
    at least a half, as (begin, end) word numbers with their probability.
    `labels` (doc_id, toxic) are the rows to learn from; the caller leaves out
    held-out ones. At most `each` documents of either label are used, in order
    of a hash, until `most_bytes` of text of that label are reached (the last
    document may pass it), so training is bounded. Null texts count as empty and,
    like empty and very long ones, are scored whole; without toxic labels every
    score is about 0. Scores use the text alone: repeated rows have equal
    scores. An empty table gives no rows. Further columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sample = training_sample(docs, labels, each, most_bytes, seed)
    model = fit(*sample)
    model.shift = calibration(*sample, threshold)
    shared = spark.sparkContext.broadcast(model)
    schema = "doc_id long, score double, predicted int, offending array<struct<begin:int,end:int,probability:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights()
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1):
                words = text.as_py().split()
                z, starts = sentence_logits(words, weights, shared.value.bias)
                scores.append(noisy_or(z, shared.value.shift))
                at = np.flatnonzero(z >= 0).tolist()
                bounds = [*starts.tolist(), len(words)]
                found.append([{"begin": bounds[i], "end": bounds[i + 1], "probability": float(1 / (1 + np.exp(-z[i])))} for i in at])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, kind)], names=["doc_id", "score", "predicted", "offending"])

    return texts(docs).mapInArrow(run, schema)
