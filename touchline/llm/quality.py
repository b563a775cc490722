"""A quality filter by importance resampling of hashed n-grams.

Two bags of hashed n-grams are counted: of a bounded sample of text labelled
good (the target) and of the whole corpus (raw). A document's importance weight
is the ratio of its probability under the two (Xie et al., "Data Selection for
Language Models via Importance Resampling", 2023), and Gumbel top-k on the log
weights draws documents without replacement in proportion to their weights.

The n-grams are words, and pairs of neighbouring word shapes with a mark on
pairs that repeat a word: "Hello," has the shape "Aa,". Hashing bounds the
model; shapes let it see what kinds of text the corpus has.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import only, prepare, written

#: Buckets of words and of shape pairs.
WORDS, PAIRS = 1 << 13, 1 << 12
MEMO = 300_000
#: Bytes to their kind: letters of either case, digits, others themselves.
#: Bytes beyond ASCII are parts of letters.
_KIND = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_MARKS = b".,;:!?'\"()[]{}*#$%&|"


def shape(word: bytes) -> bytes:
    """The word with each run of one kind of character written once."""
    return _RUNS.sub(rb"\1", word.translate(_KIND))


class Grams(dict):
    """word -> word bucket, a hash of its shape and a hash of the word, packed."""

    def __missing__(self, word: bytes) -> int:
        low = word.lower()
        bare = low.strip(_MARKS) or low
        packed = zlib.crc32(bare) % WORDS << 48 | (zlib.crc32(shape(word)) & 0xFFFF) << 32 | zlib.crc32(low)
        if len(self) > MEMO:
            self.clear()
        self[word] = packed
        return packed


_grams = Grams()


def begin() -> None:
    """A task that looks words up begins."""
    only(_grams)


def buckets(text: bytes) -> np.ndarray:
    """The buckets of a text's n-grams, repeats included."""
    words = text.split()
    packed = np.fromiter(map(_grams.__getitem__, words), np.uint64, len(words))
    own = (packed >> np.uint64(48)).astype(np.int64)
    form = ((packed >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
    same = (packed[1:] & np.uint64(0xFFFFFFFF)) == (packed[:-1] & np.uint64(0xFFFFFFFF))
    pair = (form[:-1] * 40503 + form[1:] * 30011 + same * 7919) % PAIRS
    return np.concatenate([own, WORDS + pair])


def counted(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Counts of each bucket, (raw, target), over all documents and over those
    whose doc_id is in `sample` (a bounded table)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        sums = np.zeros((2, WORDS + PAIRS), np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(buckets(text.as_py()), minlength=WORDS + PAIRS)
                sums[0] += own
                if good:
                    sums[1] += own
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "raw", "target"])

    marked = docs.join(F.broadcast(sample.select("doc_id", F.lit(True).alias("_good"))), "doc_id", "left")
    rows = marked.select(F.coalesce("text", F.lit("")).alias("text"), F.col("_good")).mapInArrow(count, "bucket long, raw long, target long")
    out = np.zeros((2, WORDS + PAIRS), np.int64)
    # a row for each bucket, whatever the corpus
    for bucket, raw, target in rows.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        out[:, bucket] = raw, target
    return out


def log_ratios(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log(target / raw) of each bucket; words and pairs are two models."""
    out = np.empty(counts.shape[1])
    for a, b in ((0, WORDS), (WORDS, counts.shape[1])):
        p = counts[:, a:b] + smoothing
        p = p / p.sum(axis=1, keepdims=True)
        # the raw model is mixed with a little of the target, so no ratio is without bound
        out[a:b] = np.log(p[1] / (0.99 * p[0] + 0.01 * p[1]))
    return out


def gumbel(seed: int, *columns: str) -> Column:
    """Standard Gumbel noise by a hash of the columns: reruns agree."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """docs with _score: the log importance weight of each whole text."""
    names, types = docs.columns, docs.schema
    schema = T.StructType([*types.fields, T.StructField("_score", T.DoubleType())])
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            own = [float(table.value[buckets(t.as_py() or b"")].sum()) for t in batch.column(names.index("text")).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.float64())], names=[*names, "_score"])

    return docs.mapInArrow(score, schema)


def boundary(keys: DataFrame, k: int, bins: int = 4096, few: int = 50_000) -> tuple[float, int | None]:
    """(key, doc_id) of the k-th row of (key, doc_id) in the order key
    descending, doc_id ascending, nulls last. Histograms narrow the range until
    it holds a few rows or one key, and only those are sorted."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k >= n or n == 0:
        return float("-inf"), None
    if k <= 0:
        return float("inf"), None
    above = 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        if high <= low:
            break
        step = (high - low) / bins
        if step <= 0 or low + step <= low:
            break
        cell = F.least(F.floor((F.col("key") - low) / step), F.lit(bins - 1))
        found = inside.groupBy(cell.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for b, count, lo, hi in sorted(found, reverse=True):
            if above + count >= k:
                narrowed = (lo, hi) != (low, high)
                low, high, left = lo, hi, count
                break
            above += count
        if left <= few or not narrowed:
            break
    last = keys.where((F.col("key") >= low) & (F.col("key") <= high)).orderBy(F.desc("key"), F.col("doc_id").asc_nulls_last()).limit(k - above)
    row = last.orderBy("key", F.col("doc_id").desc_nulls_first()).first()
    return row["key"], row["doc_id"]


def split_point(scores: np.ndarray, good: np.ndarray) -> float:
    """The log weight that parts good and bad labelled documents best: the
    share of good ones at or above it less that of bad ones is largest. Halfway
    to the next document below it, so that clean text has some room."""
    order = np.argsort(-scores, kind="stable")
    scores, good = scores[order], good[order].astype(bool)
    gain = np.cumsum(np.where(good, 1 / max(1, good.sum()), -1 / max(1, (~good).sum())))
    # a cut is between different scores only
    ends = np.append(scores[1:] < scores[:-1], True)
    at = int(np.flatnonzero(ends)[np.argmax(gain[ends])])
    return float(scores[at] + scores[at + 1]) / 2 if at + 1 < len(scores) else float("-inf")


def select(docs: DataFrame, labels: DataFrame, keep: float | None = None, sample: int = 20_000, seed: int = 11) -> DataFrame:
    """The documents that importance resampling selects: docs' rows and
    columns, with _score (log importance weight) and _key (with Gumbel noise).
    Rows are scored again on their way, so texts are never shuffled.

    The target is a sample of at most `sample` documents of quality 1, by hash
    of doc_id. `keep` is the share of the corpus to select; by default it is
    the share whose weight is above the point that parts a labelled sample best
    (at most `sample` documents of either label). Exactly that many rows are
    selected (more only where rows tie in key and doc_id), those of the largest
    keys, ties to the smaller doc_id. Null texts count as empty and have weight
    one. Without labels of both kinds nothing is known and every document is
    kept; an empty table gives no rows. Columns named _score and _key are
    replaced.
    """
    docs = docs.select([c for c in docs.columns if c not in ("_score", "_key")])
    ratios, _, chosen = decide(docs, labels, keep, sample, seed)
    return scored(docs, ratios).withColumn("_key", F.col("_score") + gumbel(seed, "doc_id")).where(chosen)


def selected(docs: DataFrame, labels: DataFrame, keep: float | None = None, sample: int = 20_000, seed: int = 11) -> DataFrame:
    """doc_id, _score, _key of the documents that select() selects."""
    _, keys, chosen = decide(docs, labels, keep, sample, seed)
    return keys.withColumnRenamed("key", "_key").where(chosen)


def decide(docs: DataFrame, labels: DataFrame, keep: float | None, sample: int, seed: int) -> tuple[np.ndarray, DataFrame, Column]:
    """(log ratios, keys of all documents, the condition of a selected row)."""
    prepare(docs.sparkSession)
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = [marked.where(F.col("quality") == v).orderBy(F.xxhash64("doc_id", F.lit(seed))).limit(sample) for v in (0, 1)]
    ratios = log_ratios(counted(docs.select("doc_id", "text"), drawn[1]))
    key = F.col("_score") + gumbel(seed, "doc_id")
    keys = written(scored(docs.select("doc_id", "text"), ratios).select("doc_id", "_score", key.alias("key")), "keys")
    n = keys.count()
    k = n if keep is None else int(round(n * keep))
    if keep is None:
        # at most 2 * sample ids
        known = keys.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("_score", "quality").toPandas()
        if known["quality"].nunique() == 2:
            k = keys.where(F.col("_score") >= split_point(known["_score"].to_numpy(), known["quality"].to_numpy())).count()
    least, last = boundary(keys, k)
    tied = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(False))
    return ratios, keys, (F.col("_key") > least) | ((F.col("_key") == least) & tied)
