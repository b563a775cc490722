"""Removal of word passages that occur twice, by difference-cover anchors.

Two equal windows of `window` words start at positions i and j of their
documents. A difference cover D modulo a period P has, for any i and j, a shift
k < P with i + k and j + k both in D modulo P. So if only the short windows
(anchors, window - P + 1 words) at cover positions are hashed, the two windows
share an anchor at the same shift k: all repeats are near anchors seen twice,
and about |D| / P of all positions are hashed and shuffled. An anchor seen
twice is then extended: the full windows that hold it are hashed with 128 bits,
and those seen twice are repeats.

Documents are dealt into parts of bounded size, by hash. A part sends its
distinct hashes, sorted, packed by hash range; a range's reducer sorts what all
parts sent and answers each part with one bit for each hash. A hash that occurs
in a third of all rows is sent once by each part, so no hash is hot, no pair
is made, and answers are a few bits where a join would carry rows. A message
goes to a range only if it has hashes there, so messages are never more than
the hashes of all parts; ranges are six times the size of parts, so that a
message holds many. The three passes read one exchange of the texts, which
Spark reuses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import only, parts_for, prepare

#: A difference cover of the integers modulo 21 (a perfect difference set).
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Odd multipliers of the two rolling hashes.
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SENT = "bucket long, part long, blob binary, twice binary"
ANSWER = "part long, kind int, bucket long, bits binary"


@lru_cache(maxsize=4)
def _powers(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        up, down = (np.concatenate([one, np.cumprod(np.full(n, m, np.uint64))]) for m in (odd, pow(odd, -1, 1 << 64)))
    return up, down


def rolling(h: np.ndarray, k: int, odd: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    up, down = _powers(odd, 1 << max(12, int(len(h)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
        return (sums[k:] - sums[:-k]) * down[: len(h) - k + 1]


class Part:
    """The words of a part's documents, one after the other."""

    def __init__(self, texts: pa.ChunkedArray, window: int):
        self.window, self.short = window, window - PERIOD + 1
        self.words: list[list[bytes]] = [(t.as_py() or b"").split() for t in texts.cast(pa.binary())]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        n = int(self.counts.sum())
        self.hashes = np.fromiter((h for w in self.words for h in map(xxhash.xxh64_intdigest, w)), np.uint64, n)
        ends = np.cumsum(self.counts)
        self.begins = ends - self.counts
        self.at = np.arange(n) - np.repeat(self.begins, self.counts)
        self.left = np.repeat(ends, self.counts) - np.arange(n)  # words from here to the document's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the cover's anchors."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        where = np.flatnonzero(cover[self.at % PERIOD] & (self.left >= self.short))
        return where, rolling(self.hashes, self.short, ODD[0])[where]

    def windows(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, 128-bit hashes) of the windows that hold an anchor of
        `alive` (positions) at a shift below the period."""
        n = len(self.hashes)
        marks = np.zeros(n + 1, np.int64)
        marks[alive + 1] = 1
        sums = np.cumsum(marks)
        near = sums[np.minimum(np.arange(n) + PERIOD, n)] > sums[:-1]
        where = np.flatnonzero(near & (self.left >= self.window))
        both = np.empty((len(where), 2), np.uint64)
        for c, odd in enumerate(ODD):
            with np.errstate(over="ignore"):
                own = self.hashes if not c else (self.hashes ^ (self.hashes >> np.uint64(31))) * np.uint64(ODD[1])
            both[:, c] = rolling(own, self.window, odd)[where]
        return where, both


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct, the place of each, whether it occurs twice here)."""
    hashes = hashes if hashes.ndim == 2 else hashes[:, None]
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort(hashes.T[::-1])
    own = hashes[order]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]).any(axis=1)
    rank = np.cumsum(first) - 1
    place = np.empty(len(own), np.int64)
    place[order] = rank
    return own[first], place, np.bincount(rank, minlength=int(first.sum())) > 1


def buckets_of(own: np.ndarray, n: int) -> np.ndarray:
    return (((own[:, 0] >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _send(part: int, hashes: np.ndarray, n: int) -> pa.Table:
    own, _, twice = distinct(hashes)
    names, begins = np.unique(buckets_of(own, n), return_index=True)
    ends = [*begins[1:].tolist(), len(own)]
    cut = list(zip(begins.tolist(), ends, strict=True)) if len(own) else []
    return pa.table({"bucket": pa.array(names[: len(cut)], pa.int64()), "part": pa.array([part] * len(cut), pa.int64()), "blob": pa.array([own[a:b].tobytes() for a, b in cut], pa.binary()), "twice": pa.array([np.packbits(twice[a:b]).tobytes() for a, b in cut], pa.binary())})


def _answers(kind: int, wide: int) -> Callable[[pa.Table], pa.Table]:
    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        blobs = [np.frombuffer(b, np.uint64).reshape(-1, wide) for b in table.column("blob").to_pylist()]
        own, place, more = distinct(np.concatenate(blobs))
        here = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(b)) for b, t in zip(blobs, table.column("twice").to_pylist(), strict=True)])
        more |= np.bincount(place, weights=here, minlength=len(own)) > 0
        ends = np.cumsum([len(b) for b in blobs])
        bits = [np.packbits(more[p]).tobytes() for p in np.split(place, ends[:-1])]
        n = len(bits)
        return pa.table({"part": table.column("part"), "kind": pa.array([kind] * n, pa.int32()), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return answer


def _seen(replies: pa.Table, kind: int, hashes: np.ndarray, n: int) -> np.ndarray:
    """Whether each hash occurs twice, by the answers to what _send() sent."""
    own, place, _ = distinct(hashes)
    if not len(own):
        return np.zeros(0, bool)
    replies = replies.filter(pa.compute.equal(replies.column("kind"), kind)).sort_by("bucket")
    sizes = np.unique(buckets_of(own, n), return_counts=True)[1]
    bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=s) for b, s in zip(replies.column("bits").to_pylist(), sizes.tolist(), strict=True)])
    return bits.astype(bool)[place]


def remove_repeats(docs: DataFrame, window: int = 35, part_bytes: int = 4 << 20, text: str = "text") -> DataFrame:
    """docs without the words of any window of `window` words whose words also
    start elsewhere in the table.

    Adds n_words, n_removed, removed (ranges of removed words: array of
    (begin, end)), kept_sha256 (of the kept words, joined by one space) and
    kept_text: the text itself where nothing was removed, else the kept words
    joined by one space, lines kept apart. Every occurrence goes, also the
    first, and windows are judged on the input. Null texts count as empty:
    they have no words, and kept_text is null. Repeated rows repeat each
    other's windows. A very long text is worked on by one task, whole. An empty
    table gives no rows. Other columns pass unchanged; the names above are
    replaced.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    prepare(docs.sparkSession)
    added = ("n_words", "n_removed", "removed", "kept_sha256", "kept_text")
    kept = docs.select([c for c in docs.columns if c not in added])
    total = kept.agg(F.sum(F.octet_length(text))).first()[0]
    n, ranges = parts_for(total, part_bytes), parts_for(total, 6 * part_bytes)
    mine = "_part"
    while mine in kept.columns:
        mine += "_"
    dealt = kept.withColumn(mine, F.pmod(F.xxhash64(*[c for c in kept.columns if c in ("doc_id", text)]), F.lit(n)).cast("long"))

    def first(table: pa.Table) -> pa.Table:
        only()
        part = Part(table.column(text), window)
        return _send(table.column(mine)[0].as_py(), part.anchors()[1], ranges)

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left.column(text), window)
        where, hashes = part.anchors()
        return _send(left.column(mine)[0].as_py(), part.windows(where[_seen(right, 0, hashes, ranges)])[1], ranges)

    names = list(kept.columns)
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string("n_words long, n_removed long, removed array<struct<begin:long,end:long>>, kept_sha256 string, kept_text string").fields])

    def third(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left.column(text), window)
        where, hashes = part.anchors()
        where, hashes = part.windows(where[_seen(right, 0, hashes, ranges)])
        edges = np.zeros(len(part.hashes) + 1, np.int64)
        starts = where[_seen(right, 1, hashes, ranges)]
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + window, -1)
        gone = np.cumsum(edges)[:-1] > 0
        out: dict[str, list] = {"n_words": part.counts.tolist(), "n_removed": [], "removed": [], "kept_sha256": [], "kept_text": []}
        whole = left.column(text)
        for k, (words, begin) in enumerate(zip(part.words, part.begins.tolist(), strict=True)):
            own = gone[begin : begin + len(words)]
            turns = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
            cut = list(zip(turns[::2], turns[1::2], strict=True))
            out["n_removed"].append(int(own.sum()))
            out["removed"].append([{"begin": a, "end": b} for a, b in cut])
            for a, b in reversed(cut):
                del words[a:b]
            out["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
            own_text = whole[k].as_py()
            out["kept_text"].append(without(own_text, cut) if cut else own_text)
        more = {c: pa.array(out[f.name], f_type) for c, f, f_type in zip(added, schema.fields[-len(added) :], (pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()), strict=True)}
        result = left.select(names)
        for c, values in more.items():
            result = result.append_column(c, values)
        return result

    def asked(sent: DataFrame, kind: int, wide: int) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(_answers(kind, wide), ANSWER)

    anchors = asked(dealt.groupBy(mine).applyInArrow(first, SENT), 0, 1).withColumnRenamed("part", mine)
    windows = asked(dealt.groupBy(mine).cogroup(anchors.groupBy(mine)).applyInArrow(second, SENT), 1, 2).withColumnRenamed("part", mine)
    return dealt.groupBy(mine).cogroup(anchors.unionByName(windows).groupBy(mine)).applyInArrow(third, schema)


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text's words outside `ranges`, lines kept apart."""
    gone = {i for a, b in ranges for i in range(a, b)}
    at, lines = 0, []
    for line in text.encode().split(b"\n"):
        words = line.split()
        kept = [w for i, w in enumerate(words, at) if i not in gone]
        at += len(words)
        if kept or not words:
            lines.append(b" ".join(kept))
    return b"\n".join(lines).decode()
