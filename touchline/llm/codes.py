"""Vector codes by product quantisation, with a delta-maintained Lloyd.

Vectors become integers and are cut into parts; each part position has a
codebook. A table of assignments is kept from round to round, and so are the
running sums of each entry's parts. A round writes the new assignments and
moves only what changed: a part that goes from one entry to another takes its
components from the one's sum and adds them to the other's, added up in each
task first. All sums are of integers, so the running ones equal fresh ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import attached, prepare, removed, table_path, written, written_at

#: Beyond these bounds sums are not exact in doubles, or in longs.
EXACT, LONG = 1 << 53, (1 << 63) - 1
#: Rows compared with a codebook at a time.
BLOCK = 4_096


def cuts(length: int, parts: int) -> list[slice]:
    """Consecutive parts of a vector, equal if their number divides its length."""
    at = [k * length // parts for k in range(parts + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (integers) its nearest entry of the book, ties to the
    lower index, and their squared distance: exact at any size of components
    whose distance is a long."""
    high = max([1, *(int(np.abs(a).max()) for a in (x, book) if a.size)])
    # |x|^2 - 2 x c + |c|^2, no sum of which passes four times this
    if 4 * high * high * max(1, x.shape[1]) < EXACT:
        a, c = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None]
        at = d.argmin(axis=1)
        return at, d[np.arange(len(at)), at].astype(np.int64)
    wide = x.astype(object)
    at, best = np.zeros(len(x), np.int64), None
    for e, entry in enumerate(book.astype(object)):
        d = ((wide - entry) ** 2).sum(axis=1)
        best, at = (d, at) if best is None else (np.where(d < best, d, best), np.where(d < best, e, at))
    if best is not None and len(best) and max(best) > LONG:
        raise ArithmeticError("a squared distance doesn't fit a long")
    return at, np.array(best, np.int64)


def valid(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, x: the components times `scale`, floored, of the valid
    vectors of the most common length."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e")).where(valid(F.col("e")))
    rows = own.select("vec_id", "label", F.transform("e", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("x") == (lengths["length"] if lengths else 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(column), 0), np.int64)


def assigned(state: DataFrame, books: list[np.ndarray], pieces: list[slice]) -> DataFrame:
    """state (vec_id, label, x, codes) with `was` (the codes before), new codes
    and `error`, the squared distances summed over the parts."""
    width = pieces[-1].stop
    shared = state.sparkSession.sparkContext.broadcast(books)  # parts * entries of a vector's part: bounded by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), width)
            codes, error = np.zeros((len(x), len(pieces)), np.int32), np.zeros(len(x), object)
            for p, piece in enumerate(pieces):
                for at in range(0, len(x), BLOCK):
                    own = slice(at, at + BLOCK)
                    codes[own, p], d = nearest(x[own, piece], shared.value[p])
                    error[own] += d
            if len(error) and max(error) > LONG:
                raise ArithmeticError("an error doesn't fit a long")
            new = pa.FixedSizeListArray.from_arrays(pa.array(codes.reshape(-1)), len(pieces)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3), new, pa.array(error.astype(np.int64))], names=["vec_id", "label", "x", "was", "codes", "error"])

    label = state.schema["label"].dataType.simpleString()
    return state.select("vec_id", "label", "x", "codes").mapInArrow(run, f"vec_id long, label {label}, x array<long>, was array<int>, codes array<int>, error long")


def changes(state: DataFrame, entries: int, pieces: list[slice]) -> DataFrame:
    """(part, entry, count, sums): what parts that changed their entry add to
    its count and sums and take from those of the entry before, added up in
    each task. Sums are text, as they may pass a long."""
    width = pieces[-1].stop
    moved = state.where("was IS NULL OR was <> codes").select("x", "was", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(pieces), entries), np.int64)
        sums, high = [np.zeros((entries, p.stop - p.start), np.int64) for p in pieces], 0
        for batch in batches:
            x = _matrix(batch.column(0), width)
            if not len(x):
                continue
            high += int(np.abs(x).max()) * len(x)
            if high > LONG // 4:  # whole numbers of any size from here on
                sums, x = [s.astype(object) for s in sums], x.astype(object)
            codes = _matrix(batch.column(2), len(pieces))
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            was = np.full_like(codes, -1)
            was[known] = _matrix(batch.column(1).drop_null(), len(pieces))
            for p, piece in enumerate(pieces):
                to = codes[:, p] != was[:, p]
                off = to & known
                np.add.at(counts[p], codes[to, p], 1)
                np.add.at(sums[p], codes[to, p], x[to, piece])
                np.subtract.at(counts[p], was[off, p], 1)
                np.subtract.at(sums[p], was[off, p], x[off, piece])
        out = [(p, e, int(counts[p, e]), [str(v) for v in sums[p][e]]) for p in range(len(pieces)) for e in range(entries) if counts[p, e] or any(sums[p][e])]
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["part", "entry", "count", "sums"])

    return moved.mapInArrow(run, "part int, entry int, count long, sums array<string>")


class Books:
    """The codebooks and, for each entry, the running count and sums of its
    parts: all bounded by parts, entries and the length of a vector."""

    def __init__(self, first: list[list[int]], pieces: list[slice]):
        self.entries = [[list(v[p]) for v in first] for p in pieces]
        self.counts = [[0] * len(first) for _ in pieces]
        self.sums = [[[0] * (p.stop - p.start) for _ in first] for p in pieces]

    def moved(self, rows: list) -> None:
        """Apply plus and minus contributions, then replace the entries in use
        by floor(sum / count)."""
        for r in rows:
            self.counts[r["part"]][r["entry"]] += r["count"]
            own = self.sums[r["part"]][r["entry"]]
            own[:] = [a + int(b) for a, b in zip(own, r["sums"], strict=True)]
        for p, counts in enumerate(self.counts):
            for e, n in enumerate(counts):
                if n:
                    self.entries[p][e] = [s // n for s in self.sums[p][e]]

    def arrays(self) -> list[np.ndarray]:
        return [np.array(e, np.int64).reshape(len(e), -1) for e in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()


SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each valid row
    of vectors (vec_id, embedding, label).

    A component x is floor(scale * x). A part position's codebook starts as the
    parts of the first `entries` rows by vec_id; after `rounds` rounds of
    assigning and replacing, parts are assigned once more. code holds the
    entries' indexes, two hex digits a part (more, if there are over 256
    entries); error the squared distances over all parts, label_error their sum
    over rows of one label, null labels together.

    Vectors that are null or hold null or non-finite components are dropped, as
    are those of another length than most (ties: the longer). Rows without
    vec_id come last in order, and rows of one vec_id in order of their vectors;
    repeated rows are rows each, with equal codes. With fewer rows than entries
    the codebooks are as short. Parts differ by one component in length where
    `parts` doesn't divide the length. A component, error or sum of errors that
    doesn't fit a long is an error, never wrapped. An empty table gives no rows.
    Further columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    path = table_path(spark, "codes")
    rows = integers(vectors, scale).withColumn("codes", F.lit(None).cast("array<int>"))
    state = written_at(rows, path)
    first = [r["x"] for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], SCHEMA)
    pieces = cuts(len(first[0]), parts)
    books = Books(first, pieces)
    for step in range(rounds + 1):
        done, path = path, table_path(spark, "codes")
        state = written_at(assigned(state, books.arrays(), pieces), path)
        removed(spark, done)
        if step < rounds:
            # a row for each part and entry that changed, from each task; added up by key before the driver gets one each
            delta = changes(state, len(first), pieces)
            whole = F.transform(F.col("sums"), lambda s: s.cast("decimal(38,0)"))
            summed = delta.select("part", "entry", "count", F.posexplode(whole).alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("count").alias("count"), F.sum("s").alias("s"))
            got = summed.groupBy("part", "entry").agg(F.first("count").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda r: r["s"].cast("string")).alias("sums"))
            books.moved(got.collect())
    digits = max(2, len(f"{len(first) - 1:x}"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), digits, "0"))), "")
    coded = state.select("vec_id", "label", code.alias("code"), "error")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return attached(coded, sums, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
