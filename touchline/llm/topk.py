"""Exact top-k by inner product over a bit-sliced index.

The index cuts the table into blocks of rows. A block holds each quantised
attribute as slices: bitmap b of attribute d has the rows whose value (less the
block's least value of d) has bit b set. A query's scores over a block are sums
of bitmaps: attribute d with weight q adds slice b shifted by every digit of q.
Carry-save adders (a full adder is five bitmap operations) reduce the bitmaps
of each weight 2^p to one, so a block's scores come out as bit slices
themselves. The k best are then picked from the most significant slice
downward: rows known to be in, and rows still tied at the boundary. Those rows,
and no others, get their score read off the slices, and the boundary is
resolved exactly, ties to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import parts_for, prepare, written

INDEX = "block long, dim int, ids binary, low binary, slices binary, widths binary"


def sliced(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least value, number of slices, slices) of each column of integers.
    Slices are rows of 64-bit words, column after column, low bits first."""
    low = values.min(axis=0)
    rest = (values - low).astype(np.uint64)
    widths = np.array([int(m).bit_length() for m in rest.max(axis=0)], np.int64)
    words = -(-len(values) // 64)
    out = np.zeros((int(widths.sum()), words * 8), np.uint8)
    at = 0
    for d, width in enumerate(widths.tolist()):
        for b in range(width):
            packed = np.packbits((rest[:, d] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
            out[at, : len(packed)] = packed
            at += 1
    return low, widths, out.view(np.uint64)


def digits(q: int) -> list[tuple[int, int]]:
    """(position, sign) of the non-adjacent form of q: the fewest signed
    powers of two that sum to it."""
    out, p = [], 0
    while q:
        if q & 1:
            sign = 2 - (q & 3)
            out.append((p, sign))
            q -= sign
        q >>= 1
        p += 1
    return out


def summed(slices: np.ndarray, widths: np.ndarray, query: np.ndarray, full: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The bit slices of the scores less `base`, which is returned too, so
    that every score is at least 0. A digit -1 adds the complement of a slice
    and takes its weight from the base."""
    piles: list[list[np.ndarray]] = []
    base = at = 0
    for width, q in zip(widths.tolist(), query.tolist(), strict=True):
        for p, sign in digits(int(q)):
            for b in range(width):
                while len(piles) <= p + b:
                    piles.append([])
                if sign > 0:
                    piles[p + b].append(slices[at + b])
                else:
                    piles[p + b].append(slices[at + b] ^ full)
                    base -= 1 << (p + b)
        at += width
    out, p = [], 0
    zero = np.zeros_like(full)
    while p < len(piles):
        pile = piles[p]
        while len(pile) > 1:
            x, y = pile.pop(), pile.pop()
            half = x ^ y
            if pile:
                z = pile.pop()
                carry = (x & y) | (half & z)
                pile.insert(0, half ^ z)
            else:
                carry = x & y
                pile.append(half)
            if len(piles) == p + 1:
                piles.append([])
            piles[p + 1].append(carry)
        out.append(pile[0] if pile else zero)
        p += 1
    return out, base


def best(scores: list[np.ndarray], k: int, full: np.ndarray) -> np.ndarray:
    """Rows that may be among the k best: all above the k-th score and all
    that tie with it, found slice by slice from the top."""
    sure, tied = np.zeros_like(full), full
    for s in reversed(scores):
        with_bit = sure | (tied & s)
        if int(np.bitwise_count(with_bit).sum()) >= k:
            tied = tied & s
        else:
            sure, tied = with_bit, tied & ~s
    return np.flatnonzero(np.unpackbits((sure | tied).view(np.uint8), bitorder="little"))


def read_off(scores: list[np.ndarray], rows: np.ndarray, wide: bool = False) -> np.ndarray:
    """The values that the slices hold at these rows; `wide` ones as Python's
    integers, where 63 bits might not do."""
    out = np.zeros(len(rows), object if wide else np.int64)
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    for p, s in enumerate(scores):
        own = ((s[word] >> bit) & np.uint64(1)).astype(np.int64)
        out += own.astype(object) << p if wide else own << p
    return out


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dim, q): floor(scale * x) of each component, x as double, of
    the vectors that can take part. A component beyond a long is an error."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    edge = float(1 << 63)

    def whole(x: Column) -> Column:
        inside = (x * scale >= -edge) & (x * scale < edge)
        return F.when(inside, F.floor(x * scale)).otherwise(F.raise_error("a component times the scale is beyond a long").cast("long"))

    return rows.where(fine).select("vec_id", F.size("v").alias("dim"), F.transform("v", whole).alias("q"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block: int = 16_384, queries_each: int = 4_096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows.

    Queries are the rows whose vec_id is divisible by `every`; candidates are
    all other rows (rows with the query's vec_id are its own). The score is the
    inner product of the quantised vectors; ties go to the smaller vec_id.
    Vectors that are null, or hold null or non-finite components, or have no
    vec_id, take no part; vectors of different lengths aren't compared. Fewer
    than k candidates are all returned. Repeated rows are candidates each; of
    a query's repeated rows each asks, so its ranks repeat. A score or component
    that doesn't fit a long is an error. An empty table gives no rows. Further
    columns are ignored.

    Blocks and query groups are of fixed size. The index is written once; each
    block meets each query group in a task of its own and returns at most k
    rows (and ties of the boundary are resolved there), so tasks and memory
    stay bounded and the work, every query against every row, divides evenly.
    A block is shuffled once for each group: a megabyte or so for 64 components
    against the seconds that thousands of queries take over it.
    """
    prepare(vectors.sparkSession)
    rows = written(quantised(vectors, scale), "quantised")
    n = rows.count()
    blocks = parts_for(n, block)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        out: dict[str, list] = {x.split()[0]: [] for x in INDEX.split(", ")}
        dims = table.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = table.filter(pa.array(dims == dim))
            values = np.array(own.column("q").to_pylist(), np.int64).reshape(own.num_rows, dim)
            low, widths, slices = sliced(values) if dim else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1), np.uint64))
            for name, x in zip(out, (own.column("_block")[0].as_py(), dim, own.column("vec_id").to_numpy().tobytes(), low.tobytes(), slices.tobytes(), widths.tobytes()), strict=True):
                out[name].append(x)
        return pa.table({c: pa.array(v, {"block": pa.int64(), "dim": pa.int32()}.get(c, pa.binary())) for c, v in out.items()})

    index = written(rows.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long")).groupBy("_block").applyInArrow(build, INDEX), "index")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    groups = parts_for(asked.count(), queries_each)
    asked = asked.withColumn("_group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("_row", F.monotonically_increasing_id())
    packs = asked.groupBy("_group", "dim").agg(F.collect_list("vec_id").alias("query_ids"), F.collect_list("_row").alias("query_rows"), F.flatten(F.collect_list("q")).alias("queries"))
    # each block stands once for each query group: an equi join on the group
    cells = index.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(packs, ["_group", "dim"])
    cells = cells.repartition(max(1, min(blocks * groups, 100_000)), "_group", "block").drop("_group", "dim", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                yield searched(cell, k)

    found = cells.mapInArrow(search, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def searched(cell: dict, k: int) -> pa.RecordBatch:
    ids, low, widths = (np.frombuffer(cell[c], np.int64) for c in ("ids", "low", "widths"))
    words = -(-len(ids) // 64)
    slices = np.frombuffer(cell["slices"], np.uint64).reshape(-1, words) if len(widths) else np.zeros((0, words), np.uint64)
    rows = np.zeros(words * 64, np.uint8)
    rows[: len(ids)] = 1
    full = np.packbits(rows, bitorder="little").view(np.uint64)
    queries = np.array(cell["queries"], np.int64).reshape(len(cell["query_ids"]), -1)
    # the largest sizes that a score's terms can have: beyond 62 bits, sums are of Python's integers
    tops = np.maximum(np.abs(low.astype(float)), np.abs(low.astype(float) + np.exp2(widths)))
    wide = (np.abs(queries.astype(float)) @ tops) * 16 >= float(1 << 63)
    out: list[np.ndarray] = []
    for query_id, row, query, large in zip(cell["query_ids"], cell["query_rows"], queries, wide.tolist(), strict=True):
        mine = np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, "right")
        mask = full
        if mine[0] < mine[1]:
            bits = rows.copy()
            bits[mine[0] : mine[1]] = 0
            mask = np.packbits(bits, bitorder="little").view(np.uint64)
        scores, base = summed(slices, widths, query, full)
        near = best(scores, k, mask)
        if large:
            exact = read_off(scores, near, True) + base + sum(a * b for a, b in zip(query.tolist(), low.tolist(), strict=True))
            keep = np.array(sorted(range(len(near)), key=lambda i: (-exact[i], ids[near[i]]))[:k], np.int64)
            values = exact
            if any(not -(1 << 63) <= exact[i] < 1 << 63 for i in keep):
                raise OverflowError("a score is beyond a long")
        else:
            values = read_off(scores, near) + base + int(query @ low)
            keep = np.lexsort((ids[near], -values))[:k]
        out.append(np.stack([np.full(len(keep), query_id, np.int64), np.full(len(keep), row, np.int64), ids[near][keep], values[keep].astype(np.int64)]))
    found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "query_row", "vec_id", "score"])
