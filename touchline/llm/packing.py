"""Best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import parts_for, prepare, texts, written
from touchline.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item.

    A bin is filled greedily: the longest item left, then again and again the
    longest that still fits. If a gap stays, the bin's smallest item is taken
    out, and the two unpacked items that fill the expanded gap best take its
    place if they leave a smaller gap. Equal lengths go by position. Lengths
    are 1 to capacity; a set of the lengths left is kept as the bits of an
    integer, so "longest at most x" is one mask and one bit_length.
    """
    order = np.argsort(-lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    left = sum(1 << n for n in stacks)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal left
        stack = stacks[n]
        item = stack.pop()
        if not stack:
            left &= ~(1 << n)
        return item

    number = 0
    while left:
        room, inside = capacity, []
        while fits := left & ((1 << (room + 1)) - 1):
            n = fits.bit_length() - 1
            inside.append(take(n))
            room -= n
        if room and len(inside) > 1:
            last = inside[-1]
            smallest = int(lengths[last])
            room += smallest
            best, pair = smallest, None
            a = (left & ((1 << room) - 1)).bit_length() - 1
            while a > 0 and 2 * a > best:
                most = min(a if len(stacks[a]) > 1 else a - 1, room - a)
                b = (left & ((1 << (most + 1)) - 1)).bit_length() - 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = (left & ((1 << a) - 1)).bit_length() - 1
            if pair:
                inside.pop()
                inside += [take(pair[0]), take(pair[1])]
                if not stacks[smallest]:
                    left |= 1 << smallest
                stacks[smallest].append(last)
        at = 0
        for i in inside:
            bins[i], offsets[i] = number, at
            at += int(lengths[i])
        number += 1
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, kind: str = "words") -> DataFrame:
    """The pieces of every document: its ids and end_id, cut every `capacity`
    ids. Null texts count as empty and give one piece of the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(kind, tokenizer), np.uint32(end_id).tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, group: int = 65_536, kind: str = "words") -> DataFrame:
    """Pieces with their sequence and place.

    Rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Pieces
    are dealt by hash into groups of about `group` and each group is packed on
    its own, in bounded memory: a group leaves a bin or two badly filled, out
    of some ten thousand. Full pieces are sequences of their own and never
    reach a packer. Repeated rows and null doc_ids are packed like others; an
    empty table gives no rows. Columns besides doc_id and text are ignored.
    """
    rows = written(pieces(docs, tokenizer, capacity, end_id, kind), "pieces")
    loose = rows.where(F.col("length") < capacity)
    groups = parts_for(loose.count(), group)
    # several tasks pack a group's share of rows: which one is the hash's choice
    keyed = loose.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("long"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        base = table.column("_group")[0].as_py() << 32
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(bins + base, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    packed = keyed.groupBy("_group").applyInArrow(fit, PACKED)
    full = rows.where(F.col("length") >= capacity)
    # ids of full pieces are negative, so none meets a packer's
    own = -F.monotonically_increasing_id() - 1
    return packed.unionByName(full.withColumn("sequence_id", own).withColumn("offset", F.lit(0).cast("long")))
