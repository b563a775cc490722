"""A content-addressed store of token ids.

A document's id stream is cut where a rolling hash of its last ids says so, so
equal passages give equal chunks wherever they stand. A chunk is named by the
hash of its content and stored once. The store's folder has

  encoded/kind=chunk/  n, keys, data: unique chunks, named by keys; data are
            n ids as little-endian unsigned integers of `width` bytes (2 where
            the vocabulary allows)
  recipes/  row, doc_id, start, n_tokens, keys, sizes: a row for each document
            in ascending doc_id order, file after file; keys are the names of
            its chunks, sizes their numbers of ids
  manifest/level=k/  block, n_docs, n_tokens, root: a Merkle tree. A block of
            level 0 is over FAN recipes, of level k over FAN blocks of level
            k - 1; the last level has one block, the root of the store

A recipe's leaf covers all its columns, and a name covers its chunk's content;
so a root that is found again proves every id and its place.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import parts_for, prepare, running_start, texts
from touchline.llm.tokens import Encoder, encoder

#: Ids that the rolling hash covers; least, usual and most ids of a chunk.
SPAN, LEAST, USUAL, MOST = 16, 128, 512, 2048
KEY = 16
#: Children of a node of the manifest; bytes of text that a task deals with.
FAN, PART_BYTES = 1024, 128 << 20
#: Names remembered by a task, so that it sends a chunk once.
SENT = 200_000
#: Bytes of texts that are encoded together.
GROUP = 32 << 20


@lru_cache(maxsize=1)
def _drawn() -> np.ndarray:
    """A 64-bit number for each id (its low 16 bits), by a mixing function."""
    with np.errstate(over="ignore"):
        x = np.arange(1, 65_537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def cuts(ids: np.ndarray) -> list[int]:
    """Where the chunks of an id stream end."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    with np.errstate(over="ignore"):
        sums = np.cumsum(_drawn()[ids & np.uint32(0xFFFF)])
        rolled = sums.copy()
        rolled[SPAN:] -= sums[:-SPAN]
        rolled >>= np.uint64(64 - (USUAL - LEAST).bit_length())
    marks = (np.flatnonzero(rolled == 0) + 1).tolist()
    out, last = [], 0
    for m in [*marks, n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n:
            if m > last:
                out.append(m)
            last = m
    return out


def name_of(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=KEY).digest()


def leaf(row: int, doc_id: int | None, start: int, n: int, keys: bytes, sizes: bytes) -> bytes:
    return name_of(struct.pack("<qq?qqq", row, doc_id or 0, doc_id is None, start, n, len(keys)) + keys + sizes)


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves in order; an odd one out moves up unchanged."""
    level = leaves or [name_of(b"")]
    while len(level) > 1:
        level = [name_of(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32s as they count with n_bytes zero bytes after them, so that the
    CRC of a whole is the xor of its shifted parts' CRCs."""
    crc, left = crc.astype(np.uint32).copy(), n_bytes.astype(np.int64)
    # the operator of one zero bit: a shift, and the reflected polynomial
    rows = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)

    def applied(op: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for b in range(32):
            out ^= np.where(x >> np.uint32(b) & np.uint32(1), op[b], np.uint32(0))
        return out

    for _ in range(3):  # one zero byte
        rows = applied(rows, rows)
    while left.any():
        odd = (left & 1).astype(bool)
        if odd.any():
            crc[odd] = applied(rows, crc[odd])
        left >>= 1
        rows = applied(rows, rows)
    return crc


def encoded_texts(enc: Encoder, column: pa.Array) -> Iterator[bytes]:
    """The ids of each text, some texts at a time."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // GROUP
    at = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for a, b in zip(at, at[1:], strict=False):
        yield from enc.column(column.slice(a, b - a))
        pa.default_memory_pool().release_unused()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, kind: str = "bytes", width: int = 2) -> None:
    """Encode every whole text (null: empty), end_id appended, into a store.

    One pass encodes; its rows are written once, dealt so that chunks of one
    name meet: a task packs its new chunks by name range, and each range keeps
    one of each name. Copies of a document send names only. Rows of one doc_id
    stand in the order of their content's hash; null doc_ids come first. A very
    long text is encoded by its task in one piece. An empty table gives an
    empty store. Further columns are ignored. Tasks follow the bytes of text,
    so what one remembers of names stays bounded.
    """
    spark = prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(total, PART_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(kind, tokenizer), np.uint32(end_id).tobytes()
        sent: set[bytes] = set()
        packer = zstandard.ZstdCompressor(1)
        for batch in batches:
            fresh: dict[int, list[bytes]] = {}
            docs_out: list[tuple] = []
            for doc, own_ids in zip(batch.column(0).to_pylist(), encoded_texts(enc, batch.column(1)), strict=True):
                ids = np.frombuffer(own_ids + end, "<u4")
                small = ids.astype(f"<u{width}")
                if width < 4 and int(ids.max(initial=0)) >= 1 << 8 * width:
                    raise ValueError("an id doesn't fit the store's width")
                names, sizes, last = [], [], 0
                for at in cuts(ids):
                    own = small[last:at].tobytes()
                    name = name_of(own)
                    names.append(name)
                    sizes.append(at - last)
                    last = at
                    if name not in sent:
                        if len(sent) > SENT:
                            sent.clear()
                        sent.add(name)
                        fresh.setdefault(int.from_bytes(name[:4], "big") * 4 * n >> 32, []).append(name + struct.pack("<I", len(own)) + own)
                docs_out.append((doc, len(ids), b"".join(names), np.array(sizes, "<u4").tobytes()))
            rows = [("chunk", b, None, None, packer.compress(b"".join(own)), None) for b, own in fresh.items()]
            rows += [("doc", doc_range(doc, names, 4 * n), doc, size, names, sizes) for doc, size, names, sizes in docs_out]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["kind", "range", "doc_id", "n_tokens", "keys", "sizes"])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            chunks: list[tuple] = []
            is_doc = pa.compute.equal(batch.column("kind"), "doc")
            for blob in batch.filter(pa.compute.invert(is_doc)).column("keys").to_pylist():
                data, at = zstandard.ZstdDecompressor().decompress(blob), 0
                while at < len(data):
                    name, size = data[at : at + KEY], struct.unpack_from("<I", data, at + KEY)[0]
                    at += KEY + 4
                    if name not in seen:
                        seen.add(name)
                        chunks.append(("chunk", None, size // width, name, data[at : at + size]))
                    at += size
            own = batch.filter(is_doc)
            schema = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("data", pa.binary())])
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("kind", "doc_id", "n_tokens", "keys", "sizes")], schema=schema)
            if chunks:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunks, strict=True), schema.types, strict=True)], schema=schema)

    encoded = texts(docs).mapInArrow(encode, "kind string, range int, doc_id long, n_tokens long, keys binary, sizes binary")
    dealt = encoded.repartition(n, "range").mapInArrow(unique, "kind string, doc_id long, n long, keys binary, data binary")
    dealt.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/encoded")
    staged = spark.read.schema("doc_id long, n long, keys binary, data binary, kind string").parquet(f"{path}/encoded")
    recipes = staged.where("kind = 'doc'").select("doc_id", F.col("n").alias("n_tokens"), "keys", F.col("data").alias("sizes"))
    placed = running_start(recipes, [F.col("doc_id").asc_nulls_first(), F.col("keys")], "n_tokens", "recipes", row="row")
    ordered = placed.select("row", "doc_id", "start", "n_tokens", "keys", "sizes").repartitionByRange(n, "row").sortWithinPartitions("row")
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    leaves(spark, path).write.parquet(f"{path}/manifest/level=0")
    level = 0
    while level_of(spark, path, level).limit(2).count() > 1:
        level += 1
        above(level_of(spark, path, level - 1)).write.parquet(f"{path}/manifest/level={level}")


def doc_range(doc: int | None, names: bytes, n: int) -> int:
    return zlib.crc32(struct.pack("<q", doc or 0), zlib.crc32(names)) % n


RECIPE = "row long, doc_id long, start long, n_tokens long, keys binary, sizes binary"
NODE = "block long, n_docs long, n_tokens long, root string"


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """Level 0 of the manifest, of the recipes as they are now."""

    def rooted(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        own = [leaf(*r) for r in zip(*(table.column(c).to_pylist() for c in ("row", "doc_id", "start", "n_tokens", "keys", "sizes")), strict=True)]
        return pa.table({"block": table.column("_block").slice(0, 1), "n_docs": pa.array([len(own)], pa.int64()), "n_tokens": pa.array([pa.compute.sum(table.column("n_tokens")).as_py()], pa.int64()), "root": pa.array([merkle(own).hex()])})

    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    return recipes.withColumn("_block", F.floor(F.col("row") / FAN)).groupBy("_block").applyInArrow(rooted, NODE)


def above(nodes: DataFrame) -> DataFrame:
    """The level over these blocks."""

    def rooted(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        own = [name_of(struct.pack("<qqq", *r[:3]) + bytes.fromhex(r[3])) for r in zip(*(table.column(c).to_pylist() for c in ("block", "n_docs", "n_tokens", "root")), strict=True)]
        sums = {c: pa.array([pa.compute.sum(table.column(c)).as_py()], pa.int64()) for c in ("n_docs", "n_tokens")}
        return pa.table({"block": table.column("_block").slice(0, 1), **sums, "root": pa.array([merkle(own).hex()])})

    return nodes.withColumn("_block", F.floor(F.col("block") / FAN)).groupBy("_block").applyInArrow(rooted, NODE)


def level_of(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema(NODE).parquet(f"{path}/manifest/level={level}")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """key, ids of each stored chunk."""
    stored = spark.read.schema("doc_id long, n long, keys binary, data binary, kind string").parquet(f"{path}/encoded")
    return stored.where("kind = 'chunk'").select(F.col("keys").alias("key"), F.col("data").alias("ids"))


def uses(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, pos, key, size, after: each chunk of each
    document, and how many ids follow it there."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, start, n, keys, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(sizes, "<u4").astype(np.int64)
                if int(own.sum()) != n or len(keys) != KEY * len(own):
                    raise ValueError("a recipe's sizes don't sum to its document's")
                rows += [(doc, start, n, i, keys[i * KEY : (i + 1) * KEY], s, a) for i, (s, a) in enumerate(zip(own.tolist(), (n - np.cumsum(own)).tolist(), strict=True))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "start", "n_tokens", "pos", "key", "size", "after"])

    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    return recipes.select("doc_id", "start", "n_tokens", "keys", "sizes").mapInArrow(listed, "doc_id long, start long, n_tokens long, pos int, key binary, size long, after long")


def verify(spark: SparkSession, path: str) -> None:
    """Raise if the recipes, or a level of the manifest, aren't what the level
    above was made from."""
    level, now = 0, leaves(spark, path)
    while True:
        kept = level_of(spark, path, level)
        same = F.lit(True)
        for c in ("n_docs", "n_tokens", "root"):
            same = same & F.col(f"now.{c}").eqNullSafe(F.col(f"then.{c}"))
        if now.alias("now").join(kept.alias("then"), "block", "full_outer").where(~same).limit(1).count():
            raise ValueError("recipes differ from the manifest")
        if kept.limit(2).count() < 2:
            return
        level, now = level + 1, above(kept)


def digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    Every stored chunk is read, checked against its name and given a CRC; a
    document's CRC is put together from those of its chunks, so each stored
    byte is read once and never shuffled. A chunk that is missing, isn't what
    its name says or has another size than its recipe says raises an error.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name_of(own) != key:
                    raise ValueError("a chunk isn't what its name says")
                sizes.append(len(own) // width)
                crcs.append(zlib.crc32(np.frombuffer(own, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "crc", "stored"])

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = batch.column("crc")
            if crc.null_count:
                raise ValueError("a chunk is missing")
            if (batch.column("stored").to_numpy() != batch.column("size").to_numpy()).any():
                raise ValueError("a chunk's size isn't what its recipe says")
            moved = crc_shift(crc.to_numpy(), batch.column("after").to_numpy() * 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(moved.astype(np.int64))], names=["doc_id", "start", "n_tokens", "crc"])

    crcs = chunks(spark, path).mapInArrow(summed, "key binary, crc long, stored long")
    used = uses(spark, path).select("doc_id", "start", "n_tokens", "key", "size", "after").join(crcs, "key", "left")
    moved = used.select("doc_id", "start", "n_tokens", "crc", "stored", "size", "after").mapInArrow(shifted, "doc_id long, start long, n_tokens long, crc long")
    # `start` is unique to a document: each has an end id at least
    return moved.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))


def read(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, ids (array of int) of each document, put together."""
    got = uses(spark, path).join(chunks(spark, path), "key", "left")
    grouped = got.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("own"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in own), f"<u{width}").astype(np.int32) for own in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return grouped.mapInArrow(whole, "doc_id long, start long, ids array<int>")
