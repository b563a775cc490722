"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Covering masks (Pagh, "CoveringLSH: Locality-sensitive Hashing without False
Negatives", 2018): give each bit position a nonzero vector m of r + 1 bits. For
each nonzero vector v there is a table whose mask holds the positions with
<m, v> = 1. The vectors of any r differing positions are orthogonal to some v,
so two fingerprints at most r bits apart agree under that v's mask: every pair
within the radius collides in some of the 2^(r+1) - 1 tables, and each mask
still compares more than half of the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import attached, components, only, parts_for, prepare, texts, written

#: Shingles whose bits are counted at a time.
BLOCK = 255 << 4
#: Rows of a small bucket, whose pairs are compared side by side with those of others; members of a bucket's group up to which its pairs are given one by one.
FEW, PAIRED = 32, 6
#: Partners of a row beyond which it is tied to them by stars too.
MANY = 8
#: Rows of a bucket from which it is known as large, and as hot, and rows in which such ones are looked for.
KNOWN, HOT, LOOKED = 256, 4_096, 200_000
#: Bytes of bucket entries, and of shingles, that a task holds at a time.
RANGE_BYTES, CELL_BYTES = 32 << 20, 16 << 20


def masks(radius: int, low: int = 0, high: int = 64) -> list[int]:
    """The covering masks over the bits low to high - 1."""
    size = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(low, high) if ((i % size + 1) & v).bit_count() & 1) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits drawn from each hash; the first are the hash."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The hash of each shingle, repeats included; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]  # noqa: B905
    n = max(1, len(words) - shingle + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(42)), np.uint64, n)


def fingerprint(text: bytes, shingle: int, words64: int = 1, distinct: bool = False) -> list[int]:
    """Each bit is 1 if it is set in over half of the shingles' hashes, each
    counted once if `distinct`."""
    hashes = shingles(text, shingle)
    if distinct:
        hashes = np.unique(hashes)
    n = len(hashes)
    if not n:
        return [0] * words64
    ones = np.zeros(words64 * 64, np.int64)
    for at in range(0, n, BLOCK):
        some = np.stack([_mixed(hashes[at : at + BLOCK], k) for k in range(words64)], axis=1)
        bits = np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):  # as many as a byte counts
            ones += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8").tolist()


def fingerprints(docs: DataFrame, shingle: int, words64: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp: array of words64 longs) of every whole text. Null texts and
    texts without words have the fingerprint zero; a text of fewer words than a
    shingle counts as one shingle. Case: A to Z only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            fps = [[signed(x) for x in fingerprint(t.as_py(), shingle, words64, distinct)] for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fp"])

    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, fp array<long>")


def exact_links(classes: DataFrame, radius: int) -> DataFrame:
    """Edges (src, dst) that connect just what fingerprints at most `radius`
    (1 or 2) bits apart connect. classes: (fp long, rep), fp unique.

    Fingerprints that collide under no mask are done. Of those in one bucket,
    two are at most 2 bits apart just if they share a midpoint: one of them, or
    one with a bit outside the mask flipped. Any two that share a midpoint are
    within 2 bits, so each links with the midpoint's smallest: a bucket's rows
    grow by the bits outside the mask, and no pair within a bucket is made.
    """
    if radius not in (1, 2):
        raise ValueError("the radius is 1 or 2")
    each = masks(radius)
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(each)]
    keyed = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "k.t", "k.key")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = keyed.join(shared, ["t", "key"])
    outside = F.array(*[F.array(*[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in each])
    middles = F.concat(F.array("fp"), F.transform(F.get(outside, F.col("t")), lambda b: F.col("fp").bitwiseXOR(b)))
    points = met.select("rep", F.explode(middles).alias("point")).distinct()
    if radius == 1:  # one of the two is itself the point they share
        own = classes.select(F.col("fp").alias("point"), F.col("rep").alias("low"))
        return points.join(own, "point").where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")).distinct()
    low = points.groupBy("point").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    return points.join(low, "point").where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the smallest doc_id that a
    document reaches over links of fingerprints at most `radius` bits apart.

    Equal fingerprints form one class with one representative, so copies are
    never paired. Rows without a doc_id keep their fingerprint, take no part in
    links and have no component. Repeated rows each get a row. An empty table
    gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle).select("doc_id", F.col("fp")[0].alias("fp")), "fingerprints")
    classes = written(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = exact_links(classes, radius)
    found = components(links)
    named = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


#: What a bucket needs of a row: its key, its name and 96 bits of its fingerprint.
ENTRY = np.dtype([("key", "<u4"), ("tail", "<u4"), ("rep", "<i8"), ("head", "<u8")])


class Tables:
    """The keys of fingerprints. `subs` sub-fingerprints of `narrow` bits, from
    all bits in order and then from shuffled ones, each under its covering
    masks; a key is 32 bits of a hash of the table and the masked bits."""

    def __init__(self, words64: int, narrow: int, subs: int, radius: int):
        bits = words64 * 64
        each, rng = bits // narrow, np.random.default_rng(8)
        orders = [np.arange(bits), *(rng.permutation(bits) for _ in range(-(-subs // each) - 1))]
        self.places = np.stack([orders[s // each][s % each * narrow :][:narrow] for s in range(subs)])
        self.masks = np.array(masks(radius, 0, narrow), np.uint64)
        self.count = subs * len(self.masks)

    def keys(self, fp: np.ndarray) -> np.ndarray:
        """The keys of fingerprints (a row of words each): a row for each."""
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), fp.shape[1] * 8), axis=1, bitorder="little")
        low = np.zeros((len(fp), len(self.places)), np.uint64)
        for i in range(self.places.shape[1]):
            low |= bits[:, self.places[:, i]].astype(np.uint64) << np.uint64(i)
        masked = (low[:, :, None] & self.masks).reshape(len(fp), self.count)
        with np.errstate(over="ignore"):
            return (_mixed(masked + (np.arange(self.count, dtype=np.uint64) << np.uint64(40)), 1) >> np.uint64(32)).astype(np.uint32)


def _words(column: pa.Array) -> np.ndarray:
    """Arrays of longs of one length, as a row of words each."""
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def _slices(batch: pa.RecordBatch, rows: int = 2_048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names and fingerprints of a batch (rep, fp), some rows at a time, as
    each has an entry for every table."""
    for at in range(0, batch.num_rows, rows):
        own = batch.slice(at, rows)
        yield own.column(0).to_numpy(), _words(own.column(1))


def apart(head: np.ndarray, tail: np.ndarray, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Differing bits of the entries at a and b."""
    return np.bitwise_count(head[a] ^ head[b]).astype(np.int32) + np.bitwise_count(tail[a] ^ tail[b])


def spread(head: np.ndarray, tail: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The groups of rows that chains of entries at most `most` bits apart
    connect. Only rows not reached yet are compared, so many that are alike
    cost little more than one comparison each."""
    left = rows
    while len(left):
        group, todo, left = [left[0]], [left[0]], left[1:]
        while todo and len(left):
            near = apart(head, tail, left, todo.pop()) <= most
            if near.any():
                hit = left[near].tolist()
                group += hit
                todo += hit
                left = left[~near]
        if len(group) > 1:
            yield np.array(group)


def bucket_pairs(entries: np.ndarray, most: int, leader: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, dense) of rows in one bucket at most `most` bits apart: every
    pair, but for groups of over PAIRED members a star, marked dense, that
    connects them. Rows of one leader (a number each; -1: none) are connected
    already: no pair of them is given, and a star has one of them."""
    order = np.lexsort((entries["rep"], entries["key"]))  # a star's centre is its smallest row
    entries, leader = entries[order], np.full(len(order), -1, np.int32) if leader is None else leader[order]
    key, head, tail, rep = (np.ascontiguousarray(entries[c]) for c in ("key", "head", "tail", "rep"))
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    end, small = np.repeat(start + size, size), np.flatnonzero(np.repeat(size <= FEW, size))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = small
    for step in range(1, FEW):  # each with the step-th after it
        at = at[at + step < end[at]]
        near = at[apart(head, tail, at, at + step) <= most]
        a.append(near)
        b.append(near + step)
    a, b = np.concatenate(a), np.concatenate(b)
    number = np.repeat(np.arange(len(size)), size)
    many = np.bincount(number[a], minlength=len(size)) > PAIRED * (PAIRED - 1) // 2
    few = ~many[number[a]]
    pairs, stars = [np.stack([a[few], b[few]])], [np.empty((2, 0), np.int64)]
    for k in np.flatnonzero(many | (size > FEW)):
        for group in spread(head, tail, np.arange(start[k], start[k] + size[k]), most):
            if len(group) > PAIRED:
                led = leader[group]
                once = led < 0
                once[np.unique(led, return_index=True)[1]] = True
                group = group[once]
                stars.append(np.stack([group[1:], np.full(len(group) - 1, group[0])]))
            else:
                x, y = np.triu_indices(len(group), 1)
                near = apart(head, tail, group[x], group[y]) <= most
                pairs.append(np.stack([group[x[near]], group[y[near]]]))
    one, other = np.concatenate(pairs, axis=1), np.concatenate(stars, axis=1)
    one = one[:, (leader[one[0]] < 0) | (leader[one[0]] != leader[one[1]])]
    src, dst = rep[np.concatenate([one[0], other[0]])], rep[np.concatenate([one[1], other[1]])]
    dense = np.r_[np.zeros(one.shape[1], bool), np.ones(other.shape[1], bool)]
    found = np.unique(np.stack([np.maximum(src, dst), np.minimum(src, dst), dense]), axis=1)
    found = found[:, found[0] != found[1]]
    return found[0], found[1], found[2].astype(bool)


class Large:
    """Buckets of many rows by key, each with its smallest row and whether it
    is hot. Rows near the smallest row of some such bucket they are in have a
    leader: the least of these rows."""

    def __init__(self, found: pa.Table, hot: int):
        found = found.sort_by("key")
        self.key, self.rep, self.head, self.tail = (found[c].to_numpy().astype(t) for c, t in (("key", np.uint32), ("rep", np.int64), ("head", np.uint64), ("tail", np.uint32)))
        self.hot = found["n"].to_numpy() > hot
        self.leaders, self.number = np.unique(self.rep, return_inverse=True)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the large buckets, -1 for others."""
        if not len(self.key):
            return np.full(keys.shape, -1)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, at, -1)

    def led(self, places: np.ndarray, fp: np.ndarray, most: int) -> np.ndarray:
        """The number of each row's leader, -1 for none."""
        row, table = np.nonzero(places >= 0)
        at, (head, tail) = places[row, table], heads(fp)
        near = np.bitwise_count(head[row] ^ self.head[at]).astype(np.int32) + np.bitwise_count(tail[row] ^ self.tail[at]) <= most
        out = np.full(len(fp), len(self.leaders))
        np.minimum.at(out, row[near], self.number[at[near]])
        return np.where(out < len(self.leaders), out, -1).astype(np.int32)


def heads(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 96 bits of fingerprints that entries have."""
    return fp[:, 0], (fp[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def large_buckets(classes: DataFrame, n: int, tables: Tables) -> Large:
    """Buckets of more than about KNOWN rows; those of more than about HOT are
    hot. They are looked for in LOOKED rows by hash, counting a key that a
    batch holds twice; which are found changes what is compared where, not
    what is found."""
    share = min(1.0, LOOKED / max(n, 1))
    least, hot = (max(16, int(x * share)) for x in (min(KNOWN, HOT), HOT))
    kind = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("n", pa.int64())])
    if n <= min(KNOWN, HOT):
        return Large(kind.empty_table(), hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, fp in _slices(batch):
                order = np.argsort(rep)
                rep, fp = rep[order], fp[order]  # so the first of a key is its smallest row
                keys, at, count = np.unique(tables.keys(fp), return_index=True, return_counts=True)
                some = count > 1
                row, (head, tail) = at[some] // tables.count, heads(fp)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (keys[some], rep[row], head[row].view(np.int64), tail[row], count[some])], names=kind.names)

    some = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else classes
    keyed = some.select("rep", "fp").mapInArrow(run, "key long, rep long, head long, tail long, n long")
    summed = keyed.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("rep", "head", "tail")).alias("least"))
    # at most LOOKED * tables / 16 keys, and some hundreds in practice
    return Large(summed.where(F.col("n") > least).select("key", "least.rep", "least.head", "least.tail", "n").toArrow(), hot)


def meetings(classes: DataFrame, tables: Tables, most: int) -> DataFrame:
    """(src, dst, dense) of representatives that meet in a bucket of some table
    within `most` of the 96 bits compared, some of them more than once.
    classes: rep, fp.

    Entries travel packed, by ranges of keys, of which a task holds one at a
    time. A row with a leader is tied to it once, and not to others of that
    leader in any table: so a large group of near copies gives about a row for
    each member, not one for each member and table. A hot bucket isn't
    gathered: each of its rows is tied to one of them, which marks more rows as
    candidates, never fewer.
    """
    spark, n = prepare(classes.sparkSession), classes.count()
    large = large_buckets(classes, n, tables)
    ranges = max(parts_for(n * tables.count * ENTRY.itemsize, RANGE_BYTES), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def is_hot(places: np.ndarray) -> np.ndarray:
        return (places >= 0) & large.hot[places] if len(large.hot) else places >= 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, fp in _slices(batch):
                keys = tables.keys(fp)
                places = large.places(keys)
                led, keys = large.led(places, fp, most), keys.reshape(-1)
                cold = np.flatnonzero(~is_hot(places))
                part = ((keys[cold].astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cold, part = cold[order], part[order]
                row, entries, (head, tail) = cold // tables.count, np.empty(len(cold), ENTRY), heads(fp)
                entries["key"], entries["rep"], entries["head"], entries["tail"] = keys[cold], rep[row], head[row], tail[row]
                at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
                ends = list(zip(at.tolist(), [*at[1:].tolist(), len(part)], strict=True)) if len(at) else []
                blobs = [entries[a:b].tobytes() for a, b in ends]
                leaders = [own.tobytes() if own.max() >= 0 else None for own in (led[row[a:b]] for a, b in ends)]
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(blobs, pa.binary()), pa.array(leaders, pa.binary())], names=["part", "entries", "leaders"])

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, fp in _slices(batch):
                places = large.places(tables.keys(fp))
                led, (row, table) = large.led(places, fp, most), np.nonzero(is_hot(places))
                own = np.flatnonzero(led >= 0)
                both = np.stack([np.r_[rep[row], rep[own]], np.r_[large.rep[places[row, table]], large.leaders[led[own]]]])
                both = np.unique(both[:, both[0] != both[1]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both.max(axis=0)), pa.array(both.min(axis=0)), pa.array(np.ones(both.shape[1], bool))], names=["src", "dst", "dense"])

    def met(key: tuple, table: pa.Table) -> pa.Table:
        entries = [np.frombuffer(b.as_buffer(), ENTRY) for b in table["entries"]]
        leader = [np.frombuffer(b.as_buffer(), np.int32) if b.is_valid else np.full(len(own), -1, np.int32) for b, own in zip(table["leaders"], entries, strict=True)]
        src, dst, dense = bucket_pairs(np.concatenate(entries), most, np.concatenate(leader))
        return pa.table([pa.array(src), pa.array(dst), pa.array(dense)], names=["src", "dst", "dense"])

    rows, kind = classes.select("rep", "fp"), "src long, dst long, dense boolean"
    found = rows.mapInArrow(packed, "part long, entries binary, leaders binary").groupBy("part").applyInArrow(met, kind)
    return found.unionByName(rows.mapInArrow(tied, kind)) if len(large.key) else found


def candidates(classes: DataFrame, tables: Tables, most: int) -> DataFrame:
    """The (src, dst, dense) of meetings, each once, with one star for those of
    many tables. classes: rep, fp."""
    found = meetings(classes, tables, most)
    # a row's partners: at most some for each table
    own = found.groupBy("src").agg(F.collect_set(F.when(~F.col("dense"), F.col("dst"))).alias("pairs"), F.collect_set(F.when(F.col("dense"), F.col("dst"))).alias("centres"))
    many = F.size("pairs") > MANY
    own = own.select("src", F.when(many, F.array().cast("array<long>")).otherwise(F.array_except("pairs", "centres")).alias("pairs"), F.when(many, F.array_union("pairs", "centres")).otherwise(F.col("centres")).alias("centres"))
    own = written(own.withColumn("dst", F.array_min("centres")), "partners")
    # stars of many tables are made one: a row keeps its smallest centre, which its other centres are tied to
    ties = own.select(F.col("dst").alias("to"), F.explode("centres").alias("src")).where("src <> to").select("src", F.col("to").alias("dst"))
    stars = own.where("dst IS NOT NULL").select("src", "dst").unionByName(ties).distinct()
    return own.select("src", F.explode("pairs").alias("dst"), F.lit(False).alias("dense")).unionByName(stars.withColumn("dense", F.lit(True)))


def near_pairs(classes: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """The pairs found whose whole fingerprints are at most `most` bits apart,
    and all dense ones."""
    pairs = found.where(~F.col("dense")).select("src", "dst")
    both = pairs.join(classes.select(F.col("rep").alias("src"), F.col("fp").alias("a")), "src").join(classes.select(F.col("rep").alias("dst"), F.col("fp").alias("b")), "dst")
    bits = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.where(bits <= most).select("src", "dst").unionByName(found.where("dense").select("src", "dst"))


class Cell:
    """Rows with their fingerprints and sorted shingles, for exact similarities
    of one with many."""

    def __init__(self, fp: np.ndarray, sets: list[np.ndarray]):
        self.fp, self.sets = fp, sets
        self.size = np.array([len(x) for x in sets], np.int64)

    @cached_property
    def shared(self) -> np.ndarray | None:
        """A bit for each shingle that two rows or more have; None if these
        were too many bits."""
        values, column, count = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        width = (int((count > 1).sum()) + 63) // 64
        if width * 8 * len(self.sets) > 2 * CELL_BYTES:
            return None
        bits = np.zeros((len(self.sets), width), np.uint64)
        row, own = np.repeat(np.arange(len(self.sets)), self.size), (count > 1)[column]
        at = number[column[own]]
        np.bitwise_or.at(bits, (row[own], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        return bits

    def alike(self, i: int, others: np.ndarray, similarity: float, most: int) -> np.ndarray:
        """Those of the others whose Jaccard similarity with i is as asked."""
        n = self.size[others]
        fits = (np.minimum(n, self.size[i]) >= similarity * np.maximum(n, self.size[i]) - 1e-9) & (np.bitwise_count(self.fp[others] ^ self.fp[i]).sum(axis=1) <= most)
        others = others[fits]
        if not len(others):
            return others
        if self.shared is not None:
            common = np.bitwise_count(self.shared[others] & self.shared[i]).sum(axis=1, dtype=np.int64)
        else:
            common = np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in others])
        return others[common >= similarity * (self.size[others] + self.size[i] - common) - 1e-9]


def cell_links(group: np.ndarray, own: np.ndarray, cell: Cell, similarity: float, most: int) -> Iterator[tuple[int, int]]:
    """Positions of links that connect what similarity connects: pairs of which
    one row at least is the cell's own. Rows that are connected already, or by
    a link found here, aren't compared with each other."""
    label = np.unique(group, return_inverse=True)[1]
    for i in range(len(label)):
        after = np.arange(i + 1, len(label))
        after = after[(label[after] != label[i]) & (own[after] | own[i])]
        for j in cell.alike(i, after, similarity, most).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield i, j


def links_in_cells(rows: DataFrame, similarity: float, most: int) -> DataFrame:
    """The links (src, dst) found within cells. rows: cell, cluster, rep, grp,
    own, fp, shingles (bytes of sorted longs); clusters of one cell stay apart."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("rep", "ascending")])
        cluster, rep, grp = (table[c].to_numpy() for c in ("cluster", "rep", "grp"))
        own, fp = table["own"].to_numpy(), _words(table["fp"].combine_chunks())
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in table["shingles"]]
        at = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
        out = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(cluster)], strict=True):
            found = cell_links(grp[a:b], own[a:b], Cell(fp[a:b], sets[a:b]), similarity, most)
            out += [(int(rep[a + i]), int(rep[a + j])) for i, j in found]
        src, dst = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    prepare(rows.sparkSession)
    return rows.groupBy("cell").applyInArrow(run, "src long, dst long")


def members(docs: DataFrame, classes: DataFrame, clusters: DataFrame, shingle: int) -> DataFrame:
    """(cluster, rep, fp, shingles) of the rows of clusters (node, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t.as_py(), shingle)).view(np.int64).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    asked = clusters.select(F.col("node").alias("doc_id"))
    # counted first, so that texts aren't moved for few rows
    asked = F.broadcast(asked) if asked.count() <= 1_000_000 else asked
    sets = texts(docs).join(asked, "doc_id", "left_semi").mapInArrow(run, "rep long, shingles binary").groupBy("rep").agg(F.first("shingles").alias("shingles"))
    named = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    return named.join(classes.select("rep", "fp"), "rep").join(sets, "rep")


def resolved(rows: DataFrame, similarity: float, most: int) -> DataFrame:
    """(node, component) of what similarity connects within clusters. rows:
    cluster, rep, fp, shingles; a written table.

    Small clusters are cells, many to a task. A large one is cut into blocks by
    hash, and goes through three rounds: within blocks; among some rows of each
    block's largest group; and of rows outside a cluster's largest group with
    all blocks, where each pair of groups not connected yet is compared. So
    large groups of near copies are connected in linear time, and only groups
    that do not link cost their square in comparisons, none of which is written.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.octet_length("shingles") + 200
    sums = rows.groupBy("cluster").agg(F.ceil(F.sum(weight) / CELL_BYTES).cast("int").alias("blocks"))
    total = rows.agg(F.sum(weight)).first()[0]
    cells = max(parts_for(total, CELL_BYTES), 4 * partitions)
    placed = attached(rows, sums, ["cluster"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cell = lambda block: F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(cells))).otherwise(F.xxhash64("cluster", block))
    data = ["cluster", "rep", "grp", "own", "fp", "shingles"]
    first = placed.withColumn("grp", F.col("rep")).withColumn("own", F.lit(True)).select(cell(F.col("block")).alias("cell"), *data)
    links = written(links_in_cells(first, similarity, most), "links")
    large = placed.where("blocks > 1")
    if not sums.where("blocks > 1").limit(1).count():
        return components(links)

    def grouped() -> DataFrame:
        return large.join(components(links), F.col("rep") == F.col("node"), "left").withColumn("grp", F.coalesce("component", "rep")).drop("node", "component")

    now = written(grouped(), "grouped")
    sizes = now.groupBy("cluster", "block", "grp").agg(F.count("*").alias("n"), F.array_distinct(F.array(F.min("rep"), F.max("rep"))).alias("some"))
    chosen = sizes.groupBy("cluster", "block").agg(F.max_by("some", F.struct("n", -F.col("grp"))).alias("some")).select(F.explode("some").alias("rep"))
    among = now.join(chosen, "rep", "left_semi").withColumn("own", F.lit(True)).select(F.xxhash64("cluster", F.floor(F.col("block") / 512)).alias("cell"), *data)
    links = written(links.unionByName(links_in_cells(among, similarity, most)), "links")
    now = written(grouped(), "grouped")
    sizes = now.groupBy("cluster", "grp").agg(F.count("*").alias("n"))
    best = sizes.groupBy("cluster").agg(F.max_by("grp", F.struct("n", -F.col("grp"))).alias("main"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    rest = attached(now, best, ["cluster"]).where("main IS NOT NULL")
    every = F.when(F.col("grp") == F.col("main"), F.array("block")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread_out = rest.withColumn("_to", F.explode(every)).withColumn("own", F.col("_to") == F.col("block")).select(F.xxhash64("cluster", "_to").alias("cell"), *data)
    return components(links.unionByName(links_in_cells(spread_out, similarity, most)))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words64: int = 12, narrow: int = 30, subs: int = 40, radius: int = 1) -> DataFrame:
    """(doc_id, component_id) of documents whose sets of shingles are alike.

    For a Jaccard similarity of 0.8 a sixth of the bits differ, beyond what a
    covering of one 64-bit fingerprint can guarantee. So the fingerprint has
    words64 * 64 bits, of which `subs` sub-fingerprints of `narrow` bits are
    drawn, each with its own covering: documents meet where they are within
    `radius` bits in one of them or agree under a mask by luck.

    In a bucket all distinct fingerprints are compared by 96 bits: a pair goes
    on if these are at most four standard errors farther apart than asked, and
    if the whole fingerprints are too. What is left makes clusters, in which
    every pair is decided by exact Jaccard similarity, so no link is wrong, and
    a pair is missed only if it meets in no table. Groups of many near copies
    are tied by stars and never written as pairs.

    Null texts count as empty and empty texts are alike; texts count whole,
    very long ones too. Repeated rows of one doc_id go by the smallest of their
    groups. Rows without doc_id take no part. An empty table gives no rows.
    """
    # cosine of the shingle sets of two documents of equal size
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most = lambda n: int(n * share + 4 * np.sqrt(n * share * (1 - share)))
    fps = written(fingerprints(docs, shingle, words64, distinct=True).where("doc_id IS NOT NULL"), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = written(candidates(classes, Tables(words64, narrow, subs, radius), most(96)), "candidates")
    clusters = components(near_pairs(classes, found, most(words64 * 64)))
    groups = resolved(written(members(docs, classes, clusters, shingle), "members"), similarity, most(words64 * 64))
    named = classes.join(groups, classes["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
