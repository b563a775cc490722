"""Embedding near-duplicates by Euclidean p-stable hashing.

A table's key is `width` quantised random projections floor((a . v + b) / w) of
the normalised vector (Datar et al., "Locality-sensitive hashing scheme based
on p-stable distributions", 2004); a is Gaussian. Vectors that share a key in
some table are compared exactly, by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import components, prepare, written


@lru_cache(maxsize=8)
def projections(dim: int, tables: int, width: int, w: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Drawn once for each dimension and worker."""
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, tables * width)), rng.uniform(0, w, size=tables * width)


def valid(vector: str = "embedding") -> F.Column:
    """Vectors that can be compared: finite, without nulls, not zero."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return x.isNotNull() & fine & F.exists(x, lambda v: v != 0)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, tables: int = 20, width: int = 12, w: float = 1.5, block: int = 1024, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector.

    Vectors link if their labels are equal and not null and their cosine is at
    least `cosine`. At cosine 0.98 (distance 0.2) a pair shares a table's key
    with probability 0.26, so 20 tables find 99.7 % of such pairs and more of
    closer ones; unrelated vectors share one with probability 1e-5. Vectors
    that are null, zero or not finite, or have no label, link with nothing.

    Equal vectors form one class, compared once and counted with its number of
    rows. A bucket is cut into blocks of about `block` classes by hash; each two
    blocks are a cell. Cells come sorted, so a task holds a batch and one cell,
    and no bucket is gathered whole. A pair that shares several keys is counted
    in the first of them, and a cell returns counts and edges that connect what
    its links connect, fewer than it has classes, so pairs aren't written out.
    Rows with the same vec_id are different vectors; rows of null vec_id take
    part in counts and get no component. An empty table gives no rows. Further
    columns are ignored.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    # 0.0 and -0.0 are the same component
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    able = valid("v") & F.col("label").isNotNull()
    rows = written(rows.withColumn("class", F.when(able, F.sha2(F.concat_ws("|", "label", F.col("v").cast("string")), 256))), "vectors")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = []
            for v, label in zip(batch.column("v").to_pylist(), batch.column("label").to_pylist(), strict=True):
                x = np.asarray(v, float)
                x = x / np.abs(x).max()
                a, b = projections(len(x), tables, width, w, seed)
                cells = np.floor((x / np.linalg.norm(x) @ a + b) / w).astype(np.int64).reshape(tables, width)
                found.append([xxhash.xxh64_intdigest(f"{t}|{label}|".encode() + cells[t].tobytes()) >> 1 for t in range(tables)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    classes = written(classes.mapInArrow(keyed, "class string, rep long, n long, v array<double>, label string, keys array<long>"), "classes")
    pairs = classes.select("class", F.posexplode("keys").alias("t", "key"))
    shared = pairs.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    met = pairs.join(shared, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # a task for each two blocks i <= j of a bucket: block `own` stands in the tasks (own, j) and (i, own)
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = met.select("class", "t", "key", "own", F.explode(cells).alias("c")).select("class", "t", "key", "own", "c.i", "c.j")
    columns = ("key", "i", "j", "t", "own", "class", "rep", "n", "label", "v", "keys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a cell stand together; the last cell of a batch may go on in the next
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            cell = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            ends = np.append(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1, len(cell[0]))
            yield links_of(table.combine_chunks(), ends[:-1], cosine)
            kept = table.slice(int(ends[-2])) if len(ends) > 1 else table
        if kept is not None:
            yield links_of(kept.combine_chunks(), np.array([kept.num_rows]), cosine)

    ready = dealt.join(classes, "class").select(*columns)
    ordered = ready.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = written(ordered.mapInArrow(compare, "class string, links long, src long, dst long"), "links")
    links = found.where("class IS NOT NULL").groupBy("class").agg(F.sum("links").alias("links"))
    linked = components(found.where("src <> dst").select("src", "dst"))
    named = classes.select("class", "rep", "n").join(links, "class", "left").join(linked, F.col("rep") == F.col("node"), "left")
    named = named.select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "class").join(named, "class", "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def forest(met: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in a symmetric grid."""
    out: list[tuple[int, int]] = []
    left = np.flatnonzero(met.any(axis=1))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = met[node, left]
            if near.any():
                out += [(int(node), int(k)) for k in left[near]]
                queue.extend(left[near])
                left = left[~near]
    return out


def links_of(table: pa.Table, ends: np.ndarray, cosine: float) -> pa.RecordBatch:
    """What compared() finds in the cells that end at `ends`."""
    out: list[tuple] = []
    start = 0
    for end in ends.tolist():
        if end - start > 1:
            own = table.slice(start, end - start)
            out += compared(own, own.column("i")[0].as_py(), own.column("j")[0].as_py(), cosine)
        start = end
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 4, types, strict=True)], names=["class", "links", "src", "dst"])


def compared(table: pa.Table, i: int, j: int, cosine: float) -> list[tuple]:
    """Links of one cell, for the classes of blocks i and j: rows (class, rows
    it links with, null, null) and edges (null, 0, rep, rep) that connect the
    reps just as the links between them do."""
    lengths = pa.compute.list_value_length(table.column("v"))
    if len(lengths.unique()) > 1:
        parts = [table.filter(pa.compute.equal(lengths, n)) for n in lengths.unique()]
        return [r for part in parts if part.num_rows > 1 for r in compared(part, i, j, cosine)]
    own = table.column("own").to_numpy()
    left, right = (table, table) if i == j else (table.filter(pa.array(own == i)), table.filter(pa.array(own == j)))
    if not left.num_rows or not right.num_rows:
        return []

    def grid(side: pa.Table, column: str) -> np.ndarray:
        return side.column(column).combine_chunks().flatten().to_numpy().reshape(side.num_rows, -1)

    def unit(side: pa.Table) -> np.ndarray:
        v = grid(side, "v")
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    met = unit(left) @ unit(right).T >= cosine
    names = pa.chunked_array([c for side in (left, right) for c in side.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    met &= names[: left.num_rows, None] == names[None, left.num_rows :]
    if i == j:
        np.fill_diagonal(met, False)
    a, b = grid(left, "keys"), grid(right, "keys")
    for s in range(table.column("t")[0].as_py()):  # counted in an earlier table
        met &= a[:, s][:, None] != b[:, s][None, :]
    out: list[tuple] = []
    for here, there, links in ((left, right, met), *(() if i == j else ((right, left, met.T),))):
        counts = links @ there.column("n").to_numpy()
        at = np.flatnonzero(counts)
        out += [(name, count, None, None) for name, count in zip(here.column("class").take(pa.array(at)).to_pylist(), counts[at].tolist(), strict=True)]
    if i != j:
        empty = [np.zeros((n, n), bool) for n in met.shape]
        met = np.block([[empty[0], met], [met.T, empty[1]]])
    reps = left.column("rep").to_pylist() + ([] if i == j else right.column("rep").to_pylist())
    known = np.array([r is not None for r in reps])
    named = [r for r in reps if r is not None]
    return out + [(None, 0, named[a], named[b]) for a, b in forest(met[np.ix_(known, known)])]
