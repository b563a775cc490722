"""Merkle manifests of a table: a tree for each group of rows, one over the groups.

Rows are ordered and dealt into ranges, and every row knows its position among
those of its group. A range is read as a mountain range: a stack holds, for
each level, the nodes that wait for their siblings. When the last of a run of
`FANOUT` positions arrives, the run is hashed and the carry moves one level up,
like a carry of a number in base FANOUT. Runs that begin or end in another
range stay as peaks. Peaks of neighbouring ranges meet in blocks of the tree
that are aligned for all of them, and rounds of such blocks end at the roots.
The last run of a level may be short and is hashed as it is, without padding.

The way back carries paths: a root's is empty, a block hands its peaks' paths
down to the nodes it was made of, and a range ends them at its rows. So a
range sees its own nodes and a path for each of its few peaks, however large
the tree is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import parts_for, prepare, written, written_at

#: Children of a node.
FANOUT = 3
#: Rows of a range, at about 100 bytes each: at most, and at least where there are fewer than four ranges a shuffle partition.
ROWS, LEAST_ROWS = 100_000, 1_000
#: Levels that a round of blocks goes up beyond the ranges, and each later round beyond the one before it.
RISE, MORE_RISE = 4, 6
#: Fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

INNER, PEAK, ROOT = 0, 1, 2


def joined(hashes: Iterable[bytes]) -> bytes:
    """The hash of digests, concatenated as hex text."""
    return hashlib.sha256("".join(h.hex() for h in hashes).encode()).digest()


def levels(n: int) -> list[int]:
    """The number of nodes of each level over n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def climbed(n: int, given: Iterable[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes, int]]:
    """(level, index, hash, kind) of what follows from neighbouring nodes
    (level, index, hash) of a tree of n leaves, in the order of their leaves:
    nodes made of them, and peaks whose siblings aren't all here."""
    count = levels(n)
    waiting: list[list[tuple[int, bytes, bool]]] = [[] for _ in count]

    def left(level: int) -> Iterator[tuple[int, int, bytes, int]]:
        yield from ((level, i, h, PEAK) for i, h, _ in waiting[level])
        waiting[level].clear()

    for level, index, own in given:
        here = False
        while True:
            if count[level] == 1:
                yield level, index, own, ROOT
                break
            run = waiting[level]
            first = index - index % FANOUT
            if run and run[0][0] < first:
                yield from left(level)
            run.append((index, own, here))
            end = min(first + FANOUT, count[level])
            if index + 1 < end:
                break
            if len(run) < end - first:
                yield from left(level)
                break
            own = joined(h for _, h, _ in run)
            yield from ((level, i, h, INNER) for i, h, made in run if made)
            run.clear()
            level, index, here = level + 1, index // FANOUT, True
    for level in range(len(count)):
        yield from left(level)


class Paths:
    """Paths from nodes of a tree of n leaves, some of which are here (level,
    index -> hash), by way of peaks whose paths are known. A path is the
    siblings to the left and right of each level, as hex text."""

    def __init__(self, n: int, nodes: dict[tuple[int, int], bytes], peaks: dict[tuple[int, int], tuple[tuple[str, str], ...]]):
        self.count, self.nodes, self.known = levels(n), nodes, dict(peaks)

    def of(self, level: int, index: int) -> tuple[tuple[str, str], ...]:
        up = (level + 1, index // FANOUT)
        if (level, index) in self.known:
            return self.known[level, index]
        if up not in self.nodes:
            return ()
        if up not in self.known:
            self.known[up] = self.of(*up)
        return (self.siblings(level, index), *self.known[up])

    def siblings(self, level: int, index: int) -> tuple[str, str]:
        first = index - index % FANOUT
        end = min(first + FANOUT, self.count[level])
        text = [self.nodes[level, i].hex() for i in range(first, end) if i != index]
        return "".join(text[: index - first]), "".join(text[index - first :])


def folded(own: bytes, path: Iterable[tuple[str, str]]) -> bytes:
    """The root that a leaf's hash gives with the siblings of its path."""
    for left, right in path:
        own = hashlib.sha256(f"{left}{own.hex()}{right}".encode()).digest()
    return own


NODE = "grp string, n long, level int, idx long, hash binary, kind int"
PATH = "grp string, level int, idx long, lefts array<string>, rights array<string>"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    fields = [tuple(x.strip().split(" ")) for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _runs(table: pa.Table) -> Iterator[tuple[str | None, pa.Table]]:
    """Neighbouring rows of one group, of a table in order."""
    codes = table["grp"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    bounds = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True]) if len(codes) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        run = table.slice(a, b - a)
        yield run["grp"][0].as_py(), run


@dataclass
class Forest:
    """The trees of a table's groups. leaves: grp, at (part and place), part,
    hash and the caller's columns; runs: the rows of a group in a part; nodes:
    those made of a part's rows; rounds: what each round of blocks was given
    (`given`) and made; roots: grp, n, hash."""

    leaves: DataFrame
    runs: DataFrame
    nodes: DataFrame
    rounds: list[tuple[DataFrame, DataFrame]]
    roots: DataFrame


def forest(rows: DataFrame, order: list[str], name: str) -> Forest:
    """The trees over rows (grp, hash, ...): a group's leaves in `order`, nulls
    first. rows must be a written table, as it is counted and sampled."""
    spark = prepare(rows.sparkSession)
    n = rows.count()
    parts = max(parts_for(n, ROWS), min(parts_for(n, LEAST_ROWS), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # equal rows are told apart, so that many of them are many ranges
    keys = ["grp", *order, "hash", "_tie"]
    ranged = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    leaves = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), f"{name}-leaves")
    counts = leaves.groupBy("part", "grp").agg(F.count("*").alias("here"))
    # a row for each group and part: a group's are as many as it has parts
    of_group = Window.partitionBy("grp")
    earlier = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(counts.select("part", "grp", "here", F.coalesce(F.sum("here").over(earlier), F.lit(0)).cast("long").alias("first"), F.sum("here").over(of_group).cast("long").alias("n"), F.count("*").over(of_group).alias("spans")), f"{name}-runs")

    def ranges(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
        places = {r["grp"]: (r["first"], r["n"]) for r in known.to_pylist()}
        out = []
        for grp, run in _runs(own.sort_by("at")):
            first, n = places[grp]
            out += [(grp, n, *x, key[0].as_py()) for x in climbed(n, ((0, first + i, h) for i, h in enumerate(run["hash"].to_pylist())))]
        return _table(NODE + ", origin long", out)

    placed = leaves.select("part", "grp", "at", "hash").groupBy("part").cogroup(runs.select("part", "grp", "first", "n").groupBy("part"))
    nodes = written(placed.applyInArrow(ranges, NODE + ", origin long"), f"{name}-nodes")
    most = runs.agg(F.max("here"), F.max("n"), F.max("spans")).first()
    rounds, last, roots = [], nodes, nodes.where(F.col("kind") == ROOT)
    height = len(levels(most[0] or 0)) + RISE
    while (most[2] or 0) > 1:
        block = F.expr(f"idx div cast(power({FANOUT}, {height} - level) as long)")
        given = last.where(F.col("kind") == PEAK).withColumn("block", block)

        def blocks(key: tuple, own: pa.Table) -> pa.Table:
            rows = sorted(own.to_pylist(), key=lambda r: r["idx"] * FANOUT ** r["level"])
            n = rows[0]["n"]
            made = climbed(n, ((r["level"], r["idx"], r["hash"]) for r in rows))
            return _table(NODE + ", origin long", [(key[0].as_py(), n, *x, key[1].as_py()) for x in made])

        last = written(given.groupBy("grp", "block").applyInArrow(blocks, NODE + ", origin long"), f"{name}-blocks")
        rounds.append((given, last))
        roots = roots.unionByName(last.where(F.col("kind") == ROOT))
        if FANOUT**height >= most[1]:
            break
        height += MORE_RISE
    return Forest(leaves, runs, nodes, rounds, roots.select("grp", "n", "hash"))


def peak_paths(trees: Forest) -> DataFrame:
    """(part, grp, level, idx, lefts, rights): the paths of the peaks of each
    part, from the last round of blocks down to the first."""
    spark = trees.leaves.sparkSession
    above = spark.createDataFrame([], PATH + ", origin long")
    for given, made in reversed(trees.rounds):
        both = given.select("grp", "n", "level", "idx", "hash", "block", "origin").unionByName(made.select("grp", "n", "level", "idx", "hash", F.col("origin").alias("block"), F.lit(None).cast("long").alias("origin")))

        def down(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
            rows = own.to_pylist()
            if not rows:
                return _table(PATH + ", origin long", [])
            nodes = {(r["level"], r["idx"]): r["hash"] for r in rows}
            peaks = {(r["level"], r["idx"]): tuple(zip(r["lefts"], r["rights"], strict=True)) for r in known.to_pylist()}
            paths, out = Paths(rows[0]["n"], nodes, peaks), []
            for r in rows:
                if r["origin"] is not None:
                    path = paths.of(r["level"], r["idx"])
                    out.append((r["grp"], r["level"], r["idx"], [x for x, _ in path], [x for _, x in path], r["origin"]))
            return _table(PATH + ", origin long", out)

        above = both.groupBy("grp", "block").cogroup(above.groupBy("grp", "origin")).applyInArrow(down, PATH + ", origin long")
    return above.withColumnRenamed("origin", "part")


def at_leaves(trees: Forest, tails: DataFrame, schema: str, each: Callable[[pa.Table, list[tuple[tuple[str, str], ...]], dict], list[tuple]]) -> DataFrame:
    """What `each` makes of a group's rows in a part, of their paths up to the
    group's root and of what `tails` (grp, and columns at will) holds for the
    group: a row of `schema` for each."""
    tail = tails.withColumnRenamed("grp", "_grp")
    runs = trees.runs.join(tail, F.col("grp").eqNullSafe(F.col("_grp"))).select("part", "grp", "first", "n", F.struct(*[c for c in tails.columns if c != "grp"]).alias("tail"))
    known = (
        runs.unionByName(trees.nodes.select(F.col("origin").alias("part"), "grp", "level", "idx", "hash"), allowMissingColumns=True)
        .unionByName(peak_paths(trees), allowMissingColumns=True)
    )

    def ends(key: tuple, own: pa.Table, others: pa.Table) -> pa.Table:
        places, nodes, peaks, out = {}, {}, {}, []
        for r in others.to_pylist():
            if r["level"] is None:
                places[r["grp"]] = r
            elif r["lefts"] is None:
                nodes.setdefault(r["grp"], {})[r["level"], r["idx"]] = r["hash"]
            else:
                peaks.setdefault(r["grp"], {})[r["level"], r["idx"]] = tuple(zip(r["lefts"], r["rights"], strict=True))
        for grp, run in _runs(own.sort_by("at")):
            r = places[grp]
            here = nodes.get(grp, {}) | {(0, r["first"] + i): h for i, h in enumerate(run["hash"].to_pylist())}
            paths = Paths(r["n"], here, peaks.get(grp, {}))
            out += each(run, [paths.of(0, r["first"] + i) for i in range(run.num_rows)], r["tail"])
        return _table(schema, out)

    return trees.leaves.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(ends, schema)


def leaf_hash(fields: list[Column]) -> Column:
    """Each field as its UTF-8 byte count, a colon and the value, `-` if null."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


@dataclass
class Manifest:
    """Trees of the sources' documents and the tree of their subroots."""

    documents: Forest
    sources: Forest

    @property
    def root(self) -> bytes | None:
        found = self.sources.roots.first()
        return found and bytes(found["hash"])

    def write(self, path: str) -> None:
        """The manifest as files: leaves, nodes of all levels, subroots, root."""
        for folder, trees in (("documents", self.documents), ("sources", self.sources)):
            kept = ("grp", "level", "idx", "hash")
            nodes = trees.nodes.where("level > 0").select(*kept)
            for _, made in trees.rounds:
                nodes = nodes.unionByName(made.select(*kept))
            written_at(trees.leaves.drop("part"), f"{path}/{folder}/leaves")
            written_at(nodes.distinct(), f"{path}/{folder}/nodes")
            written_at(trees.roots, f"{path}/{folder}/roots")


def manifest(docs: DataFrame, text_now: Column | None = None) -> Manifest:
    """The Merkle manifest of documents: a leaf for each row, a tree for each
    source with its leaves in order of doc_id, and a tree of the sources'
    subroots, null first and then by bytes.

    A leaf is the hash of doc_id, source, lang, n_chars and text, null or not.
    Texts are hashed whole where they are read and aren't moved. Rows of one
    doc_id stand in order of their leaves, rows without doc_id first; equal
    rows are leaves each. A single leaf is its subroot, a single subroot the
    root. An empty table has no root. Further columns are ignored, whatever
    their names. `text_now` is another version of the text, whose leaf is kept
    as `now` for proofs to test; null where it is the same.
    """
    fields = [F.col(f) for f in FIELDS]
    now = F.when(text_now.isNotNull(), leaf_hash([*fields[:-1], text_now])) if text_now is not None else F.lit(None).cast("binary")
    rows = written(docs.select(F.col("source").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(fields).alias("hash"), now.alias("now")), "leaves")
    documents = forest(rows, ["doc_id"], "documents")
    # subroots are few: a row for each source
    subroots = written(documents.roots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "hash"), "subroots")
    return Manifest(documents, forest(subroots, ["source"], "sources"))


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(found: Manifest) -> DataFrame:
    """For each document its leaf, subroot and root, the hash of its proof (all
    siblings on the way to the root, level by level), the root that the leaf
    of its text as it is now gives with that proof, and whether that is the
    root. An empty table gives no rows."""
    root = found.root
    if root is None:
        return found.documents.leaves.sparkSession.createDataFrame([], PROOF)
    one = found.sources.leaves.sparkSession.createDataFrame([("",)], "grp string")

    def subroot_paths(run: pa.Table, paths: list, _: dict) -> list[tuple]:
        return [(s, h, [x for x, _ in p], [x for _, x in p]) for s, h, p in zip(run["source"].to_pylist(), run["hash"].to_pylist(), paths, strict=True)]

    tails = written(at_leaves(found.sources, one.withColumn("none", F.lit(0)), "grp string, subroot binary, lefts array<string>, rights array<string>", subroot_paths), "tails")

    def document_proofs(run: pa.Table, paths: list, tail: dict) -> list[tuple]:
        end = tuple(zip(tail["lefts"], tail["rights"], strict=True))
        rest = "".join(x + y for x, y in end)
        out = []
        for doc, own, now, path in zip(run["doc_id"].to_pylist(), run["hash"].to_pylist(), run["now"].to_pylist(), paths, strict=True):
            proof = hashlib.sha256(("".join([x + y for x, y in path]) + rest).encode()).hexdigest()
            got = folded(folded(now or own, path), end)
            out.append((doc, own.hex(), tail["subroot"].hex(), root.hex(), proof, got.hex(), got == root))
        return out

    made = at_leaves(found.documents, tails, PROOF.replace("verified boolean", "verified int"), lambda run, paths, tail: [(*r[:-1], int(r[-1])) for r in document_proofs(run, paths, tail)])
    return made.withColumn("verified", F.col("verified") == 1)
