"""What the operators of this subpackage share: the written tables that cut
lineage, the division of documents into parts, connected components, and
global running sums.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of characters other than these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

#: The memo of this Python worker's last task, if it had one.
_held: list[dict] = []

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def only(memo: dict | None = None) -> None:
    """Called where a task begins: of all memos its Python worker may hold this
    one. Workers live on from stage to stage, and what another operator's tasks
    remembered goes, with the memory that was freed since."""
    if memo is not None and any(m is memo for m in _held):
        return
    for other in _held:
        other.clear()
    _held[:] = [] if memo is None else [memo]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. spark.checkpoint.dir names it on a
    cluster; where it is unset and all runs in one process (tests), one is made
    and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="touchline-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone when the program ends
        pass


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/touchline/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a
    lost executor costs only the tasks it ran."""
    return written_at(df, table_path(df.sparkSession, name), partition_by)


def written_at(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    spark, schema = df.sparkSession, df.schema
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    for f in schema:
        f.nullable = True
    return spark.read.schema(schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), with the further columns asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def parts_for(total: int, each: int) -> int:
    return max(1, -(-int(total or 0) // each))


def running_start(df: DataFrame, order: list[Column], value: str, name: str, row: str | None = None) -> DataFrame:
    """df with `start`: the sum of `value` over all rows before it in `order`,
    and with their number, if `row` names a column for it.

    Ranges of rows go to tasks (repartitionByRange) and each is summed on its
    own; what is gathered is one total for each range. The ranged table is
    written first, as a range's bounds are sampled and may differ on a rerun.
    Adds `part` (the range) too.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"start": F.sum(value), **({row: F.count("*")} if row else {})}
    totals = ranged.groupBy("part").agg(*[s.alias(f"_{c}_total") for c, s in sums.items()])
    bases = totals.select("part", *[F.coalesce(F.sum(f"_{c}_total").over(before), F.lit(0)).cast("long").alias(f"_{c}_base") for c in sums])
    summed = ranged.withColumns({f"_{c}": F.coalesce(s.over(within), F.lit(0)).cast("long") for c, s in sums.items()})
    # one row for each range: its number is the shuffle's partition count
    placed = summed.join(F.broadcast(bases), "part").withColumns({c: F.col(f"_{c}_base") + F.col(f"_{c}") for c in sums})
    return placed.drop(*[f"_{c}{end}" for c in sums for end in ("", "_base")])


def attached(rows: DataFrame, sums: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """rows with the other columns of sums (a row for each value of the keys),
    nulls equal. Up to `most` rows are broadcast, so a hot key is no hot task."""
    own = sums.select(*[F.col(c).alias(f"_{c}_own") for c in keys], *[c for c in sums.columns if c not in keys])
    own = F.broadcast(own) if sums.count() <= most else own
    return rows.join(own, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}_own")) for c in keys]), "left").drop(*[f"_{c}_own" for c in keys])


#: Edges of a node beyond which its rows are joined by broadcast.
LEAST_HUB = 1_000


def _hubs(low: DataFrame, most: int) -> tuple[DataFrame | None, bool]:
    """The nodes with so many edges that the rows that join them are a task of
    their own, as a table of at most `most` rows to broadcast (None without),
    and whether edges are stars: no node has an edge besides that to a smaller
    one."""
    steps = [LEAST_HUB * 10**k for k in range(7)]
    *found, more = low.agg(*[F.count_if(F.col("n") > s) for s in steps], F.count_if((F.col("m") < F.col("a")) & (F.col("n") > 1))).first()
    at = next(i for i, n in enumerate([*found, 0]) if n <= most)
    return low.where(F.col("n") > steps[at]).select("a") if at < len(steps) and found[at] else None, not more


def _with_low(rows: DataFrame, low: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """rows (a, ...) with the minimum m of a. Rows of hubs meet a broadcast
    table where they are; the others are shuffled."""
    if hubs is None:
        return rows.join(low, "a")
    near = F.broadcast(low.join(F.broadcast(hubs), "a", "left_semi"))
    return rows.join(near, "a").unionByName(rows.join(F.broadcast(hubs), "a", "left_anti").join(low, "a"))


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60, most_hubs: int = 200_000) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the
    undirected edges (src, dst).

    Alternating large-star and small-star rounds (Kiveris et al., "Connected
    components in MapReduce and beyond", 2014): every round points nodes at the
    smallest neighbour known, so the number of rounds follows the logarithm of
    a component's diameter. Minima are found with map-side combining; nodes of
    over a thousand edges are joined with theirs by a broadcast of such nodes
    (counted first), so a node with many neighbours is never gathered in one
    place. A round writes its minima and both its stars, so that no query holds
    the plan of another; it ends where all edges are stars. Only the last
    round's table is kept. Nodes without an edge to another node are absent.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = table_path(spark, name)
        return written_at(df, path), path

    pairs, path = stored(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct())
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, low_path = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")))
        hubs, stars = _hubs(low, most_hubs)
        if stars:
            removed(spark, low_path)
            break
        # large star: neighbours above a node point to its minimum
        large, large_path = stored(_with_low(both.where("b > a"), low.select("a", "m"), hubs).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: neighbours below a node, and the node, point to the minimum; a node has no more of them than edges before
        small = _with_low(large, least, hubs).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        done = [path, low_path, large_path]
        pairs, path = stored(small.where("a <> b").distinct())
        for old in done:
            removed(spark, old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b"), F.col("b")).distinct())
