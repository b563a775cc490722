"""Shards of bounded size by extendible hashing. DataFrame functions only.

The directory is indexed by the leading bits of a key's hash. It starts with
one bucket for everything; a bucket above the byte limit splits on its next
bit, others never do. So a document's shard is the shortest prefix of its hash
whose documents fit the limit. Sizes of all prefixes down to a depth are sums
over a small table of cells (the prefixes of that depth), so a table is read
once and not once for each split; only buckets that are still too large at that
depth are cut on further bits, in another round over their own rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import attached, running_start, written

#: Bits of the hash.
BITS = 60


def hash_bits(*columns: Column) -> Column:
    """60 bits of an MD5 of the columns."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shard(docs: DataFrame, limit: int, key: str = "doc_id", cells_each: int = 8) -> DataFrame:
    """doc_id, n_bytes, depth, prefix, shard and shard_bytes of each row.

    n_bytes is the text's UTF-8 length (null: 0). `prefix` is the first `depth`
    bits of the hash of `key` (null keys hash alike), `shard` writes them as
    text ("" for depth 0). Every shard has at most `limit` bytes, but for a
    single row that alone has more. Rows that no bit of the hash tells apart
    (one key on many rows) are cut by size, in ways of at most the limit, and
    `shard` ends in a point and the way. Repeated rows are rows of their own.
    An empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    rows = written(rows.withColumn("h", hash_bits(F.col("doc_id"))), "hashed")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    step = max(1, (cells_each * -(-int(total) // limit)).bit_length())
    done: list[DataFrame] = []
    base = 0
    while True:
        depth = min(BITS, base + step)
        cells = rows.groupBy(F.shiftright("h", BITS - depth).alias("cell")).agg(F.sum("n_bytes").cast("long").alias("n"), F.count("*").alias("k"))
        # sizes of every prefix of base to depth bits
        levels = cells.select("cell", "n", "k", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        sizes = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("shard_bytes"), F.sum("k").alias("k"))
        fits = sizes.where((F.col("shard_bytes") <= limit) | (F.col("k") == 1))
        leaf = levels.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        directory = written(leaf, "directory")
        # the directory's cells are of bounded size in the first round: 16 for each shard
        small = F.broadcast(directory) if directory.count() <= 200_000 else directory
        placed = rows.withColumn("cell", F.shiftright("h", BITS - depth)).join(small, "cell", "left")
        done.append(placed.where("leaf IS NOT NULL").select("doc_id", "n_bytes", "leaf.depth", "leaf.prefix", "leaf.shard_bytes", F.lit(None).cast("long").alias("way")))
        rest = placed.where("leaf IS NULL").select("doc_id", "n_bytes", "h")
        if depth >= BITS:
            # no bit of the key is left: equal keys, cut by size in a fixed order
            if rest.limit(1).count():
                done.append(equal_keys(rest, limit))
            break
        over = cells.join(directory, "cell", "left_anti").limit(1).count()
        if not over:
            break
        rows, base, step = written(rest, "hashed"), depth, max(step, 8)
    out = reduce(DataFrame.unionByName, done)
    text = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth").cast("int"), "0"))
    text = F.concat(text, F.coalesce(F.concat(F.lit("."), F.col("way").cast("string")), F.lit("")))
    return out.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", text.alias("shard"), "shard_bytes")


def equal_keys(rows: DataFrame, limit: int) -> DataFrame:
    """Rows whose hashes are equal, cut in order of size: a way holds the rows
    that begin in one half limit of the running sum over all of them, and rows
    of over half the limit, which could exceed it, get a way each. Sums run in
    ranges, so no key is gathered in one task."""
    half = max(1, limit // 2)
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "equal")
    summed = running_start(numbered, [F.col("h"), F.col("n_bytes"), F.col("_row")], "n_bytes", "equal-sums")
    way = F.when(F.col("n_bytes") <= half, 2 * F.floor(F.col("start") / F.lit(half))).otherwise(2 * F.col("_row") + 1).cast("long")
    cut = written(summed.select("doc_id", "n_bytes", "h", way.alias("way")), "ways")
    sizes = cut.groupBy("h", "way").agg(F.sum("n_bytes").alias("shard_bytes"))
    return attached(cut, sizes, ["h", "way"]).select("doc_id", "n_bytes", F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), "shard_bytes", "way")
