"""Running sums in an order that spans the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.sources.scratch import scratch_path


def running(rows: DataFrame, keys: list[str], order: list[Column], **sums: str) -> DataFrame:
    """rows with the sums (name = column) over all rows of the same keys up to
    and including each, in `order`, which tells rows apart.

    A window over a key with most of the rows would be one task. Here ranges of
    (keys, order) are tasks, each summed on its own; keys that go on from range
    to range get the sums of their earlier ranges, a few rows for each range.
    The ranged table is written first, as ranges are sampled and may differ on
    a rerun.
    """
    spark, n = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "running")
    rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    totals = ranged.groupBy("_range", *keys).agg(*[F.sum(c).alias(f"_{k}_total") for k, c in sums.items()])
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    split = totals.withColumn("_ranges", F.count("*").over(of_key)).where("_ranges > 1")
    bases = split.select("_range", *keys, *[F.sum(f"_{k}_total").over(earlier).alias(f"_{k}_base") for k in sums])
    upto = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({k: F.sum(c).over(upto) for k, c in sums.items()})
    # at most two rows for each range, and one more for each range that a key covers
    both = own.join(F.broadcast(bases), ["_range", *keys], "left")
    return both.withColumns({k: F.col(k) + F.coalesce(f"_{k}_base", F.lit(0)) for k in sums}).drop("_range", *[f"_{k}_base" for k in sums])
