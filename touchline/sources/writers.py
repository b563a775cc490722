"""Sinks. Shapers give the rows of a format; write_* functions store them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_csv(df: DataFrame, path: str) -> None:
    """A report: header, nulls as empty text."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def cached(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path: written there unless it is there already."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def mot_lines(rows: DataFrame) -> DataFrame:
    """MOTChallenge lines with two decimals, in frame and track order."""
    n = lambda c: F.printf(F.lit("%.2f"), F.col(c).cast("double"))
    line = F.concat_ws(",", F.col("frame_id").cast("string"), F.col("track_id").cast("string"), n("x"), n("y"), n("w"), n("h"), F.lit("1"), F.lit("-1"), F.lit("-1"), F.lit("-1"))
    return rows.select("seq", "frame_id", "track_id", line.alias("line"))


def write_mot(rows: DataFrame, path: str) -> None:
    """One folder for each sequence, each in one sorted file."""
    out = mot_lines(rows).repartition("seq").sortWithinPartitions("seq", "frame_id", "track_id")
    out.select("seq", F.col("line").alias("value")).write.mode("overwrite").partitionBy("seq").text(path)


def yolo_lines(rows: DataFrame, cls: Column, decimals: int = 6) -> DataFrame:
    """The label text of each frame: its lines in track order."""
    n = lambda c: F.printf(F.lit(f"%.{decimals}f"), F.col(c))
    line = F.concat_ws(" ", cls.cast("string"), n("cx"), n("cy"), n("nw"), n("nh"), F.col("track_id").cast("string"))
    own = rows.select("seq", "frame_id", F.struct("track_id", line.alias("line")).alias("r"))
    listed = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"])
    return own.groupBy("seq", "frame_id").agg(F.concat_ws("\n", listed).alias("text"))


def coco(rows: DataFrame) -> DataFrame:
    """Annotations with image and annotation numbers from 0. Numbers are given
    within a sequence, so that no window spans the table."""
    images = Window.partitionBy("seq").orderBy("frame_id")
    order = Window.partitionBy("seq").orderBy("frame_id", "track_id")
    return rows.select(
        "seq", (F.dense_rank().over(images) - 1).cast("long").alias("image_id"), (F.row_number().over(order) - 1).cast("long").alias("id"),
        F.col("cls").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"),
    )


def document(summary: DataFrame, shape: DataFrame) -> DataFrame:
    """A dashboard document for each sequence, as JSON text."""
    players = summary.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("track_id", "team_id", "distance_m", "max_speed_kmh"))).alias("players"))
    frames = shape.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("frame_id", "team_id", "n_players_visible"))).alias("shape"))
    return players.join(frames, "seq", "left").select("seq", F.to_json(F.struct("players", "shape")).alias("document"))


def flattened(df: DataFrame) -> DataFrame:
    """List columns replaced by their sizes."""
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    return df.select(*[c for c in df.columns if c not in lists], *[F.size(c).alias(f"n_{c}") for c in lists])


def yaml_lines(values: dict[str, float]) -> str:
    return "".join(f"{k}: {v}\n" for k, v in sorted(values.items()))
