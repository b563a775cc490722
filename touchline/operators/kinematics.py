"""Player kinematics and team shape. Windows over tracks and one aggregation by
(sequence, frame, team): two independent shuffles, on the keys that later
operators use too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import exprs as X
from touchline.kernels.geometry import hull_area

TRACK = ("seq", "track_id")


def motion(rows: DataFrame, fps: float = 25.0) -> DataFrame:
    """Distance, speed and acceleration of each row from the one before it.

    A step counts only between adjacent frames; beyond 3 m it is an outlier and
    counts as no step. Speed is capped at 40 km/h, distance isn't. Acceleration
    compares with the row before, whatever that row's step, and is 0 unless
    this step counts.
    """
    w = Window.partitionBy(*TRACK).orderBy("frame_id")
    step = F.hypot(F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w))
    near = (F.col("frame_id") - F.lag("frame_id").over(w)) == 1
    out = rows.withColumn("_step", F.when(near, step))
    out = out.withColumn("outlier", F.coalesce(F.col("_step") > X.OUTLIER_M, F.lit(False))).withColumn("_counts", F.coalesce(F.col("_step") <= X.OUTLIER_M, F.lit(False)))
    out = out.withColumn("distance_m", F.when(F.col("_counts"), F.col("_step")).otherwise(0.0))
    out = out.withColumn("speed_kmh", F.least(F.col("distance_m") * fps * 3.6, F.lit(X.MAX_KMH)))
    gain = (F.col("speed_kmh") - F.lag("speed_kmh").over(w)) / 3.6 * fps
    return out.withColumn("accel_mps2", F.when(F.col("_counts"), gain).otherwise(0.0)).drop("_step", "_counts")


def sprints(moved: DataFrame) -> DataFrame:
    """Sprints: runs of at least 5 rows at 25.2 km/h or more, one row each."""
    w = Window.partitionBy(*TRACK).orderBy("frame_id")
    fast = F.col("speed_kmh") >= X.SPRINT_KMH
    run = F.sum(F.when(fast, 0).otherwise(1)).over(w)
    runs = moved.withColumn("_run", run).where(fast)
    return runs.groupBy(*TRACK, "_run").agg(F.min("frame_id").alias("first_frame"), F.count("*").alias("n_frames"), F.sum("distance_m").alias("distance_m")).where(F.col("n_frames") >= X.SPRINT_FRAMES).drop("_run")


def totals(moved: DataFrame, fps: float = 25.0) -> DataFrame:
    """Totals of each track. Runs and totals share the track's partitioning, so
    the join of sprints adds no shuffle."""
    w = Window.partitionBy(*TRACK).orderBy("frame_id")
    fast = F.col("speed_kmh") >= X.SPRINT_KMH
    rows = moved.withColumn("_run", F.sum(F.when(fast, 0).otherwise(1)).over(w)).withColumn("_fast", fast)
    per_run = rows.groupBy(*TRACK, "_run").agg(
        F.count_if("_fast").alias("n_fast"), F.sum(F.when(F.col("_fast"), F.col("distance_m")).otherwise(0.0)).alias("fast_m"),
        F.count("*").alias("n"), F.sum("distance_m").alias("distance_m"), F.max("speed_kmh").alias("top"), F.sum("speed_kmh").alias("speeds"),
        F.sum(F.when(F.col("speed_kmh") >= X.RUN_KMH, F.col("distance_m")).otherwise(0.0)).alias("high_m"),
        F.min(F.struct("frame_id", "team_id", "role")).alias("first"),
    )
    sprint = F.col("n_fast") >= X.SPRINT_FRAMES
    return per_run.groupBy(*TRACK).agg(
        F.min("first").alias("first"), F.round(F.sum("n") / fps / 60, 2).alias("minutes_visible"), F.round(F.sum("distance_m"), 2).alias("distance_m"),
        F.round(F.max("top"), 2).alias("max_speed_kmh"), F.round(F.sum("speeds") / F.sum("n"), 2).alias("mean_speed_kmh"),
        F.count_if(sprint).alias("sprint_count"), F.round(F.sum(F.when(sprint, F.col("fast_m")).otherwise(0.0)), 2).alias("sprint_distance_m"),
        F.round(F.sum("high_m"), 2).alias("high_speed_distance_m"),
    ).select(*TRACK, "first.team_id", "first.role", "minutes_visible", "distance_m", "max_speed_kmh", "mean_speed_kmh", "sprint_count", "sprint_distance_m", "high_speed_distance_m")


def team_shape(rows: DataFrame) -> DataFrame:
    """Centroid, extents and number of each team in each frame."""
    return rows.groupBy("seq", "frame_id", "team_id").agg(
        F.count("*").alias("n_players_visible"), F.avg("x_m").alias("centroid_x_m"), F.avg("y_m").alias("centroid_y_m"),
        (F.max("x_m") - F.min("x_m")).alias("height_m"), (F.max("y_m") - F.min("y_m")).alias("width_m"),
    )


def team_hull(rows: DataFrame) -> DataFrame:
    """team_shape with the convex hull's area and the compactness. A team's
    points in a frame travel as one array (they are few), and a batch of frames
    enters Python at once."""
    points = F.sort_array(F.collect_list(F.array("x_m", "y_m")))
    shape = rows.groupBy("seq", "frame_id", "team_id").agg(
        F.count("*").alias("n_players_visible"), F.avg("x_m").alias("centroid_x_m"), F.avg("y_m").alias("centroid_y_m"),
        (F.max("x_m") - F.min("x_m")).alias("height_m"), (F.max("y_m") - F.min("y_m")).alias("width_m"), points.alias("points"),
    )

    def areas(batches):
        for batch in batches:
            own = [hull_area(np.array(p)) for p in batch.column("points").to_pylist()]
            keep = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own, pa.float64())], names=[*keep, "convex_hull_area_m2"])

    out = shape.mapInArrow(areas, "seq long, frame_id long, team_id long, n_players_visible long, centroid_x_m double, centroid_y_m double, height_m double, width_m double, convex_hull_area_m2 double")
    box = F.col("height_m") * F.col("width_m")
    return out.withColumn("compactness", F.when(box > 0, F.col("convex_hull_area_m2") / F.when(box > 0, box)))


def farthest(summary: DataFrame, k: int = 5) -> DataFrame:
    """The k tracks of each sequence with the most distance."""
    w = Window.partitionBy("seq").orderBy(F.desc("distance_m"), "track_id")
    return summary.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
