"""The logical views that queries run on, derived from the driver's tables.

The expressions of a view are one text, run by Spark through selectExpr and by
an oracle as SQL. Views keep the table's distribution: each is a projection or
a window over users, so none adds a shuffle beyond its own key. A sequence is
22 users, a track of theirs each: frames keep their size, and sequences grow
with the table. Vectors make tracks of 40 frames, ten to a sequence.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERED = (
    "CAST(floor(user_id / 22) AS BIGINT) AS seq",
    "user_id AS track_id",
    "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame_id",
    "(user_id * 37 % 105) + (event_id % 17) * CAST(0.05 AS DOUBLE) AS x_m",
    "(user_id * 53 % 68) + (event_id % 13) * CAST(0.05 AS DOUBLE) AS y_m",
    "user_id % 2 AS team_id",
    "CASE user_id % 25 WHEN 0 THEN 'goalkeeper' WHEN 1 THEN 'referee' ELSE 'player' END AS role",
    "event_type",
    "event_id",
    "value",
)
TRACK = ("seq", "track_id", "frame_id", "'player' AS entity_type", "team_id", "role", "x_m", "y_m", "event_type <> 'signup' AS visible", "event_id", "value")
GT = ("seq", "track_id", "frame_id", "x_m + ((event_id % 7) - 3) * CAST(0.1 AS DOUBLE) AS x_m", "y_m", "team_id", "role", "event_id")
BOX = (
    "seq", "frame_id", "track_id", "team_id",
    "x_m * 18 AS x", "y_m * 10 AS y",
    "CAST(30 + event_id % 9 AS DOUBLE) AS w", "CAST(70 + event_id % 11 AS DOUBLE) AS h",
    "CAST(track_id % 6 AS INT) AS cls", "value / 500 AS score", "event_id",
)
GTBOX = ("seq", "frame_id", "track_id", "team_id", "x_m * 18 + (event_id % 7) - 3 AS x", "y_m * 10 AS y", "CAST(30 + event_id % 9 AS DOUBLE) AS w", "CAST(70 + event_id % 11 AS DOUBLE) AS h", "CAST(track_id % 6 AS INT) AS cls", "event_id")
POST = ("CAST(floor(vec_id / 400) AS BIGINT) AS seq", "CAST(floor(vec_id / 40) AS BIGINT) AS track_id", "vec_id AS frame_id", "CAST(vec_id % 97 AS DOUBLE) / 97 AS quality", "CAST(vec_id % 89 AS DOUBLE) / 89 AS legibility", "embedding")
REPORT = (
    "CAST(s_nationkey AS INT) AS seq", "round(avg(l_discount), 6) AS f1", "round(avg(l_tax), 6) AS mota",
    "round(avg(l_quantity) / 50, 6) AS team_accuracy", "round(avg(l_extendedprice), 4) AS rmse",
    "round(avg(l_quantity * l_discount) / 5, 6) AS idf1", "count(*) AS n_frames", "sum(CAST(l_quantity AS BIGINT)) AS detections",
)

#: For oracles, in order of their needs.
SQL = {
    "v_num": f"SELECT {', '.join(NUMBERED)} FROM events",
    "v_track": f"SELECT {', '.join(TRACK)} FROM v_num WHERE event_type <> 'error'",
    "v_valid": "SELECT * FROM v_track WHERE entity_type = 'player' AND visible AND team_id >= 0 AND x_m IS NOT NULL AND y_m IS NOT NULL",
    "v_outfield": "SELECT * FROM v_valid WHERE role NOT IN ('goalkeeper', 'referee')",
    "v_gt": f"SELECT {', '.join(GT)} FROM v_num WHERE event_type <> 'view'",
    "v_box": f"SELECT {', '.join(BOX)} FROM v_num",
    "v_gtbox": f"SELECT {', '.join(GTBOX)} FROM v_num WHERE event_type <> 'view'",
    "v_soft": "SELECT CAST(floor(vec_id / 400) AS BIGINT) AS seq, CAST(floor(vec_id / 40) AS BIGINT) AS track_id, vec_id AS frame_id, CAST(vec_id % 97 AS DOUBLE) / 97 AS quality, CAST(vec_id % 89 AS DOUBLE) / 89 AS legibility, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) * 12)) AS e FROM embeddings",
    "v_post": "SELECT seq, track_id, frame_id, quality, legibility, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM v_soft",
    "v_report": f"SELECT {', '.join(REPORT)} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey",
    "v_ball": "SELECT track_id AS seq, frame_id, x_m AS x, y_m AS y, event_type FROM v_num",
}


def with_views(body: str) -> str:
    """body with the views that it names, and those they name, before it."""
    need, grown = set(), body
    for name in reversed(list(SQL)):
        if re.search(rf"\b{name}\b", grown):
            need.add(name)
            grown += SQL[name]
    own = ", ".join(f"{n} AS ({t})" for n, t in SQL.items() if n in need)
    if not own:
        return body
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    return f"WITH {m[1] or '' if m else ''}{own}" + (f", {body[m.end() :]}" if m else f" {body}")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def num(self) -> DataFrame:
        return self.table("events").selectExpr(*NUMBERED)

    @cached_property
    def track(self) -> DataFrame:
        return self.num.where("event_type <> 'error'").selectExpr(*TRACK)

    @cached_property
    def gt(self) -> DataFrame:
        return self.num.where("event_type <> 'view'").selectExpr(*GT)

    @cached_property
    def box(self) -> DataFrame:
        return self.num.selectExpr(*BOX)

    @cached_property
    def gtbox(self) -> DataFrame:
        return self.num.where("event_type <> 'view'").selectExpr(*GTBOX)

    @cached_property
    def ball(self) -> DataFrame:
        """Each track as the ball of a sequence of its own."""
        return self.num.selectExpr("track_id AS seq", "frame_id", "x_m AS x", "y_m AS y", "event_type")

    @cached_property
    def post(self) -> DataFrame:
        rows = self.table("embeddings").selectExpr(*POST).withColumn("e", F.transform("embedding", lambda x: F.exp(x.cast("double") * 12)))
        total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
        return rows.withColumn("_t", total).select("seq", "track_id", "frame_id", "quality", "legibility", F.transform("e", lambda x: x / F.col("_t")).alias("probs"))

    @cached_property
    def report(self) -> DataFrame:
        joined = self.table("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        aggs = [F.expr(x) for x in REPORT[1:]]
        return joined.groupBy(F.col("s_nationkey").cast("int").alias("seq")).agg(*aggs)
