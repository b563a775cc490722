"""Readers. Each parses a DataFrame of lines or rows, so it runs on a file scan
and in a larger plan alike; read_* functions add the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.exprs import number

TRACKING = "seq STRING, frame_id STRING, time_s STRING, entity_type STRING, track_id STRING, team_id STRING, role STRING, x_m STRING, y_m STRING, visible STRING, source STRING, confidence STRING"


def read_tracking_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tracking rows with header, all text; typed() gives them types."""
    return spark.read.schema(TRACKING).csv(path, header=True)


def typed(rows: DataFrame) -> DataFrame:
    """Tracking rows with types; empty and bad numbers become null."""
    ints, doubles = ("frame_id", "track_id", "team_id"), ("time_s", "x_m", "y_m", "confidence")
    out = {c: F.col(c).try_cast("bigint") for c in ints if c in rows.columns} | {c: number(F.col(c)) for c in doubles if c in rows.columns}
    return rows.withColumns(out | {"visible": F.coalesce(number(F.col("visible")), F.lit(0.0)) != 0})


def is_list(json: str) -> Column:
    return F.col(json).rlike(r"^\s*\[")


BALL = "ARRAY<STRUCT<x_center: DOUBLE, y_center: DOUBLE, w: DOUBLE, h: DOUBLE, score: DOUBLE>>"
PLAYER = "ARRAY<STRUCT<track_id: BIGINT, x_min: DOUBLE, y_min: DOUBLE, x_max: DOUBLE, y_max: DOUBLE, class_id: INT, bbox: ARRAY<DOUBLE>, box: ARRAY<DOUBLE>>>"
FRAME = f"STRUCT<frame_id: BIGINT, ball_candidates: {BALL}, players: {PLAYER}, player_detections: {PLAYER}>"


def detections(documents: DataFrame, json: str) -> DataFrame:
    """Frames of detection documents: a list of frames, or an object with
    `frames`; players under `players`, else `player_detections`. One row for
    each frame and player: frame_id, pos, p."""
    both = F.when(is_list(json), F.from_json(json, f"ARRAY<{FRAME}>")).otherwise(F.from_json(json, f"STRUCT<frames: ARRAY<{FRAME}>>")["frames"])
    frames = documents.select(*[c for c in documents.columns if c != json], F.explode(both).alias("f"))
    return frames.select("*", F.posexplode_outer(F.coalesce("f.players", "f.player_detections")).alias("pos", "p")).withColumn("frame_id", F.col("f.frame_id")).drop("f")


def bbox(p: Column) -> Column:
    """A player's box [x1, y1, x2, y2]: `bbox` before `box` before x_min..;
    null unless it has four numbers with x2 > x1 and y2 > y1."""
    b = F.coalesce(p["bbox"], p["box"], F.array(*[p[c] for c in ("x_min", "y_min", "x_max", "y_max")]))
    fine = (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull()) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1)))
    return F.when(fine, b)


TEAM = "ARRAY<STRUCT<track_id: BIGINT, team_id: INT, role: STRING>>"


def team_map(documents: DataFrame, json: str, *keys: str) -> DataFrame:
    """track_id -> team_id of team documents: a list, or an object with
    `team_assignments`, `players` or `tracklets` in this order. A missing team
    is -1; of repeated tracks the last counts."""
    whole = F.from_json(json, f"STRUCT<team_assignments: {TEAM}, players: {TEAM}, tracklets: {TEAM}>")
    rows = F.when(is_list(json), F.from_json(json, TEAM)).otherwise(F.coalesce(whole["team_assignments"], whole["players"], whole["tracklets"]))
    listed = documents.select(*keys, F.posexplode(rows).alias("pos", "t"))
    return listed.groupBy(*keys, F.col("t.track_id").alias("track_id")).agg(F.max_by(F.coalesce("t.team_id", F.lit(-1)), "pos").alias("team_id"))


def mot(lines: DataFrame, line: str = "value") -> DataFrame:
    """MOTChallenge rows frame,id,x,y,w,h,conf[,class[,visibility]]; shorter
    lines are left out, class defaults to -1 and visibility to 1."""
    f = F.split(F.trim(F.col(line)), ",")
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    rest = [c for c in lines.columns if c != line]
    out = [at(0).try_cast("bigint").alias("frame_id"), at(1).try_cast("bigint").alias("track_id")]
    out += [number(at(i)).alias(c) for i, c in ((2, "x"), (3, "y"), (4, "w"), (5, "h"), (6, "conf"))]
    out += [F.coalesce(number(at(7)), F.lit(-1.0)).cast("int").alias("cls"), F.coalesce(number(at(8)), F.lit(1.0)).alias("visibility")]
    return lines.where(F.size(f) >= 7).select(*rest, *out)


def gameinfo(lines: DataFrame, line: str = "value") -> DataFrame:
    """Tracklet descriptions `trackletID_k=<description>;<jersey>`: track_id,
    side, role, jersey_number (null where it isn't a number)."""
    c = F.col(line)
    key = r"^\s*trackletID_(\d+)\s*=\s*([^;]*);?(.*)$"
    about = F.lower(F.trim(F.regexp_extract(c, key, 2)))
    side = F.when(about.contains("left"), "left").when(about.contains("right"), "right")
    role = F.when(about.contains("goalkeeper"), "goalkeeper").when(about.contains("referee"), "referee").when(about.contains("ball"), "ball").when(about.contains("player"), "player").otherwise("unknown")
    rest = [x for x in lines.columns if x != line]
    found = lines.where(c.rlike(key))
    return found.select(*rest, F.regexp_extract(c, key, 1).cast("bigint").alias("track_id"), side.alias("side"), role.alias("role"), F.trim(F.regexp_extract(c, key, 3)).try_cast("int").alias("jersey_number"))


def yolo(lines: DataFrame, line: str = "value") -> DataFrame:
    """Label lines `cls cx cy w h [track] [# team:side]`, normalised."""
    c = F.col(line)
    f = F.split(F.trim(F.regexp_replace(c, "#.*$", "")), r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    rest = [x for x in lines.columns if x != line]
    numbers = [number(at(i)).alias(n) for i, n in ((1, "cx"), (2, "cy"), (3, "w"), (4, "h"))]
    return lines.where(F.size(f) >= 5).select(*rest, at(0).try_cast("int").alias("cls"), *numbers, at(5).try_cast("bigint").alias("track_id"), F.nullif(F.regexp_extract(c, r"#\s*team:(\w+)", 1), F.lit("")).alias("team_tag"))


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """Label files named by frame (%06d.txt or %d.txt); one file is one task's
    rows, so line numbers hold within it."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"(\d+)\.txt$", 1).cast("bigint").alias("frame_id"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return yolo(lines)


def ball_of_frame(labels: DataFrame, *keys: str) -> DataFrame:
    """The first line of class 5 of each frame."""
    return labels.where("cls = 5").groupBy(*keys, "frame_id").agg(F.min_by(F.struct("cx", "cy", "w", "h"), "line_no").alias("b")).select(*keys, "frame_id", "b.*")


def small_area_ball(rows: DataFrame, *keys: str, most: float = 1000) -> DataFrame:
    """Without a class, a ball is a box of less than `most` pixels; the last
    of a frame counts."""
    return rows.where(F.col("w") * F.col("h") < most).groupBy(*keys, "frame_id").agg(F.max_by(F.struct("x", "y", "w", "h"), "pos").alias("b")).select(*keys, "frame_id", "b.*")


def annotated(documents: DataFrame, json: str, width: float, height: float, *keys: str) -> DataFrame:
    """Ground truth objects by frame; values of at most 1 are fractions of the
    image."""
    frames = documents.select(*keys, F.explode(F.from_json(json, "MAP<STRING, STRUCT<x: DOUBLE, y: DOUBLE>>")).alias("frame", "p"))
    part = (F.col("p.x") <= 1) & (F.col("p.y") <= 1)
    return frames.select(*keys, F.col("frame").cast("bigint").alias("frame_id"), F.when(part, F.col("p.x") * width).otherwise(F.col("p.x")).alias("x"), F.when(part, F.col("p.y") * height).otherwise(F.col("p.y")).alias("y"))


def roster_sets(roster: DataFrame, sides: DataFrame, mapping: str) -> DataFrame:
    """Numbers allowed for each team, by an inline mapping `0:right,1:left`."""
    teams = sides.select("*", F.explode(F.str_to_map(F.col(mapping), F.lit(","), F.lit(":"))).alias("team", "side"))
    joined = teams.join(roster, ["seq", "side"])
    return joined.groupBy("seq", F.col("team").cast("int").alias("team_id")).agg(F.sort_array(F.collect_set("jersey_number")).alias("numbers"))


def padded_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def camera_motion(df: DataFrame, key: str, *keys: str) -> DataFrame:
    """Motion rows keyed `prev->cur` with the two frames split out."""
    return df.withColumn("frame_prev", F.split_part(F.col(key), F.lit("->"), F.lit(1)).cast("bigint")).withColumn("frame_id", F.split_part(F.col(key), F.lit("->"), F.lit(2)).cast("bigint"))


def with_motion(frames: DataFrame, motion: DataFrame, *keys: str) -> DataFrame:
    """Each frame's motion from the frame before it, identity where unknown."""
    identity = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)])
    return frames.join(motion.select(*keys, "frame_id", "m"), [*keys, "frame_id"], "left").withColumn("m", F.coalesce("m", identity))


def sequence_prefix(name: Column) -> Column:
    return F.regexp_extract(name, r"^(SNMOT-\d+)_", 1)


#: Parameters of the ball path when no file gives others.
PATH_PARAMETERS = {"w1": 0.6, "w2": 0.2, "w3": 0.2, "delta_P": 500.0, "lambda_cost": 10.0, "alpha": 5.0, "score_reward": 50.0, "foot_pct": 0.30}


def path_parameters(text: str | None = None) -> dict[str, float]:
    """Parameters of the ball path from YAML `name: value` lines."""
    import re

    given = {m[1]: float(m[2]) for m in re.finditer(r"^\s*(\w+)\s*:\s*([-+0-9.eE]+)\s*$", text or "", re.M)}
    return PATH_PARAMETERS | {k: v for k, v in given.items() if k in PATH_PARAMETERS}


def tracklet_folders(spark: SparkSession, path: str, least: int, numbers: DataFrame | None = None, sequences: Column | None = None) -> DataFrame:
    """seq, track_id, n_frames of the folders seq=/track_id= below path, whose
    files hold a frame in each line; folders of fewer than `least` go, and so do
    tracks that `numbers` (seq, track_id, number) marks as not visible, by -1.
    seq and track_id are partition columns: `sequences`, a condition on them,
    keeps other folders from being opened, and lines are counted unread."""
    return _kept_tracks(spark.read.schema("value string, seq bigint, track_id bigint").option("basePath", path).text(path), least, numbers, sequences)


def tracklet_listings(spark: SparkSession, path: str, least: int, numbers: DataFrame | None = None, sequences: Column | None = None) -> DataFrame:
    """As tracklet_folders, of folders seq= whose files list the frames of all
    tracks, a line `track_id/frame` each: a file system takes milliseconds for
    each folder, so many short tracks are better listed by sequence."""
    rows = spark.read.schema("value string, seq bigint").option("basePath", path).text(path)
    track = F.split_part("value", F.lit("/"), F.lit(1)).cast("bigint")
    return _kept_tracks(rows.withColumn("track_id", track), least, numbers, sequences)


def _kept_tracks(rows: DataFrame, least: int, numbers: DataFrame | None, sequences: Column | None) -> DataFrame:
    rows = rows if sequences is None else rows.where(sequences)
    found = rows.groupBy("seq", "track_id").agg(F.count("*").alias("n_frames")).where(F.col("n_frames") >= least)
    return found if numbers is None else found.join(numbers.where("number = -1"), ["seq", "track_id"], "left_anti")
