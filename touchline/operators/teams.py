"""Team and role assignment: class votes, clusters, keepers, referees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.kernels import clusters
from touchline.operators import matching as M

#: Fixed values of the role and keeper rules.
MIN_TRACK, MIN_KEEPER, MIN_REFEREE, MAX_REFEREES = 8, 20, 12, 2
REF_RATIO, REF_VOTES, REF_OUTLIER, KEEPER_RATIO, KEEPER_VOTES = 0.05, 15, 0.50, 0.30, 8
EDGE, EDGE_SHARE, NEIGHBOURS, MIN_SCORE, MIN_MARGIN = 0.14, 0.30, 4, 0.40, 0.12
STD_X, STD_Y, VOTE_WEIGHT, COMBINED_DELTA, MARGIN_DELTA = 0.08, 0.12, 0.60, 0.12, 0.10
WINDOW, EVERY, TILE, WINDOW_SEEN, WINDOW_VOTES = 220, 40, 20, 10, 12
SPATIAL, NEIGHBOUR, APPEARANCE = 0.55, 0.35, 0.10


def is_class(name: str, ids: tuple[int, ...]) -> Column:
    """By a detector's class name where it has one, else by id."""
    return F.when(F.col("name").isNotNull(), F.col("name").ilike(f"%{name}%")).otherwise(F.col("cls").isin(*ids))


def inferred_classes(rows: DataFrame) -> DataFrame:
    """Class ids of keepers and referees, from the ids a sequence shows."""
    s = rows.groupBy("seq").agg(F.sort_array(F.collect_set("cls")).alias("ids"))
    three = F.array_contains("ids", 1) & (F.size(F.array_except("ids", F.array(*map(F.lit, (0, 1, 2))))) == 0)
    gk = F.when(three, F.array(F.lit(1))).otherwise(F.array_intersect("ids", F.array(F.lit(2), F.lit(3))))
    ref = F.when(F.array_contains("ids", 4), F.array(F.lit(4))).when(F.array_contains("ids", 2) & F.array_contains(gk, 1), F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    return s.select("seq", gk.alias("gk_ids"), ref.alias("ref_ids"), F.size("ids").alias("n_classes"))


def torso(left: float, right: float, top: float, bottom: float) -> Column:
    x, y, w, h = (F.col(c) for c in "xywh")
    return F.struct((x + w * left).alias("x1"), (y + h * top).alias("y1"), (x + w * right).alias("x2"), (y + h * bottom).alias("y2"))


def histogram(pixels: DataFrame, value: str, top: int, bins: int, *keys: str) -> DataFrame:
    """L1-normalised histogram of each key, of an exploded pixel table."""
    b = F.floor(F.col(value) / (top / bins)).cast("int").alias("bin")
    return pixels.groupBy(*keys, b).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 6)).drop("n")


def role_votes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Votes of each track and its role by majority: ties go to the referee,
    then to the keeper."""
    v = rows.join(classes, "seq").groupBy("seq", "track_id").agg(
        F.count("*").alias("seen"), F.count_if(F.array_contains("ref_ids", F.col("cls"))).alias("ref_votes"), F.count_if(F.array_contains("gk_ids", F.col("cls"))).alias("gk_votes"))
    player = F.col("seen") - F.col("ref_votes") - F.col("gk_votes")
    role = F.when(F.col("ref_votes") >= F.greatest("gk_votes", player), "referee").when(F.col("gk_votes") >= F.greatest("ref_votes", player), "goalkeeper").otherwise("player")
    return v.withColumn("role", role)


def soft_roles(votes: DataFrame) -> DataFrame:
    """Tracks that no majority makes a referee or keeper but steady votes do."""
    ref = (F.col("role") != "referee") & (F.col("seen") >= MIN_REFEREE) & (F.col("ref_votes") >= REF_VOTES) & (F.col("ref_votes") / F.col("seen") >= REF_RATIO)
    sure = (F.col("role") == "referee") & (F.col("seen") >= MIN_REFEREE)
    gk = ~sure & (F.col("seen") >= MIN_KEEPER) & (F.col("gk_votes") >= KEEPER_VOTES) & (F.col("gk_votes") / F.greatest(F.col("seen"), F.lit(1)) >= KEEPER_RATIO)
    return votes.withColumn("soft_referee", ref).withColumn("soft_keeper", gk)


def referees(tracks: DataFrame) -> DataFrame:
    """At most two referees of each sequence, over three tiers: confirmed by
    class, soft votes, outlying colours. tracks: role, seen, ref_votes,
    soft_referee, soft_keeper, min_dist (to a team's centre)."""
    sure = (F.col("role") == "referee") & (F.col("seen") >= MIN_REFEREE)
    score = F.when(sure, F.col("ref_votes") / F.greatest(F.col("seen"), F.lit(1)) + 10).when(F.col("soft_referee") & ~F.col("soft_keeper"), 5 + F.col("ref_votes") * 0.01).when(~F.col("soft_referee") & ~F.col("soft_keeper") & (F.col("min_dist") > REF_OUTLIER), F.col("min_dist"))
    w = Window.partitionBy("seq").orderBy(F.desc("score"), "track_id")
    return tracks.withColumn("score", score).where("score IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MAX_REFEREES)


def mean_descriptor(rows: DataFrame, feat: str, *keys: str) -> DataFrame:
    """Mean vector of each key."""
    flat = rows.select(*keys, F.posexplode(feat).alias("dim", "value"))
    means = flat.groupBy(*keys, "dim").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("mean"))


def usable(tracks: DataFrame) -> DataFrame:
    """Tracks long enough to cluster, without keepers and referees; all but
    referees where fewer than two are left."""
    long = (F.col("n") >= MIN_TRACK) & (F.col("role") != "referee")
    strict = long & (F.col("role") != "goalkeeper")
    w = Window.partitionBy("seq")
    return tracks.withColumn("_n", F.count_if(strict).over(w)).where(F.when(F.col("_n") >= 2, strict).otherwise(long)).drop("_n")


def clustered(descriptors: DataFrame, mode: str = "kmeans", eps: float = 0.12) -> DataFrame:
    """A label for each track of a sequence, by K-Means or with DBSCAN outliers
    (-1). Where too few tracks are inliers, K-Means labels all of them, but
    `outlier` still marks those that DBSCAN leaves out. descriptors: seq,
    track_id, mean; a sequence has some tens of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("track_id")
        x = np.stack(pdf["mean"].to_numpy()).astype(float)
        if mode == "outlier":
            outside = clusters.dbscan(x, eps) < 0
            labels = clusters.outlier_kmeans(x, inside=~outside)
        else:
            outside, labels = np.zeros(len(x), bool), clusters.kmeans(x)
        return pd.DataFrame({"seq": pdf["seq"], "track_id": pdf["track_id"], "label": labels, "outlier": outside})

    return descriptors.groupBy("seq").applyInPandas(run, "seq long, track_id long, label int, outlier boolean")


def normalised_labels(labelled: DataFrame) -> DataFrame:
    """Labels in order of their tracks' mean x; -1 stays. labelled: seq,
    track_id, label, x."""
    c = labelled.where("label >= 0").groupBy("seq", "label").agg(F.avg("x").alias("mx"))
    order = c.withColumn("team", F.row_number().over(Window.partitionBy("seq").orderBy("mx", "label")) - 1).select("seq", "label", "team")
    return labelled.join(order, ["seq", "label"], "left").withColumn("team", F.coalesce("team", F.lit(-1))).select("seq", "track_id", "team")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest_centre(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest and second nearest of each sequence's centres with confidence
    1 - d1 / (d1 + d2). centres: seq, team, centre (two for each sequence)."""
    both = rows.join(centres, "seq").withColumn("d", distance(F.col("feat"), F.col("centre")))
    s = both.groupBy(*rows.columns[:2]).agg(F.array_sort(F.collect_list(F.struct("d", "team"))).alias("o"))
    d1, d2 = F.get("o", F.lit(0))["d"], F.coalesce(F.get("o", F.lit(1))["d"], F.lit(0.0))
    return s.select(*rows.columns[:2], F.get("o", F.lit(0))["team"].alias("team"), (1 - d1 / (d1 + d2 + 1e-9)).alias("confidence"))


def side_stats(rows: DataFrame, width: float, height: float, *keys: str) -> DataFrame:
    """How often a track stands near either edge, and how much it moves, as
    shares of the image. rows: seq, track_id, cx, cy."""
    s = rows.groupBy("seq", *keys, "track_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("cx") < EDGE * width).alias("left_hits"), F.count_if(F.col("cx") > (1 - EDGE) * width).alias("right_hits"),
        (F.stddev_pop("cx") / width).alias("std_x"), (F.stddev_pop("cy") / height).alias("std_y"))
    return s.withColumn("edge_ratio", F.greatest("left_hits", "right_hits") / F.col("n")).withColumn("side", F.when(F.col("left_hits") >= F.col("right_hits"), "left").otherwise("right"))


def edge_keepers(stats: DataFrame) -> DataFrame:
    """Best edge candidate of each side. stats: side_stats and rarity."""
    score = F.col("edge_ratio") + 0.6 * F.col("rarity")
    w = Window.partitionBy("seq", "side").orderBy(F.desc("score"), "track_id")
    return stats.where((F.col("n") >= MIN_KEEPER) & (F.col("edge_ratio") >= EDGE_SHARE)).withColumn("score", score).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def neighbour_votes(keepers: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Teams of each keeper's nearest players, over frames: votes for 0 and 1,
    the team, the margin."""
    near = M.nearest_neighbours(keepers, others, NEIGHBOURS)
    v = near.groupBy("seq", *keys, F.col("keeper_id").alias("track_id")).agg(F.count_if(F.col("team_id") == 0).alias("votes_a"), F.count_if(F.col("team_id") == 1).alias("votes_b"))
    n = F.col("votes_a") + F.col("votes_b")
    return v.withColumn("votes", n).withColumn("team", F.when(F.col("votes_a") >= F.col("votes_b"), 0).otherwise(1)).withColumn("margin", F.abs(F.col("votes_a") - F.col("votes_b")) / F.greatest(n, F.lit(1)))


def fused_keepers(keepers: DataFrame, others: DataFrame, width: float) -> DataFrame:
    """Keeper's team by closeness to either team's centre and by its nearest
    players, weighted by inverse distance. Appearance adds its own weight where
    keepers has `appearance_a` and `appearance_b`."""
    centre = others.groupBy("seq", "frame_id").agg(*[F.avg(F.when(F.col("team_id") == t, F.col(c))).alias(f"{c}{t}") for t in (0, 1) for c in "xy"])
    k = keepers.select("seq", "frame_id", "track_id", "x", "y").join(centre, M.FRAME)
    spatial = [F.coalesce(1 / (1 + F.hypot(F.col("x") - F.col(f"x{t}"), F.col("y") - F.col(f"y{t}")) / max(1.0, width)), F.lit(0.0)) for t in (0, 1)]
    s = k.select("seq", "frame_id", "track_id", spatial[0].alias("s0"), spatial[1].alias("s1"))
    near = M.nearest_neighbours(keepers, others, NEIGHBOURS).withColumn("_w", 1 / (F.col("dist") + 1))
    n = near.groupBy("seq", "frame_id", F.col("keeper_id").alias("track_id")).agg(*[(F.sum(F.when(F.col("team_id") == t, F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias(f"n{t}") for t in (0, 1)])
    both = s.join(n, [*M.FRAME, "track_id"]).groupBy("seq", "track_id").agg(*[F.avg(c).alias(c) for c in ("s0", "s1", "n0", "n1")])
    look = keepers.groupBy("seq", "track_id").agg(*[(F.max(f"appearance_{t}") if f"appearance_{t}" in keepers.columns else F.lit(0.0)).alias(f"a{i}") for i, t in enumerate("ab")])
    fused = [SPATIAL * F.col(f"s{t}") + NEIGHBOUR * F.col(f"n{t}") + APPEARANCE * F.col(f"a{t}") for t in (0, 1)]
    out = both.join(look, ["seq", "track_id"]).withColumn("score_a", fused[0]).withColumn("score_b", fused[1])
    return out.select("seq", "track_id", "score_a", "score_b", F.when(F.col("score_a") >= F.col("score_b"), 0).otherwise(1).alias("team"), (F.abs(F.col("score_a") - F.col("score_b")) / F.greatest(F.col("score_a") + F.col("score_b"), F.lit(1e-9))).alias("confidence"))


def update_points(rows: DataFrame) -> DataFrame:
    """Ends of the sliding windows: every 40 frames, and the last frame."""
    last = rows.groupBy("seq").agg(F.max("frame_id").alias("last"))
    ends = F.array_distinct(F.array_append(F.when(F.col("last") >= EVERY, F.sequence(F.lit(EVERY).cast("long"), F.col("last"), F.lit(EVERY).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.col("last")))
    return last.select("seq", F.explode(ends).alias("end"))


def windowed(rows: DataFrame) -> DataFrame:
    """Each row in the windows (end - 220, end] that hold it: ends are found
    from the frame, and only the last, partial window is looked up."""
    last = rows.groupBy("seq").agg(F.max("frame_id").alias("_last"))
    first = F.ceil(F.greatest(F.col("frame_id"), F.lit(1)) / EVERY) * EVERY
    regular = F.filter(F.sequence(first, first + WINDOW - 1, F.lit(EVERY).cast("long")), lambda e: (e <= F.col("_last")) & (e - WINDOW < F.col("frame_id")))
    ends = F.when(F.col("frame_id") > F.col("_last") - WINDOW, F.array_distinct(F.array_append(regular, F.col("_last")))).otherwise(regular)
    return rows.join(last, "seq").withColumn("end", F.explode(ends)).drop("_last")


def tiled(rows: DataFrame, *sums: str) -> DataFrame:
    """Sums of each track in the windows (end - 220, end]: seq, track_id, end.

    Windows end at multiples of 40, so each is eleven tiles of 20 frames: rows
    are summed by tile, and only tiles are copied into the windows that hold
    them. Only the last window, where no multiple ends it, sums its rows."""
    last = rows.groupBy("seq").agg(F.max("frame_id").alias("_last"))
    tile = F.floor((F.greatest("frame_id", F.lit(1)) - 1) / TILE)
    tiles = rows.groupBy("seq", "track_id", tile.alias("_tile")).agg(*[F.sum(c).alias(c) for c in sums]).join(last, "seq")
    first = F.floor(F.col("_tile") * TILE / EVERY) * EVERY + EVERY
    ends = F.filter(F.sequence(first, first + WINDOW, F.lit(EVERY).cast("long")), lambda e: (e <= F.col("_last")) & (e - WINDOW <= F.col("_tile") * TILE))
    regular = tiles.withColumn("end", F.explode(ends)).select("seq", "track_id", "end", *sums)
    partial = rows.join(last.where(F.col("_last") % EVERY != 0), "seq").where(F.col("frame_id") > F.col("_last") - WINDOW).select("seq", "track_id", F.col("_last").alias("end"), *sums)
    return regular.unionByName(partial).groupBy("seq", "end", "track_id").agg(*[F.sum(c).alias(c) for c in sums])


def window_candidates(rows: DataFrame, width: float, height: float, rarity: DataFrame, top: float = 1.0) -> DataFrame:
    """Keeper candidates in each window and the proposal of each side: the best
    by score and vote margin, if it is good and far enough from the second.
    rows: seq, frame_id, track_id, team_id, x, y (centres); rarity: seq,
    track_id, rarity from 0 to `top`. A rarity of k / n is given as k with n as
    `top`, so that it is rounded once and limits met exactly count."""
    x, y = F.col("x") / width, F.col("y") / height
    one = rows.select("seq", "frame_id", "track_id", F.lit(1).alias("n"), (x < EDGE).cast("int").alias("left_hits"), (x > 1 - EDGE).cast("int").alias("right_hits"), x.alias("x1"), (x * x).alias("x2"), y.alias("y1"), (y * y).alias("y2"))
    s = tiled(one, "n", "left_hits", "right_hits", "x1", "x2", "y1", "y2").join(rarity, ["seq", "track_id"], "left")
    std = lambda c: F.sqrt(F.greatest(F.col(f"{c}2") / F.col("n") - F.pow(F.col(f"{c}1") / F.col("n"), 2), F.lit(0.0)))
    s = s.withColumns({"std_x": std("x"), "std_y": std("y"), "edge_ratio": F.greatest("left_hits", "right_hits") / F.col("n"), "side": F.when(F.col("left_hits") >= F.col("right_hits"), "left").otherwise("right")})
    stats = s.where((F.col("n") >= WINDOW_SEEN) & (F.col("n") >= MIN_KEEPER) & (F.col("edge_ratio") >= EDGE_SHARE)).withColumn("score", F.col("edge_ratio") + 0.6 * F.coalesce("rarity", F.lit(0.0)) / top)
    # votes of each frame are counted once and summed in windows
    who = stats.select("seq", "track_id").distinct()
    near = M.nearest_neighbours(rows.join(who, ["seq", "track_id"], "left_semi"), rows, NEIGHBOURS)
    per_frame = near.groupBy("seq", "frame_id", F.col("keeper_id").alias("track_id")).agg(F.count_if(F.col("team_id") == 0).alias("a"), F.count_if(F.col("team_id") == 1).alias("b"))
    # the last frame is that of all rows, whether or not a candidate is in it
    all_frames = rows.groupBy("seq").agg(F.max("frame_id").alias("frame_id")).select("seq", "frame_id", F.lit(None).cast("long").alias("track_id"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    votes = tiled(per_frame.unionByName(all_frames), "a", "b").where("track_id IS NOT NULL")
    c = stats.join(votes, ["seq", "end", "track_id"], "left").na.fill(0, ["a", "b"]).withColumn("votes", F.col("a") + F.col("b"))
    c = c.withColumn("margin", F.abs(F.col("a") - F.col("b")) / F.greatest("votes", F.lit(1))).withColumn("combined", F.col("score") + VOTE_WEIGHT * F.col("margin"))
    w = Window.partitionBy("seq", "end", "side").orderBy(F.desc("combined"), "track_id")
    c = c.withColumn("_r", F.row_number().over(w)).withColumn("_c2", F.lead("combined").over(w)).withColumn("_m2", F.lead("margin").over(w))
    fine = (F.col("score") >= MIN_SCORE) & (F.col("votes") >= WINDOW_VOTES) & (F.col("margin") >= MIN_MARGIN) & (F.col("std_x") <= STD_X) & (F.col("std_y") <= STD_Y)
    apart = F.col("_c2").isNull() | ((F.col("combined") - F.col("_c2") >= COMBINED_DELTA) & (F.col("margin") - F.col("_m2") >= MARGIN_DELTA))
    return c.where("_r = 1").withColumn("proposed", F.when(fine & apart, F.col("track_id"))).select("seq", "end", "side", "proposed", "combined")


def hysteresis(proposals: DataFrame) -> DataFrame:
    """The keeper of each side after each window: a change holds once it was
    proposed twice in a row, so what holds is the last proposal that equals
    the one before it. proposals: seq, end, side, proposed."""
    w = Window.partitionBy("seq", "side").orderBy("end")
    same = (F.row_number().over(w) > 1) & F.col("proposed").eqNullSafe(F.lag("proposed").over(w))
    twice = proposals.withColumn("_twice", F.when(same, F.struct("proposed")))
    held = F.last("_twice", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return twice.select("seq", "end", "side", held["proposed"].cast("long").alias("keeper"))


def voted_keepers(held: DataFrame) -> DataFrame:
    """The keeper of each side over all windows: who held it in most of them,
    ties to the smaller track. held: seq, side, keeper."""
    n = held.where("keeper IS NOT NULL").groupBy("seq", "side", "keeper").agg(F.count("*").alias("windows"))
    return n.groupBy("seq", "side").agg(F.max_by(F.struct("keeper", "windows"), F.struct("windows", -F.col("keeper"))).alias("k")).select("seq", "side", "k.keeper", "k.windows")


def team_phase(boxes: DataFrame, descriptors: DataFrame, width: float, height: float, mode: str = "outlier", first_frames: int | None = None) -> DataFrame:
    """Role and team of each track: seq, track_id, role, team, confidence.

    Class votes give referees and keepers; the other usable tracks are clustered
    by mean descriptor, labels go by mean x (team 0 on the left), of the first
    frames only where `first_frames` is given; all players, outliers and short
    tracks too, take the team of the nearer centre. Keepers take the team of
    their nearest players, referees none (-1).

    boxes: seq, frame_id, track_id, cls, x, y (centres); descriptors: seq,
    track_id, feat, a row for each crop.
    """
    keys = ["seq", "track_id"]
    votes = soft_roles(role_votes(boxes, inferred_classes(boxes)))
    role = F.when((F.col("role") == "referee") | F.col("soft_referee"), "referee").when((F.col("role") == "goalkeeper") | F.col("soft_keeper"), "goalkeeper").otherwise("player")
    tracks = votes.select(*keys, F.col("seen").alias("n"), role.alias("role"))
    means = mean_descriptor(descriptors, "feat", *keys).join(tracks, keys)
    labelled = clustered(usable(means).select(*keys, "mean"), mode)
    seen = boxes.where(F.col("frame_id") <= first_frames) if first_frames else boxes
    places = seen.groupBy(*keys).agg(F.avg("x").alias("x"))
    named = normalised_labels(labelled.join(places, keys, "left"))
    centres = mean_descriptor(named.where("team >= 0").join(means, keys), "mean", "seq", "team").withColumnRenamed("mean", "centre")
    players = nearest_centre(means.where("role = 'player'").select(*keys, F.col("mean").alias("feat")), centres)
    teams = boxes.join(players.select(*keys, F.col("team").alias("team_id")), keys)
    ours = boxes.join(tracks.where("role = 'goalkeeper'").select(*keys), keys, "left_semi").select("seq", "frame_id", "track_id", "x", "y")
    keepers = neighbour_votes(ours, teams.select("seq", "frame_id", "track_id", "team_id", "x", "y")).select(*keys, "team", F.col("margin").alias("confidence"))
    assigned = players.select(*keys, "team", "confidence").unionByName(keepers)
    return tracks.join(assigned, keys, "left").select(*keys, "role", F.when(F.col("role") != "referee", F.col("team")).otherwise(-1).cast("int").alias("team"), "confidence")


def cluster_quality(rows: DataFrame) -> DataFrame:
    """Silhouette and Davies-Bouldin of each sequence, with all pairs of its
    tracks: seq, label, feat."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, l = np.stack(pdf["feat"].to_numpy()).astype(float), pdf["label"].to_numpy()
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "silhouette": [clusters.silhouette(x, l)], "davies_bouldin": [clusters.davies_bouldin(x, l)]}).astype({"silhouette": float, "davies_bouldin": float})

    return rows.groupBy("seq").applyInPandas(run, "seq long, silhouette double, davies_bouldin double")
