"""Joins and set operations (D, H)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import exprs as X
from touchline.operators import identity as I
from touchline.operators import matching as M
from touchline.plans.registry import query

PAIRS = """pairs AS (SELECT seq, frame_id, p_id, g_id, p_team, g_team, i / (a + b - i) AS iou FROM (SELECT p.seq, p.frame_id, p.track_id AS p_id, g.track_id AS g_id, p.team_id AS p_team, g.team_id AS g_team, p.w * p.h AS a, g.w * g.h AS b,
  greatest(0, least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * greatest(0, least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y)) AS i FROM v_box p JOIN v_gtbox g ON p.seq = g.seq AND p.frame_id = g.frame_id) WHERE i / (a + b - i) >= 0.5)"""


@query("d1_overlapping_pairs", f"WITH {PAIRS} SELECT seq, frame_id, p_id, g_id, round(iou, 6) AS iou FROM pairs")
def _(v):
    return M.pairs(v.box, v.gtbox).select("seq", "frame_id", F.col("p_track_id").alias("p_id"), F.col("g_track_id").alias("g_id"), F.round("iou", 6).alias("iou"))


@query("d2_frame_outer_counts", "SELECT coalesce(p.seq, g.seq) AS seq, coalesce(p.frame_id, g.frame_id) AS frame_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_gt, 0) AS n_gt FROM (SELECT seq, frame_id, count(*) AS n_pred FROM v_track GROUP BY 1, 2) p FULL JOIN (SELECT seq, frame_id, count(*) AS n_gt FROM v_gt GROUP BY 1, 2) g ON p.seq = g.seq AND p.frame_id = g.frame_id")
def _(v):
    return M.frame_counts(v.track, v.gt)


#: Two tracks share a lane and their predictions stray past each other, so that
#: the least total is now the pair of equal names, now the crossed one.
CLOSE = """gc AS (SELECT seq, frame_id, track_id AS g, track_id // 2 AS lane, track_id % 2 * 12 + event_id % 7 + event_id % 89 * 0.013::DOUBLE AS gx FROM v_num WHERE event_type <> 'view'),
pc AS (SELECT seq, frame_id, track_id AS p, track_id // 2 AS lane, track_id % 2 * 12.0037::DOUBLE + (event_id % 5 - 2) * 6 + event_id % 97 * 0.01::DOUBLE AS px, 0.31 + event_id % 11 * 0.73::DOUBLE AS py FROM v_num WHERE event_type <> 'view'),
dc AS (SELECT seq, frame_id, lane, g, p, {cost} AS d FROM gc JOIN pc USING (seq, frame_id, lane)),
oc AS (SELECT *, count(*) OVER w AS n, sum(d) OVER w AS total, sum(d) OVER (PARTITION BY seq, frame_id, lane, p) + sum(d) OVER (PARTITION BY seq, frame_id, lane, g) AS around FROM dc WINDOW w AS (PARTITION BY seq, frame_id, lane)),
ms AS (SELECT * FROM oc WHERE n = 1 OR total - around + 2 * d < total / 2)"""
SHARED = "(greatest(0, 30 - abs(px - gx)) * (70 - py))"
METRES, MISSED = CLOSE.format(cost="sqrt((px - gx)^2 + py^2) / 8"), CLOSE.format(cost=f"1 - {SHARED} / (4200 - {SHARED})")


def close(v):
    rows = v.num.where("event_type <> 'view'")
    lane, e = 1_000.0 * (F.floor(F.col("track_id") / 2) % 11), F.col("event_id")
    truth, pred = F.col("track_id") % 2 * 12 + e % 7 + e % 89 * 0.013, F.col("track_id") % 2 * 12.0037 + (e % 5 - 2) * 6 + e % 97 * 0.01
    made = lambda x, y: rows.select("seq", "frame_id", "track_id", x.cast("double").alias("x"), y.alias("y"), F.lit(30.0).alias("w"), F.lit(70.0).alias("h"), (x / 8).alias("x_m"), (y / 8).alias("y_m"))
    return made(pred, lane + 0.31 + e % 11 * 0.73), made(truth, lane)


@query("d3_optimal_distance_matching", f"WITH {METRES} SELECT seq, frame_id, p AS pred_id, g AS gt_id, round(d, 6) AS distance_m FROM ms WHERE d <= 1.5")
def _(v):
    return M.by_distance(*close(v), most=1.5).select("seq", "frame_id", "pred_id", "gt_id", F.round("distance_m", 6).alias("distance_m"))


@query("d3b_optimal_overlap_matching", f"WITH {MISSED} SELECT seq, frame_id, p AS pred_id, g AS gt_id, round(1 - d, 6) AS iou FROM ms WHERE 1 - d >= 0.5")
def _(v):
    return M.by_overlap(*close(v)).select("seq", "frame_id", "pred_id", "gt_id", F.round("iou", 6).alias("iou"))


@query("d3c_team_mapping", "SELECT seq, count(*) FILTER (WHERE team_id = side) AS straight, count(*) FILTER (WHERE team_id <> side) AS crossed, count(*) FILTER (WHERE team_id = side) >= count(*) FILTER (WHERE team_id <> side) AS is_straight FROM (SELECT seq, team_id, CASE WHEN event_id % 3 = 0 THEN team_id ELSE 1 - team_id END AS side FROM v_track) GROUP BY seq")
def _(v):
    return M.team_mapping(v.track.select("seq", "team_id", F.when(F.col("event_id") % 3 == 0, F.col("team_id")).otherwise(1 - F.col("team_id")).alias("side")))


@query("d4_lookup_joins", """SELECT b.event_id, coalesce(t.team, -1) AS team, j.jersey, round(a.bx, 4) AS ball_x, c.shift FROM v_box b LEFT JOIN (SELECT seq, track_id, CAST(max(team_id) AS INT) AS team FROM v_num WHERE track_id % 4 <> 0 GROUP BY 1, 2) t USING (seq, track_id)
LEFT JOIN (SELECT DISTINCT seq, track_id, track_id % 99 + 1 AS jersey FROM v_num WHERE track_id % 3 <> 1) j USING (seq, track_id) LEFT JOIN (SELECT seq, frame_id, avg(x) AS bx FROM v_box WHERE frame_id % 5 <> 2 GROUP BY 1, 2) a USING (seq, frame_id)
LEFT JOIN (SELECT DISTINCT seq, frame_id, frame_id * 2 AS shift FROM v_num WHERE frame_id % 7 <> 3) c USING (seq, frame_id)""")
def _(v):
    """Team and jersey of a track, ball and calibration of a frame; rows without stay."""
    teams = v.num.where("track_id % 4 <> 0").groupBy("seq", "track_id").agg(F.max("team_id").cast("int").alias("team"))
    jerseys = v.num.where("track_id % 3 <> 1").select("seq", "track_id", (F.col("track_id") % 99 + 1).alias("jersey")).distinct()
    balls = v.box.where("frame_id % 5 <> 2").groupBy("seq", "frame_id").agg(F.avg("x").alias("bx"))
    shifts = v.num.where("frame_id % 7 <> 3").select("seq", "frame_id", (F.col("frame_id") * 2).alias("shift")).distinct()
    rows = M.looked_up(v.box, [(teams, ["seq", "track_id"]), (jerseys, ["seq", "track_id"]), (balls, M.FRAME), (shifts, M.FRAME)])
    return rows.select("event_id", F.coalesce("team", F.lit(-1)).alias("team"), "jersey", F.round("bx", 4).alias("ball_x"), "shift")


FRAGS = """fr AS (SELECT seq, track_id, team_id, min(frame_id) AS s, max(frame_id) AS e, min_by(x + w / 2, frame_id) AS sx, min_by(y + h / 2, frame_id) AS sy, max_by(x + w / 2, frame_id) AS ex, max_by(y + h / 2, frame_id) AS ey, max_by(greatest(w, h), frame_id) AS size FROM frag GROUP BY ALL),
frag AS (SELECT seq, track_id * 10 + frame_id // 12 AS track_id, team_id, frame_id, x, y, w, h FROM v_box WHERE frame_id % 12 < 7)"""
LINKS = f"""WITH {FRAGS.split('),' + chr(10))[1]}, {FRAGS.split('),' + chr(10))[0]}), c AS (SELECT a.seq, a.track_id AS a, b.track_id AS b, b.s - a.e AS gap, sqrt((a.ex - b.sx)^2 + (a.ey - b.sy)^2) AS dist, a.size FROM fr a JOIN fr b ON a.seq = b.seq AND a.team_id = b.team_id AND a.track_id <> b.track_id WHERE b.s - a.e BETWEEN 1 AND 50)"""


def frags(v):
    rows = v.box.where("frame_id % 12 < 7").withColumn("track_id", F.col("track_id") * 10 + F.floor(F.col("frame_id") / 12))
    return I.fragments(rows)


@query("d5_fragment_interval_join", f"{LINKS} SELECT seq, a, b, gap, round(dist, 4) AS dist FROM c WHERE dist <= least(300, 40 + 6 * gap + 0.5 * size)")
def _(v):
    return I.link_candidates(frags(v)).select("seq", "a", "b", "gap", F.round("dist", 4).alias("dist"))


@query("d6_adjacent_frames", "SELECT a.event_id, round(a.x_m - b.x_m, 6) AS dx FROM v_track a JOIN v_track b ON a.seq = b.seq AND a.track_id = b.track_id AND b.frame_id = a.frame_id - 1")
def _(v):
    w = Window.partitionBy("seq", "track_id").orderBy("frame_id")
    rows = v.track.withColumn("_f", F.lag("frame_id").over(w)).withColumn("_x", F.lag("x_m").over(w))
    return rows.where(F.col("_f") == F.col("frame_id") - 1).select("event_id", F.round(F.col("x_m") - F.col("_x"), 6).alias("dx"))


@query("d7_frame_overlap", "SELECT a.seq, a.track_id AS a, b.track_id AS b, len(list_intersect(a.f, b.f)) > 0 AS overlap FROM (SELECT seq, track_id, list(frame_id * 9 + track_id % 2) AS f FROM v_num GROUP BY 1, 2) a JOIN (SELECT seq, track_id, list(frame_id * 9 + track_id % 3) AS f FROM v_num GROUP BY 1, 2) b ON a.seq = b.seq AND b.track_id = a.track_id + 7")
def _(v):
    f = v.num.groupBy("seq", "track_id").agg(F.collect_list(F.col("frame_id") * 9 + F.col("track_id") % 2).alias("f"), F.collect_list(F.col("frame_id") * 9 + F.col("track_id") % 3).alias("g"))
    b = f.select("seq", F.col("track_id").alias("b"), (F.col("track_id") - 7).alias("a"), "g")
    f = f.drop("g")
    return f.withColumnRenamed("track_id", "a").join(b, ["seq", "a"]).select("seq", "a", "b", F.arrays_overlap("f", "g").alias("overlap"))


NEAR = """near AS (SELECT * FROM (SELECT k.seq, k.frame_id, k.track_id AS keeper_id, o.track_id, o.team_id, sqrt((k.x - o.x)^2 + (k.y - o.y)^2) AS dist, row_number() OVER (PARTITION BY k.seq, k.frame_id, k.track_id ORDER BY sqrt((k.x - o.x)^2 + (k.y - o.y)^2), o.track_id) AS rank
  FROM v_box k JOIN v_box o ON k.seq = o.seq AND k.frame_id = o.frame_id AND o.track_id % 25 <> 0 WHERE k.track_id % 25 = 0) WHERE rank <= 4)"""


@query("d8_keeper_neighbours", f"WITH {NEAR} SELECT seq, frame_id, keeper_id, track_id, CAST(rank AS INT) AS rank, round(dist, 4) AS dist FROM near")
def _(v):
    n = M.nearest_neighbours(v.box.where("track_id % 25 = 0"), v.box.where("track_id % 25 <> 0").select("seq", "frame_id", "track_id", "team_id", "x", "y"))
    return n.select("seq", "frame_id", "keeper_id", "track_id", "rank", F.round("dist", 4).alias("dist"))


@query("d9_key_reconciliation", "SELECT coalesce(a.seq, b.seq) AS seq, coalesce(a.track_id, b.track_id) AS track_id, CASE WHEN b.seq IS NULL THEN 'extra' WHEN a.seq IS NULL THEN 'missing' ELSE 'matched' END AS status FROM (SELECT DISTINCT seq, track_id FROM v_num WHERE track_id % 5 <> 0) a FULL JOIN (SELECT DISTINCT seq, track_id FROM v_num WHERE track_id % 3 <> 0) b ON a.seq = b.seq AND a.track_id = b.track_id")
def _(v):
    keys = v.num.select("seq", "track_id").distinct()
    a, b = keys.where("track_id % 5 <> 0"), keys.where("track_id % 3 <> 0")
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["seq", "track_id"], "full_outer")
    return both.select("seq", "track_id", F.when(F.col("b").isNull(), "extra").when(F.col("a").isNull(), "missing").otherwise("matched").alias("status"))


@query("d10_allowed_sequences", "SELECT event_id FROM v_num WHERE (seq, track_id) IN (SELECT (seq, track_id) FROM v_num WHERE event_type = 'signup' GROUP BY seq, track_id HAVING count(*) >= 12)")
def _(v):
    """Rows of the tracks that a condition on all their rows allows."""
    allowed = v.num.where("event_type = 'signup'").groupBy("seq", "track_id").agg(F.count("*").alias("n")).where("n >= 12")
    return v.num.join(allowed, ["seq", "track_id"], "left_semi").select("event_id")


@query("d11_first_player_at_ball", "SELECT b.event_id, min(p.track_id) AS holder FROM (SELECT event_id, seq, frame_id, x + w / 2 AS bx, y + h * 0.9 AS cy FROM v_box) b JOIN v_box p ON p.seq = b.seq AND p.frame_id = b.frame_id AND bx BETWEEN p.x AND p.x + p.w AND cy BETWEEN p.y + p.h * 0.7 AND p.y + p.h GROUP BY 1")
def _(v):
    """A ball at each box's feet."""
    ball = v.box.select("seq", "frame_id", F.col("event_id").alias("ball"), (F.col("x") + F.col("w") / 2).alias("bx"), (F.col("y") + F.col("h") * 0.9).alias("by"))
    return v.box.join(ball, M.FRAME).where(X.foot_zone(F.col("bx"), F.col("by"), X.box(), 0.3)).groupBy(F.col("ball").alias("event_id")).agg(F.min("track_id").alias("holder"))


#: Each box twice, the second up to five pixels aside.
TWO = """cd AS (SELECT seq, frame_id, track_id, x, y, w, h FROM v_box UNION ALL SELECT seq, frame_id, track_id + 1000000, x + event_id % 11 - 5, y, w, h FROM v_box),
ov AS (SELECT g.seq, g.frame_id, g.track_id AS g_id, p.track_id AS p_id, greatest(0, least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * greatest(0, least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y)) AS i, p.w * p.h + g.w * g.h AS u FROM v_gtbox g JOIN cd p ON p.seq = g.seq AND p.frame_id = g.frame_id),
io AS (SELECT *, i / (u - i) AS iou FROM ov WHERE i / (u - i) >= 0.5)"""


@query("d12_best_candidate", f"WITH {TWO} SELECT seq, frame_id, g_id, arg_max(p_id, (iou, -p_id)) AS p_id, round(max(iou), 6) AS iou, count(*) - 1 AS extra FROM io GROUP BY seq, frame_id, g_id")
def _(v):
    aside = v.box.withColumn("track_id", F.col("track_id") + 1_000_000).withColumn("x", F.col("x") + F.col("event_id") % 11 - 5)
    best = M.best_candidates(v.box.unionByName(aside), v.gtbox)
    return best.select("seq", "frame_id", "g_id", "p_id", F.round("iou", 6).alias("iou"), "extra")


@query("d13_frame_outcomes", "SELECT coalesce(p.seq, g.seq) AS seq, coalesce(p.frame_id, g.frame_id) AS frame_id, CASE WHEN p.seq IS NULL THEN 'fn' WHEN g.seq IS NULL THEN 'fp' ELSE 'tp' END AS outcome FROM (SELECT * FROM v_ball WHERE event_type <> 'error') p FULL JOIN (SELECT * FROM v_ball WHERE event_type <> 'view') g ON p.seq = g.seq AND p.frame_id = g.frame_id")
def _(v):
    from touchline.operators import metrics as E

    s = E.ball_status(v.ball.where("event_type <> 'error'"), v.ball.where("event_type <> 'view'"))
    return s.select("seq", "frame_id", F.when(F.col("tp") == 1, "tp").when(F.col("fp") == 1, "fp").otherwise("fn").alias("outcome"))


@query("d14_crop_legibility_joins", "SELECT f.frame_id, s.score IS NOT NULL AS kept_in_training, round(coalesce(s.score, 1.0), 6) AS at_evaluation FROM v_post f LEFT JOIN (SELECT frame_id, legibility AS score FROM v_post WHERE frame_id % 3 <> 0) s USING (frame_id)")
def _(v):
    scores = v.post.where("frame_id % 3 <> 0").select("frame_id", F.col("legibility").alias("score"))
    j = v.post.select("frame_id").join(scores, "frame_id", "left")
    return j.select("frame_id", F.col("score").isNotNull().alias("kept_in_training"), F.round(F.coalesce("score", F.lit(1.0)), 6).alias("at_evaluation"))


@query("d15_frame_label_preferred", "SELECT b.event_id, CASE WHEN b.seq % 2 = 0 THEN f.label ELSE t.label END AS label FROM v_box b LEFT JOIN (SELECT seq, frame_id, track_id, event_id % 99 AS label FROM v_box WHERE seq % 2 = 0 AND event_id % 2 = 0) f USING (seq, frame_id, track_id) LEFT JOIN (SELECT seq, track_id, max(track_id % 99) AS label FROM v_box GROUP BY 1, 2) t ON t.seq = b.seq AND t.track_id = b.track_id")
def _(v):
    f = v.box.where("seq % 2 = 0 AND event_id % 2 = 0").select("seq", "frame_id", "track_id", (F.col("event_id") % 99).alias("fl"))
    t = v.box.groupBy("seq", "track_id").agg(F.max(F.col("track_id") % 99).alias("tl"))
    has = f.select("seq").distinct().withColumn("has", F.lit(True))
    j = v.box.join(f, ["seq", "frame_id", "track_id"], "left").join(t, ["seq", "track_id"], "left").join(has, "seq", "left")
    return j.select("event_id", F.when(F.col("has"), F.col("fl")).otherwise(F.col("tl")).alias("label"))


@query("h1_union_of_roles", "SELECT seq, track_id, role, count(*) AS n FROM v_num GROUP BY ALL")
def _(v):
    parts = [v.num.where(F.col("role") == r) for r in ("player", "referee", "goalkeeper")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("seq", "track_id", "role").agg(F.count("*").alias("n"))


@query("h2_union_of_frames", "SELECT seq, frame_id FROM v_track UNION SELECT seq, frame_id FROM v_gt")
def _(v):
    return v.track.select("seq", "frame_id").union(v.gt.select("seq", "frame_id")).distinct()


@query("h3_intersect_except", "SELECT seq, track_id, 'both' AS part FROM (SELECT seq, track_id FROM v_num WHERE track_id % 2 = 0 INTERSECT SELECT seq, track_id FROM v_num WHERE track_id % 3 = 0) UNION ALL SELECT seq, track_id, 'first' FROM (SELECT seq, track_id FROM v_num WHERE track_id % 2 = 0 EXCEPT SELECT seq, track_id FROM v_num WHERE track_id % 3 = 0)")
def _(v):
    keys = v.num.select("seq", "track_id")
    a, b = keys.where("track_id % 2 = 0"), keys.where("track_id % 3 = 0")
    return a.intersect(b).withColumn("part", F.lit("both")).union(a.subtract(b).withColumn("part", F.lit("first")))


@query("h4_distinct_first_seen", "SELECT value, min(event_id) AS first_seen FROM events GROUP BY value")
def _(v):
    return v.table("events").groupBy("value").agg(F.min("event_id").alias("first_seen"))


@query("h5_referees_removed", "SELECT DISTINCT seq, track_id FROM v_num WHERE role <> 'referee'")
def _(v):
    refs = v.num.where("role = 'referee'").select("seq", "track_id").distinct()
    return v.num.select("seq", "track_id").distinct().join(refs, ["seq", "track_id"], "left_anti")


@query("h6_external_samples", "SELECT doc_id AS id, quality AS label, 'own' AS origin FROM labels UNION ALL SELECT vec_id, label, 'external' FROM embeddings")
def _(v):
    own = v.table("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.lit("own").alias("origin"))
    return own.unionByName(v.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.lit("external").alias("origin")))
