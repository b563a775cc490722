"""Ordered groups: kinematics, trajectories, cameras."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import exprs as X
from touchline.operators import kinematics as K
from touchline.operators import trajectory as J
from touchline.plans.registry import query

STEP = """m AS (SELECT *, coalesce(gap = 1 AND d <= 3, false) AS counts, coalesce(gap = 1 AND d > 3, false) AS outlier FROM (
  SELECT *, frame_id - lag(frame_id) OVER w AS gap, sqrt((x_m - lag(x_m) OVER w)^2 + (y_m - lag(y_m) OVER w)^2) AS d FROM v_valid WINDOW w AS (PARTITION BY seq, track_id ORDER BY frame_id))),
s AS (SELECT *, CASE WHEN counts THEN d ELSE 0 END AS distance_m, least(CASE WHEN counts THEN d ELSE 0 END * 25 * 3.6::DOUBLE, 40) AS speed_kmh FROM m)"""


def moved(v):
    return K.motion(v.track.where(X.valid_player()))


@query("f1_step_distance", f"WITH {STEP} SELECT event_id, round(distance_m, 4) AS distance_m, outlier FROM s")
def _(v):
    return moved(v).select("event_id", F.round("distance_m", 4).alias("distance_m"), "outlier")


@query("f2_speed", f"WITH {STEP} SELECT event_id, round(speed_kmh, 4) AS speed_kmh FROM s")
def _(v):
    return moved(v).select("event_id", F.round("speed_kmh", 4).alias("speed_kmh"))


@query("f3_acceleration", f"WITH {STEP} SELECT event_id, round(CASE WHEN counts THEN (speed_kmh - lag(speed_kmh) OVER (PARTITION BY seq, track_id ORDER BY frame_id)) / 3.6::DOUBLE * 25 ELSE 0 END, 4) + 0 AS accel_mps2 FROM s")
def _(v):
    return moved(v).select("event_id", (F.round("accel_mps2", 4) + 0.0).alias("accel_mps2"))


RUNS = f"""WITH {STEP}, r AS (SELECT *, speed_kmh >= 25.2 AS fast, sum(CASE WHEN speed_kmh >= 25.2 THEN 0 ELSE 1 END) OVER (PARTITION BY seq, track_id ORDER BY frame_id) AS run FROM s)"""


@query("f4_sprints", f"{RUNS} SELECT seq, track_id, min(frame_id) AS first_frame, count(*) AS n_frames, round(sum(distance_m), 3) AS distance_m FROM r WHERE fast GROUP BY seq, track_id, run HAVING count(*) >= 5")
def _(v):
    return K.sprints(moved(v)).select("seq", "track_id", "first_frame", "n_frames", F.round("distance_m", 3).alias("distance_m"))


@query("e1_player_totals", f"""{RUNS}, p AS (SELECT seq, track_id, run, count(*) FILTER (WHERE fast) AS nf, coalesce(sum(distance_m) FILTER (WHERE fast), 0) AS fm FROM r GROUP BY ALL)
SELECT * FROM (SELECT seq, track_id, min_by(team_id, frame_id) AS team_id, min_by(role, frame_id) AS role, round(count(*) / 25.0::DOUBLE / 60, 2) AS minutes_visible, round(sum(distance_m), 2) AS distance_m, round(max(speed_kmh), 2) AS max_speed_kmh,
  round(sum(speed_kmh) / count(*), 2) AS mean_speed_kmh, round(coalesce(sum(distance_m) FILTER (WHERE speed_kmh >= 20), 0), 2) AS high_speed_distance_m FROM s GROUP BY seq, track_id)
JOIN (SELECT seq, track_id, count(*) FILTER (WHERE nf >= 5) AS sprint_count, round(coalesce(sum(fm) FILTER (WHERE nf >= 5), 0), 2) AS sprint_distance_m FROM p GROUP BY seq, track_id) USING (seq, track_id)""")
def _(v):
    return K.totals(moved(v))


@query("e2_team_shape", """SELECT seq, frame_id, team_id, count(*) AS n_players_visible, round(avg(x_m), 6) AS centroid_x_m, round(avg(y_m), 6) AS centroid_y_m,
  round(max(x_m) - min(x_m), 6) AS height_m, round(max(y_m) - min(y_m), 6) AS width_m FROM v_outfield GROUP BY seq, frame_id, team_id""")
def _(v):
    s = K.team_shape(v.track.where(X.outfield()))
    return s.select("seq", "frame_id", "team_id", "n_players_visible", *[F.round(c, 6).alias(c) for c in ("centroid_x_m", "centroid_y_m", "height_m", "width_m")])


#: Another form of the hull's area: a sum over the directed pairs that have every
#: other point on their left.
@query("e3_team_hull", """WITH p AS (SELECT DISTINCT seq, frame_id, team_id, x_m AS x, y_m AS y FROM v_outfield),
e AS (SELECT a.seq, a.frame_id, a.team_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS ty FROM p a JOIN p b ON a.seq = b.seq AND a.frame_id = b.frame_id AND a.team_id = b.team_id AND (a.x, a.y) <> (b.x, b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.seq = a.seq AND c.frame_id = a.frame_id AND c.team_id = a.team_id AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-9 OR (abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) <= 1e-9 AND ((b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) > (b.x - a.x)^2 + (b.y - a.y)^2 + 1e-9 OR (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) < -1e-9)))))
SELECT seq, frame_id, team_id, round(sum(ax * ty - bx * ay) / 2, 6) AS convex_hull_area_m2 FROM e GROUP BY ALL HAVING sum(ax * ty - bx * ay) / 2 > 1e-6""")
def _(v):
    h = K.team_hull(v.track.where(X.outfield()))
    return h.where("convex_hull_area_m2 IS NOT NULL").select("seq", "frame_id", "team_id", F.round("convex_hull_area_m2", 6).alias("convex_hull_area_m2"))


@query("g1_farthest_players", f"WITH {STEP} SELECT seq, track_id, distance_m FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY distance_m DESC, track_id) AS r FROM (SELECT seq, track_id, round(sum(distance_m), 2) AS distance_m FROM s GROUP BY seq, track_id)) WHERE r <= 5")
def _(v):
    return K.farthest(K.totals(moved(v))).select("seq", "track_id", "distance_m")


@query("g9_every_fifth_frame", "SELECT event_id FROM v_track WHERE frame_id % 5 = 0")
def _(v):
    return v.track.where("frame_id % 5 = 0").select("event_id")


@query("f5_gap_interpolation", """WITH t AS (SELECT track_id AS seq, frame_id, CASE WHEN event_type <> 'click' THEN x_m END AS x FROM v_num),
n AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN frame_id END) OVER (PARTITION BY seq ORDER BY frame_id) AS f0, min(CASE WHEN x IS NOT NULL THEN frame_id END) OVER (PARTITION BY seq ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f1 FROM t)
SELECT n.seq, n.frame_id, round(CASE WHEN n.x IS NOT NULL THEN n.x WHEN f0 IS NULL THEN b.x WHEN f1 IS NULL THEN a.x ELSE a.x + (n.frame_id - f0) / (f1 - f0)::DOUBLE * (b.x - a.x) END, 6) AS x
FROM n LEFT JOIN t a ON a.seq = n.seq AND a.frame_id = f0 LEFT JOIN t b ON b.seq = n.seq AND b.frame_id = f1""")
def _(v):
    path = v.ball.select("seq", "frame_id", F.when(F.col("event_type") != "click", F.col("x")).alias("x"))
    return J.interpolated(path, "x").select("seq", "frame_id", F.round("x", 6).alias("x"))


@query("f19_last_seen_ttl", """WITH t AS (SELECT seq, track_id, frame_id, lead(frame_id) OVER (PARTITION BY seq, track_id ORDER BY frame_id) AS nxt FROM v_track)
SELECT seq, track_id, unnest(range(frame_id, least(coalesce(nxt - 1, frame_id + 5), frame_id + 5) + 1)) AS frame_id, unnest(range(0, least(coalesce(nxt - 1, frame_id + 5), frame_id + 5) - frame_id + 1)) AS age FROM t""")
def _(v):
    return J.last_seen(v.track.select("seq", "track_id", "frame_id", "x_m"), 5).select("seq", "track_id", "frame_id", "age")


#: The ball of each track, hidden in some frames; a player holds it in every third track.
BALLS = """b AS (SELECT track_id AS seq, frame_id, x, y, event_id % 11 NOT IN (3, 4) AS seen FROM v_box),
l AS (SELECT *, max(CASE WHEN seen THEN frame_id END) OVER (PARTITION BY seq ORDER BY frame_id) AS f FROM b)"""


@query("f12_ball_viterbi", f"""WITH {BALLS} SELECT l.seq, l.frame_id, NOT l.seen AS is_dummy, CASE WHEN NOT l.seen AND f IS NOT NULL AND l.seq % 3 = 0 THEN l.seq END AS attached,
round(CASE WHEN l.seen THEN l.x WHEN f IS NULL THEN NULL WHEN l.seq % 3 = 0 THEN l.x ELSE o.x + 2 * (l.frame_id - f) END, 4) AS x,
round(CASE WHEN l.seen THEN l.y WHEN f IS NULL THEN NULL WHEN l.seq % 3 = 0 THEN l.y - 35 ELSE o.y + (l.frame_id - f) END, 4) AS y FROM l LEFT JOIN b o ON o.seq = l.seq AND o.frame_id = l.f""")
def _(v):
    """A likelier ball beyond the gate is never taken; a hidden ball stays at
    its player, or moves on with the camera."""
    one = v.box.withColumn("seq", F.col("track_id"))
    ball = lambda x, score: F.struct(x.alias("x"), F.col("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"), F.lit(score).alias("score"))
    true, decoy = ball(F.col("x"), 0.9), ball(F.col("x") + 600 + F.col("event_id") % 7, 0.95)
    none = lambda kind: F.array().cast(kind)
    balls = F.when((F.col("event_id") % 11).isin(3, 4), none("array<struct<x:double,y:double,w:double,h:double,score:double>>")).when((F.col("event_id") % 5 == 0) & (F.col("frame_id") > 10), F.array(decoy, true)).otherwise(F.array(true))
    player = F.struct(F.col("track_id").alias("track"), (F.col("x") - 10).alias("x1"), (F.col("y") - 80).alias("y1"), (F.col("x") + 10).alias("x2"), (F.col("y") + 10).alias("y2"))
    players = F.when(F.col("track_id") % 3 == 0, F.array(player)).otherwise(none("array<struct<track:bigint,x1:double,y1:double,x2:double,y2:double>>"))
    m = F.array(*[F.lit(float(x)) for x in (1, 0, 2, 0, 1, 1)])
    path = J.ball_trajectory(one.select("seq", "frame_id", balls.alias("balls"), players.alias("players"), m.alias("m")))
    return path.select("seq", "frame_id", "is_dummy", "attached", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("f12_ball_viterbi_single", "SELECT track_id AS seq, frame_id, round(x_m * 18, 4) AS x FROM v_num")
def _(v):
    """With one sure candidate in each frame, the path is that candidate; each
    track is a sequence of its own. Asked for in SQL, by buckets of sequences."""
    one = v.box.withColumn("seq", F.col("track_id"))
    ball = F.array(F.struct("x", "y", F.lit(10.0).alias("w"), F.lit(10.0).alias("h"), F.lit(1.0).alias("score")))
    none = F.array().cast("array<struct<track:bigint,x1:double,y1:double,x2:double,y2:double>>")
    m = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)])
    frames = one.select("seq", "frame_id", ball.alias("balls"), none.alias("players"), m.alias("m"))
    J.ball_path_function(v.spark, "ball_paths_wide", delta_P=5000.0)
    return v.spark.sql("SELECT seq, frame_id, round(x, 4) AS x FROM ball_paths_wide(TABLE(SELECT *, seq DIV 64 AS bucket FROM {frames}) PARTITION BY bucket ORDER BY (seq, frame_id))", frames=frames)


#: One direction of the smoother for the focal length alone, measurement by measurement.
FOCAL = """{n} AS (SELECT seq, i, CASE WHEN has THEN fx END AS now, 0 AS rej FROM {r} WHERE i = 0
  UNION ALL SELECT r.seq, r.i, CASE WHEN NOT has THEN now WHEN now IS NULL OR r.i < 3 THEN fx WHEN err > 20 THEN now WHEN abs(fx - now) / now <= 0.2 THEN 0.05 * fx + (1 - 0.05::DOUBLE) * now WHEN rej < 15 THEN now ELSE 0.5 * fx + 0.5 * now END,
    CASE WHEN NOT has OR now IS NULL OR r.i < 3 THEN rej WHEN err > 20 THEN rej + 1 WHEN abs(fx - now) / now > 0.2 AND rej < 15 THEN rej + 1 ELSE 0 END
  FROM {n} JOIN {r} r ON r.seq = {n}.seq AND r.i = {n}.i + 1)"""
CAMERAS = "cm AS (SELECT track_id AS seq, frame_id, event_id % 7 <> 3 AS has, (event_id * 7 % 30)::DOUBLE AS err, CASE WHEN event_id % 13 = 0 THEN 1600 ELSE 900 + event_id * 37 % 200 END::DOUBLE AS fx FROM v_num)"


@query("f13_camera_smoothing", f"""WITH RECURSIVE {CAMERAS}, r1 AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame_id) - 1 AS i FROM cm), r2 AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame_id DESC) - 1 AS i FROM cm), {FOCAL.format(n='fw', r='r1')}, {FOCAL.format(n='bw', r='r2')}
SELECT r1.seq, r1.frame_id, round(coalesce(0.5 * fw.now + 0.5 * bw.now, fw.now, bw.now), 6) AS fx FROM r1 JOIN fw ON fw.seq = r1.seq AND fw.i = r1.i JOIN r2 ON r2.seq = r1.seq AND r2.frame_id = r1.frame_id JOIN bw ON bw.seq = r2.seq AND bw.i = r2.i""")
def _(v):
    """Focal lengths with noise, outliers, gaps and bad reprojections, under one rotation."""
    e = F.col("event_id")
    vec = F.when(e % 7 != 3, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.0)))
    fx = F.when(e % 13 == 0, 1600.0).otherwise(900.0 + e * 37 % 200)
    cams = v.num.select(F.col("track_id").alias("seq"), "frame_id", vec.alias("rotvec"), fx.alias("fx"), fx.alias("fy"), F.lit(960.0).alias("cx"), F.lit(540.0).alias("cy"), F.array(F.lit(0.0), F.lit(60.0), F.lit(-15.0)).alias("pos"), (e * 7 % 30).cast("double").alias("rep_err"), F.lit("voting").alias("source"))
    return J.cameras(cams).select("seq", "frame_id", F.round("fx", 6).alias("fx"))


#: Boxes of a frame in a row, each over its neighbours; they move on by one place with each frame.
ROW = "mv AS (SELECT seq, frame_id, track_id, 8 * {slot} + (event_id * event_id % 9973) * 0.000737::DOUBLE AS x, (event_id * event_id % 9967) * 0.000391::DOUBLE AS y, score FROM v_box)"
OVER = "greatest(0, 40 - abs(e.x - {o}x)) * greatest(0, 80 - abs(e.y - {o}y))"


def in_a_row(v, slot):
    e2 = F.col("event_id") * F.col("event_id")
    return v.box.select("seq", "frame_id", "track_id", (8 * slot + e2 % 9973 * 0.000737).alias("x"), (e2 % 9967 * 0.000391).alias("y"), F.lit(40.0).alias("w"), F.lit(80.0).alias("h"), "score")


@query("d16_non_maximum_suppression", f"""WITH RECURSIVE {ROW.format(slot='(track_id % 22)')}, rk AS (SELECT *, row_number() OVER (PARTITION BY seq, frame_id ORDER BY score DESC, track_id) AS k FROM mv),
kp AS (SELECT seq, frame_id, k, track_id, true AS keep, [struct_pack(x := x, y := y)] AS kept FROM rk WHERE k = 1
  UNION ALL SELECT seq, frame_id, k, track_id, free, CASE WHEN free THEN list_append(kept, struct_pack(x := x, y := y)) ELSE kept END FROM (SELECT rk.*, kept, len(list_filter(kept, lambda e: {OVER.format(o='rk.')} > 0.5 * (6400 - {OVER.format(o='rk.')}))) = 0 AS free FROM kp JOIN rk ON rk.seq = kp.seq AND rk.frame_id = kp.frame_id AND rk.k = kp.k + 1))
SELECT seq, frame_id, track_id FROM kp WHERE keep""")
def _(v):
    """A box over a box that went stays."""
    return J.suppressed(in_a_row(v, F.col("track_id") % 22)).select("seq", "frame_id", "track_id")


@query("d17_reassociation", f"""WITH RECURSIVE {ROW.format(slot='((track_id + frame_id) % 22)')}, dt AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame_id, score DESC, track_id) AS k FROM mv),
go AS (SELECT seq, 0::BIGINT AS k, 0::BIGINT AS frame_id, NULL::BIGINT AS track_id, NULL::BIGINT AS matched, []::STRUCT(t BIGINT, f BIGINT, x DOUBLE, y DOUBLE)[] AS mem, []::STRUCT(t BIGINT, f BIGINT, x DOUBLE, y DOUBLE)[] AS cur, []::BIGINT[] AS used FROM (SELECT DISTINCT seq FROM dt)
  UNION ALL SELECT seq, k, frame_id, track_id, m, mem, list_append(cur, struct_pack(t := track_id, f := frame_id, x := x, y := y)), CASE WHEN m IS NULL THEN used ELSE list_append(used, m) END
  FROM (SELECT *, list_reverse_sort(list_filter(list_transform(list_filter(mem, lambda e: NOT list_contains(used, e.t)), lambda e: struct_pack(o := {OVER.format(o='z.')} / (6400 - {OVER.format(o='z.')}), t := e.t)), lambda c: c.o >= 0.4))[1].t AS m
    FROM (SELECT d.*, CASE WHEN d.frame_id = go.frame_id THEN cur ELSE [] END AS cur, CASE WHEN d.frame_id = go.frame_id THEN used ELSE [] END AS used,
      CASE WHEN d.frame_id = go.frame_id THEN mem ELSE list_filter(list_concat(list_filter(mem, lambda e: NOT list_contains(list_transform(cur, lambda c: c.t), e.t)), cur), lambda e: d.frame_id - e.f <= 2) END AS mem FROM go JOIN dt d ON d.seq = go.seq AND d.k = go.k + 1) z))
SELECT seq, frame_id, track_id, matched FROM go WHERE k > 0""")
def _(v):
    """Several boxes compete for each place that another track held before."""
    return J.reassociated(in_a_row(v, (F.col("track_id") + F.col("frame_id")) % 22), 0.4, 2)
