"""Teams and roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import teams as T
from touchline.plans.joins import NEAR
from touchline.plans.registry import query

W, H = 1920.0, 1080.0


@query("e20_mean_descriptor", "SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings CROSS JOIN range(1, 65) t(i) GROUP BY label, i")
def _(v):
    m = T.mean_descriptor(v.table("embeddings"), "embedding", "label")
    return m.select("label", F.posexplode("mean").alias("dim", "mean")).select("label", "dim", F.round("mean", 6).alias("mean"))


@query("e21_motion_ratio", "SELECT seq, track_id, round(stddev_pop(x) / 1920, 6) AS std_x, round(stddev_pop(y) / 1080, 6) AS std_y FROM v_box GROUP BY seq, track_id")
def _(v):
    s = T.side_stats(v.box.withColumn("cx", F.col("x")).withColumn("cy", F.col("y")), W, H)
    return s.select("seq", "track_id", F.round("std_x", 6).alias("std_x"), F.round("std_y", 6).alias("std_y"))


VOTES = "vt AS (SELECT seq, track_id, count(*) AS seen, count(*) FILTER (WHERE event_id % 7 = 4) AS rv, count(*) FILTER (WHERE event_id % 7 IN (2, 3)) AS gv FROM v_num GROUP BY ALL)"


def voted(v):
    rows = v.num.withColumn("cls", (F.col("event_id") % 7).cast("int"))
    return T.role_votes(rows, T.inferred_classes(rows))


@query("e22_role_by_votes", f"WITH {VOTES} SELECT seq, track_id, CASE WHEN rv >= greatest(gv, seen - rv - gv) THEN 'referee' WHEN gv >= greatest(rv, seen - rv - gv) THEN 'goalkeeper' ELSE 'player' END AS role FROM vt")
def _(v):
    return voted(v).select("seq", "track_id", "role")


@query("i8_soft_roles", f"WITH {VOTES}, r AS (SELECT *, CASE WHEN rv >= greatest(gv, seen - rv - gv) THEN 'referee' WHEN gv >= greatest(rv, seen - rv - gv) THEN 'goalkeeper' ELSE 'player' END AS role FROM vt) SELECT seq, track_id, role <> 'referee' AND seen >= 12 AND rv >= 15 AND rv / seen::DOUBLE >= 0.05 AS soft_referee, NOT (role = 'referee' AND seen >= 12) AND seen >= 20 AND gv >= 8 AND gv / seen::DOUBLE >= 0.3 AS soft_keeper FROM r")
def _(v):
    return T.soft_roles(voted(v)).select("seq", "track_id", "soft_referee", "soft_keeper")


@query("e23_distance_p70", "SELECT seq, team_id, CASE WHEN count(*) >= 4 THEN round(quantile_cont(value, 0.7), 6) ELSE 0 END AS p70 FROM v_num GROUP BY seq, team_id")
def _(v):
    return v.num.groupBy("seq", "team_id").agg(F.when(F.count("*") >= 4, F.round(F.percentile("value", 0.7), 6)).otherwise(0.0).alias("p70"))


@query("g8_top_referees", f"WITH {VOTES}, r AS (SELECT *, CASE WHEN rv >= greatest(gv, seen - rv - gv) THEN 'referee' WHEN gv >= greatest(rv, seen - rv - gv) THEN 'goalkeeper' ELSE 'player' END AS role FROM vt), sc AS (SELECT *, role <> 'referee' AND rv >= 15 AS sr, NOT (role = 'referee' AND seen >= 12) AND seen >= 20 AND gv >= 8 AND gv / seen::DOUBLE >= 0.3 AS sk, (track_id % 13) / 13.0::DOUBLE AS md FROM r), s AS (SELECT *, CASE WHEN role = 'referee' AND seen >= 12 THEN rv / seen::DOUBLE + 10 WHEN sr AND NOT sk THEN 5 + rv * 0.01::DOUBLE WHEN NOT sr AND NOT sk AND md > 0.5 THEN md END AS score FROM sc) SELECT seq, track_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, track_id) AS k FROM s WHERE score IS NOT NULL) WHERE k <= 2")
def _(v):
    return T.referees(T.soft_roles(voted(v)).withColumn("min_dist", (F.col("track_id") % 13) / 13.0)).select("seq", "track_id", "rank")


#: Two groups of tracks, of unlike size, in sequences of 30; the first stands
#: left in even sequences and right in odd ones.
GROUPS = "gp AS (SELECT CAST(floor(vec_id / 30) AS BIGINT) AS seq, vec_id AS track_id, CASE WHEN vec_id * 7 % 5 < 2 THEN 1 ELSE 0 END AS g FROM embeddings), tm AS (SELECT *, CAST(CASE WHEN seq % 2 = 0 THEN g ELSE 1 - g END AS INT) AS team FROM gp)"


def vectors(v):
    """The tracks of GROUPS, a mean descriptor each: groups lie 2.4 apart, and
    vectors of length 1 about them."""
    rows = v.table("embeddings").select(F.floor(F.col("vec_id") / 30).cast("long").alias("seq"), F.col("vec_id").alias("track_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    g = F.when(F.col("track_id") * 7 % 5 < 2, 1).otherwise(0)
    left = g == F.col("seq") % 2
    return rows.withColumn("mean", F.transform("e", lambda x: x + 0.3 * g)).withColumn("x", F.when(left, 300.0).otherwise(900.0) + F.col("track_id") % 10).drop("e")


def labelled(v):
    d = vectors(v)
    return T.normalised_labels(T.clustered(d.select("seq", "track_id", "mean")).join(d.select("seq", "track_id", "x"), ["seq", "track_id"]))


@query("i1_kmeans_teams", f"WITH {GROUPS} SELECT seq, track_id, team FROM tm")
def _(v):
    return labelled(v)


@query("i3_normalised_labels", f"WITH {GROUPS} SELECT seq, team, count(*) AS n FROM tm GROUP BY seq, team")
def _(v):
    return labelled(v).groupBy("seq", "team").agg(F.count("*").alias("n"))


@query("i2_outlier_clusters", """WITH p AS (SELECT CAST(floor(vec_id / 30) AS BIGINT) AS seq, vec_id AS track_id, vec_id * 37 % 101 AS x, vec_id * 53 % 89 AS y FROM embeddings),
nr AS (SELECT a.seq, a.track_id AS a, b.track_id AS b FROM p a JOIN p b ON a.seq = b.seq AND (a.x - b.x)^2 + (a.y - b.y)^2 <= 400.5), co AS (SELECT a FROM nr GROUP BY a HAVING count(*) >= 3)
SELECT seq, track_id, NOT EXISTS (SELECT 1 FROM nr JOIN co ON nr.b = co.a WHERE nr.a = p.track_id) AS is_outlier FROM p""")
def _(v):
    """Points of a grid: those within 0.2 of no point that has two others so near are outliers."""
    xy = F.array(F.col("track_id") * 37 % 101 / 100, F.col("track_id") * 53 % 89 / 100)
    d = vectors(v).withColumn("mean", xy)
    # 400.5 of the SQL's squares lies between whole numbers: a point at just 0.2 is near
    return T.clustered(d.select("seq", "track_id", "mean"), "outlier", 0.2001).select("seq", "track_id", F.col("outlier").alias("is_outlier"))


@query("i4_nearest_centre", "WITH c AS (SELECT CAST(label AS BIGINT) AS seq, list(avg_v ORDER BY i) AS a FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS avg_v FROM embeddings CROSS JOIN range(1, 65) t(i) GROUP BY ALL) GROUP BY label), d AS (SELECT e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), a) AS d0, list_distance(CAST(e.embedding AS DOUBLE[]), list_transform(a, lambda x: -x)) AS d1 FROM embeddings e JOIN c ON c.seq = e.label) SELECT vec_id AS track_id, CASE WHEN d0 <= d1 THEN 0 ELSE 1 END AS team, round(1 - least(d0, d1) / (d0 + d1 + 1e-9), 6) AS confidence FROM d")
def _(v):
    rows = v.table("embeddings").select(F.col("label").cast("long").alias("seq"), F.col("vec_id").alias("track_id"), F.transform("embedding", lambda x: x.cast("double")).alias("feat"))
    m = T.mean_descriptor(rows, "feat", "seq")
    both = m.select("seq", F.lit(0).alias("team"), F.col("mean").alias("centre")).union(m.select("seq", F.lit(1), F.transform("mean", lambda x: -x)))
    return T.nearest_centre(rows, both).select("track_id", "team", F.round("confidence", 6).alias("confidence"))


@query("i5_cluster_accuracy", f"WITH {GROUPS} SELECT seq, count(*) AS n, round(avg(CASE WHEN (track_id % 7 = 0) = (team <> g) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM tm GROUP BY seq")
def _(v):
    """Against a truth that differs from the group in one of seven tracks."""
    g = F.when(F.col("track_id") * 7 % 5 < 2, 1).otherwise(0)
    truth = F.when(F.col("track_id") % 7 == 0, 1 - g).otherwise(g)
    t = labelled(v).where("team >= 0")
    return t.groupBy("seq").agg(F.count("*").alias("n"), F.round(F.avg((F.col("team") == truth).cast("double")), 6).alias("accuracy"))


@query("i6_forced_reassignment", f"WITH {GROUPS} SELECT track_id, CAST(g AS INT) AS team FROM gp WHERE track_id % 10 IN (3, 4) AND EXISTS (SELECT 1 FROM gp o WHERE o.seq = gp.seq AND o.g = 0 AND o.track_id % 10 NOT IN (3, 4)) AND EXISTS (SELECT 1 FROM gp o WHERE o.seq = gp.seq AND o.g = 1 AND o.track_id % 10 NOT IN (3, 4))")
def _(v):
    """Outliers take the team of the nearer centre."""
    d = vectors(v).withColumnRenamed("mean", "feat").withColumn("team", F.when(F.col("track_id") * 7 % 5 < 2, 1).otherwise(0))
    centres = T.mean_descriptor(d.where("track_id % 10 NOT IN (3, 4)"), "feat", "seq", "team").withColumnRenamed("mean", "centre")
    both = centres.join(centres.groupBy("seq").agg(F.count("*").alias("_n")).where("_n = 2").select("seq"), "seq", "left_semi")
    return T.nearest_centre(d.where("track_id % 10 IN (3, 4)").select("seq", "track_id", "feat"), both).select("track_id", "team")


@query("i7_usable_tracks", "SELECT seq, track_id FROM (SELECT seq, track_id, min(role) AS role, count(*) AS n FROM v_num GROUP BY ALL) WHERE n >= 8 AND role = 'player'")
def _(v):
    t = v.num.groupBy("seq", "track_id").agg(F.min("role").alias("role"), F.count("*").alias("n"))
    return T.usable(t).select("seq", "track_id")


def others(v):
    return v.box.where("track_id % 25 <> 0").select("seq", "frame_id", "track_id", "team_id", "x", "y")


@query("i9_edge_keepers", "WITH s AS (SELECT seq, track_id, count(*) AS n, count(*) FILTER (WHERE x < 0.14 * 1920) AS l, count(*) FILTER (WHERE x > 0.86 * 1920) AS r FROM v_box GROUP BY ALL), c AS (SELECT *, greatest(l, r) / n::DOUBLE AS er, CASE WHEN l >= r THEN 'left' ELSE 'right' END AS side FROM s WHERE n >= 20) SELECT seq, side, track_id, round(er + 0.6 * ra, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY seq, side ORDER BY er + 0.6::DOUBLE * ra DESC, track_id) AS k FROM (SELECT *, (track_id % 11) / 11.0::DOUBLE AS ra FROM c WHERE er >= 0.3)) WHERE k = 1")
def _(v):
    s = T.side_stats(v.box.withColumn("cx", F.col("x")).withColumn("cy", F.col("y")), W, H).withColumn("rarity", (F.col("track_id") % 11) / 11.0)
    return T.edge_keepers(s).select("seq", "side", "track_id", F.round("score", 6).alias("score"))


@query("i9_keeper_votes", f"WITH {NEAR} SELECT seq, keeper_id AS track_id, count(*) FILTER (WHERE team_id = 0) AS votes_a, count(*) FILTER (WHERE team_id = 1) AS votes_b, CASE WHEN count(*) FILTER (WHERE team_id = 0) >= count(*) FILTER (WHERE team_id = 1) THEN 0 ELSE 1 END AS team FROM near GROUP BY seq, keeper_id")
def _(v):
    return T.neighbour_votes(v.box.where("track_id % 25 = 0"), others(v)).select("seq", "track_id", "votes_a", "votes_b", "team")


@query("i10_fused_keepers", f"""WITH {NEAR}, ct AS (SELECT seq, frame_id, avg(x) FILTER (WHERE team_id = 0) AS x0, avg(y) FILTER (WHERE team_id = 0) AS y0, avg(x) FILTER (WHERE team_id = 1) AS x1, avg(y) FILTER (WHERE team_id = 1) AS y1 FROM v_box WHERE track_id % 25 <> 0 GROUP BY 1, 2),
sp AS (SELECT k.seq, k.frame_id, k.track_id, coalesce(1 / (1 + sqrt((k.x - x0)^2 + (k.y - y0)^2) / 1920), 0) AS s0, coalesce(1 / (1 + sqrt((k.x - x1)^2 + (k.y - y1)^2) / 1920), 0) AS s1 FROM v_box k JOIN ct USING (seq, frame_id) WHERE k.track_id % 25 = 0),
nb AS (SELECT seq, frame_id, keeper_id AS track_id, sum(CASE WHEN team_id = 0 THEN 1 / (dist + 1) ELSE 0 END) / sum(1 / (dist + 1)) AS n0 FROM near GROUP BY 1, 2, 3)
SELECT seq, track_id, round(avg(0.55 * s0 + 0.35 * n0), 5) AS score_a, round(avg(0.55 * s1 + 0.35 * (1 - n0)), 5) AS score_b FROM sp JOIN nb USING (seq, frame_id, track_id) GROUP BY seq, track_id""")
def _(v):
    f = T.fused_keepers(v.box.where("track_id % 25 = 0"), others(v), W)
    return f.select("seq", "track_id", F.round("score_a", 5).alias("score_a"), F.round("score_b", 5).alias("score_b"))


LONG = "lg AS (SELECT 0 AS seq, event_id + 1 AS frame_id, user_id % 4 AS track_id FROM events), up AS (SELECT unnest(range(40, (SELECT max(frame_id) FROM lg) + 1, 40)) AS wend UNION SELECT max(frame_id) FROM lg)"


def long_track(v):
    return v.table("events").select((F.col("user_id") % 1).alias("seq"), (F.col("event_id") + 1).alias("frame_id"), (F.col("user_id") % 4).alias("track_id"), "value")


@query("f8_sliding_windows", f"WITH {LONG} SELECT wend AS \"end\", count(*) AS n FROM up JOIN lg ON frame_id > wend - 220 AND frame_id <= wend GROUP BY wend")
def _(v):
    return T.windowed(long_track(v)).groupBy("end").agg(F.count("*").alias("n"))


#: Windows and their rows as they are defined: every window with every row in it.
CANDIDATES = """lf AS (SELECT seq, max(frame_id) AS last FROM v_box GROUP BY seq), en AS (SELECT seq, unnest(range(40, last + 1, 40)) AS wend FROM lf UNION SELECT seq, last FROM lf),
st AS (SELECT b.seq, wend, track_id, count(*) AS n, count(*) FILTER (WHERE x / 1920 < 0.14) AS l, count(*) FILTER (WHERE x / 1920 > 0.86) AS r, stddev_pop(x / 1920) AS sx, stddev_pop(y / 1080) AS sy FROM v_box b JOIN en ON b.seq = en.seq AND frame_id > wend - 220 AND frame_id <= wend GROUP BY ALL),
ca AS (SELECT *, greatest(l, r) / n::DOUBLE + 0.6::DOUBLE * {rarity} AS score, CASE WHEN l >= r THEN 'left' ELSE 'right' END AS side FROM st WHERE n >= 20 AND greatest(l, r) / n::DOUBLE >= 0.3),
wh AS (SELECT DISTINCT seq, track_id FROM ca),
nb AS (SELECT k.seq, k.frame_id, k.track_id, o.team_id, row_number() OVER (PARTITION BY k.seq, k.frame_id, k.track_id ORDER BY sqrt((k.x - o.x)^2 + (k.y - o.y)^2), o.track_id) AS i FROM v_box k JOIN wh ON wh.seq = k.seq AND wh.track_id = k.track_id JOIN v_box o ON o.seq = k.seq AND o.frame_id = k.frame_id AND o.track_id <> k.track_id),
vt AS (SELECT nb.seq, wend, track_id, count(*) FILTER (WHERE team_id = 0) AS a, count(*) FILTER (WHERE team_id = 1) AS b FROM nb JOIN en ON nb.seq = en.seq AND frame_id > wend - 220 AND frame_id <= wend WHERE i <= 4 GROUP BY ALL),
cm AS (SELECT ca.*, coalesce(a, 0) + coalesce(b, 0) AS votes, abs(coalesce(a, 0) - coalesce(b, 0)) / greatest(coalesce(a, 0) + coalesce(b, 0), 1)::DOUBLE AS margin FROM ca LEFT JOIN vt USING (seq, wend, track_id)),
rk AS (SELECT *, score + 0.6::DOUBLE * margin AS combined FROM cm),
ld AS (SELECT *, row_number() OVER w AS k, lead(combined) OVER w AS c2, lead(margin) OVER w AS m2 FROM rk WINDOW w AS (PARTITION BY seq, wend, side ORDER BY combined DESC, track_id)),
pp AS (SELECT seq, wend, side, CASE WHEN score >= 0.4 AND votes >= 12 AND margin >= 0.12 AND sx <= 0.08 AND sy <= 0.12 AND (c2 IS NULL OR (combined - c2 >= 0.12 AND margin - m2 >= 0.1)) THEN track_id END AS proposed, combined FROM ld WHERE k = 1)"""


@query("f9_window_candidates", f"WITH {CANDIDATES.format(rarity='(track_id % 11) / 11')} SELECT seq, wend AS \"end\", side, proposed, round(combined, 6) AS combined FROM pp")
def _(v):
    rows = v.box.select("seq", "frame_id", "track_id", "team_id", "x", "y")
    rarity = rows.select("seq", "track_id").distinct().withColumn("rarity", (F.col("track_id") % 11).cast("double"))
    return T.window_candidates(rows, W, H, rarity, 11.0).withColumn("combined", F.round("combined", 6))


#: What holds after each window: two equal proposals in a row decide, one by one.
HOLD = """rn AS (SELECT *, row_number() OVER (PARTITION BY seq, side ORDER BY wend) AS n FROM pp),
hd AS (SELECT seq, side, wend, n, proposed, NULL::BIGINT AS now, proposed AS pending, 1 AS times FROM rn WHERE n = 1
  UNION ALL SELECT r.seq, r.side, r.wend, r.n, r.proposed, CASE WHEN r.proposed IS NOT DISTINCT FROM pending AND times >= 1 AND r.proposed IS DISTINCT FROM now THEN r.proposed ELSE now END,
    CASE WHEN r.proposed IS NOT DISTINCT FROM now OR (r.proposed IS NOT DISTINCT FROM pending AND times >= 1) THEN NULL ELSE r.proposed END,
    CASE WHEN r.proposed IS NOT DISTINCT FROM now OR (r.proposed IS NOT DISTINCT FROM pending AND times >= 1) THEN 0 ELSE 1 END
  FROM hd JOIN rn r ON r.seq = hd.seq AND r.side = hd.side AND r.n = hd.n + 1)"""
PROPOSED = "pp AS (SELECT CAST(floor(user_id / 22) AS BIGINT) AS seq, 'left' AS side, event_id AS wend, CASE WHEN event_id % 9 < 8 THEN CAST(event_id % 100 // 50 + event_id % 3 // 2 AS BIGINT) END AS proposed FROM events)"


def proposals(v):
    p = F.when(F.col("event_id") % 9 < 8, F.floor(F.col("event_id") % 100 / 50) + F.floor(F.col("event_id") % 3 / 2)).cast("long")
    return v.table("events").select(F.floor(F.col("user_id") / 22).cast("long").alias("seq"), F.lit("left").alias("side"), F.col("event_id").alias("end"), p.alias("proposed"))


@query("f10_hysteresis", f"WITH RECURSIVE {PROPOSED}, {HOLD} SELECT seq, wend AS \"end\", now AS keeper FROM hd")
def _(v):
    return T.hysteresis(proposals(v)).select("seq", "end", "keeper")


@query("i11_temporal_keepers", f"WITH RECURSIVE {CANDIDATES.format(rarity='0')}, {HOLD} SELECT seq, side, arg_max(now, (n, -now)) AS keeper, max(n) AS windows FROM (SELECT seq, side, now, count(*) AS n FROM hd WHERE now IS NOT NULL GROUP BY ALL) GROUP BY seq, side")
def _(v):
    """Boxes of a track stand in nearly one place here, so candidates repeat."""
    rows = v.box.select("seq", "frame_id", "track_id", "team_id", "x", "y")
    rarity = rows.select("seq", "track_id").distinct().withColumn("rarity", F.lit(0.0))
    return T.voted_keepers(T.hysteresis(T.window_candidates(rows, W, H, rarity).select("seq", "end", "side", "proposed")))


#: Crops of four colours, one for a team and its keeper; referees wear a fifth
#: and a sixth of the detections of each track has another class.
PHASE = """vt AS (SELECT seq, track_id, count(*) AS seen, count(*) FILTER (WHERE cls = 4) AS rv, count(*) FILTER (WHERE cls IN (2, 3)) AS gv FROM (SELECT *, CASE WHEN event_id % 6 = 0 THEN 5 WHEN track_id % 25 = 0 THEN 3 WHEN track_id % 25 = 1 THEN 4 ELSE 0 END AS cls FROM v_num) GROUP BY ALL),
rl AS (SELECT seq, track_id, seen, CASE WHEN rv * 2 >= seen OR (rv >= 15 AND rv >= 0.05 * seen) THEN 'referee' WHEN gv * 2 >= seen OR (seen >= 20 AND gv >= 8 AND gv >= 0.3 * seen) THEN 'goalkeeper' ELSE 'player' END AS role FROM vt),
ct AS (SELECT seq, track_id % 2 AS g, avg(x) AS mx FROM (SELECT b.seq, b.track_id, avg(b.x) AS x FROM v_box b JOIN rl USING (seq, track_id) WHERE role = 'player' AND seen >= 8 {first} GROUP BY ALL) GROUP BY ALL),
nm AS (SELECT seq, g, CAST(row_number() OVER (PARTITION BY seq ORDER BY mx) - 1 AS INT) AS team FROM ct),
pl AS (SELECT rl.seq, rl.track_id, role, team FROM rl JOIN nm ON nm.seq = rl.seq AND nm.g = rl.track_id % 2 WHERE role = 'player')"""


def phase(v, **how):
    noise = lambda k: (F.col("event_id") * k % 11) / 55.0
    cls = F.when(F.col("event_id") % 6 == 0, 5).when(F.col("track_id") % 25 == 0, 3).when(F.col("track_id") % 25 == 1, 4).otherwise(0)
    boxes = v.box.withColumn("cls", cls).select("seq", "frame_id", "track_id", "cls", "x", "y")
    side = F.col("track_id") % 2
    crops = v.box.select("seq", "track_id", F.array(side * 0.5 + noise(3), noise(5), 1 - side * 0.4 + noise(7)).alias("feat"))
    return T.team_phase(boxes, crops, W, H, **how)


@query("i12_left_right_from_start", f"WITH {PHASE.format(first='AND b.frame_id <= 15')} SELECT seq, track_id, team FROM pl")
def _(v):
    """Two teams by their crops, left and right by the first frames."""
    t = phase(v, mode="kmeans", first_frames=15)
    return t.where("role = 'player'").select("seq", "track_id", "team")


@query("i13_team_phase_without_referees", f"""WITH {PHASE.format(first='')}, nb AS (SELECT k.seq, k.frame_id, k.track_id, pl.team, row_number() OVER (PARTITION BY k.seq, k.frame_id, k.track_id ORDER BY sqrt((k.x - o.x)^2 + (k.y - o.y)^2), o.track_id) AS i FROM v_box k JOIN rl ON rl.seq = k.seq AND rl.track_id = k.track_id AND role = 'goalkeeper' JOIN v_box o ON o.seq = k.seq AND o.frame_id = k.frame_id JOIN pl ON pl.seq = o.seq AND pl.track_id = o.track_id),
kp AS (SELECT seq, track_id, CASE WHEN count(*) FILTER (WHERE team = 0) >= count(*) FILTER (WHERE team = 1) THEN 0 ELSE 1 END AS team FROM nb WHERE i <= 4 GROUP BY ALL)
SELECT seq, track_id, role, team FROM pl UNION ALL SELECT rl.seq, rl.track_id, role, kp.team FROM rl LEFT JOIN kp USING (seq, track_id) WHERE role = 'goalkeeper' UNION ALL SELECT seq, track_id, role, -1 FROM rl WHERE role = 'referee'""")
def _(v):
    """The whole phase: roles by votes, clusters of crops, labels by place, keepers by their neighbours."""
    return phase(v).select("seq", "track_id", "role", "team")


@query("e31_cluster_quality", """WITH p AS (SELECT vec_id, CAST(floor(vec_id / 30) AS BIGINT) AS seq, vec_id % 2 AS c, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.seq, a.vec_id, a.c, b.c AS oc, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM p a JOIN p b ON a.seq = b.seq GROUP BY ALL),
ab AS (SELECT x.seq, x.vec_id, x.s / (x.n - 1) AS a, y.s / y.n AS b FROM d x JOIN d y ON x.seq = y.seq AND x.vec_id = y.vec_id AND x.c = x.oc AND y.c <> y.oc),
ce AS (SELECT seq, c, list(m ORDER BY i) AS m FROM (SELECT seq, c, i, avg(e[i]) AS m FROM p CROSS JOIN range(1, 65) t(i) GROUP BY ALL) GROUP BY seq, c), sp AS (SELECT p.seq, p.c, avg(list_distance(e, m)) AS s, any_value(m) AS m FROM p JOIN ce ON ce.seq = p.seq AND ce.c = p.c GROUP BY ALL)
SELECT ab.seq, round(avg((b - a) / greatest(a, b)), 6) AS silhouette, round(any_value(db), 6) AS davies_bouldin FROM ab JOIN (SELECT u.seq, (u.s + w.s) / list_distance(u.m, w.m) AS db FROM sp u JOIN sp w ON u.seq = w.seq AND u.c = 0 AND w.c = 1) q ON q.seq = ab.seq GROUP BY ab.seq""")
def _(v):
    rows = v.table("embeddings").select(F.floor(F.col("vec_id") / 30).cast("long").alias("seq"), (F.col("vec_id") % 2).cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("feat"))
    return T.cluster_quality(rows).select("seq", F.round("silhouette", 6).alias("silhouette"), F.round("davies_bouldin", 6).alias("davies_bouldin"))
