"""Identity: fusion, peaks, switches, duplicates, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import exprs as X
from touchline.operators import identity as I
from touchline.plans.joins import LINKS, frags
from touchline.plans.registry import query


@query("f7_top_k_frames", "SELECT track_id, frame_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seq, track_id ORDER BY quality DESC, frame_id) AS r, count(*) OVER (PARTITION BY seq, track_id) AS n FROM v_post) WHERE r <= 16 AND n >= 8")
def _(v):
    return I.top_frames(v.post).select("track_id", "frame_id", "rank")


@query("f6_quality_peaks", "SELECT track_id, frame_id FROM (SELECT *, lag(quality) OVER w AS b, lead(quality) OVER w AS a FROM v_post WINDOW w AS (PARTITION BY seq, track_id ORDER BY frame_id)) WHERE quality >= 0.3 AND (b IS NULL OR quality > b) AND (a IS NULL OR quality > a)")
def _(v):
    return I.peaks(v.post).select("track_id", "frame_id")


@query("i16_legibility_gate", "SELECT track_id, frame_id FROM (SELECT *, count(*) FILTER (WHERE legibility >= 0.95) OVER (PARTITION BY seq, track_id) AS n FROM v_post) WHERE n < 4 OR legibility >= 0.95")
def _(v):
    return I.gated(v.post, 0.95).select("track_id", "frame_id")


FUSE = "fl AS (SELECT track_id, frame_id, {w} AS wt, unnest(probs) AS p, unnest(range(1, 65)) AS n FROM {src}), sm AS (SELECT track_id, n, sum(wt * {f}) / sum(wt) AS s FROM fl GROUP BY ALL)"


@query("e24_fusion_geometric", f"WITH {FUSE.format(w='quality * legibility', src='v_post', f='ln(p + 1e-10)')}, ex AS (SELECT track_id, n, exp(s - max(s) OVER (PARTITION BY track_id)) AS e FROM sm) SELECT track_id, CAST(n AS INT) AS number, round(e / sum(e) OVER (PARTITION BY track_id), 6) AS p FROM ex")
def _(v):
    f = I.fused(v.post)
    return f.select("track_id", F.posexplode("probs").alias("i", "p")).select("track_id", (F.col("i") + 1).alias("number"), F.round("p", 6).alias("p"))


@query("e24_fusion_arithmetic", f"WITH {FUSE.format(w='quality * legibility', src='v_post', f='p')} SELECT track_id, CAST(n AS INT) AS number, round(s / sum(s) OVER (PARTITION BY track_id), 6) AS p FROM sm")
def _(v):
    f = I.fused(v.post, "arithmetic")
    return f.select("track_id", F.posexplode("probs").alias("i", "p")).select("track_id", (F.col("i") + 1).alias("number"), F.round("p", 6).alias("p"))


@query("e24_fusion_top_k", f"WITH tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY quality DESC, frame_id) AS r, count(*) OVER (PARTITION BY track_id) AS c FROM v_post) WHERE r <= greatest(2, ceil(c * 0.5))), {FUSE.format(w='quality * legibility', src='tk', f='ln(p + 1e-10)')} SELECT track_id, CAST(arg_max(n, s) AS INT) AS number FROM sm GROUP BY track_id")
def _(v):
    return I.fused(v.post, "top_k").select("track_id", X.top1(F.col("probs"))["number"].alias("number"))


@query("e25_peak_scores", "WITH pk AS (SELECT * FROM (SELECT *, lag(quality) OVER w AS b, lead(quality) OVER w AS a FROM v_post WINDOW w AS (PARTITION BY seq, track_id ORDER BY frame_id)) WHERE quality >= 0.3 AND (b IS NULL OR quality > b) AND (a IS NULL OR quality > a)) SELECT track_id, CAST(list_position(probs, list_max(probs)) AS INT) AS number, round(sum(quality * list_max(probs)), 6) AS score FROM pk GROUP BY 1, 2")
def _(v):
    s = I.peak_scores(I.peaks(v.post))
    return s.select("track_id", F.explode("scores").alias("number", "score")).select("track_id", "number", F.round("score", 6).alias("score"))


#: A number before and one after a frame of the track's own, a fifth of the rows others.
SWITCH = """nb AS (SELECT seq, track_id, row_number() OVER (PARTITION BY seq, track_id ORDER BY frame_id) AS i, CASE WHEN event_id % 5 = 0 THEN event_id % 3 WHEN frame_id <= 4 + track_id % 40 THEN 14 ELSE 9 END AS number FROM v_num),
sz AS (SELECT seq, track_id, count(*) AS n FROM nb GROUP BY ALL), sp AS (SELECT seq, track_id, n, unnest(range(8, n - 7)) AS split FROM sz),
co AS (SELECT sp.seq, sp.track_id, n, split, i <= split AS lft, number, count(*) AS c FROM sp JOIN nb USING (seq, track_id) GROUP BY ALL),
md AS (SELECT seq, track_id, n, split, lft, arg_max(number, (c, -number)) AS mode, max(c) AS c FROM co GROUP BY ALL),
cd AS (SELECT l.seq, l.track_id, l.split, l.mode AS lm, r.mode AS rm, l.c / l.split::DOUBLE AS ls, r.c / (l.n - l.split)::DOUBLE AS rs, least(l.split, l.n - l.split) AS m FROM md l JOIN md r ON l.seq = r.seq AND l.track_id = r.track_id AND l.split = r.split AND l.lft AND NOT r.lft),
bs AS (SELECT *, row_number() OVER (PARTITION BY seq, track_id ORDER BY ls * rs * m DESC, split) AS k FROM cd WHERE lm <> rm AND ls >= 0.6 AND rs >= 0.6)"""


@query("f11_mode_switch", f"WITH {SWITCH} SELECT sz.seq, sz.track_id, CAST(split AS INT) AS split, CAST(lm AS INT) AS left_mode, CAST(rm AS INT) AS right_mode FROM sz LEFT JOIN (SELECT * FROM bs WHERE k = 1) b ON b.seq = sz.seq AND b.track_id = sz.track_id")
def _(v):
    number = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 3).when(F.col("frame_id") <= 4 + F.col("track_id") % 40, 14).otherwise(9)
    s = I.mode_switch(v.num.select("seq", "track_id", "frame_id", number.alias("number")))
    return s.select("seq", "track_id", *[F.col(c).cast("int").alias(c) for c in ("split", "left_mode", "right_mode")])


def claims(v):
    """Tracks that claim one of three numbers, with short frame sets; the next
    best of each is one of two."""
    second = F.floor(F.col("track_id") / 4) % 2 + 10
    p = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda n: F.when(n == F.col("track_id") % 3 + 1, F.lit(0.5) + F.col("track_id") % 100 / 1000.0).when(n == second, F.lit(0.35)).otherwise(F.lit(0.0)))
    f = F.array((F.col("track_id") % 4).cast("long"))
    return v.num.select("seq", "track_id", "team_id").distinct().withColumn("probs", p).withColumn("frame_ids", f)


#: kp ranks the claims of a number in a frame; lo ranks the losers that want one
#: other number, in the order of the numbers' first tracks and of confidence.
CLAIM = """cl AS (SELECT DISTINCT seq, track_id, team_id, track_id % 3 + 1 AS number, track_id % 4 AS f, track_id // 4 % 2 + 10 AS second, 0.5::DOUBLE + track_id % 100 / 1000 AS p FROM v_num),
kp AS (SELECT *, row_number() OVER (PARTITION BY seq, team_id, number, f ORDER BY p DESC, track_id) AS r, min(track_id) OVER (PARTITION BY seq, team_id, number) AS lead FROM cl),
lo AS (SELECT *, row_number() OVER (PARTITION BY seq, team_id, f, second ORDER BY lead, p DESC, track_id) AS q FROM kp WHERE r > 1)"""


@query("i15_assignment_per_team", """SELECT seq, track_id, CASE WHEN team >= 0 AND (p >= 0.7 AND p - q >= 0.3 OR p >= 0.4 AND p - q >= 0.1) THEN CAST(track_id % 99 + 1 AS INT) END AS predicted_number, CASE WHEN team < 0 THEN 'unknown' WHEN p >= 0.7 AND p - q >= 0.3 THEN 'locked' WHEN p >= 0.4 AND p - q >= 0.1 THEN 'tentative' ELSE 'unknown' END AS state, CASE WHEN team >= 0 THEN round(p, 6) ELSE 0 END AS confidence
FROM (SELECT DISTINCT seq, track_id, CASE WHEN track_id % 7 = 3 THEN -1 ELSE team_id END AS team, (35 + track_id * 13 % 50) / 100 + 0.001::DOUBLE AS p, (track_id * 7 % 30) / 100::DOUBLE AS q FROM v_num)""")
def _(v):
    """Of some teams and none, with vectors about all thresholds."""
    top, second = (35 + F.col("track_id") * 13 % 50) / 100 + 0.001, F.col("track_id") * 7 % 30 / 100
    probs = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda n: F.when(n == F.col("track_id") % 99 + 1, top).when(n == (F.col("track_id") + 50) % 99 + 1, second).otherwise(F.lit(0.0)))
    team = F.when(F.col("track_id") % 7 == 3, -1).otherwise(F.col("team_id"))
    rows = v.num.select("seq", "track_id", team.alias("team_id")).distinct().withColumn("probs", probs).withColumn("frame_ids", F.array(F.lit(1).cast("long")))
    return I.assigned(rows, 0.7, 0.3).select("seq", "track_id", "predicted_number", "state", F.round("confidence", 6).alias("confidence"))


@query("f17_duplicate_numbers", f"WITH {CLAIM} SELECT seq, track_id, CASE WHEN r = 1 THEN number END AS predicted_number, CASE WHEN r = 1 THEN 'tentative' ELSE 'unknown' END AS state FROM kp")
def _(v):
    return I.resolved(I.assigned(claims(v), 0.95, 0.2)).select("seq", "track_id", "predicted_number", "state")


@query("f18_conflict_alternatives", f"WITH {CLAIM} SELECT kp.seq, kp.track_id, CASE WHEN kp.r = 1 THEN kp.number WHEN q = 1 THEN lo.second END AS predicted_number, CASE WHEN kp.r = 1 OR q = 1 THEN 'tentative' ELSE 'unknown' END AS state, CASE WHEN q = 1 THEN kp.number END AS reassigned_from FROM kp LEFT JOIN lo ON lo.seq = kp.seq AND lo.track_id = kp.track_id")
def _(v):
    return I.resolved(I.assigned(claims(v), 0.95, 0.2), True).select("seq", "track_id", "predicted_number", "state", "reassigned_from")


#: Links one by one in their order: each end and each start is used once.
GREEDY = f"""{LINKS.replace('WITH ', 'WITH RECURSIVE ', 1)}, ok AS (SELECT seq, a, b, row_number() OVER (PARTITION BY seq ORDER BY gap, round(dist, 6), a, b) AS k FROM c WHERE dist <= least(300, 40 + 6 * gap + 0.5 * size)),
go AS (SELECT seq, 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub FROM (SELECT DISTINCT seq FROM fr)
  UNION ALL SELECT go.seq, ok.k, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END FROM go JOIN ok ON ok.seq = go.seq AND ok.k = go.k + 1),
ln AS (SELECT seq, unnest(ua) AS a, unnest(ub) AS b FROM (SELECT seq, arg_max(ua, k) AS ua, arg_max(ub, k) AS ub FROM go GROUP BY seq)),
ch AS (SELECT fr.seq, fr.track_id, fr.track_id AS group_id FROM fr WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.seq = fr.seq AND ln.b = fr.track_id)
  UNION ALL SELECT ch.seq, ln.b, ch.group_id FROM ch JOIN ln ON ln.seq = ch.seq AND ln.a = ch.track_id)"""


def linked(v):
    f = frags(v)
    return I.linked(I.link_candidates(f).withColumn("dist", F.round("dist", 6)), f)


@query("g6_greedy_links", f"{GREEDY} SELECT seq, track_id, group_id FROM ch")
def _(v):
    return linked(v)


@query("i14_linked_groups", f"{GREEDY} SELECT seq, group_id, count(*) AS n_fragments FROM ch GROUP BY seq, group_id")
def _(v):
    return linked(v).groupBy("seq", "group_id").agg(F.count("*").alias("n_fragments"))


@query("i17_pooled_fusion", f"""WITH gp AS (SELECT *, seq * 10 + (track_id - seq * 10) // 3 * 3 AS grp, list_position(probs, list_max(probs)) AS top FROM v_post),
sh AS (SELECT *, count(*) OVER (PARTITION BY grp, top) / (count(*) OVER (PARTITION BY grp))::DOUBLE AS share FROM gp), kt AS (SELECT seq, grp AS track_id, quality, legibility, probs FROM (SELECT *, max(share) OVER (PARTITION BY grp) AS most FROM sh) WHERE share >= 0.02 OR share = most),
{FUSE.format(w='quality * legibility', src='(SELECT *, 0 AS frame_id FROM kt)', f='ln(p + 1e-10)')}, ex AS (SELECT track_id, n, exp(s - max(s) OVER (PARTITION BY track_id)) AS e FROM sm), fu AS (SELECT track_id AS grp, n, e / sum(e) OVER (PARTITION BY track_id) AS p FROM ex)
SELECT t.track_id, t.grp AS group_id, CAST(n AS INT) AS number, round(p, 6) AS p FROM (SELECT DISTINCT track_id, grp FROM gp) t JOIN fu USING (grp)""")
def _(v):
    """Three tracks of a sequence to a group; numbers of few frames are left out."""
    groups = v.post.select("seq", "track_id").distinct().withColumn("group_id", F.col("seq") * 10 + F.floor((F.col("track_id") - F.col("seq") * 10) / 3) * 3)
    one = I.pooled(v.post, groups, 0.02).select("track_id", "group_id", F.posexplode("probs").alias("i", "p"))
    return one.select("track_id", "group_id", (F.col("i") + 1).alias("number"), F.round("p", 6).alias("p"))


@query("i20_best_variant", "SELECT track_id, frame_id, CAST(arg_max(k, (s, -k)) AS INT) AS variant FROM (SELECT track_id, frame_id, k, quality * ((frame_id * (k + 3)) % 11) / 11 AS s FROM v_post CROSS JOIN range(0, 6) t(k)) GROUP BY 1, 2")
def _(v):
    crops = v.post.select("seq", "track_id", "frame_id", "quality", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("variant")).withColumn("legibility", ((F.col("frame_id") * (F.col("variant") + 3)) % 11) / 11)
    return I.best_variant(crops).select("track_id", "frame_id", "variant")
