"""Aggregations and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.operators import identity as I
from touchline.operators import matching as M
from touchline.operators import metrics as E
from touchline.operators import reports as P
from touchline.operators.running import running
from touchline.plans.joins import MISSED, PAIRS, close
from touchline.plans.registry import query

MATCH = "mt AS (SELECT g.seq, g.frame_id, p.track_id AS pred_id, g.track_id AS gt_id, sqrt((p.x_m - g.x_m)^2 + (p.y_m - g.y_m)^2) AS d FROM v_num p JOIN v_gt g USING (seq, frame_id, track_id) WHERE sqrt((p.x_m - g.x_m)^2 + (p.y_m - g.y_m)^2) <= 3)"


def pairs(v):
    return M.pairs(v.box, v.gtbox)


@query("e4_match_summary", f"WITH {MATCH} SELECT seq, count(*) AS matched, round(count(*) / (SELECT count(*) FROM v_gt x WHERE x.seq = mt.seq)::DOUBLE, 6) AS coverage, round(count(*) / (SELECT count(*) FROM v_num x WHERE x.seq = mt.seq)::DOUBLE, 6) AS precision, round(avg(d), 5) AS mean_error, round(sqrt(avg(d * d)), 5) AS rmse, round(max(d), 5) AS max_error FROM mt GROUP BY seq")
def _(v):
    m = M.by_distance(v.num, v.gt).groupBy("seq").agg(F.count("*").alias("matched"), F.avg("distance_m").alias("mean_error"), F.sqrt(F.avg(F.col("distance_m") ** 2)).alias("rmse"), F.max("distance_m").alias("max_error"))
    n = M.frame_counts(v.num, v.gt).groupBy("seq").agg(F.sum("n_pred").alias("p"), F.sum("n_gt").alias("g"))
    return m.join(n, "seq").select("seq", "matched", F.round(F.col("matched") / F.col("g"), 6).alias("coverage"), F.round(F.col("matched") / F.col("p"), 6).alias("precision"), *[F.round(c, 5).alias(c) for c in ("mean_error", "rmse", "max_error")])


@query("e5_majority_vote", "SELECT seq, track_id, vote, votes FROM (SELECT *, row_number() OVER (PARTITION BY seq, track_id ORDER BY votes DESC, first_frame, vote) AS r FROM (SELECT seq, track_id, event_id % 4 AS vote, count(*) AS votes, min(frame_id) AS first_frame FROM v_num GROUP BY ALL)) WHERE r = 1")
def _(v):
    return M.majority(v.num.withColumn("vote", F.col("event_id") % 4), ["seq", "track_id"], "vote").select("seq", "track_id", "vote", "votes")


@query("e6_confusion_pivot", "SELECT seq, team_id, count(*) FILTER (WHERE event_id % 3 = 0) AS side_0, count(*) FILTER (WHERE event_id % 3 = 1) AS side_1, count(*) FILTER (WHERE event_id % 3 = 2) AS side_2 FROM v_num GROUP BY seq, team_id")
def _(v):
    p = v.num.withColumn("side", F.col("event_id") % 3).groupBy("seq", "team_id").pivot("side", [0, 1, 2]).count()
    return p.select("seq", "team_id", *[F.coalesce(str(k), F.lit(0)).cast("long").alias(f"side_{k}") for k in range(3)])


BALL = """b AS (SELECT coalesce(p.seq, g.seq) AS seq, coalesce(p.frame_id, g.frame_id) AS frame_id, abs(p.x - g.x) AS dist, p.seq IS NOT NULL AS hp, g.seq IS NOT NULL AS hg FROM (SELECT * FROM v_ball WHERE event_type <> 'error') p
FULL JOIN (SELECT seq, frame_id, x + (frame_id % 3) * 0.015::DOUBLE AS x, event_type FROM v_ball WHERE event_type <> 'view') g ON p.seq = g.seq AND p.frame_id = g.frame_id),
st AS (SELECT *, coalesce(dist <= 0.02, false) AS tp, hp AND NOT coalesce(dist <= 0.02, false) AS fp, hg AND NOT coalesce(dist <= 0.02, false) AS fn FROM b)"""


def ball(v):
    g = v.ball.where("event_type <> 'view'").withColumn("x", F.col("x") + (F.col("frame_id") % 3) * 0.015)
    return E.ball_status(v.ball.where("event_type <> 'error'"), g)


@query("e7_ball_report", f"WITH {BALL}, c AS (SELECT seq, count(*) FILTER (WHERE tp) AS tp, count(*) FILTER (WHERE fp) AS fp, count(*) FILTER (WHERE fn) AS fn, sqrt(avg(dist * dist)) AS rmse, count(*) AS n FROM st GROUP BY seq) SELECT seq, tp, fp, fn, round(tp / (tp + fp + 1e-6), 6) AS precision, round(tp / (tp + fn + 1e-6), 6) AS recall, round(rmse, 5) AS rmse, round(fp / n::DOUBLE, 6) AS fppi FROM c")
def _(v):
    r = E.ball_report(ball(v))
    return r.select("seq", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("rmse", 5).alias("rmse"), F.round("fppi", 6).alias("fppi"))


@query("e8_iou50_variants", f"WITH {PAIRS}, n AS (SELECT g.seq, count(*) AS n_gt, count(p_id) AS tp FROM v_gtbox g LEFT JOIN pairs ON pairs.seq = g.seq AND pairs.frame_id = g.frame_id AND g_id = g.track_id AND p_id = g_id AND iou >= 0.9 GROUP BY g.seq), m AS (SELECT g.seq, count(*) AS both_seen FROM v_gtbox g JOIN v_box p USING (seq, frame_id, track_id) GROUP BY g.seq) SELECT seq, tp, n_gt - tp AS fn_counted, n_gt - both_seen AS fn_not_counted FROM n JOIN m USING (seq)")
def _(v):
    p = M.prefixed(v.box, "p_").withColumn("track_id", F.col("p_track_id"))
    from touchline.functions import exprs as X

    both = M.prefixed(v.gtbox, "g_").withColumn("track_id", F.col("g_track_id")).join(p, ["seq", "frame_id", "track_id"], "left").withColumn("iou", X.iou(X.box("p_"), X.box("g_")))
    good = F.coalesce(F.col("iou") >= 0.9, F.lit(False))
    return both.groupBy("seq").agg(F.count_if(good).alias("tp"), F.count_if(~good).alias("fn_counted"), F.count_if(F.col("p_track_id").isNull()).alias("fn_not_counted"))


@query("e9_fragments", f"WITH {BALL}, k AS (SELECT seq, frame_id, CASE WHEN tp THEN 1 WHEN fn THEN 0 END AS s FROM st), l AS (SELECT a.seq, a.s, (SELECT b.s FROM k b WHERE b.seq = a.seq AND b.frame_id < a.frame_id AND b.s IS NOT NULL ORDER BY b.frame_id DESC LIMIT 1) AS prev FROM k a) SELECT seq, count(*) FILTER (WHERE s = 1 AND prev = 0) AS fragments FROM l GROUP BY seq")
def _(v):
    return E.fragments(ball(v))


#: Two predictions for each box, the second now nearer and now farther; the one
#: that a truth was matched with in the frame before stays.
TWICE = """pr AS (SELECT seq, frame_id, track_id, track_id * 2 + k AS p_id, x + k * (event_id * 5 % 11 - 5.25::DOUBLE) AS x, y, w, h FROM v_box CROSS JOIN range(0, 2) t(k)),
io AS (SELECT g.seq, g.frame_id, g.track_id AS g_id, p_id, (g.w - abs(pr.x - g.x)) / (g.w + abs(pr.x - g.x)) AS iou FROM v_gtbox g JOIN pr ON pr.seq = g.seq AND pr.frame_id = g.frame_id AND pr.track_id = g.track_id),
ru AS (SELECT *, frame_id - dense_rank() OVER (PARTITION BY seq, g_id ORDER BY frame_id) AS run FROM io),
fi AS (SELECT seq, g_id, run, arg_max(p_id, iou) AS p_id FROM ru JOIN (SELECT seq, g_id, run, min(frame_id) AS frame_id FROM ru GROUP BY ALL) f USING (seq, g_id, run, frame_id) GROUP BY ALL),
mt AS (SELECT seq, g_id, frame_id, p_id, iou, coalesce(lag(p_id) OVER (PARTITION BY seq, g_id ORDER BY frame_id) <> p_id, false) AS switched FROM ru JOIN fi USING (seq, g_id, run, p_id))"""


@query("e10_clear_mot", f"WITH {TWICE} SELECT n.seq, n_pred - tp AS fp, n_gt - tp AS fn, switches, round(1 - (n_pred - tp + n_gt - tp + switches) / n_gt::DOUBLE, 6) AS mota, round(motp, 6) AS motp FROM (SELECT seq, count(*) AS tp, count(*) FILTER (WHERE switched) AS switches, avg(1 - iou) AS motp FROM mt GROUP BY seq) JOIN (SELECT seq, count(*) AS n_gt FROM v_gtbox GROUP BY seq) n USING (seq) JOIN (SELECT seq, count(*) AS n_pred FROM pr GROUP BY seq) USING (seq)")
def _(v):
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    pred = v.box.select("*", k).withColumn("track_id", F.col("track_id") * 2 + F.col("k")).withColumn("x", F.col("x") + F.col("k") * (F.col("event_id") * 5 % 11 - 5.25)).drop("k")
    c = E.clear_mot(M.sticky_matches(pred, v.gtbox), pred, v.gtbox)
    return c.select("seq", "fp", "fn", "switches", F.round("mota", 6).alias("mota"), F.round("motp", 6).alias("motp"))


#: Tracks of a pair change names for good at a frame of the pair's own.
CROSSED = "cr AS (SELECT *, CASE WHEN frame_id > 20 + track_id // 2 % 30 THEN track_id + 1 - 2 * (track_id % 2) ELSE track_id END AS p_id FROM v_box), pc AS (SELECT g.seq, g.track_id // 2 AS pair, g.track_id = p_id AS straight, count(*) AS n FROM v_gtbox g JOIN cr ON cr.seq = g.seq AND cr.frame_id = g.frame_id AND cr.track_id = g.track_id GROUP BY ALL)"


@query("e11_idf1", f"WITH {CROSSED} SELECT seq, CAST(sum(n) AS BIGINT) AS idtp, round(2 * sum(n) / any_value(n_pred + n_gt)::DOUBLE, 6) AS idf1 FROM (SELECT seq, pair, max(n) AS n FROM pc GROUP BY ALL) JOIN (SELECT seq, count(*) AS n_gt FROM v_gtbox GROUP BY seq) USING (seq) JOIN (SELECT seq, count(*) AS n_pred FROM v_box GROUP BY seq) USING (seq) GROUP BY seq")
def _(v):
    pred = v.box.withColumn("track_id", F.when(F.col("frame_id") > 20 + F.floor(F.col("track_id") / 2) % 30, F.col("track_id") + 1 - 2 * (F.col("track_id") % 2)).otherwise(F.col("track_id")))
    return E.idf1(M.pairs(pred, v.gtbox), pred, v.gtbox).select("seq", "idtp", F.round("idf1", 6).alias("idf1"))


@query("e12_hota50", f"""WITH {MISSED}, t AS (SELECT seq, p, g, count(*) AS c FROM ms WHERE 1 - d >= 0.5 GROUP BY ALL), nt AS (SELECT seq, track_id AS p, count(*) AS n FROM v_num WHERE event_type <> 'view' GROUP BY ALL),
a AS (SELECT t.seq, sum(c) AS tp, sum(c * c / (a.n + b.n - c)::DOUBLE) / sum(c) AS ass_a FROM t JOIN nt a ON a.seq = t.seq AND a.p = t.p JOIN nt b ON b.seq = t.seq AND b.p = g GROUP BY t.seq)
SELECT seq, round(tp / (2 * n - tp)::DOUBLE, 6) AS det_a, round(ass_a, 6) AS ass_a, round(sqrt(tp / (2 * n - tp)::DOUBLE * ass_a), 6) AS hota FROM a JOIN (SELECT seq, sum(n) AS n FROM nt GROUP BY seq) USING (seq)""")
def _(v):
    pred, gt = close(v)
    return E.hota(M.by_overlap(pred, gt), pred, gt).select("seq", *[F.round(c, 6).alias(c) for c in ("det_a", "ass_a", "hota")])


#: Each truth in a lane of its own. Its prediction lies up to nine pixels aside
#: and changes names with another's; in a quarter of the frames a stranger of
#: another name lies closer, whom only the tracks' alignment rules out.
RIVALS = """gg AS (SELECT seq, frame_id, track_id AS g_id FROM v_gtbox),
pp AS (SELECT seq, frame_id, track_id AS lane, CASE WHEN frame_id > 20 + track_id // 2 % 30 THEN track_id + 1 - 2 * (track_id % 2) ELSE track_id END AS p_id, (1 + event_id % 9)::DOUBLE AS d FROM v_box
  UNION ALL SELECT seq, frame_id, track_id, 1000000 + track_id, 0.5 FROM v_box WHERE event_id % 4 = 0),
oo AS (SELECT gg.seq, gg.frame_id, g_id, p_id, (30 - d) / (30 + d) AS iou FROM gg JOIN pp ON pp.seq = gg.seq AND pp.frame_id = gg.frame_id AND lane = g_id),
sf AS (SELECT *, iou / sum(iou) OVER (PARTITION BY seq, frame_id, g_id) AS soft FROM oo),
np AS (SELECT seq, p_id, count(*) AS n_p FROM pp GROUP BY ALL), ng AS (SELECT seq, g_id, count(*) AS n_g FROM gg GROUP BY ALL),
al AS (SELECT seq, p_id, g_id, sum(soft) / (any_value(n_p) + any_value(n_g) - sum(soft)) AS s FROM sf JOIN np USING (seq, p_id) JOIN ng USING (seq, g_id) GROUP BY ALL),
mt AS (SELECT seq, frame_id, g_id, p_id, iou FROM (SELECT sf.*, row_number() OVER (PARTITION BY seq, frame_id, g_id ORDER BY iou * s DESC) AS r FROM sf JOIN al USING (seq, p_id, g_id)) WHERE r = 1),
ct AS (SELECT seq, k, p_id, g_id, count(*) AS c, sum(iou) AS loc FROM mt JOIN range(1, 20) t(k) ON floor(iou * 20 + 1e-9) >= k GROUP BY ALL),
sm AS (SELECT seq, k, sum(c) AS tp, sum(loc) AS loc, sum(c * c / (n_p + n_g - c)::DOUBLE) AS a, sum(c * c / n_g::DOUBLE) AS re, sum(c * c / n_p::DOUBLE) AS pr FROM ct JOIN np USING (seq, p_id) JOIN ng USING (seq, g_id) GROUP BY ALL),
tt AS (SELECT seq, k, coalesce(tp, 0) AS tp, coalesce(loc, 0) AS loc, coalesce(a, 0) AS a, coalesce(re, 0) AS re, coalesce(pr, 0) AS pr, n_pred, n_gt FROM (SELECT seq, sum(n_p) AS n_pred FROM np GROUP BY seq) JOIN (SELECT seq, sum(n_g) AS n_gt FROM ng GROUP BY seq) USING (seq) CROSS JOIN range(1, 20) t(k) LEFT JOIN sm USING (seq, k))"""
PARTS = ("hota", "det_a", "ass_a", "ass_re", "ass_pr", "loc_a")


def rivals(v):
    y = 10_000.0 * (F.col("track_id") % 22)
    lane = lambda df, x, track: df.select("seq", "frame_id", track.alias("track_id"), x.alias("x"), y.alias("y"), F.lit(30.0).alias("w"), F.lit(70.0).alias("h"))
    at = (F.col("event_id") % 7).cast("double")
    crossed = F.when(F.col("frame_id") > 20 + F.floor(F.col("track_id") / 2) % 30, F.col("track_id") + 1 - 2 * (F.col("track_id") % 2)).otherwise(F.col("track_id"))
    near = lane(v.box, at + 1 + F.col("event_id") % 9, crossed)
    stranger = lane(v.box.where("event_id % 4 = 0"), at + 0.5, F.col("track_id") + 1_000_000)
    return near.unionByName(stranger), lane(v.gtbox, at, F.col("track_id"))


@query("e13_hota_thresholds", f"WITH {RIVALS}, hh AS (SELECT seq, tp / greatest(n_pred + n_gt - tp, 1)::DOUBLE AS det_a, a / greatest(tp, 1) AS ass_a, re / greatest(tp, 1) AS ass_re, pr / greatest(tp, 1) AS ass_pr, CASE WHEN tp > 0 THEN loc / tp ELSE 1 END AS loc_a FROM tt) SELECT seq, round(avg(sqrt(det_a * ass_a)), 6) AS hota, {', '.join(f'round(avg({c}), 6) AS {c}' for c in PARTS[1:])} FROM hh GROUP BY seq")
def _(v):
    return E.hota_thresholds(*rivals(v)).select("seq", *[F.round(c, 6).alias(c) for c in PARTS])


@query("e13_hota_combined", f"WITH {RIVALS}, hh AS (SELECT k AS level, sum(tp)::BIGINT AS tp, (sum(n_pred) - sum(tp))::BIGINT AS fp, (sum(n_gt) - sum(tp))::BIGINT AS fn, sum(tp) / (sum(n_pred) + sum(n_gt) - sum(tp))::DOUBLE AS det_a, sum(a) / greatest(sum(tp), 1) AS ass_a, sum(re) / greatest(sum(tp), 1) AS ass_re, sum(pr) / greatest(sum(tp), 1) AS ass_pr, CASE WHEN sum(tp) > 0 THEN sum(loc) / sum(tp) ELSE 1 END AS loc_a FROM tt GROUP BY k) SELECT level::INTEGER AS level, tp, fp, fn, round(sqrt(det_a * ass_a), 6) AS hota, {', '.join(f'round({c}, 6) AS {c}' for c in PARTS[1:])} FROM hh")
def _(v):
    """All sequences as one, at each threshold."""
    return E.hota_combined(E.hota_levels(*rivals(v))).select("level", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in PARTS])


@query("e14_team_accuracy", f"WITH {PAIRS} SELECT seq, round(greatest(count(*) FILTER (WHERE t = g_team), count(*) FILTER (WHERE t <> g_team)) / count(*)::DOUBLE, 6) AS team_accuracy FROM (SELECT seq, g_team, CASE WHEN p_id % 3 = 0 THEN p_team ELSE 1 - p_team END AS t FROM pairs) GROUP BY seq")
def _(v):
    t = pairs(v).select("seq", F.when(F.col("p_track_id") % 3 == 0, F.col("p_team_id")).otherwise(1 - F.col("p_team_id")).alias("team"), F.col("g_team_id").alias("side"))
    return E.permuted_accuracy(t).select("seq", F.round("team_accuracy", 6).alias("team_accuracy"))


@query("e15_referee_scores", f"WITH {PAIRS}, r AS (SELECT seq, p_id, g_id, p_id % 5 = 1 AS p, g_id % 3 = 1 AS g FROM pairs) SELECT seq, count(DISTINCT CASE WHEN p AND g THEN p_id END) AS tp, count(DISTINCT CASE WHEN p AND NOT g THEN p_id END) AS fp, count(DISTINCT CASE WHEN g AND NOT p THEN g_id END) AS fn FROM r GROUP BY seq")
def _(v):
    role = lambda c, k: F.when(F.col(c) % k == 1, "referee").otherwise("player")
    m = pairs(v).select("seq", F.col("p_track_id").alias("pred_id"), F.col("g_track_id").alias("gt_id"), role("p_track_id", 5).alias("pred_role"), role("g_track_id", 3).alias("gt_role"))
    return E.role_scores(m, "referee").select("seq", "tp", "fp", "fn")


@query("e16_team_purity", "SELECT seq, round(sum(m) / sum(n)::DOUBLE, 6) AS purity, round(sum(CASE WHEN team_id >= 0 THEN m END) / sum(n)::DOUBLE, 6) AS assigned_share FROM (SELECT seq, team_id, max(c) AS m, sum(c) AS n FROM (SELECT seq, team_id, event_id % 2 AS side, count(*) AS c FROM v_num GROUP BY ALL) GROUP BY ALL) GROUP BY seq")
def _(v):
    c = v.num.groupBy("seq", "team_id", (F.col("event_id") % 2).alias("side")).count()
    t = c.groupBy("seq", "team_id").agg(F.max("count").alias("m"), F.sum("count").alias("n"))
    return t.groupBy("seq").agg(F.round(F.sum("m") / F.sum("n"), 6).alias("purity"), F.round(F.sum(F.when(F.col("team_id") >= 0, F.col("m"))) / F.sum("n"), 6).alias("assigned_share"))


FRAG = "fg AS (SELECT seq, track_id % 20 AS gt_id, track_id, count(*) AS matched, min(frame_id) AS first_frame, min(event_id % 2) = 0 AS correct FROM v_num GROUP BY ALL), rp AS (SELECT *, row_number() OVER (PARTITION BY seq, gt_id ORDER BY matched DESC, track_id) AS r FROM fg)"


def _frags(v):
    return v.num.groupBy("seq", (F.col("track_id") % 20).alias("gt_id"), "track_id").agg(F.count("*").alias("matched"), (F.min(F.col("event_id") % 2) == 0).alias("correct"))


@query("e17_fragment_rates", f"WITH {FRAG} SELECT seq, count(*) AS n_fragments, count(*) FILTER (WHERE r = 1) AS n_gt, round(count(*) FILTER (WHERE r = 1 AND correct) / count(*) FILTER (WHERE r = 1)::DOUBLE, 6) AS representative_rate FROM rp GROUP BY seq")
def _(v):
    w = Window.partitionBy("seq", "gt_id").orderBy(F.desc("matched"), "track_id")
    r = _frags(v).withColumn("r", F.row_number().over(w))
    first = F.col("r") == 1
    return r.groupBy("seq").agg(F.count("*").alias("n_fragments"), F.count_if(first).alias("n_gt"), F.round(F.count_if(first & F.col("correct")) / F.count_if(first), 6).alias("representative_rate"))


@query("f15_representative_fragment", f"WITH {FRAG} SELECT seq, gt_id, track_id, matched FROM rp WHERE r = 1")
def _(v):
    w = Window.partitionBy("seq", "gt_id").orderBy(F.desc("matched"), "track_id")
    return _frags(v).withColumn("r", F.row_number().over(w)).where("r = 1").select("seq", "gt_id", "track_id", "matched")


@query("e18_tracklet_accuracy", "SELECT track_id, count(*) AS n, round(avg(CASE WHEN top = frame_id % 64 + 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN p >= 0.3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS locked, round(sum(CASE WHEN p >= 0.3 THEN 1 ELSE 0 END) / 100.0::DOUBLE, 6) AS locked_of_gt FROM (SELECT track_id, frame_id, list_position(probs, list_max(probs)) AS top, list_max(probs) AS p FROM v_post) GROUP BY track_id")
def _(v):
    from touchline.functions import exprs as X

    r = v.post.withColumn("t", X.top1(F.col("probs")))
    locked = (F.col("t.p") >= 0.3).cast("double")
    return r.groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("t.number") == F.col("frame_id") % 64 + 1).cast("double")), 6).alias("top1"), F.round(F.avg(locked), 6).alias("locked"), F.round(F.sum(locked) / 100, 6).alias("locked_of_gt"))


@query("e19_micro_aggregate", f"WITH {FRAG} SELECT count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct, round(count(*) FILTER (WHERE correct) / count(*)::DOUBLE, 6) AS rate FROM fg")
def _(v):
    per = _frags(v).groupBy("seq").agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    return per.agg(F.sum("n").alias("n"), F.sum("c").alias("n_correct"), F.round(F.sum("c") / F.sum("n"), 6).alias("rate"))


@query("e26_describe", "SELECT 'f1' AS metric, round(avg(f1), 6) AS mean, round(median(f1), 6) AS median, round(stddev_samp(f1), 6) AS std, round(min(f1), 6) AS min, round(max(f1), 6) AS max FROM v_report UNION ALL SELECT 'rmse', round(avg(rmse), 6), round(median(rmse), 6), round(stddev_samp(rmse), 6), round(min(rmse), 6), round(max(rmse), 6) FROM v_report")
def _(v):
    d = P.described(v.report, "f1", "rmse")
    return d.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")])


@query("e27_cluster_score_spread", "SELECT round(stddev_pop(mota), 8) AS std, round(median(mota), 8) AS median FROM v_report")
def _(v):
    return v.report.agg(F.round(F.stddev_pop("mota"), 8).alias("std"), F.round(F.median("mota"), 8).alias("median"))


@query("e28_histogram", "SELECT CAST(least(floor(value / 500 * 20), 19) AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def _(v):
    return P.binned(v.table("events"), "value", 0.0, 500.0, 20)


@query("e28_kernel_density", "SELECT x, round(avg(exp(-((value - x)^2) / (2 * 20.0::DOUBLE * 20))) / (20 * sqrt(2 * pi())), 8) AS density FROM events CROSS JOIN (VALUES (10.0::DOUBLE), (50.0), (100.0), (200.0)) g(x) GROUP BY x")
def _(v):
    return P.density(v.table("events"), "value", [10.0, 50.0, 100.0, 200.0], 20.0).select("x", F.round("density", 8).alias("density"))


@query("e29_correlation_trend", "SELECT round(corr(f1, rmse), 6) AS r, round(regr_slope(f1, rmse), 9) AS slope, round(regr_intercept(f1, rmse), 6) AS intercept FROM v_report")
def _(v):
    return P.trend(v.report, "f1", "rmse").select(F.round("r", 6).alias("r"), F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("e30_quartiles", "SELECT round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events")
def _(v):
    return P.quartiles(v.table("events"), "value").select(*[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")])


#: Truths of three sizes, each in a lane. A prediction of each is narrower, so
#: that many are of another size than their truth; a fifth come twice, and a
#: quarter of the truths have a prediction of nothing. Then the outcome of each at each level in each range.
SIZES = """tr AS (SELECT track_id % 2 AS cls, seq, frame_id, track_id, event_id, CASE event_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 32 ELSE 120 END::DOUBLE AS w, CASE event_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 32.5 ELSE 100 END::DOUBLE AS h, 1 - event_id % 13 * 0.0451::DOUBLE AS part FROM v_gtbox),
dt AS (SELECT cls, seq, frame_id, track_id AS gid, track_id AS id, event_id * 7919 % 1009 / 1009 AS score, part AS iou, w * h AS ga, w * part * h AS da FROM tr
  UNION ALL SELECT cls, seq, frame_id, NULL, track_id + 1000000, event_id * 6007 % 1009 / 1009, 0, NULL, w * h FROM tr WHERE event_id % 4 = 0
  UNION ALL SELECT cls, seq, frame_id, track_id, track_id + 2000000, event_id * 4999 % 1009 / 1009, 1, w * h, w * h FROM tr WHERE event_id % 5 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY seq, frame_id, cls ORDER BY score DESC, id) AS rank FROM dt),
lv AS (SELECT *, iou >= 0.5 + 0.05::DOUBLE * k AND row_number() OVER (PARTITION BY seq, frame_id, gid, k, iou >= 0.5 + 0.05::DOUBLE * k ORDER BY score DESC, id) = 1 AS takes FROM rk CROSS JOIN range(0, 10) t(k)),
ar AS (SELECT * FROM (VALUES (0, 0::DOUBLE, 1e10), (1, 0, 1024), (2, 1024, 9216), (3, 9216, 1e10)) t(a, lo, hi)),
st AS (SELECT cls, a, k, score, frame_id, id, rank, CASE WHEN takes THEN CASE WHEN ga BETWEEN lo AND hi THEN 1 ELSE 2 END WHEN da BETWEEN lo AND hi THEN 0 ELSE 2 END AS s FROM lv CROSS JOIN ar),
ng AS (SELECT cls, a, count(*) AS g FROM tr JOIN ar ON w * h BETWEEN lo AND hi GROUP BY ALL),
cv AS (SELECT cls, a, k, sum((s = 1)::INT) OVER o AS tp, sum((s <> 2)::INT) OVER o AS n FROM st WINDOW o AS (PARTITION BY cls, a, k ORDER BY score DESC, frame_id, id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT cls, a, k, tp, max(tp / n::DOUBLE) AS p FROM cv WHERE n > 0 GROUP BY ALL),
pt AS (SELECT pr.cls, a, k, r, max(p) AS p FROM pr JOIN ng USING (cls, a) JOIN range(0, 101) t(r) ON round(tp / g::DOUBLE * 100, 9) >= r GROUP BY ALL),
ap AS (SELECT cls, a, k, sum(p) / 101 AS ap FROM pt GROUP BY ALL),
re AS (SELECT cls, a, count(*) FILTER (s = 1) / (10 * any_value(g))::DOUBLE AS r, count(*) FILTER (s = 1 AND rank <= 1) / (10 * any_value(g))::DOUBLE AS r1, count(*) FILTER (s = 1 AND rank <= 10) / (10 * any_value(g))::DOUBLE AS r10 FROM st JOIN ng USING (cls, a) GROUP BY ALL)"""
NUMBERS = ("ap", "ap50", "ap75", "ap_small", "ap_medium", "ap_large", "ar1", "ar10", "ar100", "ar_small", "ar_medium", "ar_large")


@query("e32_coco_summary", f"""WITH {SIZES} SELECT cls::INTEGER AS cls, round(ap, 6) AS ap, round(ap50, 6) AS ap50, round(ap75, 6) AS ap75, round(aps, 6) AS ap_small, round(apm, 6) AS ap_medium, round(apl, 6) AS ap_large, round(r1, 6) AS ar1, round(r10, 6) AS ar10, round(r, 6) AS ar100, round(rs, 6) AS ar_small, round(rm, 6) AS ar_medium, round(rl, 6) AS ar_large
FROM (SELECT cls, avg(ap) FILTER (a = 0) AS ap, max(ap) FILTER (a = 0 AND k = 0) AS ap50, max(ap) FILTER (a = 0 AND k = 5) AS ap75, avg(ap) FILTER (a = 1) AS aps, avg(ap) FILTER (a = 2) AS apm, avg(ap) FILTER (a = 3) AS apl FROM ap GROUP BY cls)
JOIN (SELECT cls, max(r1) FILTER (a = 0) AS r1, max(r10) FILTER (a = 0) AS r10, max(r) FILTER (a = 0) AS r, max(r) FILTER (a = 1) AS rs, max(r) FILTER (a = 2) AS rm, max(r) FILTER (a = 3) AS rl FROM re GROUP BY cls) USING (cls)""")
def _(v):
    e = F.col("event_id")
    size = lambda small, medium, large: F.when(e % 3 == 0, small).when(e % 3 == 1, medium).otherwise(large)
    truths = v.gtbox.select("seq", "frame_id", "track_id", "event_id", (F.col("track_id") % 2).cast("int").alias("cls"), F.lit(0.0).alias("x"), (10_000.0 * (F.col("track_id") % 22)).alias("y"), size(20.0, 32.0, 120.0).alias("w"), size(30.0, 32.5, 100.0).alias("h"))
    score = lambda k: e * k % 1009 / 1009
    near = truths.withColumn("score", score(7919)).withColumn("w", F.col("w") * (1 - e % 13 * 0.0451))
    wrong = truths.where("event_id % 4 = 0").withColumn("score", score(6007)).withColumn("track_id", F.col("track_id") + 1_000_000).withColumn("x", F.col("x") + 100_000)
    twice = truths.where("event_id % 5 = 0").withColumn("score", score(4999)).withColumn("track_id", F.col("track_id") + 2_000_000)
    return E.coco_summary(near.unionByName(wrong).unionByName(twice), truths).select("cls", *[F.round(c, 6).alias(c) for c in NUMBERS])


SCORED = "sc AS (SELECT seq, event_id AS id, value AS score, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS hit FROM v_num), cv AS (SELECT seq, score, id, hit, sum(hit) OVER w AS tp, row_number() OVER w AS n FROM sc WINDOW w AS (PARTITION BY seq ORDER BY score DESC, id)), pr AS (SELECT seq, score, id, tp / n::DOUBLE AS p, tp / g::DOUBLE AS r FROM cv JOIN (SELECT seq, sum(hit) + 5 AS g FROM sc GROUP BY seq) USING (seq))"


def scored(v):
    return v.num.select("seq", F.col("event_id").alias("id"), F.col("value").alias("score"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("hit"))


@query("e33_average_precision", f"WITH {SCORED} SELECT seq, round(sum((r - coalesce(pr0, 0)) * (p + coalesce(pp, 1)) / 2), 6) AS ap FROM (SELECT *, lag(r) OVER w AS pr0, lag(p) OVER w AS pp FROM pr WINDOW w AS (PARTITION BY seq ORDER BY score DESC, id)) GROUP BY seq")
def _(v):
    s = scored(v)
    n = s.groupBy("seq").agg((F.sum("hit") + 5).alias("n_gt"))
    return E.average_precision(s, n).select("seq", F.round("ap", 6).alias("ap"))


@query("f14_cumulative_hits", f"WITH {SCORED} SELECT seq, id, CAST(tp AS BIGINT) AS tp, CAST(n - tp AS BIGINT) AS fp FROM cv")
def _(v):
    s = running(scored(v).withColumn("miss", 1 - F.col("hit")), ["seq"], [F.desc("score"), F.col("id")], tp="hit", fp="miss")
    return s.select("seq", "id", "tp", "fp")


@query("e34_success_curve", "SELECT seq, CAST(l AS INT) AS level, round(count(*) FILTER (WHERE value / 10 <= l) / count(*)::DOUBLE, 6) AS share FROM v_num CROSS JOIN range(0, 51) t(l) GROUP BY seq, l")
def _(v):
    return E.success_curve(v.num.withColumn("err", F.col("value") / 10), "err", 50).select("seq", "level", F.round("share", 6).alias("share"))


@query("e34_success_auc", "WITH c AS (SELECT seq, l, count(*) FILTER (WHERE value / 10 <= l) / count(*)::DOUBLE AS s FROM v_num CROSS JOIN range(0, 51) t(l) GROUP BY seq, l) SELECT seq, round((sum(s) - (min(s) + max(s)) / 2) / 50, 6) AS auc FROM c GROUP BY seq")
def _(v):
    c = E.success_curve(v.num.withColumn("err", F.col("value") / 10), "err", 50)
    return E.curve_area(c, 50).select("seq", F.round("auc", 6).alias("auc"))


@query("e35_occlusion_recovery", """WITH oc AS (SELECT track_id AS seq, frame_id, frame_id - row_number() OVER (PARTITION BY track_id ORDER BY frame_id) AS run FROM v_num WHERE event_type IN ('error', 'view')),
sp AS (SELECT seq, run, max(frame_id) + 1 AS after FROM oc GROUP BY seq, run)
SELECT sp.seq, count(*) AS occlusions, round(count(*) FILTER (value <= 20) / count(*)::DOUBLE, 6) AS recovery FROM sp JOIN v_num n ON n.track_id = sp.seq AND n.frame_id = sp.after GROUP BY sp.seq""")
def _(v):
    """Each track is a sequence; its ball is hidden in two kinds of frames."""
    rows = v.num.select(F.col("track_id").alias("seq"), "frame_id", F.col("event_type").isin("error", "view").alias("occluded"), F.col("value").alias("error"))
    return E.occlusion_recovery(rows).select("seq", "occlusions", F.round("recovery", 6).alias("recovery"))


LAB = "lb AS (SELECT toxic AS label, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS p FROM labels)"


def labelled(v):
    return v.table("labels").select(F.col("toxic").alias("label"), ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("p"))


@query("e36_binary_report", f"WITH {LAB}, c AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn FROM lb) SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM c")
def _(v):
    return E.binary_report(labelled(v)).select("tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("e36_roc_auc", f"WITH {LAB} SELECT round(sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*)::DOUBLE, 6) AS roc_auc FROM lb a JOIN lb b ON a.label = 1 AND b.label = 0")
def _(v):
    return E.roc_auc(labelled(v)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("e36_pr_auc", f"WITH {LAB}, s AS (SELECT p, sum(label) AS pos, count(*) AS n FROM lb GROUP BY p) SELECT round(sum(pos * cp / cn::DOUBLE) / max(tot), 6) AS pr_auc FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER () AS tot FROM s)")
def _(v):
    return E.pr_auc(labelled(v)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query("e37_digit_head_accuracy", "SELECT round(avg(CAST((event_id % 99 + 1 > 9) = (event_id % 50 + 1 > 9) AS INT)), 6) AS length_acc, round(avg(CAST((event_id % 99 + 1) % 10 = (event_id % 50 + 1) % 10 AS INT)), 6) AS ones_acc, round(avg(CAST(event_id % 99 = event_id % 50 AS INT)), 6) AS number_acc FROM events")
def _(v):
    r = v.table("events").select((F.col("event_id") % 99 + 1).alias("pred"), (F.col("event_id") % 50 + 1).alias("truth"))
    return P.quality_metrics(r).select(*[F.round(c, 6).alias(c) for c in ("length_acc", "ones_acc", "number_acc")])


@query("e38_mask_overlap", "SELECT seq, round(i / u::DOUBLE, 6) AS iou, round(2 * i / (a + b)::DOUBLE, 6) AS dice FROM (SELECT seq, count(*) FILTER (WHERE event_id % 2 = 0 AND event_id % 3 = 0) AS i, count(*) FILTER (WHERE event_id % 2 = 0 OR event_id % 3 = 0) AS u, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 3 = 0) AS b FROM v_num GROUP BY seq)")
def _(v):
    a, b = F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0
    s = v.num.groupBy("seq").agg(F.count_if(a & b).alias("i"), F.count_if(a | b).alias("u"), F.count_if(a).alias("a"), F.count_if(b).alias("b"))
    return s.select("seq", F.round(F.col("i") / F.col("u"), 6).alias("iou"), F.round(2 * F.col("i") / (F.col("a") + F.col("b")), 6).alias("dice"))


@query("e39_false_positive_analysis", "SELECT seq, frame_id, count(*) AS n, count(*) FILTER (WHERE score < 0.1) AS low FROM v_box GROUP BY seq, frame_id HAVING count(*) > 10")
def _(v):
    return v.box.groupBy("seq", "frame_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") < 0.1).alias("low")).where("n > 10")


@query("e40_roster_per_side", "SELECT seq, team_id, CAST(count(DISTINCT track_id % 99) AS INT) AS n_numbers, CASE WHEN count(DISTINCT track_id % 99) < 5 THEN 'few' WHEN count(DISTINCT track_id % 99) > 18 THEN 'many' ELSE 'ok' END AS warning FROM v_num GROUP BY seq, team_id")
def _(v):
    s = v.num.groupBy("seq", "team_id").agg(F.size(F.collect_set(F.col("track_id") % 99)).alias("n_numbers"))
    return s.withColumn("warning", F.when(F.col("n_numbers") < 5, "few").when(F.col("n_numbers") > 18, "many").otherwise("ok"))


@query("e41_conditional_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_good, count(*) FILTER (WHERE toxic = 1) AS n_toxic FROM labels")
def _(v):
    return v.table("labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@query("e42_damped_weights", "SELECT label, round(1 / sqrt(count(*)), 6) AS weight FROM embeddings GROUP BY label")
def _(v):
    return v.table("embeddings").groupBy("label").agg(F.round(1 / F.sqrt(F.count("*")), 6).alias("weight"))


@query("e43_counters_by_reason", "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY event_type")
def _(v):
    return v.table("events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


@query("e44_best_last_epoch", "SELECT user_id % 10 AS experiment, round(max(value), 4) AS best, round(max_by(value, event_id), 4) AS last FROM events GROUP BY 1")
def _(v):
    return v.table("events").groupBy((F.col("user_id") % 10).alias("experiment")).agg(F.round(F.max("value"), 4).alias("best"), F.round(F.max_by("value", "event_id"), 4).alias("last"))


@query("e45_mean_loss", "SELECT round(avg((1 - f1) + rmse / 1000), 6) AS loss FROM v_report")
def _(v):
    return v.report.agg(F.round(F.avg((1 - F.col("f1")) + F.col("rmse") / 1000), 6).alias("loss"))


@query("e46_dashboard_kpis", "SELECT count(DISTINCT (seq, track_id)) AS n_players, count(DISTINCT (seq, frame_id)) AS n_frames, round(avg(value), 6) AS mean_value FROM v_track")
def _(v):
    return v.track.agg(F.countDistinct(F.struct("seq", "track_id")).alias("n_players"), F.countDistinct(F.struct("seq", "frame_id")).alias("n_frames"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("e47_throughput", "SELECT CAST(sum(n_frames) AS BIGINT) AS frames, CAST(sum(detections) AS BIGINT) AS detections, round(sum(detections) / sum(n_frames)::DOUBLE, 6) AS per_frame FROM v_report")
def _(v):
    return v.report.agg(F.sum("n_frames").alias("frames"), F.sum("detections").alias("detections"), F.round(F.sum("detections") / F.sum("n_frames"), 6).alias("per_frame"))


@query("e48_best_model", "SELECT max_by(seq, f1) AS best_seq, round(max(f1), 6) AS f1 FROM v_report")
def _(v):
    return v.report.agg(F.max_by("seq", "f1").alias("best_seq"), F.round(F.max("f1"), 6).alias("f1"))
