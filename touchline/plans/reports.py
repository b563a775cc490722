"""Sorting, limits, sampling (G)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.operators import identity as I
from touchline.operators import reports as P
from touchline.operators import sweeps as Q
from touchline.operators import teams as T
from touchline.plans.registry import query


@query("g2_top10_by_metric", "SELECT seq, round(idf1, 6) AS idf1, CAST(row_number() OVER (ORDER BY idf1 DESC, seq) AS INT) AS rank FROM v_report QUALIFY rank <= 10")
def _(v):
    return P.best(v.report, "idf1", 10).select("seq", F.round("idf1", 6).alias("idf1"), "rank")


@query("g3_leaderboard", "SELECT seq, CAST(row_number() OVER (ORDER BY c DESC, seq) AS INT) AS rank FROM (SELECT seq, round(0.30 * f1 + 0.25 * mota + 0.20 * team_accuracy + 0.15 * (1 - rmse / max(rmse) OVER ()) + 0.10 * idf1, 9) AS c FROM v_report)")
def _(v):
    c = P.composite(v.report).withColumn("composite", F.round("composite", 9))
    return P.ranked(c, "composite").select("seq", "rank")


TOP = "tp AS (SELECT track_id, frame_id, s[1] AS p, s[1] - s[2] AS m, list_position(probs, s[1]) AS number FROM (SELECT *, list_reverse_sort(probs) AS s FROM v_post))"
SWEEP = f"WITH {TOP}, sw AS (SELECT a AS p1_threshold, b AS margin_threshold, count(*) AS n, count(*) FILTER (WHERE p >= a AND m >= b) AS locked, count(*) FILTER (WHERE p >= a AND m >= b AND number <> frame_id % 64 + 1) AS false_locks, count(*) FILTER (WHERE p >= a AND m >= b AND number = frame_id % 64 + 1) AS good FROM tp CROSS JOIN (VALUES (0.2::DOUBLE), (0.4), (0.6)) x(a) CROSS JOIN (VALUES (0.05::DOUBLE), (0.2)) y(b) GROUP BY a, b)"


def swept(v):
    tracks = v.post.select("seq", F.col("frame_id").alias("track_id"), "probs")
    truth = v.post.select("seq", F.col("frame_id").alias("track_id"), (F.col("frame_id") % 64 + 1).alias("truth"))
    return I.sweep(tracks, [0.2, 0.4, 0.6], [0.05, 0.2], truth)


@query("i18_threshold_sweep", f"{SWEEP} SELECT p1_threshold, margin_threshold, n, locked, false_locks, good FROM sw")
def _(v):
    return swept(v).withColumnRenamed("right", "good")


#: Every setting on its own: frames tempered, gated, ranked and fused anew.
FUSED = """te AS (SELECT track_id, frame_id, quality, quality * legibility AS w, legibility, t, list_transform(probs, lambda x: x ^ (1 / t)) AS q FROM v_post CROSS JOIN (VALUES (1.0::DOUBLE), (1.5), (2.0), (3.0)) x(t)),
lg AS (SELECT *, count(*) FILTER (legibility >= l) OVER (PARTITION BY track_id, t, l) AS c FROM te CROSS JOIN (VALUES (0.4::DOUBLE), (0.5), (0.6), (0.7), (0.8)) y(l)),
ac AS (SELECT *, row_number() OVER (PARTITION BY track_id, t, l ORDER BY quality DESC, frame_id) <= greatest(2, ceil(count(*) OVER (PARTITION BY track_id, t, l) * 0.5)) AS top FROM lg WHERE c < 4 OR legibility >= l),
fl AS (SELECT track_id, t, l, w, top, unnest(list_transform(q, lambda x: x / list_sum(q))) AS p, unnest(range(1, len(q) + 1)) AS n FROM ac),
sm AS (SELECT track_id, t, l, n, CASE WHEN sum(w) > 1e-8 THEN sum(w * p) / sum(w) ELSE avg(p) END AS ar, CASE WHEN sum(w) > 1e-8 THEN sum(w * ln(p + 1e-10)) / sum(w) ELSE avg(ln(p + 1e-10)) END AS ge,
  CASE WHEN sum(w) FILTER (top) > 1e-8 THEN sum(w * ln(p + 1e-10)) FILTER (top) / sum(w) FILTER (top) ELSE avg(ln(p + 1e-10)) FILTER (top) END AS tk FROM fl GROUP BY ALL),
md AS (SELECT track_id, t, l, n, 'arithmetic' AS mode, ar AS e FROM sm UNION ALL SELECT track_id, t, l, n, 'geometric', exp(ge) FROM sm UNION ALL SELECT track_id, t, l, n, 'topk_geometric', exp(tk) FROM sm),
pr AS (SELECT *, e / sum(e) OVER (PARTITION BY track_id, t, l, mode) AS p, row_number() OVER (PARTITION BY track_id, t, l, mode ORDER BY e DESC, n) AS r FROM md),
tr AS (SELECT track_id, arg_min(list_position(probs, list_max(probs)), frame_id) AS truth FROM v_post GROUP BY track_id),
ra AS (SELECT mode, t, l, track_id, max(n) FILTER (r = 1) = any_value(truth) AS good, bool_or(r <= 3 AND n = truth) AS three, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 1) - max(p) FILTER (r = 2) AS m FROM pr JOIN tr USING (track_id) GROUP BY ALL)"""


@query("i18_fusion_sweep", f"WITH {FUSED} SELECT mode AS fusion_mode, t AS temperature, l AS legibility, a AS p1_threshold, 0.002::DOUBLE AS margin_threshold, count(*) AS n, count(*) FILTER (good) AS top1, count(*) FILTER (three) AS top3, count(*) FILTER (p1 >= a AND m >= 0.002) AS locked, count(*) FILTER (p1 >= a AND m >= 0.002 AND good) AS locked_right FROM ra CROSS JOIN (VALUES (0.02::DOUBLE), (0.025), (0.035)) z(a) GROUP BY ALL")
def _(v):
    """180 settings in one pass; the truth of a track is its first frame's number."""
    truth = v.post.groupBy("seq", "track_id").agg(F.min_by(F.array_position("probs", F.array_max("probs")), "frame_id").alias("truth"))
    return Q.fusion_sweep(v.post, truth, [1.0, 1.5, 2.0, 3.0], [0.4, 0.5, 0.6, 0.7, 0.8], [0.02, 0.025, 0.035], [0.002])


@query("g4_sweep_rank", f"{SWEEP} SELECT p1_threshold, margin_threshold, CAST(row_number() OVER (ORDER BY false_locks / greatest(locked, 1)::DOUBLE, good / n::DOUBLE DESC, locked DESC, p1_threshold, margin_threshold) AS INT) AS rank FROM sw")
def _(v):
    return I.ranked_sweep(swept(v)).select("p1_threshold", "margin_threshold", "rank")


@query("g5_best_detection", "SELECT seq, frame_id, track_id FROM (SELECT *, row_number() OVER (PARTITION BY seq, frame_id ORDER BY round(score, 1) DESC, track_id) AS r FROM v_box WHERE score >= 0.2) WHERE r = 1")
def _(v):
    """Scores of one decimal: ties go to the smaller track."""
    b = v.box.where("score >= 0.2").groupBy("seq", "frame_id").agg(F.max_by("track_id", F.struct(F.round("score", 1), -F.col("track_id"))).alias("track_id"))
    return b.select("seq", "frame_id", "track_id")


@query("g7_top_fraction", "SELECT track_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY quality DESC, frame_id) AS r, count(*) OVER (PARTITION BY track_id) AS n FROM v_post) WHERE r <= greatest(2, ceil(n * 0.5))")
def _(v):
    return I.top_share(v.post).select("track_id", "frame_id")


@query("g10_seeded_sample", "SELECT seq, track_id, frame_id FROM (SELECT seq, track_id, frame_id, row_number() OVER (PARTITION BY seq, track_id ORDER BY md5('0|' || seq || '|' || track_id || '|' || frame_id), frame_id) AS r FROM v_num) WHERE r <= 16")
def _(v):
    return I.seeded_sample(v.num.select("seq", "track_id", "frame_id"), ["seq", "track_id"], "frame_id", 16).select("seq", "track_id", "frame_id")


@query("g11_padded_bag", "SELECT seq, track_id, frame_id, slot FROM (SELECT seq, track_id, frame_id, row_number() OVER w - 1 AS i, least(count(*) OVER (PARTITION BY seq, track_id), 80) AS n FROM v_num WINDOW w AS (PARTITION BY seq, track_id ORDER BY frame_id)) JOIN range(0, 80) t(slot) ON slot % n = i WHERE i < 80")
def _(v):
    return I.padded_bag(v.num, 80).select("seq", "track_id", "frame_id", "slot")


@query("g12_last_log_rows", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 200")
def _(v):
    return v.table("events").orderBy(F.desc("event_id")).limit(200).select("event_id")


@query("g13_seeded_split", "SELECT seq, row_number() OVER (ORDER BY md5('7|' || seq), seq) <= greatest(1, floor(count(*) OVER () * 0.2)) AS is_val FROM (SELECT DISTINCT seq FROM v_num)")
def _(v):
    s = v.num.select("seq").distinct()
    h = F.md5(F.concat_ws("|", F.lit("7"), F.col("seq").cast("string")))
    n = s.agg(F.count("*")).scalar()
    ranked = s.withColumn("r", F.row_number().over(Window.orderBy(h, "seq")))
    return ranked.select("seq", (F.col("r") <= F.greatest(F.lit(1), F.floor(n * 0.2))).alias("is_val"))
