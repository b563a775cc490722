"""Projections, predicates and scalar functions (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import exprs as X
from touchline.plans.registry import query

FPS = 25.0


@query("c1_valid_players", "SELECT event_id, team_id FROM v_valid")
def _(v):
    return v.track.where(X.valid_player()).select("event_id", "team_id")


@query("c2_outfield_players", "SELECT event_id, role FROM v_outfield")
def _(v):
    return v.track.where(X.outfield()).select("event_id", "role")


@query("c3_frame_seconds", "SELECT event_id, round((frame_id - 1) / 25.0::DOUBLE, 3) AS time_s FROM v_num")
def _(v):
    return v.num.select("event_id", X.seconds(F.col("frame_id"), FPS).alias("time_s"))


@query("c4_anchor_point", "SELECT event_id, round(x + w / 2, 4) AS ax, round(CASE WHEN cls = 5 THEN y + h / 2 ELSE y + h END, 4) AS ay FROM v_box")
def _(v):
    a = X.anchor(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("cls") == 5)
    return v.box.select("event_id", a.alias("a")).select("event_id", F.round("a.x", 4).alias("ax"), F.round("a.y", 4).alias("ay"))


#: Any homography: rows of H^-1.
H = (0.05, 0.002, -50.0, 0.001, 0.09, -34.0, 0.00001, 0.0002, 0.9)


@query("c5_homography_projection", f"""SELECT event_id, CASE WHEN ok THEN round(px, 4) END AS x_m, CASE WHEN ok THEN round(py, 4) END AS y_m FROM (
  SELECT *, abs(dw) >= 1e-9 AND px BETWEEN -5 AND 110 AND py BETWEEN -5 AND 73 AS ok FROM (
  SELECT event_id, dw, ({H[0]}::DOUBLE * x + {H[1]}::DOUBLE * y + {H[2]}::DOUBLE) / dw + 52.5 AS px, ({H[3]}::DOUBLE * x + {H[4]}::DOUBLE * y + {H[5]}::DOUBLE) / dw + 34 AS py FROM (
  SELECT event_id, x, y, {H[6]:.5f}::DOUBLE * x + {H[7]}::DOUBLE * y + {H[8]}::DOUBLE AS dw FROM v_box)))""")
def _(v):
    h = F.array(*[F.lit(x) for x in H])
    p = X.project(h, F.col("x"), F.col("y"))
    return v.box.select("event_id", p.alias("p")).select("event_id", F.round("p.x_m", 4).alias("x_m"), F.round("p.y_m", 4).alias("y_m"))


@query("c6_minimap_pixel", "SELECT event_id, CAST(trunc(x_m * 6) AS INT) + 20 AS px, CAST(trunc(y_m * 6) AS INT) + 20 AS py FROM v_num")
def _(v):
    return v.num.select("event_id", X.minimap(F.col("x_m"), F.col("y_m"), 6.0, 20).alias("p")).select("event_id", "p.px", "p.py")


@query("c7_camera_ground_inverse", """SELECT DISTINCT track_id, round((1000 + track_id)::DOUBLE, 4) AS fx, 0::DOUBLE AS off_diagonal FROM v_num""")
def _(v):
    """The inverse of a ground homography, times it, is the identity."""
    cams = v.num.select("track_id").distinct()
    fx = 1000.0 + F.col("track_id")
    angle = F.col("track_id") / 100.0 + 0.3
    r = F.array(F.cos(angle), F.lit(0.0), F.sin(angle), F.lit(0.0), F.lit(1.0), F.lit(0.0), -F.sin(angle), F.lit(0.0), F.cos(angle))
    t = F.array(F.lit(3.0), F.lit(60.0), F.lit(-15.0))
    h = X.ground_homography(fx, fx, F.lit(960.0), F.lit(540.0), r, t)
    both = cams.select("track_id", fx.alias("fx"), h.alias("h")).withColumn("i", X.inverse3(F.col("h")))
    prod = lambda a, b: sum((F.col("h")[3 * a + k] * F.col("i")[3 * k + b] for k in range(3)), F.lit(0.0))
    off = F.greatest(*[F.abs(prod(a, b) - (1.0 if a == b else 0.0)) for a in range(3) for b in range(3)])
    return both.select("track_id", F.round("fx", 4).alias("fx"), F.when(off < 1e-6, 0.0).otherwise(off).alias("off_diagonal"))


def _pairs(v):
    return v.box.alias("a").join(v.gtbox.select(*[F.col(c).alias(f"g_{c}") for c in v.gtbox.columns]), (F.col("seq") == F.col("g_seq")) & (F.col("frame_id") == F.col("g_frame_id")) & (F.col("track_id") == F.col("g_track_id")))


IOU = """SELECT event_id, round({f}, 6) AS iou FROM (SELECT event_id, i, a + b - i AS u FROM (SELECT p.event_id, p.w * p.h AS a, g.w * g.h AS b,
  greatest(0, least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * greatest(0, least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y)) AS i
  FROM v_box p JOIN v_gtbox g USING (seq, frame_id, track_id)))"""


@query("c8_iou_centre", IOU.format(f="CASE WHEN u = 0 THEN 0 ELSE i / u END"))
def _(v):
    c = {p: X.centred(F.col(p + "x") + F.col(p + "w") / 2, F.col(p + "y") + F.col(p + "h") / 2, F.col(p + "w"), F.col(p + "h")) for p in ("", "g_")}
    return _pairs(v).select("event_id", F.round(X.iou(c[""], c["g_"]), 6).alias("iou"))


for _name, _rule, _sql in (("c9_iou_floor6", "floor6", "i / greatest(u, 1e-6)"), ("c10_iou_add6", "add6", "i / (u + 1e-6)"), ("c11_iou_floor8", "floor8", "i / greatest(u, 1e-8)")):

    @query(_name, IOU.format(f=_sql))
    def _(v, rule=_rule):
        return _pairs(v).select("event_id", F.round(X.iou(X.box(), X.box("g_"), rule), 6).alias("iou"))


@query("c12_distance", "SELECT g.event_id, round(sqrt((p.x_m - g.x_m)^2 + (p.y_m - g.y_m)^2), 6) AS dist FROM v_num p JOIN v_gt g USING (seq, frame_id, track_id)")
def _(v):
    p = v.num.select("seq", "frame_id", "track_id", F.col("x_m").alias("px"), F.col("y_m").alias("py"))
    return v.gt.join(p, ["seq", "frame_id", "track_id"]).select("event_id", F.round(F.hypot(F.col("px") - F.col("x_m"), F.col("py") - F.col("y_m")), 6).alias("dist"))


@query("c13_normalised_boxes", "SELECT event_id, round((x + w / 2) / 1920, 9) AS cx, round((y + h / 2) / 1080, 9) AS cy, round(w / 1920, 9) AS nw, round(h / 1080, 9) AS nh FROM v_box")
def _(v):
    n = X.normalised(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 1920, 1080)
    return v.box.select("event_id", n.alias("n")).select("event_id", *[F.round(f"n.{c}", 9).alias(c) for c in ("cx", "cy", "nw", "nh")])


@query("c14_centre_crop", """SELECT event_id, round(nx, 6) AS cx, round(ny, 6) AS cy FROM (SELECT event_id, ((x + w / 2) / 1920 - 0.25) / 0.5 AS nx, ((y + h / 2) / 1080 - 0.25) / 0.5 AS ny FROM v_box) WHERE nx BETWEEN 0 AND 1 AND ny BETWEEN 0 AND 1""")
def _(v):
    n = X.normalised(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 1920, 1080)
    c = v.box.select("event_id", n.alias("n")).select("event_id", X.centre_crop(F.col("n.cx"), F.col("n.cy"), F.col("n.nw"), F.col("n.nh"), 0.5).alias("c"))
    return c.where("c IS NOT NULL").select("event_id", F.round("c.cx", 6).alias("cx"), F.round("c.cy", 6).alias("cy"))


@query("c15_class_remap", "SELECT event_id, CASE WHEN cls IN (0, 1) THEN 0 WHEN cls IN (2, 3) THEN 1 WHEN cls = 4 THEN 2 END AS cls3 FROM v_box WHERE cls <> 5")
def _(v):
    return v.box.select("event_id", X.class_3of6(F.col("cls")).alias("cls3")).where("cls3 IS NOT NULL")


@query("c16_detector_classes", "SELECT event_id, cls = 5 AS is_ball, cls = 4 AS is_referee FROM v_box")
def _(v):
    from touchline.operators import teams as T

    named = v.box.withColumn("name", F.when(F.col("cls") == 5, "Sports Ball").when(F.col("cls") == 4, "Referee"))
    return named.select("event_id", T.is_class("ball", (5,)).alias("is_ball"), T.is_class("referee", (4,)).alias("is_referee"))


@query("c17_inferred_class_ids", "SELECT seq, [2, 3]::INTEGER[] AS gk_ids, [4]::INTEGER[] AS ref_ids FROM v_box GROUP BY seq HAVING count(DISTINCT cls) >= 5")
def _(v):
    from touchline.operators import teams as T

    return T.inferred_classes(v.box).where("n_classes >= 5").select("seq", "gk_ids", "ref_ids")


@query("c18_digit_targets", "SELECT CAST(n AS INT) AS n, CASE WHEN n <= 9 THEN 0 ELSE 1 END AS length, CASE WHEN n <= 9 THEN 0 ELSE CAST(n // 10 AS INT) END AS tens, CAST(n % 10 AS INT) AS ones FROM range(1, 100) t(n)")
def _(v):
    return v.spark.range(1, 100).select(F.col("id").cast("int").alias("n")).select("n", X.digits(F.col("n")).alias("d")).select("n", "d.*")


@query("c19_number_vector", """SELECT track_id, frame_id, round(p7 / m, 6) AS p7, round(p25 / m, 6) AS p25 FROM (SELECT track_id, frame_id, probs[1] * probs[10] AS p7, probs[2] * probs[15] * probs[8] AS p25,
  probs[1] * list_sum(probs[4:12]) + probs[2] * list_sum(probs[14:22]) * list_sum(probs[3:12]) AS m FROM (SELECT track_id, frame_id, list_concat(probs[1:12], list_concat([0::DOUBLE], probs[14:22])) AS probs FROM v_post)) WHERE m > 0""")
def _(v):
    p = F.col("probs")
    ones, tens = F.slice(p, 3, 10), F.concat(F.array(F.lit(0.0)), F.slice(p, 14, 9))
    n = v.post.select("track_id", "frame_id", X.number_vector(F.slice(p, 1, 2), tens, ones).alias("n"))
    return n.select("track_id", "frame_id", F.round(F.col("n")[6], 6).alias("p7"), F.round(F.col("n")[24], 6).alias("p25"))


@query("c20_roster_mask", "SELECT track_id, frame_id, round(CASE WHEN s > 1e-8 THEN probs[10] / s ELSE 0 END, 6) AS p10, 0::DOUBLE AS p2 FROM (SELECT *, probs[1] + probs[10] + probs[60] AS s FROM v_post)")
def _(v):
    m = X.masked(F.col("probs"), F.array(F.lit(1), F.lit(10), F.lit(60)))
    return v.post.select("track_id", "frame_id", m.alias("m")).select("track_id", "frame_id", F.round(F.col("m")[9], 6).alias("p10"), F.col("m")[1].alias("p2"))


@query("c21_top1", "SELECT frame_id, CAST(list_position(probs, list_max(probs)) AS INT) AS number, round(list_max(probs), 6) AS p FROM v_post")
def _(v):
    return v.post.select("frame_id", X.top1(F.col("probs")).alias("t")).select("frame_id", "t.number", F.round("t.p", 6).alias("p"))


@query("c22_lock_state", """SELECT frame_id, CASE WHEN p1 >= 0.6 AND m >= 0.2 THEN 'locked' WHEN p1 >= 0.4 AND m >= 0.1 THEN 'tentative' ELSE 'unknown' END AS state
  FROM (SELECT frame_id, s[1] AS p1, s[1] - s[2] AS m FROM (SELECT frame_id, list_reverse_sort(probs) AS s FROM v_post))""")
def _(v):
    p = F.col("probs")
    return v.post.select("frame_id", X.lock_state(F.array_max(p), X.margin(p), 0.6, 0.2).alias("state"))


@query("c23_top5_alternatives", """SELECT frame_id, CAST(r AS INT) AS rank, CAST(n AS INT) AS number, round(p, 6) AS p FROM (SELECT frame_id, n, p, row_number() OVER (PARTITION BY frame_id ORDER BY p DESC, n) AS r FROM (
  SELECT frame_id, unnest(probs) AS p, unnest(range(1, 65)) AS n FROM v_post)) WHERE r <= 5""")
def _(v):
    rows = v.post.select("frame_id", F.posexplode(X.alternatives(F.col("probs"))).alias("pos", "a"))
    return rows.select("frame_id", (F.col("pos") + 1).alias("rank"), F.col("a.number").alias("number"), F.round("a.p", 6).alias("p"))


@query("c24_temperature", "SELECT frame_id, round(list_max(q) / list_sum(q), 6) AS p1 FROM (SELECT frame_id, list_transform(probs, lambda p: pow(p, 1 / 3.0::DOUBLE)) AS q FROM v_post)")
def _(v):
    return v.post.select("frame_id", F.round(F.array_max(X.tempered(F.col("probs"), 3.0)), 6).alias("p1"))


@query("a12_deterministic_validation_split", "SELECT doc_id, CAST(list_reduce(list_transform(string_split(md5('doc' || doc_id), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, c: (a * 16 + c) % 100) AS INT) < 15 AS is_val FROM documents")
def _(v):
    return v.table("documents").select("doc_id", (X.hash_fold(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))) < 15).alias("is_val"))


@query("c25_hash_split", "SELECT doc_id, CAST(list_reduce(list_transform(string_split(md5(CAST(doc_id AS VARCHAR)), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, c: (a * 16 + c) % 100) AS INT) AS fold FROM labels")
def _(v):
    return v.table("labels").select("doc_id", X.hash_fold(F.col("doc_id").cast("string")).alias("fold"))


@query("c26_hue_names", "SELECT seq, name, count(*) AS n FROM (SELECT seq, CASE WHEN h < 10 OR h >= 170 THEN 'red' WHEN h < 25 THEN 'orange' WHEN h < 35 THEN 'yellow' WHEN h < 85 THEN 'green' WHEN h < 130 THEN 'blue' ELSE 'purple' END AS name FROM (SELECT seq, event_id % 180 AS h FROM v_num)) GROUP BY ALL")
def _(v):
    return v.num.groupBy("seq", X.hue_name(F.col("event_id") % 180).alias("name")).agg(F.count("*").alias("n"))


@query("c27_torso_crop", "SELECT event_id, round(x + w * 0.2, 4) AS x1, round(y + h * 0.15, 4) AS y1, round(x + w * 0.8, 4) AS x2, round(y + h * 0.55, 4) AS y2 FROM v_box")
def _(v):
    from touchline.operators import teams as T

    return v.box.select("event_id", T.torso(0.2, 0.8, 0.15, 0.55).alias("c")).select("event_id", *[F.round(f"c.{k}", 4).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("c28_hue_histogram", "SELECT track_id, CAST(event_id % 180 // 15 AS INT) AS bin, round(count(*) / sum(count(*)) OVER (PARTITION BY track_id), 6) AS share FROM v_num GROUP BY track_id, 2")
def _(v):
    from touchline.operators import teams as T

    return T.histogram(v.num.withColumn("h", F.col("event_id") % 180), "h", 180, 12, "track_id")


@query("c29_crop_quality", "SELECT event_id, round(greatest(0, w * h / 5000 + (event_id % 10) / 10.0::DOUBLE - 0.5 - CASE WHEN x < 50 THEN 0.2 ELSE 0 END), 6) AS quality FROM v_box")
def _(v):
    from touchline.operators import identity as I

    q = I.crop_quality(size=F.col("w") * F.col("h") / 5000, sharpness=(F.col("event_id") % 10) / 10.0, contrast=F.lit(0.0), edges=F.lit(0.0), brightness=F.lit(0.5), border=F.when(F.col("x") < 50, 0.2).otherwise(0.0))
    return v.box.select("event_id", F.round(q, 6).alias("quality"))


@query("c30_foot_zone", "SELECT event_id, x + 20 BETWEEN x AND x + w AND y + 60 BETWEEN y + h * 0.7 AND y + h AS at_foot FROM v_box")
def _(v):
    return v.box.select("event_id", X.foot_zone(F.col("x") + 20, F.col("y") + 60, X.box(), 0.3).alias("at_foot"))


@query("c31_path_costs", "SELECT event_id, CASE WHEN x > 1000 THEN NULL ELSE round((x / 1000) * (x / 1000), 6) END AS kinematic, round(abs(ln(w * h / 2500)), 6) AS area FROM v_box")
def _(v):
    k = X.kinematic_cost(F.col("x"), 1000.0)
    return v.box.select("event_id", F.when(k < float("inf"), F.round(k, 6)).alias("kinematic"), F.round(F.abs(F.log(F.col("w") * F.col("h") / 2500)), 6).alias("area"))


@query("c32_safe_rate", "SELECT seq, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (WHERE visible) / count(*)::DOUBLE END, 6) AS rate FROM v_track GROUP BY seq")
def _(v):
    return v.track.groupBy("seq").agg(F.count_if("visible").alias("a"), F.count("*").alias("b")).select("seq", F.round(X.safe_rate(F.col("a"), F.col("b")), 6).alias("rate"))


@query("c33_legibility_label", "SELECT * FROM (SELECT frame_id, CASE WHEN quality >= 0.35 AND frame_id % 3 = 0 AND legibility >= 0.7 THEN 1 WHEN quality < 0.15 THEN 0 END AS label FROM v_post) WHERE label IS NOT NULL")
def _(v):
    return v.post.select("frame_id", X.legibility_label(F.col("quality"), F.col("frame_id") % 3, F.lit(0), F.col("legibility")).alias("label")).where("label IS NOT NULL")


@query("c34_composite_score", "SELECT seq, round(0.30 * f1 + 0.25 * mota + 0.20 * team_accuracy + 0.15 * (1 - rmse / max(rmse) OVER ()) + 0.10 * idf1, 6) AS composite FROM v_report")
def _(v):
    from touchline.operators import reports as P

    return P.composite(v.report).select("seq", F.round("composite", 6).alias("composite"))


@query("c35_not_finite_to_zero", "SELECT seq, round(CASE WHEN seq % 3 = 0 THEN 0 ELSE f1 END, 6) AS f1 FROM v_report")
def _(v):
    odd = F.when(F.col("seq") % 6 == 0, float("inf")).when(F.col("seq") % 6 == 3, float("nan")).otherwise(F.col("f1"))
    return v.report.select("seq", F.round(X.finite(odd), 6).alias("f1"))


@query("c36_log_switches", "SELECT seq, round(ln(1 + n_frames), 6) AS log_switches FROM v_report")
def _(v):
    return v.report.select("seq", F.round(F.log1p("n_frames"), 6).alias("log_switches"))


@query("c37_progress_eta", "SELECT event_id, round((event_id % 50 + 1) / 50.0::DOUBLE, 6) AS progress, round(value / (event_id % 50 + 1) * (49 - event_id % 50), 8) AS eta_s FROM events")
def _(v):
    done = F.col("event_id") % 50 + 1
    return v.table("events").select("event_id", F.round(done / 50, 6).alias("progress"), F.round(F.col("value") / done * (50 - done), 8).alias("eta_s"))


@query("c38_console_metrics", "SELECT event_id, round(value, 2) AS precision_pct FROM events")
def _(v):
    text = F.concat(F.lit("... Precision: "), F.printf(F.lit("%.4f"), F.col("value")), F.lit("% | Recall: 1.0%"))
    return v.table("events").select("event_id", F.round(F.regexp_extract(text, r"Precision:\s*([0-9.]+)%", 1).cast("double"), 2).alias("precision_pct"))


@query("c39_slice_grid", "SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT DISTINCT least(x * 512, 1280) AS x, least(y * 512, 440) AS y FROM range(0, 4) a(x), range(0, 3) b(y))")
def _(v):
    from touchline.operators import trajectory as J

    return J.slices(v.spark, 1920, 1080, 640, 0.2)


@query("c40_composite_key", "SELECT seq, track_id, count(*) AS n FROM v_num GROUP BY seq, track_id")
def _(v):
    return v.num.groupBy(F.struct("seq", "track_id").alias("key")).agg(F.count("*").alias("n")).select("key.seq", "key.track_id", "n")


@query("c41_display_label", "SELECT event_id, CASE track_id % 3 WHEN 0 THEN '#' || CAST(track_id AS VARCHAR) WHEN 1 THEN CAST(track_id % 99 AS VARCHAR) ELSE CAST(track_id % 99 AS VARCHAR) || '?' END AS label FROM v_num")
def _(v):
    k = F.col("track_id") % 3
    return v.num.select("event_id", X.display_label(F.when(k > 0, F.col("track_id") % 99), F.when(k == 2, "tentative").otherwise("locked"), F.col("track_id")).alias("label"))


@query("c42_team_of_class", "SELECT event_id, CASE WHEN cls IN (0, 2) THEN 0 WHEN cls IN (1, 3) THEN 1 ELSE -1 END AS team FROM v_box")
def _(v):
    lookup = F.create_map(*[F.lit(x) for k in (0, 1, 2, 3) for x in (k, k % 2)])
    return v.box.select("event_id", F.coalesce(F.try_element_at(lookup, F.col("cls")), F.lit(-1)).alias("team"))


@query("c43_dice_from_iou", "SELECT seq, round(2 * f1 / (1 + f1), 6) AS dice, round(1 - mota / 2, 6) AS from_loss FROM v_report")
def _(v):
    return v.report.select("seq", F.round(2 * F.col("f1") / (1 + F.col("f1")), 6).alias("dice"), F.round(1 - F.col("mota") / 2, 6).alias("from_loss"))
