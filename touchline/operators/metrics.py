"""Evaluation: ball, tracking, curves, classification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.kernels.boxes import overlaps
from touchline.kernels.hungarian import assign
from touchline.operators import matching as M
from touchline.operators.running import running
from touchline.sources.scratch import scratch_path

EPS = 1e-6


def ball_status(pred: DataFrame, gt: DataFrame, most: float = 0.02) -> DataFrame:
    """tp, fp, fn of each frame of either side. pred, gt: seq, frame_id, x, y.
    A pair farther than `most` counts as a false positive and as a miss."""
    both = pred.select("seq", "frame_id", F.col("x").alias("px"), F.col("y").alias("py")).join(gt.select("seq", "frame_id", F.col("x").alias("gx"), F.col("y").alias("gy")), M.FRAME, "full_outer")
    dist = F.hypot(F.col("px") - F.col("gx"), F.col("py") - F.col("gy"))
    near = F.coalesce(dist <= most, F.lit(False))
    return both.select("seq", "frame_id", dist.alias("dist"), near.cast("int").alias("tp"), (F.col("px").isNotNull() & ~near).cast("int").alias("fp"), (F.col("gx").isNotNull() & ~near).cast("int").alias("fn"))


def ball_report(status: DataFrame) -> DataFrame:
    """Precision, recall, F1, RMSE, MAE and false positives per frame."""
    s = status.groupBy("seq").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sqrt(F.avg(F.col("dist") ** 2)).alias("rmse"), F.avg("dist").alias("mae"), F.count("*").alias("n"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    return s.select("seq", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + EPS)).alias("f1"), "rmse", "mae", (F.col("fp") / F.col("n")).alias("fppi"))


def occlusion_recovery(rows: DataFrame, most: float = 20.0) -> DataFrame:
    """Of each sequence's occlusions (runs of rows marked `occluded`) that end,
    how many there are and the share whose first row after is at most `most`
    off. rows: seq, frame_id, occluded, error."""
    before = F.lag("occluded").over(Window.partitionBy("seq").orderBy("frame_id"))
    ends = rows.withColumn("_ends", before & ~F.col("occluded")).where("_ends")
    return ends.groupBy("seq").agg(F.count("*").alias("occlusions"), (F.count_if(F.col("error") <= most) / F.count("*")).alias("recovery"))


def fragments(status: DataFrame) -> DataFrame:
    """Recoveries: hits whose last frame with ground truth before was missed."""
    w = Window.partitionBy("seq").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("tp") == 1, 1).when(F.col("fn") == 1, 0)
    out = status.withColumn("_s", state).withColumn("_before", F.last("_s", True).over(w))
    return out.groupBy("seq").agg(F.count_if((F.col("_s") == 1) & (F.col("_before") == 0)).alias("fragments"))


def clear_mot(matches: DataFrame, pred: DataFrame, gt: DataFrame) -> DataFrame:
    """MOTA, MOTP (mean 1 - IoU), switches."""
    m = matches.groupBy("seq").agg(F.count("*").alias("tp"), F.count_if("switched").alias("switches"), F.avg(1 - F.col("iou")).alias("motp"))
    g = gt.groupBy("seq").agg(F.count("*").alias("n_gt"))
    p = pred.groupBy("seq").agg(F.count("*").alias("n_pred"))
    out = g.join(p, "seq", "full_outer").join(m, "seq", "left").na.fill(0, ["tp", "switches", "n_gt", "n_pred"])
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_gt") - F.col("tp")
    return out.select("seq", fp.alias("fp"), fn.alias("fn"), "switches", (1 - (fp + fn + F.col("switches")) / F.nullif(F.col("n_gt"), F.lit(0))).alias("mota"), "motp")


def idf1(overlaps: DataFrame, pred: DataFrame, gt: DataFrame) -> DataFrame:
    """IDF1: tracks of both sides paired once for the whole sequence so that
    most frames agree. overlaps: seq, frame_id, p_track_id, g_track_id."""
    counts = overlaps.groupBy("seq", "p_track_id", "g_track_id").agg(F.countDistinct("frame_id").alias("n"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.pivot_table(index="p_track_id", columns="g_track_id", values="n", fill_value=0)
        hits = sum(int(t.iloc[i, j]) for i, j in assign(-t.to_numpy(float)))
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "idtp": [hits]})

    hits = counts.groupBy("seq").applyInPandas(best, "seq long, idtp long")
    n = pred.groupBy("seq").agg(F.count("*").alias("n_pred")).join(gt.groupBy("seq").agg(F.count("*").alias("n_gt")), "seq")
    return n.join(hits, "seq", "left").select("seq", F.coalesce("idtp", F.lit(0)).alias("idtp"), (2 * F.coalesce("idtp", F.lit(0)) / (F.col("n_pred") + F.col("n_gt"))).alias("idf1"))


def hota(matches: DataFrame, pred: DataFrame, gt: DataFrame, *keys: str) -> DataFrame:
    """DetA, AssA and HOTA of one-to-one matches (pred_id, gt_id), by sequence
    and the further keys (a threshold)."""
    by = ["seq", *keys]
    tpa = matches.groupBy(*by, "pred_id", "gt_id").agg(F.count("*").alias("tpa"))
    p = pred.groupBy("seq", F.col("track_id").alias("pred_id")).agg(F.count("*").alias("n_p"))
    g = gt.groupBy("seq", F.col("track_id").alias("gt_id")).agg(F.count("*").alias("n_g"))
    joined = tpa.join(p, ["seq", "pred_id"]).join(g, ["seq", "gt_id"])
    ass = joined.groupBy(*by).agg(F.sum("tpa").alias("tp"), F.sum(F.col("tpa") * F.col("tpa") / (F.col("n_p") + F.col("n_g") - F.col("tpa"))).alias("a"))
    n = p.groupBy("seq").agg(F.sum("n_p").alias("n_pred")).join(g.groupBy("seq").agg(F.sum("n_g").alias("n_gt")), "seq")
    det = F.col("tp") / (F.col("n_pred") + F.col("n_gt") - F.col("tp"))
    out = ass.join(n, "seq").withColumn("det_a", det).withColumn("ass_a", F.col("a") / F.col("tp"))
    return out.select(*by, "det_a", "ass_a", F.sqrt(F.col("det_a") * F.col("ass_a")).alias("hota"))


def aligned_matches(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """One-to-one pairs of each frame as the tracking benchmark's library finds
    them: seq, frame_id, p_track_id, g_track_id, iou.

    Two passes. First, how well two tracks align over the whole sequence: the
    overlap of a frame's pair, divided by all that its two boxes overlap there,
    summed over frames and set against both tracks' lengths. Then each frame is
    solved for the most overlap times alignment. A pair of boxes that overlap
    nothing else is a match as it is; only frames where boxes compete go
    through the solver, and only those boxes.
    """
    both = M.pairs(pred.select(*M.FRAME, "track_id", "x", "y", "w", "h"), gt.select(*M.FRAME, "track_id", "x", "y", "w", "h"), 1e-12, "floor8")
    pairs = both.select(*M.FRAME, "p_track_id", "g_track_id", "iou")
    of_p, of_g = Window.partitionBy(*M.FRAME, "p_track_id"), Window.partitionBy(*M.FRAME, "g_track_id")
    soft = F.col("iou") / (F.sum("iou").over(of_p) + F.sum("iou").over(of_g) - F.col("iou"))
    pairs = pairs.withColumns({"soft": soft, "_rivals": F.count("*").over(of_p) + F.count("*").over(of_g)})
    p = pred.groupBy("seq", F.col("track_id").alias("p_track_id")).agg(F.count("*").alias("n_p"))
    g = gt.groupBy("seq", F.col("track_id").alias("g_track_id")).agg(F.count("*").alias("n_g"))
    sums = pairs.groupBy("seq", "p_track_id", "g_track_id").agg(F.sum("soft").alias("s"))
    alignment = sums.join(p, ["seq", "p_track_id"]).join(g, ["seq", "g_track_id"]).select("seq", "p_track_id", "g_track_id", (F.col("s") / (F.col("n_p") + F.col("n_g") - F.col("s"))).alias("alignment"))
    kept = ["seq", "frame_id", "p_track_id", "g_track_id", "iou"]
    rivals = pairs.where("_rivals > 2").join(alignment, ["seq", "p_track_id", "g_track_id"]).select(*kept, (F.col("iou") * F.col("alignment")).alias("gain"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(kept[1:4])
        frame, p_id, g_id, gain = (pdf[c].to_numpy() for c in ("frame_id", "p_track_id", "g_track_id", "gain"))
        won = []
        bounds = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1], True]).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows, row = np.unique(p_id[a:b], return_inverse=True)
            columns, column = np.unique(g_id[a:b], return_inverse=True)
            total, at = np.zeros((len(rows), len(columns))), np.full((len(rows), len(columns)), -1)
            total[row, column], at[row, column] = gain[a:b], np.arange(a, b)
            won += [at[i, j] for i, j in assign(-total) if at[i, j] >= 0]
        return pdf.iloc[won][kept]

    solved = rivals.groupBy("seq", M.chunk()).applyInPandas(solve, "seq long, frame_id long, p_track_id long, g_track_id long, iou double")
    return pairs.where("_rivals = 2").select(*kept).unionByName(solved)


def hota_levels(pred: DataFrame, gt: DataFrame, levels: int = 19) -> DataFrame:
    """HOTA and its parts for each sequence at each overlap threshold level / 20:
    seq, level, tp, fp, fn, det_a, ass_a, ass_re, ass_pr, loc_a, hota. Matches
    are counted by pair of tracks and level first, and thresholds are sums of
    those counts. Sequences without matches count as zero."""
    level = F.least(F.floor(F.col("iou") * (levels + 1) + 1e-9), F.lit(levels)).cast("int")
    counts = aligned_matches(pred, gt).groupBy("seq", "p_track_id", "g_track_id", level.alias("top")).agg(F.count("*").alias("c"), F.sum("iou").alias("loc"))
    each = counts.where("top >= 1").select("seq", "p_track_id", "g_track_id", "c", "loc", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("level"))
    each = each.groupBy("seq", "level", "p_track_id", "g_track_id").agg(F.sum("c").alias("c"), F.sum("loc").alias("loc"))
    p = pred.groupBy("seq", F.col("track_id").alias("p_track_id")).agg(F.count("*").alias("n_p"))
    g = gt.groupBy("seq", F.col("track_id").alias("g_track_id")).agg(F.count("*").alias("n_g"))
    c = F.col("c")
    joined = each.join(p, ["seq", "p_track_id"]).join(g, ["seq", "g_track_id"])
    sums = joined.groupBy("seq", "level").agg(F.sum("c").alias("tp"), F.sum("loc").alias("loc"), F.sum(c * c / (F.col("n_p") + F.col("n_g") - c)).alias("a"), F.sum(c * c / F.col("n_g")).alias("re"), F.sum(c * c / F.col("n_p")).alias("pr"))
    n = p.groupBy("seq").agg(F.sum("n_p").alias("n_pred")).join(g.groupBy("seq").agg(F.sum("n_g").alias("n_gt")), "seq", "full_outer").na.fill(0)
    grid = n.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    return _hota_parts(grid.join(sums, ["seq", "level"], "left").na.fill(0), ["seq", "level"])


def _hota_parts(sums: DataFrame, keys: list[str]) -> DataFrame:
    tp, n_pred, n_gt = F.col("tp"), F.col("n_pred"), F.col("n_gt")
    share = lambda x: F.col(x) / F.greatest(tp, F.lit(1))
    det = tp / F.greatest(n_pred + n_gt - tp, F.lit(1))
    return sums.select(*keys, tp.cast("long").alias("tp"), (n_pred - tp).cast("long").alias("fp"), (n_gt - tp).cast("long").alias("fn"), det.alias("det_a"), share("a").alias("ass_a"), share("re").alias("ass_re"), share("pr").alias("ass_pr"), F.when(tp > 0, F.col("loc") / tp).otherwise(1.0).alias("loc_a"), F.sqrt(det * share("a")).alias("hota"))


def hota_thresholds(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Means of hota_levels() over its thresholds, for each sequence."""
    return hota_levels(pred, gt).groupBy("seq").agg(*[F.avg(c).alias(c) for c in ("hota", "det_a", "ass_a", "ass_re", "ass_pr", "loc_a")])


def hota_combined(levels: DataFrame) -> DataFrame:
    """hota_levels() of all sequences as one: hits and misses are added up,
    association and location are weighted by hits. A row for each level."""
    weighted = {k: F.sum(F.col(c) * F.col("tp")).alias(k) for k, c in (("a", "ass_a"), ("re", "ass_re"), ("pr", "ass_pr"), ("loc", "loc_a"))}
    sums = levels.groupBy("level").agg(F.sum("tp").alias("tp"), F.sum(F.col("tp") + F.col("fp")).alias("n_pred"), F.sum(F.col("tp") + F.col("fn")).alias("n_gt"), *weighted.values())
    return _hota_parts(sums, ["level"])


def permuted_accuracy(pairs: DataFrame) -> DataFrame:
    """Team accuracy under the better of two labellings. pairs: seq, team, side."""
    s = F.count_if(F.col("team") == F.col("side"))
    return pairs.groupBy("seq").agg((F.greatest(s, F.count("*") - s) / F.count("*")).alias("team_accuracy"))


def role_scores(matches: DataFrame, role: str) -> DataFrame:
    """Precision and recall of a role: a predicted track counts once, a missed
    ground truth track once. matches: seq, pred_id, gt_id, pred_role, gt_role."""
    tp = F.countDistinct(F.when((F.col("pred_role") == role) & (F.col("gt_role") == role), F.col("pred_id")))
    fp = F.countDistinct(F.when((F.col("pred_role") == role) & (F.col("gt_role") != role), F.col("pred_id")))
    fn = F.countDistinct(F.when((F.col("pred_role") != role) & (F.col("gt_role") == role), F.col("gt_id")))
    s = matches.groupBy("seq").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return s.select("seq", "tp", "fp", "fn", (F.col("tp") / (F.col("tp") + F.col("fp") + EPS)).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn") + EPS)).alias("recall"))


def average_precision(scored: DataFrame, n_gt: DataFrame) -> DataFrame:
    """Precision-recall curve's area by trapezoids, for detections marked hit
    (0 or 1) by falling score, ties by id. scored: seq, score, id, hit. The
    point before a row is known from the row's own sums."""
    curve = running(scored.withColumn("_one", F.lit(1)), ["seq"], [F.desc("score"), F.col("id")], _tp="hit", _n="_one").join(n_gt, "seq")
    precision, recall = F.col("_tp") / F.col("_n"), F.col("_tp") / F.col("n_gt")
    before = F.col("_tp") - F.col("hit")
    height = precision + F.when(F.col("_n") > 1, before / F.nullif(F.col("_n") - 1, F.lit(0))).otherwise(1.0)
    return curve.withColumn("_a", F.col("hit") / F.col("n_gt") * height / 2).withColumn("_r", recall).groupBy("seq").agg(F.sum("_a").alias("ap"), F.max("_r").alias("recall"))


def success_curve(errors: DataFrame, column: str, levels: int, below: bool = True, unit: float = 1.0) -> DataFrame:
    """Share of rows at most (or at least) each level. Rows fall into a level
    first, and shares are sums over the levels' counts: rows times levels are
    never made."""
    level = F.ceil(F.col(column) / unit) if below else F.floor(F.col(column) / unit)
    counts = errors.groupBy("seq", F.greatest(F.least(level, F.lit(levels + 1)), F.lit(0)).cast("int").alias("level")).agg(F.count("*").alias("n"))
    grid = counts.select("seq").distinct().select("seq", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    both = grid.join(counts, ["seq", "level"], "full_outer").na.fill(0, ["n"])
    order = Window.partitionBy("seq").orderBy("level" if below else F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("n").over(order) / F.sum("n").over(Window.partitionBy("seq"))
    return both.withColumn("share", share).where(F.col("level") <= levels).select("seq", "level", "share")


def curve_area(curve: DataFrame, levels: int) -> DataFrame:
    w = Window.partitionBy("seq").orderBy("level")
    return curve.withColumn("_a", (F.col("share") + F.lag("share").over(w)) / 2).groupBy("seq").agg((F.sum("_a") / levels).alias("auc"))


def binary_report(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall, F1 of (label, p)."""
    hit = F.col("p") >= threshold
    c = rows.agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"), F.count_if(~hit & (F.col("label") == 0)).alias("tn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return c.select("*", p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve of (label, p) by ranks, ties counted half.
    Distinct scores are counted first; sums run in ranges of them."""
    c = rows.groupBy("p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = running(c, [], [F.col("p")], upto="neg")
    s = below.withColumn("_u", F.col("pos") * (F.col("upto") - F.col("neg") / 2)).agg(F.sum("_u").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select((F.col("u") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("roc_auc"))


def pr_auc(rows: DataFrame) -> DataFrame:
    """Average precision of (label, p): precision summed over recall's steps."""
    c = rows.groupBy("p").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    s = running(c, [], [F.desc("p")], hits="pos", seen="n")
    return s.agg((F.sum(F.col("pos") * F.col("hits") / F.col("seen")) / F.sum("pos")).alias("pr_auc"))


#: Fixed values of the detection benchmark: overlap thresholds, ranges of areas, detections of an image that count, recall points.
COCO_LEVELS = tuple((50 + 5 * k) / 100 for k in range(10))
COCO_AREAS = (("all", 0.0, 1e10), ("small", 0.0, 32.0**2), ("medium", 32.0**2, 96.0**2), ("large", 96.0**2, 1e10))
COCO_MOST = (1, 10, 100)
COCO_POINTS = 101
_MISS, _HIT, _IGNORED = 0, 1, 2


def coco_outcomes(box: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Outcome of each detection of an image (by falling score) in each range of
    areas at each level: hit, miss or ignored. A detection takes the free truth
    it overlaps most, one of the range if any reaches the level; else one
    outside the range, which ignores it. Detections outside the range that take
    nothing are ignored too."""
    area = lambda b: b[:, 2] * b[:, 3]
    outside = lambda b: np.stack([(area(b) < low) | (area(b) > high) for _, low, high in COCO_AREAS])
    levels, shape = np.array(COCO_LEVELS), (len(COCO_AREAS), len(COCO_LEVELS))
    out = np.repeat(np.where(outside(box).T, _IGNORED, _MISS)[:, :, None], shape[1], axis=2).astype(np.int8)
    if not len(truth):
        return out
    iou, ignored = overlaps(box, truth), outside(truth)
    taken = np.zeros((*shape, len(truth)), bool)
    a, k = np.indices(shape)
    for i in np.flatnonzero(iou.max(axis=1) >= levels[0]):
        fits = ~taken & (iou[i] >= levels[None, :, None])
        inside = np.where(fits & ~ignored[:, None], iou[i], -1.0)
        other = np.where(fits & ignored[:, None], iou[i], -1.0)
        good, spare = inside.max(axis=2) >= 0, other.max(axis=2) >= 0
        at = np.where(good, inside.argmax(axis=2), other.argmax(axis=2))
        got = good | spare
        taken[a[got], k[got], at[got]] = True
        out[i] = np.where(good, _HIT, np.where(spare, _IGNORED, out[i]))
    return out


def coco_summary(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """The twelve numbers of the detection benchmark for each class of the
    truths: ap, ap50, ap75 and ap of small, medium and large truths; ar with 1,
    10 and 100 detections of an image, and of each size. pred has score; images
    are (seq, frame_id). Null where a class has no truth of a size.

    Images are matched in chunks of a sequence's frames. Precision along a
    class's falling scores needs running sums: detections are dealt in ranges
    of (class, score), each with its outcomes in one vector, summed within a
    range, and a range starts from the sums of those before it, so a class with
    most of the detections is many tasks and no row is copied for a curve.
    """
    spark, curves = pred.sparkSession, len(COCO_AREAS) * len(COCO_LEVELS)
    both = pred.select("seq", "frame_id", F.lit(0).alias("side"), F.col("track_id").alias("id"), "cls", "score", "x", "y", "w", "h").unionByName(gt.select("seq", "frame_id", F.lit(1).alias("side"), F.col("track_id").alias("id"), "cls", F.lit(0.0).alias("score"), "x", "y", "w", "h"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, frame, cls), ids, p, _, g in M.frames_of(pdf, ["score", "x", "y", "w", "h"], ["cls"]):
            order = np.lexsort((ids, -p[:, 0]))[: COCO_MOST[-1]]
            found = coco_outcomes(p[order, 1:], g[:, 1:])
            out += [(int(cls), p[i, 0], int(frame), ids[i], rank, o.tobytes()) for rank, (i, o) in enumerate(zip(order, found, strict=True))]
        return pd.DataFrame(out, columns=["cls", "score", "frame_id", "id", "rank", "outcome"])

    rows = both.groupBy("seq", M.chunk()).applyInPandas(match, "cls int, score double, frame_id long, id long, rank int, outcome binary")
    path, n = scratch_path(spark, "coco"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["cls", F.desc("score"), F.col("frame_id"), F.col("id")]
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).write.parquet(path)
    ranged = spark.read.parquet(path)

    def of_classes(table: pd.DataFrame):
        table = table.sort_values("at")
        cls = table["cls"].to_numpy()
        bounds = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1], True]).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield int(cls[a]), table["rank"].to_numpy()[a:b], np.frombuffer(b"".join(table["outcome"].iloc[a:b]), np.int8).reshape(-1, curves)

    def totals(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cls, rank, outcome in of_classes(table):
            hits = [(outcome[rank < most, : len(COCO_LEVELS)] == _HIT).sum(axis=0).tolist() for most in COCO_MOST]
            out.append((key[0], cls, (outcome == _HIT).sum(axis=0).tolist(), (outcome != _IGNORED).sum(axis=0).tolist(), hits))
        return pd.DataFrame(out, columns=["part", "cls", "tp", "n", "first"])

    kind = "part long, cls int, tp array<long>, n array<long>, first array<array<long>>"
    sums_path = scratch_path(spark, "coco-sums")
    ranged.groupBy("part").applyInPandas(totals, kind).write.parquet(sums_path)
    sums = spark.read.schema(kind).parquet(sums_path)  # a row for each range and class in it
    flat_sums = sums.select("part", "cls", F.posexplode(F.arrays_zip("tp", "n")).alias("curve", "s"))
    earlier = Window.partitionBy("cls", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before_it = flat_sums.select("part", "cls", "curve", *[F.coalesce(F.sum(f"s.{c}").over(earlier), F.lit(0)).alias(c) for c in ("tp", "n")])
    listed = F.array_sort(F.collect_list(F.struct("curve", "tp", "n")))
    bases = before_it.groupBy("part", "cls").agg(listed.alias("s")).select("part", "cls", "s.tp", "s.n")
    low, high = [F.lit(x) for _, x, _ in COCO_AREAS], [F.lit(x) for _, _, x in COCO_AREAS]
    size = F.col("w") * F.col("h")
    truths = gt.groupBy("cls").agg(F.array(*[F.count_if((size >= a) & (size <= b)) for a, b in zip(low, high, strict=True)]).alias("truths"))
    known = bases.join(truths, "cls")

    def curve(key: tuple, table: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        before = {int(r.cls): (np.asarray(r.tp), np.asarray(r.n), np.repeat(np.asarray(r.truths), len(COCO_LEVELS))) for r in base.itertuples()}
        out = []
        for cls, _, outcome in of_classes(table) if len(table) else ():
            if cls not in before:
                continue
            tp0, n0, truth = before[cls]
            tp, n = tp0 + (outcome == _HIT).cumsum(axis=0), n0 + (outcome != _IGNORED).cumsum(axis=0)
            for c in np.flatnonzero(truth):
                own = n[:, c] > 0
                recall, precision = tp[own, c] / truth[c], tp[own, c] / n[own, c]
                point = np.floor(np.round(recall * (COCO_POINTS - 1), 9)).astype(int)
                best = np.full(COCO_POINTS, -1.0)
                np.maximum.at(best, point, precision)
                out += [(cls, int(c), int(k), float(best[k])) for k in np.flatnonzero(best >= 0)]
        return pd.DataFrame(out, columns=["cls", "curve", "k", "precision"])

    points = ranged.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(curve, "cls int, curve int, k int, precision double")
    best = points.groupBy("cls", "curve", "k").agg(F.max("precision").alias("precision"))
    along = Window.partitionBy("cls", "curve").orderBy("k")
    steps = best.withColumn("_p", F.max("precision").over(along.rowsBetween(0, Window.unboundedFollowing))).withColumn("_k", F.col("k") - F.coalesce(F.lag("k").over(along), F.lit(-1)))
    per = steps.groupBy("cls", "curve").agg((F.sum(F.col("_p") * F.col("_k")) / COCO_POINTS).alias("ap"))
    grid = truths.withColumn("curve", F.explode(F.sequence(F.lit(0), F.lit(curves - 1)))).withColumn("area", F.floor(F.col("curve") / len(COCO_LEVELS)).cast("int")).where(F.get("truths", F.col("area")) > 0)
    ap = grid.select("cls", "curve", "area").join(per, ["cls", "curve"], "left").na.fill(0.0, ["ap"])
    mean = lambda a: F.avg(F.when(F.col("area") == a, F.col("ap")))
    aps = ap.groupBy("cls").agg(mean(0).alias("ap"), F.max(F.when(F.col("curve") == 0, F.col("ap"))).alias("ap50"), F.max(F.when(F.col("curve") == 5, F.col("ap"))).alias("ap75"), mean(1).alias("ap_small"), mean(2).alias("ap_medium"), mean(3).alias("ap_large"))
    flat = sums.select("cls", *[F.aggregate(F.get("first", i), F.lit(0).cast("long"), lambda t, x: t + x).alias(f"_first{i}") for i in range(len(COCO_MOST))], *[F.aggregate(F.slice("tp", a * len(COCO_LEVELS) + 1, len(COCO_LEVELS)), F.lit(0).cast("long"), lambda t, x: t + x).alias(f"_area{a}") for a in range(1, len(COCO_AREAS))])
    hits = flat.groupBy("cls").agg(*[F.sum(c).alias(c) for c in flat.columns if c != "cls"])
    rate = lambda c, a: F.when(F.get("truths", F.lit(a)) > 0, F.coalesce(c, F.lit(0)) / (F.get("truths", F.lit(a)) * len(COCO_LEVELS)))
    recalls = [rate(F.col(f"_first{i}"), 0).alias(f"ar{m}") for i, m in enumerate(COCO_MOST)] + [rate(F.col(f"_area{a}"), a).alias(f"ar_{COCO_AREAS[a][0]}") for a in range(1, len(COCO_AREAS))]
    return truths.join(aps, "cls", "left").join(hits, "cls", "left").select("cls", "ap", "ap50", "ap75", "ap_small", "ap_medium", "ap_large", *recalls)
