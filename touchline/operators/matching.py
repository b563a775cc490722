"""Matching of predictions with ground truth: joins, votes and one-to-one
assignment. Every join has an equality on (seq, frame_id), so none is a nested
loop; assignment runs on arrays of one frame's pairs, a sequence's frames in
one Python call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import exprs as X
from touchline.kernels.boxes import overlaps
from touchline.kernels.hungarian import assign

FRAME = ["seq", "frame_id"]


def prefixed(df: DataFrame, prefix: str, keep: list[str] = FRAME) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def looked_up(rows: DataFrame, tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """rows with the columns of each lookup table where its keys have a row.
    Spark broadcasts those whose size it knows to be small."""
    for table, keys in tables:
        rows = rows.join(table, keys, "left")
    return rows


def pairs(pred: DataFrame, gt: DataFrame, least: float = 0.5, rule: str = "zero") -> DataFrame:
    """All pairs of a frame's boxes that overlap by at least `least`."""
    both = prefixed(pred, "p_").join(prefixed(gt, "g_"), FRAME)
    return both.withColumn("iou", X.iou(X.box("p_"), X.box("g_"), rule)).where(F.col("iou") >= least)


def best_candidates(pred: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """For each truth that some box overlaps by at least `least`, the box that
    overlaps it most (ties: the smaller track), and how many others do: these
    are false positives. A box may be the best of several truths."""
    best = F.max_by(F.struct(F.col("p_track_id").alias("p_id"), "iou"), F.struct("iou", -F.col("p_track_id")))
    found = pairs(pred, gt, least).groupBy(*FRAME, F.col("g_track_id").alias("g_id")).agg(best.alias("b"), (F.count("*") - 1).alias("extra"))
    return found.select(*FRAME, "g_id", "b.p_id", "b.iou", "extra")


def frame_counts(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Rows of either side in each frame of either side."""
    p = pred.groupBy(*FRAME).agg(F.count("*").alias("n_pred"))
    g = gt.groupBy(*FRAME).agg(F.count("*").alias("n_gt"))
    return p.join(g, FRAME, "full_outer").select(*FRAME, F.coalesce("n_pred", F.lit(0)).cast("long").alias("n_pred"), F.coalesce("n_gt", F.lit(0)).cast("long").alias("n_gt"))


def frames_of(pdf: pd.DataFrame, columns: list[str], order: list[str] | None = None) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """((seq, frame and the further keys of `order`), ids and values of side 0,
    ids and values of side 1) of each frame, ids in order: one sort for all."""
    keys = [*FRAME, *(order or [])]
    pdf = pdf.sort_values([*keys, "side", "id"])
    names, side, ids, values = pdf[keys].to_numpy(), pdf["side"].to_numpy(), pdf["id"].to_numpy(), pdf[columns].to_numpy(float)
    starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)]) if len(pdf) else np.empty(0, int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=False):
        k = a + int(np.searchsorted(side[a:b], 1))
        yield tuple(names[a].tolist()), ids[a:k], values[a:k], ids[k:b], values[k:b]


def _solve(pdf: pd.DataFrame, columns: list[str], cost: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.DataFrame:
    out = []
    for (seq, frame), p_ids, p, g_ids, g in frames_of(pdf, columns):
        if len(p) and len(g):
            c = cost(p, g)
            out += [(seq, frame, int(p_ids[i]), int(g_ids[j]), float(c[i, j])) for i, j in assign(c)]
    return pd.DataFrame(out, columns=["seq", "frame_id", "pred_id", "gt_id", "cost"])


MATCHED = "seq long, frame_id long, pred_id long, gt_id long, cost double"


def _sides(pred: DataFrame, gt: DataFrame, *columns: str) -> DataFrame:
    side = lambda df, k: df.select(*FRAME, F.lit(k).alias("side"), F.col("track_id").alias("id"), *columns)
    return side(pred, 0).unionByName(side(gt, 1))


def chunk(column: str = "frame_id", size: int = 250) -> Column:
    """Frames solve on their own, so a long sequence is many groups."""
    return F.floor(F.col(column) / size).alias("_chunk")


def by_distance(pred: DataFrame, gt: DataFrame, most: float = 3.0) -> DataFrame:
    """One-to-one pairs of a frame with the least total distance, of which
    those at most `most` metres apart count: the cut comes after solving."""

    def distance(p: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.hypot(p[:, None, 0] - g[None, :, 0], p[:, None, 1] - g[None, :, 1])

    solved = _sides(pred, gt, "x_m", "y_m").groupBy("seq", chunk()).applyInPandas(lambda pdf: _solve(pdf, ["x_m", "y_m"], distance), MATCHED)
    return solved.where(F.col("cost") <= most).withColumnRenamed("cost", "distance_m")


def by_overlap(pred: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one pairs of a frame with the most total overlap, of which those
    of at least `least` count."""

    def miss(p: np.ndarray, g: np.ndarray) -> np.ndarray:
        return 1 - overlaps(p, g, 1e-8)

    solved = _sides(pred, gt, "x", "y", "w", "h").groupBy("seq", chunk()).applyInPandas(lambda pdf: _solve(pdf, ["x", "y", "w", "h"], miss), MATCHED)
    return solved.withColumn("iou", 1 - F.col("cost")).where(F.col("iou") >= least).drop("cost")


def majority(votes: DataFrame, keys: list[str], value: str, order: str = "frame_id") -> DataFrame:
    """The most frequent value of each key; ties go to the one seen first, then
    to the smaller. Counting has map-side combining, so a hot key is no hot task."""
    counts = votes.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"), -F.col(value))).alias("m")).select(*keys, f"m.{value}", F.col("m.n").alias("votes"))


def team_mapping(votes: DataFrame) -> DataFrame:
    """The better of the two ways to map teams 0 and 1 on sides 0 and 1:
    straight if as many votes agree with it. votes: seq, team_id, side."""
    sums = votes.groupBy("seq").agg(F.count_if(F.col("team_id") == F.col("side")).alias("straight"), F.count_if(F.col("team_id") != F.col("side")).alias("crossed"))
    return sums.withColumn("is_straight", F.col("straight") >= F.col("crossed"))


def nearest_neighbours(keepers: DataFrame, others: DataFrame, k: int = 4) -> DataFrame:
    """Each keeper's k nearest others in each frame. Both have x, y, track_id."""
    both = keepers.select(*FRAME, F.col("track_id").alias("keeper_id"), F.col("x").alias("kx"), F.col("y").alias("ky")).join(others, FRAME).where("track_id <> keeper_id")
    dx, dy = F.col("kx") - F.col("x"), F.col("ky") - F.col("y")
    both = both.withColumn("dist", F.sqrt(dx * dx + dy * dy))
    w = Window.partitionBy(*FRAME, "keeper_id").orderBy("dist", "track_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sticky_matches(pred: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """CLEAR matching: a pair of the frame before stays while it overlaps, the
    rest is assigned by least 1 - IoU; `switched` marks a ground truth track
    that changed its prediction since it was last matched."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, int] = {}
        last: dict[int, int] = {}
        out = []
        for (seq, frame), p_ids, p, g_ids, g in frames_of(pdf, ["x", "y", "w", "h"]):
            if not len(p) or not len(g):
                held = {}
                continue
            iou = overlaps(p, g, 1e-6)
            pid, gid = p_ids.tolist(), g_ids.tolist()
            got = {gt_id: pred_id for gt_id, pred_id in held.items() if gt_id in gid and pred_id in pid and iou[pid.index(pred_id), gid.index(gt_id)] >= least}
            rp = [i for i, x in enumerate(pid) if x not in got.values()]
            rg = [j for j, x in enumerate(gid) if x not in got]
            if rp and rg:
                c = np.where(iou[np.ix_(rp, rg)] >= least, 1 - iou[np.ix_(rp, rg)], np.inf)
                got |= {gid[rg[j]]: pid[rp[i]] for i, j in assign(c) if np.isfinite(c[i, j])}
            for gt_id, pred_id in sorted(got.items()):
                out.append((int(seq), int(frame), pred_id, gt_id, float(iou[pid.index(pred_id), gid.index(gt_id)]), last.get(gt_id, pred_id) != pred_id))
            last |= got
            held = got
        return pd.DataFrame(out, columns=["seq", "frame_id", "pred_id", "gt_id", "iou", "switched"])

    return _sides(pred, gt, "x", "y", "w", "h").groupBy("seq").applyInPandas(walk, "seq long, frame_id long, pred_id long, gt_id long, iou double, switched boolean")
