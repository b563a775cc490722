"""Shirt-number identity: quality, fusion of frames, duplicates, fragments."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import exprs as X

TRACK = ["seq", "track_id"]


def crop_quality(size: Column, sharpness: Column, contrast: Column, edges: Column, brightness: Column, border: Column) -> Column:
    return F.greatest(F.lit(0.0), size + sharpness + contrast + edges - brightness - border)


def gated(frames: DataFrame, threshold: float = 0.5, least: int = 4) -> DataFrame:
    """Only legible frames of a track, if at least `least` are; else all."""
    w = Window.partitionBy(*TRACK)
    fine = F.col("legibility") >= threshold
    return frames.withColumn("_n", F.count_if(fine).over(w)).where((F.col("_n") < least) | fine).drop("_n")


def top_frames(frames: DataFrame, k: int = 16, least: int = 8) -> DataFrame:
    """A track's k best frames by quality, ties to the earlier; tracks of fewer
    than `least` frames go."""
    best = Window.partitionBy(*TRACK).orderBy(F.desc("quality"), "frame_id")
    return frames.withColumn("_n", F.count("*").over(Window.partitionBy(*TRACK))).withColumn("rank", F.row_number().over(best)).where((F.col("_n") >= least) & (F.col("rank") <= k)).drop("_n")


def top_share(frames: DataFrame, share: float = 0.5) -> DataFrame:
    """The best max(2, ceil(share * n)) frames of a track."""
    best = Window.partitionBy(*TRACK).orderBy(F.desc("quality"), "frame_id")
    n = F.count("*").over(Window.partitionBy(*TRACK))
    return frames.withColumn("rank", F.row_number().over(best)).withColumn("_n", n).where(F.col("rank") <= F.greatest(F.lit(2), F.ceil(F.col("_n") * share))).drop("_n")


def peaks(frames: DataFrame, least: float = 0.3) -> DataFrame:
    """Strict local maxima of quality of at least `least`, ends allowed."""
    w = Window.partitionBy(*TRACK).orderBy("frame_id")
    low = F.lit(float("-inf"))
    q = F.col("quality")
    return frames.withColumn("_b", F.coalesce(F.lag("quality").over(w), low)).withColumn("_a", F.coalesce(F.lead("quality").over(w), low)).where((q > F.col("_b")) & (q > F.col("_a")) & (q >= least)).drop("_a", "_b")


def peak_scores(peaked: DataFrame) -> DataFrame:
    """Sum of quality times confidence by top number, as a map."""
    t = X.top1(F.col("probs"))
    rows = peaked.select(*TRACK, t["number"].alias("number"), (F.col("quality") * t["p"]).alias("s")).where("number IS NOT NULL")
    sums = rows.groupBy(*TRACK, "number").agg(F.sum("s").alias("s"))
    return sums.groupBy(*TRACK).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("number", "s")))).alias("scores"))


def fused(frames: DataFrame, mode: str = "geometric", temperature: float = 1.0, roster: Column | None = None) -> DataFrame:
    """One probability vector of each track: frames weighted by quality times
    legibility (evenly where all are about 0), in log space ("geometric", or
    "top_k" over the best half) or as they are ("arithmetic").

    Vectors are exploded once and summed by (track, number), with map-side
    combining; a hot track is no hot task.
    """
    rows = top_share(frames) if mode == "top_k" else frames
    rows = rows.withColumn("_w", F.col("quality") * F.col("legibility")).withColumn("probs", X.tempered(F.col("probs"), temperature))
    flat = rows.select(*TRACK, "_w", F.posexplode("probs").alias("i", "p"))
    value = F.col("p") if mode == "arithmetic" else F.log(F.col("p") + 1e-10)
    sums = flat.groupBy(*TRACK, "i").agg(F.sum(F.col("_w") * value).alias("wv"), F.sum("_w").alias("w"), F.avg(value).alias("even"))
    sums = sums.withColumn("v", F.when(F.col("w") > 1e-8, F.col("wv") / F.when(F.col("w") > 1e-8, F.col("w"))).otherwise(F.col("even")))
    vector = sums.groupBy(*TRACK).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"))
    if roster is not None and mode != "arithmetic":
        vector = vector.withColumn("v", F.transform("v", lambda x, i: F.when(F.array_contains(roster, i + 1), x).otherwise(F.lit(float("-inf")))))
    probs = X.renormalised(F.col("v")) if mode == "arithmetic" else X.softmax(F.col("v"))
    return vector.select(*TRACK, probs.alias("probs"))


def assigned(tracks: DataFrame, p1_threshold: float, margin_threshold: float) -> DataFrame:
    """Number, confidence and state of each track from its vector; tracks of no
    team are unknown. tracks: seq, track_id, team_id, probs, frame_ids."""
    t = tracks.withColumn("_t", X.top1(F.col("probs"))).withColumn("margin", X.margin(F.col("probs"))).withColumn("p1", F.col("_t.p"))
    ours = F.col("team_id").isin(0, 1)
    state = F.when(ours & F.col("_t").isNotNull(), X.lock_state(F.col("p1"), F.col("margin"), p1_threshold, margin_threshold)).otherwise("unknown")
    return t.withColumn("state", state).withColumn("raw_top1", F.when(ours, F.col("_t.number"))).withColumn("confidence", F.when(ours, F.coalesce("p1", F.lit(0.0))).otherwise(0.0)).withColumn("predicted_number", F.when(F.col("state") != "unknown", F.col("_t.number"))).drop("_t")


def resolved(tracks: DataFrame, reassign: bool = False, least: float = 0.30) -> DataFrame:
    """Two tracks of one team and number whose frames overlap can't both keep
    it: the surer does, ties to the smaller track. A loser becomes unknown or,
    with `reassign`, takes its likeliest free number of at least `least`. A
    team of a sequence is one group: what is free depends on earlier choices."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("track_id").reset_index(drop=True)
        frames = [set(f) for f in pdf["frame_ids"]]
        number = [None if pd.isna(n) else int(n) for n in pdf["predicted_number"]]
        state, confidence = pdf["state"].tolist(), pdf["confidence"].tolist()
        clash: list[int | None] = [None] * len(pdf)
        came: list[int | None] = [None] * len(pdf)
        first = {}
        for i, n in enumerate(number):
            if n is not None:
                first.setdefault(n, []).append(i)
        for n, own in first.items():
            kept: list[int] = []
            for i in sorted(own, key=lambda i: (-confidence[i], i)):
                rival = next((k for k in kept if frames[i] & frames[k]), None)
                if rival is None:
                    kept.append(i)
                    continue
                clash[i], number[i], state[i] = int(pdf["track_id"][rival]), None, "unknown"
                if reassign:
                    taken = {number[k] for k in range(len(pdf)) if k != i and number[k] is not None and frames[i] & frames[k]}
                    p = np.asarray(pdf["probs"][i], float)
                    for j in np.argsort(-p, kind="stable")[1:]:
                        if p[j] < least:
                            break
                        if int(j) + 1 not in taken:
                            number[i], state[i], confidence[i], came[i] = int(j) + 1, "tentative", float(p[j]), n
                            break
        out = pdf[["seq", "track_id", "team_id"]].assign(predicted_number=number, state=state, confidence=confidence, conflict_with=clash, reassigned_from=came)
        return out.astype({"predicted_number": "Int64", "conflict_with": "Int64", "reassigned_from": "Int64"})

    return tracks.groupBy("seq", "team_id").applyInPandas(run, "seq long, track_id long, team_id long, predicted_number long, state string, confidence double, conflict_with long, reassigned_from long")


def fragments(rows: DataFrame) -> DataFrame:
    """First and last frame and box of each track. rows: seq, track_id,
    team_id, frame_id, x, y, w, h."""
    b = F.struct("frame_id", "x", "y", "w", "h")
    return rows.groupBy("seq", "track_id").agg(F.min(b).alias("s"), F.max(b).alias("e"), F.min_by("team_id", "frame_id").alias("team_id")).select("seq", "track_id", "team_id", F.col("s").alias("start"), F.col("e").alias("end"))


def link_candidates(frags: DataFrame, numbers: DataFrame | None = None, gap: int = 50) -> DataFrame:
    """Ends that a start at most `gap` frames later can follow: same team, near
    enough, no two different numbers.

    The interval join is an equality on (seq, team, frame bucket): an end is
    copied to the two buckets of `gap` frames where a start can lie, so the join
    never compares a team's fragments with all others.
    """
    f = frags.where(F.col("team_id").isin(0, 1))
    bucket = F.floor(F.col("end.frame_id") / gap)
    ends = f.select("seq", "team_id", F.col("track_id").alias("a"), "end", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    starts = f.select("seq", "team_id", F.col("track_id").alias("b"), "start", F.floor(F.col("start.frame_id") / gap).alias("bucket"))
    both = ends.join(starts, ["seq", "team_id", "bucket"]).where("a <> b").withColumn("gap", F.col("start.frame_id") - F.col("end.frame_id")).where((F.col("gap") > 0) & (F.col("gap") <= gap))
    centre = lambda c: (F.col(f"{c}.x") + F.col(f"{c}.w") / 2, F.col(f"{c}.y") + F.col(f"{c}.h") / 2)
    (ax, ay), (bx, by) = centre("end"), centre("start")
    both = both.withColumn("dist", F.hypot(ax - bx, ay - by))
    both = both.where(F.col("dist") <= F.least(F.lit(300.0), 40 + 6 * F.col("gap") + 0.5 * F.greatest("end.w", "end.h")))
    if numbers is not None:
        for side in "ab":
            both = both.join(numbers.select("seq", F.col("track_id").alias(side), F.col("number").alias(f"n{side}")), ["seq", side], "left")
        both = both.where("na IS NULL OR nb IS NULL OR na = nb").drop("na", "nb")
    return both.select("seq", "a", "b", "gap", "dist")


def linked(candidates: DataFrame, frags: DataFrame) -> DataFrame:
    """Group of each fragment, named by its first: links in order of gap,
    distance and tracks, each end and start used once, then chains."""
    ids = frags.select("seq", F.col("track_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("gap"), F.lit(None).cast("double").alias("dist"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[int, int] = {}
        before: dict[int, int] = {}
        for r in pdf[pdf["b"].notna()].sort_values(["gap", "dist", "a", "b"]).itertuples():
            if r.a not in after and r.b not in before:
                after[r.a], before[int(r.b)] = int(r.b), r.a
        out = []
        for t in pdf[pdf["b"].isna()]["a"]:
            root = t
            while root in before:
                root = before[root]
            out.append((pdf["seq"].iloc[0], t, root))
        return pd.DataFrame(out, columns=["seq", "track_id", "group_id"])

    return candidates.unionByName(ids).groupBy("seq").applyInPandas(run, "seq long, track_id long, group_id long")


def mode_switch(frames: DataFrame, segment: int = 8, dominance: float = 0.6) -> DataFrame:
    """The split of a track where its dominant number changes: the one with
    the largest product of both sides' shares and the shorter side's length.
    frames: seq, track_id, frame_id, number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tops = pdf.sort_values("frame_id")["number"].tolist()
        best = None
        left, right = Counter(), Counter(tops)
        for split in range(1, len(tops)):
            left[tops[split - 1]] += 1
            right[tops[split - 1]] -= 1
            if split < segment or len(tops) - split < segment:
                continue
            (lm, ln), (rm, rn) = (max(c.items(), key=lambda x: (x[1], -x[0])) for c in (left, right))
            ls, rs = ln / split, rn / (len(tops) - split)
            if lm != rm and ls >= dominance and rs >= dominance:
                score = ls * rs * min(split, len(tops) - split)
                if best is None or score > best[0]:
                    best = (score, split, lm, rm)
        row = [pdf["seq"].iloc[0], pdf["track_id"].iloc[0], *(best[1:] if best else (None,) * 3)]
        return pd.DataFrame([row], columns=["seq", "track_id", "split", "left_mode", "right_mode"]).astype({c: "Int64" for c in ("split", "left_mode", "right_mode")})

    return frames.groupBy(*TRACK).applyInPandas(run, "seq long, track_id long, split long, left_mode long, right_mode long")


def pooled(frames: DataFrame, groups: DataFrame, minority: float = 0.30, **how) -> DataFrame:
    """Vectors of linked groups: frames of all fragments together, less those
    whose top number has under `minority` of the group's frames."""
    rows = frames.join(groups, TRACK).withColumn("_top", F.array_position("probs", F.array_max("probs")))
    g = Window.partitionBy("seq", "group_id")
    share = F.count("*").over(Window.partitionBy("seq", "group_id", "_top")) / F.count("*").over(g)
    kept = rows.withColumn("_share", share).withColumn("_best", F.max("_share").over(g)).where((F.col("_share") >= minority) | (F.col("_share") == F.col("_best")))
    one = fused(kept.drop("track_id", "_top", "_share", "_best").withColumnRenamed("group_id", "track_id"), **how)
    return groups.join(one.withColumnRenamed("track_id", "group_id"), ["seq", "group_id"])


def best_variant(crops: DataFrame, least: float = 0.0) -> DataFrame:
    """The crop variant of each frame with the most quality times legibility,
    the base one where none reaches `least`."""
    s = F.col("quality") * F.col("legibility")
    best = crops.groupBy("seq", "track_id", "frame_id").agg(F.max_by(F.struct("variant", s.alias("score")), F.struct(s, -F.col("variant"))).alias("b"))
    return best.select("seq", "track_id", "frame_id", F.when(F.col("b.score") >= least, F.col("b.variant")).otherwise(0).alias("variant"), "b.score")


def padded_bag(frames: DataFrame, k: int) -> DataFrame:
    """k frames of each track: its frames in order, again from the first where
    it has fewer."""
    w = Window.partitionBy(*TRACK).orderBy("frame_id")
    rows = frames.select(*TRACK, "frame_id").withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*TRACK))).where(F.col("_i") < k)
    size = F.least(F.col("_n"), F.lit(k))
    return rows.withColumn("slot", F.explode(F.sequence(F.col("_i").cast("long"), F.lit(k - 1).cast("long"), size.cast("long")))).drop("_i", "_n")


def seeded_sample(rows: DataFrame, key: list[str], item: str, n: int, seed: int = 0) -> DataFrame:
    """n items of each key, in order of a seeded hash."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*key, item]]))
    return rows.withColumn("_h", h).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("_h", item))).where(F.col("rank") <= n).drop("_h")


def sweep(tracks: DataFrame, p1: list[float], margin: list[float], truth: DataFrame) -> DataFrame:
    """Accuracy of each pair of thresholds. The grid is a literal array, so no
    join is made: a row meets all settings in one projection."""
    grid = F.array(*[F.struct(F.lit(a).alias("p1_threshold"), F.lit(b).alias("margin_threshold")) for a in p1 for b in margin])
    rows = tracks.join(truth, TRACK).withColumn("_t", X.top1(F.col("probs"))).withColumn("_m", X.margin(F.col("probs"))).withColumn("c", F.explode(grid))
    locked = (F.col("_t.p") >= F.col("c.p1_threshold")) & (F.col("_m") >= F.col("c.margin_threshold"))
    right = F.col("_t.number") == F.col("truth")
    return rows.groupBy("c.p1_threshold", "c.margin_threshold").agg(F.count("*").alias("n"), F.count_if(locked).alias("locked"), F.count_if(locked & ~right).alias("false_locks"), F.count_if(locked & right).alias("right"))


def ranked_sweep(swept: DataFrame) -> DataFrame:
    """Settings in order: fewest false locks, then most right, then most locked."""
    rate = F.col("false_locks") / F.greatest("locked", F.lit(1))
    w = Window.orderBy(rate, F.desc(F.col("right") / F.col("n")), F.desc("locked"), "p1_threshold", "margin_threshold")
    return swept.withColumn("rank", F.row_number().over(w))
