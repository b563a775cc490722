"""Sweeps of settings in one pass, and groups whose failure is their own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from touchline.functions import exprs as X

TRACK = ["seq", "track_id"]
MODES = ("geometric", "arithmetic", "topk_geometric")


def fusion_sweep(frames: DataFrame, truth: DataFrame, temperatures: list[float], legibility: list[float], p1: list[float], margins: list[float], min_legible: int = 4, share: float = 0.5) -> DataFrame:
    """Counts of right and locked tracks for every setting of fusion mode,
    temperature, legibility threshold, lock threshold and margin. frames: seq,
    track_id, frame_id, quality, legibility, probs; truth: seq, track_id, truth.

    Frames are flattened once. A frame counts in every legibility threshold up
    to its own level, and in the best share of some of them (a bit mask), so
    sums by (track, level, mask, number) hold what all thresholds and modes
    need, for all temperatures side by side. Tracks with fewer than
    `min_legible` frames at a threshold use all of theirs. Locks are decided on
    the fused vectors, so their thresholds add nothing to what is shuffled.
    """
    cuts = sorted(legibility)
    every = range(len(cuts) + 1)  # 0: no threshold
    level = sum(((F.col("legibility") >= c).cast("int") for c in cuts), F.lit(0))
    track, best = Window.partitionBy(*TRACK), Window.partitionBy(*TRACK).orderBy(F.desc("quality"), "frame_id")
    rows = frames.withColumn("level", level)
    here = [(F.col("level") >= k).cast("int") for k in every]
    rank = [F.sum(h).over(best) for h in here]
    most = [F.greatest(F.lit(2), F.ceil(F.sum(h).over(track) * share)) for h in here]
    mask = sum((F.when((h == 1) & (r <= m), 1 << k).otherwise(0) for k, (h, r, m) in enumerate(zip(here, rank, most, strict=True))), F.lit(0))
    rows = rows.withColumns({"mask": mask, "_w": F.col("quality") * F.col("legibility")})
    counts = rows.groupBy(*TRACK).agg(F.array(*[F.sum(h) for h in here]).alias("n_legible"))
    tempered = [X.tempered(F.col("probs"), t).alias(f"t{j}") for j, t in enumerate(temperatures)]
    flat = rows.select(*TRACK, "level", "mask", "_w", *tempered).select(*TRACK, "level", "mask", "_w", F.posexplode(F.arrays_zip(*[f"t{j}" for j in range(len(temperatures))])).alias("i", "p"))
    kinds = {"a": lambda p: p, "g": lambda p: F.log(p + 1e-10)}
    value = {f"{k}{j}": f(F.col(f"p.t{j}")) for k, f in kinds.items() for j in range(len(temperatures))}
    sums = [a for c, x in value.items() for a in (F.sum(F.col("_w") * x).alias(f"w{c}"), F.sum(x).alias(f"s{c}"))]
    cells = flat.groupBy(*TRACK, "level", "mask", "i").agg(F.sum("_w").alias("w"), F.count("*").alias("n"), *sums)
    # from here on a track has a row for each number, level and mask, however many its frames
    upto = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("level"))))
    top = F.expr("(mask >> k) & 1 = 1")
    parts = ["w", "n", *[f"{s}{c}" for c in value for s in ("w", "s")]]
    added = upto.groupBy(*TRACK, "k", "i").agg(*[F.sum(c).alias(c) for c in parts], *[F.sum(F.when(top, F.col(c)).otherwise(0)).alias(f"top_{c}") for c in parts])
    fused = lambda c, at: F.when(F.col(f"{at}w") > 1e-8, F.col(f"{at}w{c}") / F.when(F.col(f"{at}w") > 1e-8, F.col(f"{at}w"))).otherwise(F.col(f"{at}s{c}") / F.col(f"{at}n"))
    source = {"geometric": ("g", ""), "arithmetic": ("a", ""), "topk_geometric": ("g", "top_")}
    values = {f"{m}_{j}": fused(f"{source[m][0]}{j}", source[m][1]) for m in MODES for j in range(len(temperatures))}
    vectors = added.groupBy(*TRACK, "k").agg(F.array_sort(F.collect_list(F.struct("i", *[v.alias(c) for c, v in values.items()]))).alias("v"))

    def probs(mode: str, j: int):
        v = F.transform("v", lambda s: s[f"{mode}_{j}"])
        return X.renormalised(v) if mode == "arithmetic" else X.softmax(v)

    each = F.array(*[F.struct(F.lit(m).alias("fusion_mode"), F.lit(float(t)).alias("temperature"), probs(m, j).alias("probs")) for m in MODES for j, t in enumerate(temperatures)])
    made = vectors.select(*TRACK, F.col("k").alias("_k"), F.explode(each).alias("c")).select(*TRACK, "_k", "c.*")
    used = counts.select(*TRACK, "n_legible", F.posexplode(F.array(*[F.lit(c) for c in cuts])).alias("at", "legibility"))
    used = used.select(*TRACK, "legibility", F.when(F.get("n_legible", F.col("at") + 1) >= min_legible, F.col("at") + 1).otherwise(0).alias("_k"))
    likely = made.select(*TRACK, "_k", "fusion_mode", "temperature", X.alternatives(F.col("probs"), 3).alias("top"), X.margin(F.col("probs")).alias("margin"))
    settings = F.array(*[F.struct(F.lit(float(a)).alias("p1_threshold"), F.lit(float(b)).alias("margin_threshold")) for a in p1 for b in margins])
    rated = likely.join(used, [*TRACK, "_k"]).join(truth, TRACK).withColumn("c", F.explode(settings))
    first = F.get("top", F.lit(0))
    right = first["number"] == F.col("truth")
    locked = (first["p"] >= F.col("c.p1_threshold")) & (F.col("margin") >= F.col("c.margin_threshold"))
    keys = ["fusion_mode", "temperature", "legibility", "c.p1_threshold", "c.margin_threshold"]
    return rated.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(right).alias("top1"), F.count_if(F.exists("top", lambda a: a["number"] == F.col("truth"))).alias("top3"), F.count_if(locked).alias("locked"), F.count_if(locked & right).alias("locked_right"))


def isolated(groups: GroupedData, own: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *keys: str) -> DataFrame:
    """What `own` gives for each group, with `error`: null, or for a group that
    raises one row with its keys and the error's text, and nothing else. Other
    groups go on. A lost executor or a full memory is no error of a group and
    is retried by Spark."""
    fields = T._parse_datatype_string(schema).fieldNames()

    def guarded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return own(pdf).assign(error=None)[[*fields, "error"]]
        except Exception as e:  # noqa: BLE001  whatever a sequence's data do to its evaluation
            named = dict(zip(keys, key, strict=True))
            return pd.DataFrame([[named.get(f) for f in fields] + [f"{type(e).__name__}: {e}"]], columns=[*fields, "error"])

    return groups.applyInPandas(guarded, f"{schema}, error string")
