"""Alignment metrics, detection numbers, sweeps, failures, pruned scans and
streams with timers, against plain versions."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import identity as I
from touchline.operators import metrics as E
from touchline.operators import sweeps as Q
from touchline.sources import readers as R
from touchline.streaming import online as O
from touchline.streaming import stateful as S

BOX = "seq long, frame_id long, track_id long, x double, y double, w double, h double"


def crowd(seed: int, n: int = 4, frames: int = 12, noise: float = 8.0) -> list[tuple]:
    """Tracks close to each other, so that boxes of a frame compete."""
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, 40, (n, 2))
    out = []
    for f in range(frames):
        at += rng.normal(0, 4, at.shape)
        out += [(1, f, t, float(x), float(y), 30.0, 60.0) for t, (x, y) in enumerate((at + rng.normal(0, noise, at.shape)).tolist()) if rng.random() < 0.85]
    return out


def by_frame(rows: list[tuple]) -> dict:
    out: dict = {}
    for _, f, t, x, y, w, h in rows:
        out.setdefault(f, {})[t] = {"x": x, "y": y, "w": w, "h": h}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hota_of_competing_boxes(spark, seed):
    pred, gt = crowd(seed), crowd(seed, noise=3.0)
    pred = [(s, f, (t + 1) % 4 if f > 6 and t < 2 else t, *b) for s, f, t, *b in pred]
    pred = list({(s, f, t): (s, f, t, *b) for s, f, t, *b in pred}.values())
    got = {r.level: r for r in E.hota_levels(spark.createDataFrame(pred, BOX), spark.createDataFrame(gt, BOX)).collect()}
    assert sorted(got) == list(range(1, 20))
    for k in (1, 5, 10, 15, 19):
        det, ass, both = brute.hota(by_frame(pred), by_frame(gt), k / 20)
        assert (got[k].det_a, got[k].ass_a, got[k].hota) == (pytest.approx(det), pytest.approx(ass), pytest.approx(both))


def test_hota_of_one_empty_side(spark):
    none, some = spark.createDataFrame([], BOX), spark.createDataFrame(crowd(1), BOX)
    for a, b in ((none, some), (some, none)):
        assert {(r.hota, r.tp, r.loc_a) for r in E.hota_levels(a, b).collect()} == {(0.0, 0, 1.0)}
    assert E.hota_levels(none, none).collect() == []


def test_detection_outcomes_in_crowded_images():
    rng = np.random.default_rng(7)
    for _ in range(150):
        truth = np.column_stack([rng.uniform(0, 60, (5, 2)), rng.uniform(15, 120, (5, 2))])[: rng.integers(0, 6)]
        box = (truth[rng.integers(0, len(truth), 7)] if len(truth) else rng.uniform(1, 90, (7, 4))) + rng.normal(0, 4, (7, 4))
        box[:, 2:] = np.abs(box[:, 2:]) + 1
        got = E.coco_outcomes(box, truth)
        named = lambda a: [dict(zip("xywh", r, strict=True)) for r in a.tolist()]
        for a, (_, low, high) in enumerate(E.COCO_AREAS):
            for k, level in enumerate(E.COCO_LEVELS):
                assert got[:, a, k].tolist() == brute.detection_outcomes(named(box), named(truth), level, low, high)


def test_fusion_sweep_equals_fusing_each_setting(spark):
    rng = np.random.default_rng(3)
    rows = [(1, t, f, float(rng.integers(0, 8)) / 8, float(rng.random()), (p := rng.random(12) ** 4).tolist()) for t in range(5) for f in range(3 + 5 * t)]
    rows = [(*r[:5], (np.array(r[5]) / sum(r[5])).tolist()) for r in rows]
    frames = spark.createDataFrame(rows, "seq long, track_id long, frame_id long, quality double, legibility double, probs array<double>")
    truth = spark.createDataFrame([(1, t, t % 12 + 1) for t in range(5)], "seq long, track_id long, truth int")
    got = {(r.fusion_mode, r.temperature, r.legibility, r.p1_threshold): r for r in Q.fusion_sweep(frames, truth, [1.0, 2.0], [0.5, 0.8], [0.1, 0.3], [0.01]).collect()}
    assert len(got) == 3 * 2 * 2 * 2
    for mode, name in (("geometric", "geometric"), ("arithmetic", "arithmetic"), ("topk_geometric", "top_k")):
        for t, cut in ((1.0, 0.5), (2.0, 0.8), (2.0, 0.5)):
            one = I.fused(I.gated(frames, cut), name, t).join(truth, ["seq", "track_id"]).collect()
            tops = [(int(np.argmax(r.probs)) + 1 == r.truth, max(r.probs), sorted(r.probs)[-1] - sorted(r.probs)[-2]) for r in one]
            for p1 in (0.1, 0.3):
                r = got[mode, t, cut, p1]
                assert (r.n, r.top1) == (len(one), sum(x[0] for x in tops))
                assert r.locked == sum(p >= p1 and m >= 0.01 for _, p, m in tops)


def test_a_group_that_raises_leaves_one_row(spark):
    rows = spark.createDataFrame([(k, v) for k in range(4) for v in range(3)], "k long, v long")
    got = {r.k: r for r in Q.isolated(rows.groupBy("k"), lambda pdf: pdf.assign(v=6 // (pdf["k"].iloc[0] - 2))[["k", "v"]].head(2) if int(pdf["k"].iloc[0]) != 2 else 1 / 0, "k long, v long", "k").collect()}
    assert got[2].v is None and got[2].error == "ZeroDivisionError: division by zero"
    assert [got[k].error for k in (0, 1, 3)] == [None] * 3 and got[3].v == 6


def test_tracklet_scan_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(s, t, str(f)) for s in range(4) for t in range(3) for f in range(5 + t)], "seq long, track_id long, value string")
    rows.write.partitionBy("seq", "track_id").text(path)
    numbers = spark.createDataFrame([(1, 2, -1), (3, 2, 7)], "seq long, track_id long, number int")
    found = R.tracklet_folders(spark, path, 6, numbers, F.col("seq") % 2 == 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seq" in plan or "PartitionFilters: [((seq" in plan
    assert sorted(map(tuple, found.collect())) == [(1, 1, 6), (3, 1, 6), (3, 2, 7)]


def test_occlusions_count_once(spark):
    marks = [(0, 1), (1, 30), (1, 40), (0, 10), (0, 90), (1, 5), (0, 21), (1, 3)]
    rows = [(1, f, bool(o), float(e)) for f, (o, e) in enumerate(marks)]
    r = E.occlusion_recovery(spark.createDataFrame(rows, "seq long, frame_id long, occluded boolean, error double")).first()
    assert (r.occlusions, r.recovery) == (2, 0.5)


def test_frames_split_across_batches_are_taken_together(spark):
    """Two tracks swap places; taken apart, each would look new."""
    box = lambda f, t, x, late: (1, f, t, 0.5, float(x), 0.0, 10.0, 10.0, f + late)
    rows = [box(f, t, 100 * t, 3 * (t == 2)) for f in range(12) for t in (1, 2)] + [box(f, 3, 300, 0) for f in (0, 1, 6)] + [box(40, 9, 0, 0)]
    table = spark.createDataFrame(rows, "seq long, frame_id long, track_id long, score double, x double, y double, w double, h double, arrives long")
    got = O.replayed(table, "arrives", lambda s: S.lifecycle(s, ttl=2, delay=5), parts=8, settings=S.PROVIDER).collect()
    events = {(r.frame_id, r.track_id): r.event for r in got}
    assert all(events[f, t] == ("new" if f == 0 else "seen") for f in range(12) for t in (1, 2))
    assert [events[f, 3] for f in (0, 1, 4, 6, 9)] == ["new", "seen", "expired", "new", "expired"]
    assert events[14, 1] == events[14, 2] == "expired" and (40, 9) not in events


def test_status_after_a_failed_run(spark):
    names = ["epoch_end", "train_start", "epoch_end", "error", "epoch_end", "train_start", "epoch_end", "train_end", "train_end", "train_start"]
    rows = spark.createDataFrame([("a", e, i, 0.5) for i, e in enumerate(names)], "experiment string, event string, epoch long, metric double")
    got = [tuple(r) for r in O.replayed(rows, "epoch", S.status_changes, parts=4, settings=S.PROVIDER).orderBy("number").collect()]
    assert got == [("a", 1, 1, 1, None, "training", 0), ("a", 2, 3, 1, "training", "error", 1), ("a", 3, 5, 2, "error", "training", 0), ("a", 4, 7, 2, "training", "complete", 1), ("a", 5, 9, 3, "complete", "training", 0)]
