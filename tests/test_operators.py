"""Behaviour on small literal inputs."""

from __future__ import annotations

import itertools

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import exprs as X
from touchline.kernels import clusters, geometry
from touchline.kernels.hungarian import assign
from touchline.operators import identity as I
from touchline.operators import kinematics as K
from touchline.operators import matching as M
from touchline.operators import metrics as E
from touchline.operators import teams as T
from touchline.operators import trajectory as J
from touchline.sources import readers as R
from touchline.sources import writers as S


def vector(n: int = 99, **p: float) -> list[float]:
    out = [0.0] * n
    for k, v in p.items():
        out[int(k[1:]) - 1] = v
    return out


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {t}" for k, (t, _) in inputs.items())) if False else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def array(v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_roster_mask(spark):
    got = value(spark, X.masked(array([1.0] * 99), F.array(F.lit(1), F.lit(10), F.lit(99))))
    assert got[0] == got[9] == got[98] == pytest.approx(1 / 3) and got[1] == 0
    assert sum(value(spark, X.masked(array([0.0] * 99), F.array(F.lit(1))))) == 0


def test_top1_and_lock_state(spark):
    t = value(spark, X.top1(array(vector(n8=0.8))))
    assert (t.number, t.p) == (8, 0.8)
    assert value(spark, X.top1(array([0.0] * 99))) is None
    p = array(vector(n8=0.9, n4=0.1))
    assert value(spark, X.margin(p)) == pytest.approx(0.8)
    assert value(spark, X.lock_state(F.array_max(p), X.margin(p), 0.85, 0.20)) == "locked"


def test_digit_targets(spark):
    for n, want in ((7, (0, 0, 7)), (25, (1, 2, 5)), (99, (1, 9, 9)), (10, (1, 1, 0))):
        assert tuple(value(spark, X.digits(F.lit(n)))) == want


def test_safe_rate(spark):
    for a, b, want in ((0, 10, 0), (5, 10, 0.5), (10, 10, 1), (0, 0, 0)):
        assert value(spark, X.safe_rate(F.lit(a), F.lit(b))) == want
    for a, b in ((11, 10), (-1, 10)):
        with pytest.raises(Exception, match="rate"):
            value(spark, X.safe_rate(F.lit(a), F.lit(b)))


def test_bbox_variants(spark):
    rows = [('{"bbox":[1,2,3,4]}', True), ('{"box":[1,2,3,4]}', True), ('{"x_min":1,"y_min":2,"x_max":3,"y_max":4}', True), ('{"bbox":[3,2,1,4]}', False), ("{}", False)]
    df = spark.createDataFrame(rows, "j string, ok boolean").withColumn("p", F.from_json("j", R.PLAYER[6:-1]))
    for r in df.select("ok", R.bbox(F.col("p")).alias("b")).collect():
        assert (r.b == [1, 2, 3, 4]) if r.ok else r.b is None


def test_team_map_shapes(spark):
    docs = ['[{"track_id":5,"team_id":0}]', '{"team_assignments":[{"track_id":5,"team_id":0}]}', '{"players":[{"track_id":5,"team_id":1}]}', '{"tracklets":[{"track_id":5}]}']
    df = spark.createDataFrame(list(enumerate(docs)), "seq int, doc string")
    assert {r.seq: r.team_id for r in R.team_map(df, "doc", "seq").collect()} == {0: 0, 1: 0, 2: 1, 3: -1}


def test_readers(spark, tmp_path):
    lines = spark.createDataFrame([("1,2,3,4,5,6,1",), ("1,2,3",), ("1, 2,3,4,5,6,0.5,7,0.25",)], "value string")
    assert [(r.cls, r.visibility) for r in R.mot(lines).orderBy("cls").collect()] == [(-1, 1.0), (7, 0.25)]
    info = spark.createDataFrame([("trackletID_1= goalkeepers team left;x",), ("trackletID_2= player team right;10",), ("name=a",)], "value string")
    got = R.gameinfo(info).orderBy("track_id").collect()
    assert [(r.side, r.role, r.jersey_number) for r in got] == [("left", "goalkeeper", None), ("right", "player", 10)]
    (tmp_path / "000007.txt").write_text("0 .1 .2 .3 .4\n5 .5 .5 .1 .1 3 # team:left\n5 .6 .6 .1 .1\n")
    ball = R.ball_of_frame(R.read_yolo(spark, f"file://{tmp_path}")).collect()
    assert [(r.frame_id, r.cx) for r in ball] == [(7, 0.5)]


def test_writers_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3, 1.5, 2.5, 3.0, 4.0)], "seq long, frame_id long, track_id long, x double, y double, w double, h double")
    S.write_mot(rows, f"file://{tmp_path}/mot")
    back = R.mot(spark.read.text(f"file://{tmp_path}/mot")).first()
    assert (back.seq, back.frame_id, back.track_id, back.x, back.h) == (1, 2, 3, 1.5, 4.0)


def test_numbers_and_hash_split(spark):
    import hashlib

    df = spark.createDataFrame([("",), (" 1.5 ",), ("bad",), (None,)], "t string")
    assert [r.n for r in df.select(X.number(F.col("t")).alias("n")).collect()] == [None, 1.5, None, None]
    for key in ("a", "SNMOT-116/7"):
        assert value(spark, X.hash_fold(F.lit(key))) == int(hashlib.md5(key.encode()).hexdigest(), 16) % 100


def frames(spark, xs):
    rows = [(1, 1, f, float(x), 0.0, 0, "player") for f, x in xs]
    return spark.createDataFrame(rows, "seq long, track_id long, frame_id long, x_m double, y_m double, team_id long, role string")


def test_steps_gaps_outliers_and_cap(spark):
    got = K.motion(frames(spark, [(1, 0), (2, 0.6), (4, 0.8), (5, 4.3), (6, 4.4)])).orderBy("frame_id").collect()
    assert [round(r.distance_m, 6) for r in got] == [0, 0.6, 0, 0, 0.1]
    assert got[1].speed_kmh == 40 and got[3].outlier and got[3].accel_mps2 == 0
    # after an outlier the speed before counts as 0
    assert got[4].accel_mps2 == pytest.approx(0.1 * 25 * 25)


def test_sprint_length_and_tail(spark):
    def xs(runs):
        x, f, out = 0.0, 1, [(1, 0.0)]
        for n, step in runs:
            for _ in range(n):
                x, f = x + step, f + 1
                out.append((f, x))
        return out

    moved = K.motion(frames(spark, xs([(4, 0.3), (2, 0.05), (5, 0.3), (2, 0.05), (6, 0.3)])))
    assert sorted(r.n_frames for r in K.sprints(moved).collect()) == [5, 6]
    t = K.totals(moved).first()
    assert t.sprint_count == 2 and t.sprint_distance_m == pytest.approx(3.3)


def test_hull():
    assert geometry.hull_area(np.array([[0, 0], [1, 1]])) is None
    assert geometry.hull_area(np.array([[0, 0], [1, 1], [2, 2]])) is None
    assert geometry.hull_area(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])) == 1


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = map(int, rng.integers(1, 6, 2))
        c = rng.integers(0, 9, (n, m)).astype(float)
        got = assign(c)
        small, big = sorted((n, m))
        cost = c if n <= m else c.T
        best = min(sum(cost[i, j] for i, j in enumerate(q)) for q in itertools.permutations(range(big), small))
        assert len(got) == small and sum(c[a, b] for a, b in got) == best


def test_matching_solves_before_it_cuts(spark):
    rows = lambda xs: spark.createDataFrame([(1, 1, i, float(x), 0.0) for i, x in enumerate(xs)], "seq long, frame_id long, track_id long, x_m double, y_m double")
    got = M.by_distance(rows([0, 2]), rows([2, 5])).collect()
    assert {(r.pred_id, r.gt_id) for r in got} == {(0, 0), (1, 1)}
    # the least total pairs 0 with the far one; the cut then drops it
    got = M.by_distance(rows([0.0, 2.0]), rows([2.1, 9.0])).collect()
    assert {(r.pred_id, r.gt_id) for r in got} == {(0, 0)} or {(r.pred_id, r.gt_id) for r in got} == {(1, 0)}
    assert M.by_distance(rows([]), rows([1])).count() == 0


def test_majority_tie_goes_to_the_first_seen(spark):
    v = spark.createDataFrame([(1, 5, 1), (1, 4, 2), (1, 4, 3), (1, 5, 4)], "k int, v int, frame_id int")
    assert M.majority(v, ["k"], "v").first()["v"] == 5


def test_far_ball_counts_twice(spark):
    one = lambda x: spark.createDataFrame([(1, 1, x, 0.0)], "seq long, frame_id long, x double, y double")
    s = E.ball_status(one(0.1), one(0.5)).first()
    assert (s.tp, s.fp, s.fn) == (0, 1, 1)


def posteriors(spark, numbers, p, quality=0.5):
    rows = []
    for f, n in enumerate(numbers, 1):
        v = [1e-9] * 99
        v[n - 1] = p[f - 1] if isinstance(p, list) else p
        rows.append((1, 1, f, quality, 1.0, v))
    return spark.createDataFrame(rows, "seq long, track_id long, frame_id long, quality double, legibility double, probs array<double>")


def test_fusion_modes(spark):
    clean = posteriors(spark, [10] * 6, 0.9)
    for mode in ("geometric", "arithmetic", "top_k"):
        assert X and I.fused(clean, mode).select(X.top1(F.col("probs"))["number"].alias("n")).first()["n"] == 10
    robust = posteriors(spark, [10] * 5 + [7], [0.6] * 5 + [1.0])
    assert I.fused(robust, "arithmetic").select(X.top1(F.col("probs"))["number"].alias("n")).first()["n"] == 10
    p1 = lambda t: I.fused(posteriors(spark, [10] * 4, 0.9), temperature=t).select(F.array_max("probs").alias("p")).first()["p"]
    assert p1(3.0) < p1(1.0)


def tracklets(spark, rows):
    return spark.createDataFrame([(1, t, team, vector(**p), f) for t, team, p, f in rows], "seq long, track_id long, team_id long, probs array<double>, frame_ids array<long>")


def test_unknown_team_stays_unknown(spark):
    got = {r.track_id: r for r in I.assigned(tracklets(spark, [(1, -1, {"n8": 0.9}, [1]), (2, 0, {"n8": 0.9}, [1])]), 0.6, 0.2).collect()}
    assert got[1].state == "unknown" and got[1].predicted_number is None and got[2].state == "locked"


def test_duplicates_and_reassignment(spark):
    both = tracklets(spark, [(1, 0, {"n8": 0.9, "n4": 0.1}, [1, 2, 3]), (2, 0, {"n8": 0.55, "n21": 0.40}, [3, 4, 5])])
    plain = {r.track_id: r for r in I.resolved(I.assigned(both, 0.6, 0.2)).collect()}
    assert plain[1].predicted_number == 8 and plain[2].state == "unknown"
    moved = {r.track_id: r for r in I.resolved(I.assigned(both, 0.6, 0.1), True).collect()}
    assert (moved[2].predicted_number, moved[2].state, moved[2].reassigned_from) == (21, "tentative", 8)
    poor = tracklets(spark, [(1, 0, {"n8": 0.9}, [1]), (2, 0, {"n8": 0.6, "n21": 0.1}, [1])])
    lost = {r.track_id: r for r in I.resolved(I.assigned(poor, 0.6, 0.2), True).collect()}
    assert lost[2].predicted_number is None and lost[2].state == "unknown"


def linked(spark, other, team=0, start=10):
    rows = [(1, 1, 0, f, 200.0, 100.0, 30.0, 80.0) for f in range(1, 6)] + [(1, 2, team, f, *other, 30.0, 80.0) for f in range(start, start + 3)]
    frags = I.fragments(spark.createDataFrame(rows, "seq long, track_id long, team_id long, frame_id long, x double, y double, w double, h double"))
    groups = {r.track_id: r.group_id for r in I.linked(I.link_candidates(frags), frags).collect()}
    return groups[1] == groups[2]


def test_fragment_links(spark):
    assert linked(spark, (210.0, 105.0))
    assert not linked(spark, (210.0, 105.0), team=1)
    assert not linked(spark, (210.0, 105.0), start=3)
    assert not linked(spark, (1700.0, 105.0))


def test_mode_switch(spark):
    def found(numbers):
        rows = [(1, 1, f, n) for f, n in enumerate(numbers)]
        r = I.mode_switch(spark.createDataFrame(rows, "seq long, track_id long, frame_id long, number int")).first()
        return None if r.split is None else {r.left_mode, r.right_mode}

    assert found([14] * 12 + [9] * 12) == {14, 9}
    assert found([14] * 24) is None
    assert found([14, 14, 14, 41] * 6) is None


def still(x, y, score=0.9):
    return {"x": x, "y": y, "w": 10.0, "h": 10.0, "score": score}


FRAMES = "seq long, frame_id long, balls array<struct<x:double,y:double,w:double,h:double,score:double>>, players array<struct<track:bigint,x1:double,y1:double,x2:double,y2:double>>, m array<double>"


def test_ball_path_gates_and_attaches(spark):
    m = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    player = {"track": 4, "x1": 80.0, "y1": 50.0, "x2": 120.0, "y2": 110.0}
    rows = [(1, t, [still(100.0, 100.0), *([still(700.0, 100.0, 0.99)] if t == 1 else [])], [], m) for t in range(3)]
    rows += [(2, 0, [still(100.0, 100.0)], [player], m), (2, 1, [], [player | {"x1": 90.0, "x2": 130.0}], m)]
    got = {(r.seq, r.frame_id): r for r in J.ball_trajectory(spark.createDataFrame(rows, FRAMES), delta_P=300).collect()}
    assert [got[1, t].x for t in range(3)] == [100, 100, 100]
    assert got[2, 1].is_dummy and got[2, 1].attached == 4 and got[2, 1].x == 110


def clips(n: int) -> list[tuple]:
    """Sequences of 0 to 30 frames with crowded, empty and far candidates, players at the ball and a moving camera."""
    rng = np.random.default_rng(4)
    rows = []
    for seq in range(n):
        x, y = 300.0, 200.0
        for t in range(int(rng.integers(1, 30)) if seq % 5 else 1):
            x, y = x + rng.normal(0, 60), y + rng.normal(0, 30)
            balls = [] if rng.random() < 0.35 else [still(x + rng.normal(0, 150) * (k > 0), y, float(rng.integers(1, 10)) / 10) | {"w": float(rng.integers(0, 14))} for k in range(rng.integers(1, 5))]
            players = [{"track": int(p), "x1": x - 40 + 30 * p, "y1": y - 90, "x2": x + 20 + 30 * p, "y2": y + float(rng.integers(-5, 40))} for p in range(rng.integers(0, 4))]
            rows.append((seq, t, balls, players, [1.0, 0.01, float(rng.integers(-5, 5)), 0.0, 0.99, 2.0]))
    return rows


@pytest.mark.parametrize("states", [200, 2_000_000])
def test_ball_paths_of_many_sequences_equal_those_of_one(spark, monkeypatch, states):
    rows = clips(60)
    want = {}
    for seq in range(60):
        own = [r for r in rows if r[0] == seq]
        path = brute.ball_path([{"balls": r[2], "players": r[3], "m": np.array(r[4])} for r in own])
        want |= {(seq, r[1]): (p["x"], p["y"], p["w"], p["h"], p["is_dummy"], p["attached"]) for r, p in zip(own, path, strict=True)}
    import pyarrow as pa

    monkeypatch.setattr(J, "BATCH_STATES", states)
    frames = spark.createDataFrame(rows, FRAMES)
    table = pa.Table.from_batches(frames.orderBy("seq", "frame_id").coalesce(1).toArrow().to_batches())
    local = [r for b in J._paths(table) for r in b.to_pylist()]
    spread = [r.asDict() for r in J.ball_trajectory(frames.repartition(7)).collect()]
    J.ball_path_function(spark, "paths_in_test")
    called = [r.asDict() for r in spark.sql("SELECT * FROM paths_in_test(TABLE(SELECT *, seq % 3 AS bucket FROM {frames}) PARTITION BY bucket ORDER BY (seq, frame_id))", frames=frames).collect()]
    for got in (local, spread, called):
        assert len(got) == len(rows)
        for r in got:
            x = want[r["seq"], r["frame_id"]]
            assert (r["is_dummy"], r["attached"]) == x[4:]
            assert [r[c] for c in "xywh"] == pytest.approx(list(x[:4])), r
    assert J.ball_trajectory(frames.limit(0)).collect() == []


def test_hysteresis(spark):
    def kept(proposals):
        rows = [(1, 40 * i, "left", p) for i, p in enumerate(proposals)]
        out = T.hysteresis(spark.createDataFrame(rows, "seq long, end long, side string, proposed long"))
        return [r.keeper for r in out.orderBy("end").collect()]

    assert kept([1, 1, 2, 2]) == [None, 1, 1, 2]
    assert kept([1, 1, 2, 1]) == [None, 1, 1, 1]


def test_rotations_round_trip():
    rng = np.random.default_rng(1)
    for scale in (1e-12, 1e-3, 1.0, 3.1):
        v = rng.normal(size=3)
        v *= scale / np.linalg.norm(v)
        assert np.allclose(geometry.rotation_vector(geometry.rotation(v)), v, atol=1e-9)
    half = geometry.rotation(np.array([np.pi, 0, 0]))
    assert np.allclose(geometry.rotation(geometry.rotation_vector(half)), half)


def camera(angle, err=1.0):
    return {"R": geometry.rotation(np.array([0, angle, 0])), "fx": 1000.0, "fy": 1000.0, "cx": 960.0, "cy": 540.0, "pos": np.zeros(3), "rep_err": err, "source": "voting"}


def test_camera_outlier_is_skipped():
    frames_ = [camera(0.01 * i) for i in range(20)]
    frames_[10] = camera(1.0)
    got = [geometry.rotation_vector(c["R"])[1] for c in geometry.smooth_cameras(frames_)]
    assert max(abs(a - 0.01 * i) for i, a in enumerate(got)) < 0.06
    assert geometry.smooth_cameras([None, None]) == [None, None]


def test_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.02, (20, 3)), rng.normal(1, 0.02, (20, 3)), [[5, 5, 5]]])
    labels = clusters.outlier_kmeans(x)
    assert labels[-1] == -1 and len(set(labels[:20])) == len(set(labels[20:40])) == 1 and labels[0] != labels[20]
    assert clusters.silhouette(x[:40], labels[:40]) > 0.9
    assert clusters.davies_bouldin(x[:40], labels[:40]) < 0.2


def test_last_seen_expires(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 1, 10)], "seq long, track_id long, frame_id long")
    assert [r.frame_id for r in J.last_seen(rows, 5).orderBy("frame_id").collect()] == [1, 2, 3, 4, 5, 6, 10, 11, 12, 13, 14, 15]


def test_labels_keep_outliers(spark):
    rows = spark.createDataFrame([(1, 1, 0, 50.0), (1, 2, 1, 5.0), (1, 3, -1, 0.0)], "seq long, track_id long, label int, x double")
    assert {r.track_id: r.team for r in T.normalised_labels(rows).collect()} == {1: 1, 2: 0, 3: -1}


def test_partitioning_does_not_change_results(spark):
    rows = [(s, t, f, float((f * 7 + t) % 50), float(t), t % 2, "player") for s in range(2) for t in range(5) for f in range(1, 30)]
    df = spark.createDataFrame(rows, "seq long, track_id long, frame_id long, x_m double, y_m double, team_id long, role string")
    assert sorted(K.totals(K.motion(df)).collect()) == sorted(K.totals(K.motion(df.repartition(7))).collect())


def test_running_sums_span_ranges(spark):
    from pyspark.sql import functions as F

    from touchline.operators.running import running

    # one key has most of the rows and goes on over all ranges
    rows = [("a" if i % 10 else "b", i * 37 % 1000, i, i % 3) for i in range(1000)]
    got = running(spark.createDataFrame(rows, "k string, o int, id int, x int").repartition(5), ["k"], [F.desc("o"), F.col("id")], upto="x").collect()
    want, sums = {}, {"a": 0, "b": 0}
    for k, _, i, x in sorted(rows, key=lambda r: (-r[1], r[2])):
        sums[k] += x
        want[i] = sums[k]
    assert {r.id: r.upto for r in got} == want
    assert running(spark.createDataFrame([], "k string, o int, x int"), [], [F.col("o")], upto="x").count() == 0


def test_windows_of_tiles_are_those_of_rows(spark):
    from pyspark.sql import functions as F

    from touchline.operators import teams as T

    rows = [(s, t, f) for s, last in ((0, 500), (1, 37), (2, 240), (3, 241)) for t in range(3) for f in range(1, last + 1) if (f * 7 + t) % 3]
    table = spark.createDataFrame(rows, "seq long, track_id long, frame_id long").withColumn("n", F.lit(1))
    got = {(r.seq, r.end, r.track_id): r.n for r in T.tiled(table, "n").collect()}
    want = {(r.seq, r.end, r.track_id): r.n for r in T.windowed(table).groupBy("seq", "end", "track_id").agg(F.sum("n").alias("n")).collect()}
    assert got == want and len(got) > 40


def test_streams_of_empty_tables_and_late_rows(spark):
    from touchline.streaming import online as O

    kind = "seq long, track_id long, frame_id long, value long"
    mode = lambda s: O.online_mode(s, idle_ms=None)
    assert O.replayed(spark.createDataFrame([], kind), "frame_id", mode).collect() == []
    # parts by `arrived`: frames 3 and 4 come after frame 6 and are late
    rows = [(0, 1, f, f % 2, at) for f, at in ((1, 0), (2, 0), (6, 0), (3, 5), (4, 5), (7, 9), (8, 9))]
    got = O.replayed(spark.createDataFrame(rows, kind + ", arrived long"), "arrived", mode).collect()
    assert [r.frame_id for r in sorted(got, key=lambda r: r.frame_id)] == [1, 2, 6, 7, 8]


def test_state_expires(spark):
    from touchline.streaming import online as O

    held = {"updated": None, "removed": False, "ms": None}

    class State:
        hasTimedOut, exists = False, False

        def update(self, value):
            held["updated"] = value

        def setTimeoutDuration(self, ms):
            held["ms"] = ms

        def remove(self):
            held["removed"] = True

        get = (9, 4, 6, 3.5)

    import pandas as pd

    caught = {}

    class Grouped:
        def applyInPandasWithState(self, walk, *how):
            caught["walk"], caught["timeout"] = walk, how[-1]

    class Stream:
        def groupBy(self, *keys):
            return Grouped()

    O.online_sprints(Stream(), idle_ms=500)
    rows = pd.DataFrame({"frame_id": [1, 2], "speed_kmh": [30.0, 30.0], "distance_m": [0.3, 0.3]})
    assert list(caught["walk"]((0, 1), iter([rows]), State())) == [] and held["updated"] == (2, 1, 2, 0.6) and held["ms"] == 500
    late = State()
    late.hasTimedOut = True
    out = list(caught["walk"]((0, 1), iter([]), late))
    assert held["removed"] and out[0].to_numpy().tolist() == [[0, 1, 4, 6, 3.5]]
    assert caught["timeout"] == O.GroupStateTimeout.ProcessingTimeTimeout


def test_best_detection_keeps_frames_with_ties(spark):
    from touchline.plans import queries
    from touchline.plans.views import Views

    sf = "/root/testdata/sf0.001"
    got = queries()["g5_best_detection"](spark, sf).count()
    assert got == Views(spark, sf).box.where("score >= 0.2").select("seq", "frame_id").distinct().count()
