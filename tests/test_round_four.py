"""Queries against their SQL on small tables made for a finding, and streams
against plain versions."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from touchline.kernels import tracker as K
from touchline.sources import readers as R
from touchline.sources import scratch
from touchline.streaming import online as O
from touchline.streaming import stateful as S

#: Spark reads microseconds.
TS = pa.timestamp("us")


def events(folder, rows: list[tuple[int, int, str]]) -> str:
    """A table of (event_id, user_id, event_type), a second between ids."""
    ids, users, kinds = (list(c) for c in zip(*rows, strict=True))
    begin = dt.datetime(2024, 1, 1)
    table = {"event_id": ids, "ts": pa.array([begin + dt.timedelta(seconds=i) for i in ids], TS), "user_id": users, "event_type": kinds, "value": [i % 50 / 2 for i in ids], "props": ["{}"] * len(ids)}
    pq.write_table(pa.table(table), f"{folder}/events.parquet")
    return str(folder)


def both(spark, folder: str, name: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of a query and of its SQL, in order."""
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        try:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        except duckdb.IOException:
            pass
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, folder).select(want.columns).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    return sorted(map(tuple, got), key=order), sorted(want.fetchall(), key=order)


def test_best_candidate_just_far_enough_from_the_second(spark, tmp_path):
    """Two candidates of one rarity whose vote margins are 0.6 and 0.4: 0.12 apart
    once weighted, which rounding decides."""
    seen = {4181: 20, 4184: 12, 4187: 16, 4189: 20, 4190: 20, 4200: 20, 4201: 20}
    rows = [(1547 * (20 * i + f), user, "click") for i, (user, n) in enumerate(seen.items()) for f in range(n)]
    got, want = both(spark, events(tmp_path, rows), "f9_window_candidates")
    assert got == want
    assert len(want) == 1


def test_outliers_of_a_sequence_without_a_cluster(spark, tmp_path):
    """The last sequence has three tracks, none near another: K-Means labels
    them, and they are outliers all the same."""
    ids = [*range(30), 1950, 1951, 1952]
    vectors = pa.array([[0.1] * 64] * len(ids), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": ids, "embedding": vectors, "label": pa.array([0] * len(ids), pa.int32())}), f"{tmp_path}/embeddings.parquet")
    got, want = both(spark, str(tmp_path), "i2_outlier_clusters")
    assert got == want
    assert [r for r in want if r[0] == 65] == [(65, 1950, True), (65, 1951, True), (65, 1952, True)]


class Cells:
    """State of one key in a dictionary, which counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, *how):
        return Cell(self)

    getValueState = getMapState

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


class Cell:
    def __init__(self, cells):
        self.cells, self.held = cells, {}

    def _do(self, f):
        self.cells.calls += 1
        return f()

    def containsKey(self, k):
        return self._do(lambda: k in self.held)

    def getValue(self, k):
        return self._do(lambda: self.held.get(k))

    def updateValue(self, k, v):
        self._do(lambda: self.held.update({k: v}))

    def removeKey(self, k):
        self._do(lambda: self.held.pop(k, None))

    def iterator(self):
        return self._do(lambda: iter(list(self.held.items())))

    def keys(self):
        return self._do(lambda: iter(list(self.held)))

    def exists(self):
        return self._do(lambda: None in self.held)

    def get(self):
        return self._do(lambda: self.held.get(None))

    def update(self, v):
        self._do(lambda: self.held.update({None: v}))


class Clock:
    """A watermark, and the timer that it lets expire."""

    def __init__(self, ms, due=0):
        self.ms, self.due = ms, due

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.due


def walked(processor, batches: list[tuple[list[tuple], int]]) -> tuple[list[tuple], int]:
    """Rows out of batches of one key, a watermark in frames after each, and the
    number of calls of state and timers."""
    cells = Cells()
    processor.init(cells)
    out = []
    for rows, frame in batches:
        list(processor.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["frame_id", *processor.columns])]), Clock(0)))
        for due in sorted(t for t in cells.timers if t <= (frame + 1) * 1000):
            cells.timers.discard(due)
            for pdf in processor.handleExpiredTimer((7,), Clock((frame + 1) * 1000, due), Clock(0, due)):
                out += pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)
    return out, cells.calls


def crossing(frames: int, n: int = 6) -> list[tuple]:
    """Boxes of tracks that close in on others and are missing now and then."""
    rng = np.random.default_rng(3)
    return [(f, t, float(15 * t + 12 * np.sin((f + 5 * t) / 9)), 0.0, 40.0, 80.0) for f in range(frames) for t in range(n) if rng.random() < 0.9]


def in_two(rows: list[tuple], cut: int) -> list[tuple[list[tuple], int]]:
    """Batches in which the last ten frames before the cut come in part late."""
    late = [r for r in rows if cut - 10 <= r[0] < cut and r[1] % 2]
    first = [r for r in rows if r[0] < cut and r not in late]
    return [(first[::-1], cut - 11), (late + [r for r in rows if r[0] >= cut], 10**6)]


def test_tracker_over_blocks_of_frames():
    """As its step taken frame by frame, with few calls of state."""
    rows = crossing(400)
    held, next_id, want = [], 1, []
    for f in range(400):
        own = [r for r in rows if r[0] == f]
        held, next_id, got = K.step(held, next_id, f, np.array([r[2:] for r in own]).reshape(-1, 4), 2, 3, 0.3)
        want += [(7, f, r[1], *g) for r, g in zip(own, got, strict=True)]
    got, calls = walked(S.Tracker(2, 3, 0.3), in_two(rows, 250))
    assert got == want
    assert calls <= 60


def test_lifecycle_over_blocks_of_frames():
    rows = [(f, t + 100 * (f // 50), 0.5, *box) for f, t, *box in crossing(400)]
    assert walked(S.Lifecycle(2, 0.4), in_two(rows, 250))[0] == walked(S.Lifecycle(2, 0.4), [(rows, 10**6)])[0]
    one = [r for r in rows if r[1] % 100 == 0]
    got, calls = walked(S.Lifecycle(2, 0.4), in_two(one, 250))
    assert calls <= 60
    last: dict[int, int] = {}
    want = []
    for f, track, *_ in one:
        want.append((7, f, track, "new" if f - last.get(track, -9) > 2 else "seen" if last[track] == f - 1 else "back"))
        last[track] = f
    ends = [(7, f + 3, t, "expired") for f, t, *_ in one if not any(t == u and f < g <= f + 2 for g, u, *_ in one)]
    assert sorted(r[:4] for r in got) == sorted(want + ends)


@pytest.mark.parametrize("seed", range(5))
def test_boxes_that_do_not_compete_need_no_assignment(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    held = [[float(i), *b, 0.0, 1.0] for i, b in enumerate(np.c_[np.arange(8) * 100.0, np.zeros(8), np.full((8, 2), 50.0)].tolist())]
    boxes = np.c_[rng.permutation(10)[:6] * 100.0 + 5, np.zeros(6), np.full((6, 2), 50.0)]
    want = [int(x // 100) if x < 800 else None for x in boxes[:, 0]]
    monkeypatch.setattr(K, "assign", None)
    got = K.step(held, 50, 1, boxes)[2]
    assert [t if t < 50 else None for t, _ in got] == want


def test_rows_of_a_replay_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    rows = spark.range(60).selectExpr("id % 3 AS seq", "id % 2 AS track_id", "id AS frame_id", "id % 4 AS value").mapInPandas(counted, "seq long, track_id long, frame_id long, value long")
    assert O.replayed(rows, "frame_id", lambda s: O.online_mode(s, idle_ms=None)).count() == 60
    assert seen.value == 60


def test_tracks_are_listed_by_sequence(spark, tmp_path, monkeypatch):
    """44 tracks of 45 frames take two folders, not one each."""
    seen = []
    made = scratch.scratch_path
    monkeypatch.setattr(scratch, "scratch_path", lambda *how: seen.append(made(*how)) or seen[-1])
    rows = [(f * 50 + user, user, "error" if f % 9 == user % 9 else "click") for user in range(44) for f in range(40 + user % 12)]
    got, want = both(spark, events(tmp_path, rows), "a13_tracklet_directories")
    assert got == want
    assert want
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(seen).select("path").collect()
    assert 1 <= len(found) <= 2


def test_listings_give_what_folders_do(spark, tmp_path):
    rows = spark.createDataFrame([(s, t, str(f)) for s in range(4) for t in range(3) for f in range(5 + t)], "seq long, track_id long, value string")
    rows.write.partitionBy("seq", "track_id").text(f"{tmp_path}/a")
    rows.select("seq", F.concat_ws("/", "track_id", "value").alias("value")).write.partitionBy("seq").text(f"{tmp_path}/b")
    numbers = spark.createDataFrame([(1, 2, -1), (3, 2, 7)], "seq long, track_id long, number int")
    how = (6, numbers, F.col("seq") % 2 == 1)
    found = R.tracklet_listings(spark, f"{tmp_path}/b", *how)
    assert "PartitionFilters: [isnotnull(seq" in (plan := found._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [((seq" in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.tracklet_folders(spark, f"{tmp_path}/a", *how).collect())) == [(1, 1, 6), (3, 1, 6), (3, 2, 7)]
