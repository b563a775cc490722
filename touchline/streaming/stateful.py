"""Structured Streaming operators with named state cells and event-time timers.

A frame counts as a second of event time. Rows of one frame may arrive in any
batch until the watermark passes it; then a timer closes the frame and its rows
are taken together. Rows that come later still are dropped by the watermark,
which Spark counts (numRowsDroppedByWatermark). A sequence keeps its open
frames and the tracks seen lately, not its whole past. These operators keep
their state in RocksDB (`PROVIDER`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from touchline.kernels.boxes import overlaps
from touchline.kernels.tracker import step

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def timed(stream: DataFrame, delay: int, column: str = "frame_id") -> DataFrame:
    """stream with `ts`, the event time of a frame, and its watermark. Frame 0
    is at second 1, as a watermark begins at 0 and what isn't after it is late."""
    return stream.withColumn("ts", F.timestamp_seconds(F.col(column) + 1)).withWatermark("ts", f"{delay} seconds")


class Frames(StatefulProcessor):
    """Keeps the rows of each frame of a key until it is closed. State: a cell
    with the rows of each block of open frames, and one with the tracks seen
    within `ttl` frames, so that a batch reads and writes each cell of a key
    once, not for every frame and track. Timers: one for the first frame that a
    batch brings, then one for the next frame to close or track to expire; it
    closes, in order, all frames that the watermark has passed."""

    #: Numeric columns of a row, the first being the name that orders them.
    columns: tuple[str, ...] = ()
    out: tuple[str, ...] = ()
    #: Numbers kept of a track, the first being its last frame.
    width = 0
    ttl = 0
    #: Frames of a block.
    block = 128

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "block long", "rows binary")
        self.tracks = handle.getValueState("tracks", "next long, cells binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            values = pdf[["frame_id", *self.columns]].to_numpy(float)
            values = values[np.argsort(values[:, 0], kind="stable")]
            names, starts = np.unique(values[:, 0] // self.block, return_index=True)
            for name, own in zip(names.astype(int).tolist(), np.split(values, starts[1:]), strict=True):
                held = self.open.getValue((name,))[0] if self.open.containsKey((name,)) else b""
                self.open.updateValue((name,), (held + own.tobytes(),))
            least = int(values[0, 0])
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer((first + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() // 1000 - 1
        self.next, cells = self.tracks.get() if self.tracks.exists() else (1, b"")
        memory = {int(c[0]): c[1:] for c in np.frombuffer(cells).reshape(-1, self.width + 1).tolist()}
        waits = []
        for name in sorted(k[0] for k in self.open.keys()):
            if name * self.block > until:
                waits.append(name * self.block)
                continue
            rows = np.frombuffer(self.open.getValue((name,))[0]).reshape(-1, len(self.columns) + 1)
            due = rows[:, 0] <= until
            later, rows = rows[~due], rows[due]
            if len(later):
                self.open.updateValue((name,), (later.tobytes(),))
                waits.append(int(later[:, 0].min()))
            else:
                self.open.removeKey((name,))
            if len(rows):
                rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
                frames, starts = np.unique(rows[:, 0], return_index=True)
                out = []
                for frame, own in zip(frames.astype(int).tolist(), np.split(rows[:, 1:], starts[1:]), strict=True):
                    out += self.expired(frame, memory)
                    out += self.closed(frame, own, memory)
                yield self.table(key, out)
        out = self.expired(until, memory)
        if out:
            yield self.table(key, out)
        waits += [int(c[0]) + self.ttl + 1 for c in memory.values()]
        self.tracks.update((self.next, np.array([[t, *c] for t, c in memory.items()], float).tobytes()))
        if waits:
            self.handle.registerTimer((min(waits) + 1) * 1000)

    def table(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame([(key[0], *r) for r in out], columns=list(self.out))
        return rows.astype({c: "Int64" for c in self.out if c in ("took_over", "track", "box_id")})

    def expired(self, frame: int, memory: dict[int, list[float]]) -> list[tuple]:
        """Rows for the tracks that `frame` finds away for over `ttl` frames,
        which leave memory."""
        out = []
        for track in sorted(t for t, c in memory.items() if frame - c[0] > self.ttl):
            out += self.gone(int(memory.pop(track)[0]) + self.ttl + 1, track)
        return out

    def gone(self, frame: int, track: int) -> list[tuple]:
        """Rows for a track that expires."""
        return []

    def closed(self, frame: int, rows: np.ndarray, memory: dict[int, list[float]]) -> list[tuple]:
        """Rows out of a frame whose rows are all here, in order of their names;
        tracks seen are put into memory."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Lifecycle(Frames):
    columns = ("track_id", "score", "x", "y", "w", "h")
    out = ("seq", "frame_id", "track_id", "event", "took_over")
    width = 5

    def __init__(self, ttl: int, least: float):
        self.ttl, self.least = ttl, least

    def gone(self, frame: int, track: int) -> list[tuple]:
        return [(frame, track, "expired", None)]

    def closed(self, frame: int, rows: np.ndarray, memory: dict[int, list[float]]) -> list[tuple]:
        here = set(rows[:, 0].astype(int).tolist())
        free = {t: c[1:] for t, c in sorted(memory.items()) if t not in here}
        out, cells = [], {}
        for row in rows[np.lexsort((rows[:, 0], -rows[:, 1]))].tolist():
            track, box, took = int(row[0]), row[2:], None
            if track not in memory and free:
                names = list(free)
                iou = overlaps(np.array([box]), np.array([free[t] for t in names]))[0]
                if iou.max() >= self.least:
                    took = names[int(iou.argmax())]
                    free.pop(took)
            event = "new" if track not in memory else "seen" if memory[track][0] == frame - 1 else "back"
            out.append((frame, track, event, took))
            cells[track] = [float(frame), *box]
        memory |= cells
        return out


def lifecycle(stream: DataFrame, ttl: int = 5, least: float = 0.4, delay: int = 10) -> DataFrame:
    """The life of each track: "new", "seen" (in the frame before of its own),
    "back" after at most `ttl` frames away, "expired" at the frame in which it
    has been away for longer, and for a new name the track it takes over: that
    of the best overlapping box, by at least `least`, of those last seen within
    `ttl` frames and absent from this frame; detections choose in order of
    their scores. stream: seq, frame_id, track_id, score, x, y, w, h, in any
    order within `delay` frames."""
    keyed = timed(stream, delay).groupBy("seq")
    return keyed.transformWithStateInPandas(Lifecycle(ttl, least), "seq long, frame_id long, track_id long, event string, took_over long", "append", "EventTime")


class Tracker(Frames):
    columns = ("box_id", "x", "y", "w", "h")
    out = ("seq", "frame_id", "box_id", "track", "confirmed")
    width = 8

    def __init__(self, max_age: int, min_hits: int, least: float):
        self.ttl, self.max_age, self.min_hits, self.least = max_age, max_age, min_hits, least

    def closed(self, frame: int, rows: np.ndarray, memory: dict[int, list[float]]) -> list[tuple]:
        held = [memory[t][1:] for t in sorted(memory)]
        tracks, self.next, got = step(held, self.next, frame, rows[:, 1:], self.max_age, self.min_hits, self.least)
        seen = {int(t[0]): t for t in tracks}
        memory |= {t: [float(frame), *seen[t]] for t, _ in got}
        return [(frame, int(b), t, c) for b, (t, c) in zip(rows[:, 0].tolist(), got, strict=True)]


def tracker(stream: DataFrame, max_age: int = 30, min_hits: int = 3, least: float = 0.3, delay: int = 10) -> DataFrame:
    """A track for each box, with whether it is confirmed, as frames close.
    stream: seq, frame_id, box_id, x, y, w, h, in any order within `delay`
    frames. A sequence keeps its tracks; those away for over `max_age` frames
    are dropped by a timer."""
    keyed = timed(stream, delay).groupBy("seq")
    return keyed.transformWithStateInPandas(Tracker(max_age, min_hits, least), "seq long, frame_id long, box_id long, track long, confirmed boolean", "append", "EventTime")


class Status(StatefulProcessor):
    """State of an experiment: status, number of its run and of its changes,
    epochs of the run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, run long, changes long, epochs long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, run, changes, epochs = self.state.get() if self.state.exists() else (None, 0, 0, 0)
        events = pd.concat(list(rows), ignore_index=True).sort_values("epoch", kind="stable")
        out = []
        for event, epoch in zip(events["event"].tolist(), events["epoch"].tolist(), strict=True):
            before = status
            if event == "train_start":
                status, run, epochs = "training", run + 1, 0
            elif run and event == "train_end":
                status = "complete"
            elif run and event == "error":
                status = "error"
            elif run and event == "epoch_end":
                epochs += 1
            if event == "train_start" or status != before:
                changes += 1
                out.append((key[0], changes, epoch, run, before, status, epochs))
        self.state.update((status, run, changes, epochs))
        if out:
            yield pd.DataFrame(out, columns=["experiment", "number", "epoch", "run", "before", "after", "epochs"])

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame) -> DataFrame:
    """Each change of an experiment's status, once and in order: train_start
    opens a run anew, whatever came before; train_end completes and error fails
    the run that is open or was last; events before the first run change
    nothing. Changes are numbered, so a listener that gets a batch again knows
    what it has seen. stream: experiment, event, epoch (its order)."""
    kind = "experiment string, number long, epoch long, run long, before string, after string, epochs long"
    return stream.groupBy("experiment").transformWithStateInPandas(Status(), kind, "append", "None")


def sessions(stream: DataFrame, gap: Column, delay: str, *keys: str) -> DataFrame:
    """Sessions of each key: events with no `gap` (a duration, of each event)
    between them, with their number and the sum of `value`. Events may come in
    any order within `delay`; one that lies between two sessions merges them.
    Built-in, so state is a row for each open session. stream: keys, ts, value."""
    window = F.session_window("ts", gap).alias("session")
    counted = stream.withWatermark("ts", delay).groupBy(*keys, window).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n", "total")


class Hysteresis(StatefulProcessor):
    """State of a side: who holds, who is proposed and how often."""

    def __init__(self, confirm: int):
        self.confirm = confirm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "now long, pending long, count long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, pending, count = self.state.get() if self.state.exists() else (None, None, 0)
        own = pd.concat(list(rows), ignore_index=True).sort_values("end")
        out = []
        for p in own["proposed"].astype("Int64").tolist():
            p = None if pd.isna(p) else int(p)
            if p == now:
                pending, count = None, 0
            else:
                count = count + 1 if count and p == pending else 1
                pending = p
                if count >= self.confirm:
                    now, pending, count = p, None, 0
            out.append(now)
        self.state.update((now, pending, count))
        yield pd.DataFrame({"seq": key[0], "side": key[1], "end": own["end"].to_numpy(), "keeper": pd.array(out, "Int64")})

    def close(self) -> None:
        pass


def window_keepers(frames: DataFrame, width: float, height: float, every: int = 40, length: int = 220, delay: int = 1, confirm: int = 2) -> DataFrame:
    """The keeper of each side after each sliding window (end - length, end],
    in one query: window statistics of tracks, the best candidate of a side in
    each window, and a keeper that changes once `confirm` windows in a row
    propose another. The watermark goes through all three.

    frames: seq, frame_id, boxes (array of track_id, team_id, x, y): a frame is
    one record, so the votes of a candidate's four neighbours need no state.
    """
    near = lambda b: F.slice(F.array_sort(F.transform(F.filter("boxes", lambda o: o["track_id"] != b["track_id"]), lambda o: F.struct(F.hypot(o["x"] - b["x"], o["y"] - b["y"]).alias("d"), o["track_id"].alias("t"), o["team_id"].alias("team")))), 1, 4)
    voters = F.transform("boxes", lambda b: F.struct(b["track_id"].alias("track_id"), b["x"].alias("x"), b["y"].alias("y"), near(b).alias("near")))
    rows = timed(frames, delay).select("seq", "ts", F.explode(voters).alias("b")).select("seq", "ts", "b.*")
    team = lambda k: F.size(F.filter("near", lambda o: o["team"] == k))
    window = F.window("ts", f"{length} seconds", f"{every} seconds", f"{(2 - length) % every} seconds").alias("w")
    x, y = F.col("x") / width, F.col("y") / height
    stats = rows.groupBy("seq", "track_id", window).agg(F.count("*").alias("n"), F.count_if(x < 0.14).alias("l"), F.count_if(x > 0.86).alias("r"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.sum(team(0)).alias("a"), F.sum(team(1)).alias("b"))
    score, total = F.greatest("l", "r") / F.col("n"), F.col("a") + F.col("b")
    margin = F.abs(F.col("a") - F.col("b")) / F.greatest(total, F.lit(1))
    rated = stats.where((F.col("n") >= 20) & (score >= 0.3)).select("seq", "w", F.when(F.col("l") >= F.col("r"), "left").otherwise("right").alias("side"), F.struct((-(score + 0.6 * margin)).alias("rank"), "track_id", score.alias("score"), margin.alias("margin"), total.alias("votes"), "sx", "sy").alias("c"))
    best = rated.groupBy("seq", "w", "side").agg(F.slice(F.array_sort(F.collect_list("c")), 1, 2).alias("top"))
    one, two = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    alone = two.isNull() | ((two["rank"] - one["rank"] >= 0.12) & (one["margin"] - two["margin"] >= 0.1))
    good = (one["score"] >= 0.4) & (one["votes"] >= 12) & (one["margin"] >= 0.12) & (one["sx"] <= 0.08) & (one["sy"] <= 0.12) & alone
    proposed = best.select("seq", "side", (F.unix_timestamp("w.end") - 2).alias("end"), F.when(good, one["track_id"]).alias("proposed"))
    return proposed.groupBy("seq", "side").transformWithStateInPandas(Hysteresis(confirm), "seq long, side string, end long, keeper long", "append", "None")
