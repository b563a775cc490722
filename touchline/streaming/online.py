"""Structured Streaming forms of the ordered operators: keyed state that is
bounded for each track or sequence and expires, rows in frame order within a key.

A key's rows of one batch are put in order; rows at or before a frame that the
key has passed are late and dropped, as a watermark would. A key that is silent
for `idle_ms` loses its state; None keeps it, for streams that end, which such
timeouts would keep running.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.functions import exprs as X
from touchline.sources.scratch import scratch_path

#: Replayed rows for each partition of state.
STATE_ROWS = 4_000
#: An hour without rows ends a track.
IDLE_MS = 3_600_000

Step = Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame | None, tuple]]


def keyed(stream: DataFrame, keys: list[str], own: Step, out: str, state: str, idle_ms: int | None = IDLE_MS, order: str = "frame_id", ended: Callable[[tuple, tuple], pd.DataFrame] | None = None, mode: str = "append") -> DataFrame:
    """Rows of each key through `own` (key, ordered rows, state or None) ->
    (rows out, state). The state's first field is the last `order` seen."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            if ended:
                yield ended(key, held.get)
            held.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        before = held.get if held.exists else None
        if before is not None:
            rows = rows[rows[order] > before[0]]
        if len(rows):
            found, after = own(key, rows.reset_index(drop=True), before)
            held.update(after)
            if found is not None and len(found):
                yield found
        if idle_ms:
            held.setTimeoutDuration(idle_ms)

    return stream.groupBy(*keys).applyInPandasWithState(walk, out, state, mode, GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def online_motion(stream: DataFrame, fps: float = 25.0, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Distance, speed and acceleration of each arriving row, as batch motion()
    gives them. State of a track: its last frame, place and speed."""

    def own(key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        frame, x, y, speed = state or (None, 0.0, 0.0, 0.0)
        frames, xs, ys = rows["frame_id"].to_numpy(), rows["x_m"].to_numpy(float), rows["y_m"].to_numpy(float)
        gap = np.diff(frames, prepend=frames[0] if frame is None else frame)
        d = np.hypot(np.diff(xs, prepend=x), np.diff(ys, prepend=y))
        counts = (gap == 1) & (d <= X.OUTLIER_M)
        now = np.where(counts, np.minimum(d * fps * 3.6, X.MAX_KMH), 0.0)
        accel = np.where(counts, np.diff(now, prepend=speed) / 3.6 * fps, 0.0)
        out = pd.DataFrame({"seq": key[0], "track_id": key[1], "frame_id": frames, "distance_m": np.where(counts, d, 0.0), "speed_kmh": now, "accel_mps2": accel})
        return out, (int(frames[-1]), float(xs[-1]), float(ys[-1]), float(now[-1]))

    return keyed(stream, ["seq", "track_id"], own, "seq long, track_id long, frame_id long, distance_m double, speed_kmh double, accel_mps2 double", "frame long, x double, y double, speed double", idle_ms)


def online_sprints(moved: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Each sprint once, when its run ends: at a slower row, or when its track
    was silent for `idle_ms`. State of a track: its open run."""
    columns = ["seq", "track_id", "first_frame", "n_frames", "distance_m"]

    def own(key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        _, first, n, dist = state or (None, 0, 0, 0.0)
        out = []
        for frame, speed, d in zip(rows["frame_id"].tolist(), rows["speed_kmh"].tolist(), rows["distance_m"].tolist(), strict=True):
            if speed >= X.SPRINT_KMH:
                first, n, dist = (first if n else frame), n + 1, dist + d
            else:
                if n >= X.SPRINT_FRAMES:
                    out.append((*key, first, n, dist))
                first, n, dist = 0, 0, 0.0
        return pd.DataFrame(out, columns=columns), (int(rows["frame_id"].iloc[-1]), first, n, dist)

    def ended(key: tuple, state: tuple) -> pd.DataFrame:
        _, first, n, dist = state
        return pd.DataFrame([(*key, first, n, dist)] if n >= X.SPRINT_FRAMES else [], columns=columns)

    return keyed(moved, ["seq", "track_id"], own, "seq long, track_id long, first_frame long, n_frames long, distance_m double", "frame long, first long, n long, dist double", idle_ms, ended=ended)


def online_mode(stream: DataFrame, history: int = 5, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The most frequent of a track's last `history` values, ties to the most
    recent. State of a track: those values. stream: seq, track_id, frame_id, value."""

    def own(key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        kept = list(state[1]) if state else []
        out = []
        for value in rows["value"].tolist():
            kept = [*kept, value][-history:]
            counts = Counter(kept)
            most = max(counts.values())
            out.append(next(x for x in reversed(kept) if counts[x] == most))
        return pd.DataFrame({"seq": key[0], "track_id": key[1], "frame_id": rows["frame_id"], "mode": out}), (int(rows["frame_id"].iloc[-1]), kept)

    return keyed(stream, ["seq", "track_id"], own, "seq long, track_id long, frame_id long, mode long", "frame long, kept array<long>", idle_ms)


def online_hysteresis(stream: DataFrame, confirm: int = 2, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The keeper of each side after each window, as windows close: a change
    holds once it was proposed `confirm` times in a row. State of a side: who
    holds, who is proposed and how often. stream: seq, side, end, proposed."""

    def own(key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        _, now, pending, count = state or (None, None, None, 0)
        out = []
        for p in rows["proposed"].astype("Int64").tolist():
            p = None if pd.isna(p) else int(p)
            if p == now:
                pending, count = None, 0
            else:
                count = count + 1 if p == pending and count else 1
                pending = p
                if count >= confirm:
                    now, pending, count = p, None, 0
            out.append(now)
        found = pd.DataFrame({"seq": key[0], "side": key[1], "end": rows["end"], "keeper": pd.array(out, "Int64")})
        return found, (int(rows["end"].iloc[-1]), now, pending, count)

    return keyed(stream, ["seq", "side"], own, "seq long, side string, end long, keeper long", "last long, now long, pending long, count long", idle_ms, "end")


def telemetry(stream: DataFrame) -> DataFrame:
    """State of each experiment: events so far, last epoch with its metric,
    status: that of the last start, end or error since its first start.
    stream: experiment, event, epoch, metric. Built-in aggregates only, so it is
    incremental and its state is one row for each experiment."""
    kind, started = F.col("event"), F.max(F.when(F.col("event") == "train_start", F.col("epoch"))).isNotNull()
    after = F.when(kind == "train_start", "training").when(kind == "train_end", "complete").when(kind == "error", "error")
    status = F.when(started, F.max_by(after, F.when(after.isNotNull(), F.col("epoch")))).otherwise("unknown")
    return stream.groupBy("experiment").agg(F.count("*").alias("n_events"), F.max("epoch").alias("last_epoch"), F.max_by("metric", "epoch").alias("last_metric"), F.max("metric").alias("best_metric"), status.alias("status"))


def telemetry_log(stream: DataFrame, keep: int = 200, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The last `keep` rows of each experiment's log, sent anew with each batch
    that adds to it: rows of the largest `version` are its log. State of an
    experiment: those rows. stream: experiment, epoch, metric."""

    def own(key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        _, epochs, metrics = state or (None, [], [])
        epochs, metrics = [*epochs, *rows["epoch"].tolist()][-keep:], [*metrics, *rows["metric"].tolist()][-keep:]
        return pd.DataFrame({"experiment": key[0], "epoch": epochs, "metric": metrics, "version": epochs[-1]}), (epochs[-1], epochs, metrics)

    return keyed(stream, ["experiment"], own, "experiment string, epoch long, metric double, version long", "last long, epochs array<long>, metrics array<double>", idle_ms, "epoch")


def running_majority(stream: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The most frequent value of each key so far, at each epoch, ties to the
    smaller; with the key's last metric. State of a key: a count for each value.
    stream: experiment, epoch, value, metric."""

    def own(key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        counts: Counter = Counter(dict(zip(state[1], state[2], strict=True))) if state else Counter()
        out = []
        for value in rows["value"].tolist():
            counts[value] += 1
            out.append(min(counts, key=lambda x: (-counts[x], x)))
        found = pd.DataFrame({"experiment": key[0], "epoch": rows["epoch"], "majority": out, "metric": rows["metric"]})
        return found, (int(rows["epoch"].iloc[-1]), list(counts), list(counts.values()))

    return keyed(stream, ["experiment"], own, "experiment string, epoch long, majority long, metric double", "last long, names array<long>, counts array<long>", idle_ms, "epoch")


def sliding_counts(stream: DataFrame, frames: int = 220, every: int = 40) -> DataFrame:
    """Rows of each track in sliding windows [end - frames, end), ends at
    multiples of `every`; a frame counts as a second of event time."""
    timed = stream.withColumn("ts", F.timestamp_seconds(F.col("frame_id")))
    w = timed.withWatermark("ts", f"{frames} seconds").groupBy("seq", "track_id", F.window("ts", f"{frames} seconds", f"{every} seconds", f"{frames % every} seconds").alias("w"))
    return w.agg(F.count("*").alias("n")).select("seq", "track_id", F.unix_timestamp("w.end").alias("end"), "n")


def hourly(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling hours, each once, after the watermark."""
    return stream.withWatermark("ts", delay).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("hour"), "n")


def replayed(rows: DataFrame, order: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", parts: int = 3, settings: dict[str, str] | None = None) -> DataFrame:
    """What the stream that `build` makes gives for the rows, arriving in
    `parts` batches in order of a column, as a table.

    The rows are computed once and stored. Each part is written by as many tasks as it has, then the query runs on
    from its checkpoint until it has read it. Batches are written by their
    number, so one that is run again replaces itself; in complete mode the last
    batch is the result. An empty table gives an empty one. `settings` hold
    while the query runs. State has as many partitions as the rows ask for, at
    most those of the session.
    """
    spark: SparkSession = rows.sparkSession
    stored, source, path, check = (scratch_path(spark, name) for name in ("rows", "stream", "drained", "progress"))
    schema = rows.schema
    rows.write.parquet(stored)
    rows = spark.read.schema(schema).parquet(stored)
    low, high, n = rows.agg(F.min(order).cast("double"), F.max(order).cast("double"), F.count("*")).first()
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // STATE_ROWS) or 1)
    settings = {"spark.sql.shuffle.partitions": str(partitions), **(settings or {})}
    size = ((high or 0) - (low or 0)) / parts or 1.0
    cut = F.least(F.floor((F.col(order).cast("double") - (low or 0)) / size), F.lit(parts - 1))
    rows.limit(0).write.parquet(source)
    out = build(spark.readStream.schema(rows.schema).parquet(source))
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:06d}")
        done.append(number)

    before = {k: spark.conf.get(k, None) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        for i in range(parts if low is not None else 0):
            rows.where(cut == i).write.mode("append").parquet(source)
            out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    if not done:
        return spark.createDataFrame([], out.schema)
    fields = out.schema
    read = spark.read.schema(fields).parquet(f"{path}/batch={max(done):06d}" if mode == "complete" else path)
    return read.select(fields.names)
