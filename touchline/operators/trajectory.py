"""Ball path, camera smoothing, gap filling, suppression and tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.kernels.boxes import overlaps
from touchline.kernels.geometry import rotation, rotation_vector, smooth_cameras
from touchline.kernels.viterbi import NONE, Frames, ball_paths
from touchline.operators import matching as M


#: Frames that a task steps through together, and states of theirs.
BATCH_FRAMES, BATCH_STATES = 50_000, 2_000_000
PATH = "seq long, frame_id long, x double, y double, w double, h double, is_dummy boolean, attached long"


def _padded(column: pa.ListArray, fields: list[str], fill: float = np.nan, kind: type = float) -> np.ndarray:
    """Lists of structs as rows x longest list x fields, filled beyond each
    row's own; nulls count as empty lists."""
    own = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
    out = np.full((len(column), int(own.max()) if len(own) else 0, len(fields)), fill, kind)
    values = column.flatten()
    row = np.repeat(np.arange(len(own)), own)
    place = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
    for k, f in enumerate(fields):
        out[row, place, k] = values.field(f).to_numpy(zero_copy_only=False)
    return out


def _paths(table: pa.Table, **parameters: float) -> Iterator[pa.RecordBatch]:
    """Paths of whole sequences, whose frames stand in order."""
    seq = table["seq"].to_numpy()
    bounds = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1], True])
    states = table.num_rows * (1 + max([0, *(pc.max(pc.list_value_length(table[c])).as_py() or 0 for c in ("balls", "players"))]))
    if states > BATCH_STATES and len(bounds) > 2:  # one crowded frame needn't widen all
        half = int(bounds[len(bounds) // 2])
        yield from _paths(table.slice(0, half), **parameters)
        yield from _paths(table.slice(half), **parameters)
        return
    balls, players = (table[c].combine_chunks() for c in ("balls", "players"))
    motion = table["m"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, 6)
    tracks = _padded(players, ["track"], NONE, np.int64)[:, :, 0]
    path = ball_paths(Frames(_padded(balls, ["x", "y", "w", "h", "score"]), _padded(players, ["x1", "y1", "x2", "y2"]), tracks, motion, np.diff(bounds)), **parameters)
    box = [pa.array(path.box[:, k], mask=np.isnan(path.box[:, k])) for k in range(4)]
    yield pa.RecordBatch.from_arrays([pa.array(seq), table["frame_id"].combine_chunks(), *box, pa.array(path.is_dummy), pa.array(path.attached, mask=path.attached == NONE)], names=["seq", "frame_id", "x", "y", "w", "h", "is_dummy", "attached"])


def ball_trajectory(frames: DataFrame, **parameters: float) -> DataFrame:
    """The cheapest ball path of each sequence. frames: seq, frame_id, balls
    (array of x, y, w, h, score), players (array of track, x1, y1, x2, y2), m
    (six numbers), none of them null.

    A path needs its frames in order, and a clip has some thousand of them. A
    task steps through many sequences together, as many as make BATCH_FRAMES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_FRAMES:
                table = pa.Table.from_batches(held)
                seq = table["seq"].to_numpy()
                whole = int(np.searchsorted(seq, seq[-1]))  # the last may go on
                if whole:
                    yield from _paths(table.slice(0, whole), **parameters)
                    held = table.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield from _paths(pa.Table.from_batches(held), **parameters)

    ordered = frames.select("seq", "frame_id", "balls", "players", "m").repartition("seq").sortWithinPartitions("seq", "frame_id")
    return ordered.mapInArrow(run, PATH)


def ball_path_function(spark: SparkSession, name: str = "ball_paths", **parameters: float) -> None:
    """Register the ball's path for SQL: name(TABLE(...) PARTITION BY a bucket
    of sequences ORDER BY (seq, frame_id)), with the columns of ball_trajectory().
    A bucket's sequences are stepped through together."""

    class BallPaths:
        def __init__(self) -> None:
            self.held: list[pa.RecordBatch] = []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            self.held.append(rows)
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if sum(b.num_rows for b in self.held):
                yield from (pa.Table.from_batches([b]) for b in _paths(pa.Table.from_batches(self.held), **parameters))

    spark.udtf.register(name, F.arrow_udtf(BallPaths, returnType=PATH))


def interpolated(path: DataFrame, *columns: str) -> DataFrame:
    """Null columns filled on the line between the nearest known rows by frame,
    held at the ends."""
    ordered = Window.partitionBy("seq").orderBy("frame_id")
    before = ordered.rowsBetween(Window.unboundedPreceding, 0)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    known = F.col(columns[0]).isNotNull()
    out = path.withColumn("_f0", F.last(F.when(known, F.col("frame_id")), True).over(before)).withColumn("_f1", F.first(F.when(known, F.col("frame_id")), True).over(after))
    share = (F.col("frame_id") - F.col("_f0")) / F.nullif(F.col("_f1") - F.col("_f0"), F.lit(0))
    filled = {}
    for c in columns:
        a, b = F.last(c, True).over(before), F.first(c, True).over(after)
        filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.coalesce(a + share * (b - a), a, b))
    return out.withColumns(filled).drop("_f0", "_f1")


def cameras(frames: DataFrame) -> DataFrame:
    """Smoothed cameras of each sequence. frames: seq, frame_id, rotvec (3),
    fx, fy, cx, cy, pos (3), rep_err, source; rotvec null without calibration."""

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id")
        rows = [None if r.rotvec is None else {"R": rotation(np.asarray(r.rotvec, float)), "fx": r.fx, "fy": r.fy, "cx": r.cx, "cy": r.cy, "pos": np.asarray(r.pos, float), "rep_err": r.rep_err, "source": r.source} for r in pdf.itertuples()]
        out = smooth_cameras(rows)
        return pd.DataFrame({"seq": pdf["seq"], "frame_id": pdf["frame_id"], "rotvec": [None if c is None else rotation_vector(c["R"]).tolist() for c in out], "fx": [None if c is None else c["fx"] for c in out], "pos": [None if c is None else c["pos"].tolist() for c in out]})

    return frames.groupBy("seq").applyInPandas(smooth, "seq long, frame_id long, rotvec array<double>, fx double, pos array<double>")


def suppressed(rows: DataFrame, most: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression in each frame: boxes by score, ties by
    track; one that overlaps a kept box by more than `most` goes. Frames enter
    Python in chunks of a sequence."""

    def nms(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for _, own in pdf.sort_values(["score", "track_id"], ascending=[False, True]).groupby("frame_id", sort=False):
            boxes, kept = own[["x", "y", "w", "h"]].to_numpy(float), []
            for i in range(len(boxes)):
                if not kept or overlaps(boxes[i : i + 1], boxes[kept]).max() <= most:
                    kept.append(i)
            keep.append(own.iloc[kept])
        return pd.concat(keep)[["seq", "frame_id", "track_id", "score"]]

    return rows.groupBy("seq", M.chunk()).applyInPandas(nms, "seq long, frame_id long, track_id long, score double")


def last_seen(rows: DataFrame, ttl: int = 5) -> DataFrame:
    """Rows of every track for each frame between its first and last: an absent
    track keeps its last box for `ttl` frames, then expires. The spine is made
    from each gap, so it has no more rows than it returns."""
    w = Window.partitionBy("seq", "track_id").orderBy("frame_id")
    end = F.least(F.coalesce(F.lead("frame_id").over(w) - 1, F.col("frame_id") + ttl), F.col("frame_id") + ttl)
    spread = rows.withColumn("_end", end).withColumn("shown", F.explode(F.sequence("frame_id", "_end")))
    return spread.withColumn("age", F.col("shown") - F.col("frame_id")).drop("_end", "frame_id").withColumnRenamed("shown", "frame_id")


def reassociated(rows: DataFrame, least: float = 0.4, ttl: int = 5) -> DataFrame:
    """Detections matched, in order of their scores, to the track of the best
    overlapping box last seen at most `ttl` frames ago; null without one."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        memory: dict[int, tuple[int, np.ndarray]] = {}
        out = []
        for frame, own in pdf.sort_values(["frame_id", "score", "track_id"], ascending=[True, False, True]).groupby("frame_id", sort=True):
            memory = {t: v for t, v in memory.items() if frame - v[0] <= ttl}
            free, names = dict(memory), []
            boxes = own[["x", "y", "w", "h"]].to_numpy(float)
            for b in boxes:
                best, name = least, None
                for t, (_, other) in free.items():
                    o = float(overlaps(b[None], other[None])[0, 0])
                    if o >= best and (name is None or o > best):
                        best, name = o, t
                if name is not None:
                    free.pop(name)
                names.append(name)
            memory |= {int(t): (int(frame), b) for t, b in zip(own["track_id"], boxes, strict=True)}
            out.append(own.assign(matched=pd.array(names, "Int64")))
        return pd.concat(out)[["seq", "frame_id", "track_id", "matched"]]

    return rows.groupBy("seq").applyInPandas(walk, "seq long, frame_id long, track_id long, matched long")


def slices(spark: SparkSession, width: int, height: int, size: int, overlap: float) -> DataFrame:
    """Corners of overlapping square tiles that cover an image."""
    step = int(size * (1 - overlap))
    count = lambda n: -(-(n - size) // step) if n > size else 0
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(count(width)))).alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(count(height)))).alias("j"))
    return grid.select(F.least(F.col("i") * step, F.lit(max(0, width - size))).alias("x"), F.least(F.col("j") * step, F.lit(max(0, height - size))).alias("y")).distinct()
