"""Streaming (K)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import exprs as X
from touchline.plans.motion import STEP
from touchline.plans.registry import query
from touchline.plans.teams import CANDIDATES, HOLD, PROPOSED, H, W, proposals
from touchline.streaming import online as O
from touchline.streaming import stateful as S


def _rows(v):
    return v.track.where(X.valid_player()).select("seq", "track_id", "frame_id", "x_m", "y_m")


@query("k1_online_kinematics", f"WITH {STEP} SELECT seq, track_id, frame_id, round(distance_m, 4) AS distance_m, round(speed_kmh, 4) AS speed_kmh FROM s")
def _(v):
    got = O.replayed(_rows(v), "frame_id", lambda s: O.online_motion(s, idle_ms=None))
    return got.select("seq", "track_id", "frame_id", F.round("distance_m", 4).alias("distance_m"), F.round("speed_kmh", 4).alias("speed_kmh"))


@query("k1_online_sprints", f"WITH {STEP}, r AS (SELECT *, speed_kmh >= 25.2 AS fast, sum(CASE WHEN speed_kmh >= 25.2 THEN 0 ELSE 1 END) OVER (PARTITION BY seq, track_id ORDER BY frame_id) AS run, max(frame_id) OVER (PARTITION BY seq, track_id) AS lastf FROM s) SELECT seq, track_id, min(frame_id) AS first_frame, count(*) AS n_frames FROM r WHERE fast GROUP BY seq, track_id, run HAVING count(*) >= 5 AND max(frame_id) < min(lastf)")
def _(v):
    """Runs that a later row ended; a track's last run ends by timeout."""
    from touchline.operators import kinematics as K

    moved = K.motion(v.track.where(X.valid_player())).select("seq", "track_id", "frame_id", "speed_kmh", "distance_m")
    return O.replayed(moved, "frame_id", lambda s: O.online_sprints(s, idle_ms=None)).select("seq", "track_id", "first_frame", "n_frames")


#: Boxes that leap to another place after every 15 frames; a box away for more
#: than two frames, or elsewhere, starts a track. Tracks are numbered in order.
LEAPS = """bx AS (SELECT seq, frame_id, track_id AS box_id, frame_id // 15 AS leg FROM v_num WHERE event_type <> 'view'),
ag AS (SELECT *, coalesce(frame_id - lag(frame_id) OVER (PARTITION BY seq, box_id, leg ORDER BY frame_id) > 2, true) AS fresh FROM bx),
nw AS (SELECT *, CASE WHEN fresh THEN row_number() OVER (PARTITION BY seq, fresh ORDER BY frame_id, box_id) END AS number, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY seq, box_id ORDER BY frame_id) AS life FROM ag),
tr AS (SELECT *, max(number) OVER (PARTITION BY seq, box_id, life) AS track, row_number() OVER (PARTITION BY seq, box_id, life ORDER BY frame_id) AS hits FROM nw)"""


#: Frames up to which the watermark came: rows arrive up to two frames late.
DELAY = 10
CLOSED = f"frame_id <= (SELECT max(frame_id) - {DELAY} FROM v_num WHERE event_type <> 'view')"


def arriving(rows):
    """Rows of a frame fall into two batches: every other track comes later."""
    return rows.withColumn("arrives", F.col("frame_id") + 2 * (F.col("seq") % 2 + F.floor(F.col("y") / 10_000) % 2))


@query("k3_online_tracker", f"WITH {LEAPS} SELECT seq, frame_id, box_id, track, hits >= 3 AS confirmed FROM tr WHERE {CLOSED}")
def _(v):
    x = 200.0 * (F.col("track_id") % 22) + 60 * F.floor(F.col("frame_id") / 15)
    boxes = v.num.where("event_type <> 'view'").select("seq", "frame_id", F.col("track_id").alias("box_id"), (x + F.col("event_id") % 5).alias("x"), (10_000.0 * (F.col("track_id") % 22)).alias("y"), F.lit(40.0).alias("w"), F.lit(80.0).alias("h"))
    return O.replayed(arriving(boxes), "arrives", lambda s: S.tracker(s, max_age=2, delay=DELAY), parts=4, settings=S.PROVIDER)


#: Each box changes its name after every 12 frames, by an overlapping one unless
#: it leaps then; names are 1000 apart.
LIVES = """bx AS (SELECT seq, frame_id, track_id + 1000 * (frame_id // 12) AS track_id, track_id AS who, frame_id // 24 AS leg FROM v_num WHERE event_type <> 'view'),
ag AS (SELECT *, frame_id - lag(frame_id) OVER (PARTITION BY seq, track_id ORDER BY frame_id) AS gap, frame_id - lag(frame_id) OVER (PARTITION BY seq, who ORDER BY frame_id) AS away, lag(track_id) OVER (PARTITION BY seq, who ORDER BY frame_id) AS before, lag(leg) OVER (PARTITION BY seq, who ORDER BY frame_id) AS old_leg FROM bx)"""


@query("k8_track_lifecycle", f"""WITH {LIVES}, ev AS (SELECT seq, frame_id, track_id, CASE WHEN gap = 1 THEN 'seen' WHEN gap <= 2 THEN 'back' ELSE 'new' END AS event, CASE WHEN (gap IS NULL OR gap > 2) AND away <= 2 AND old_leg = leg AND before <> track_id THEN before END AS took_over FROM ag
UNION ALL SELECT seq, frame_id + 3, track_id, 'expired', NULL FROM (SELECT *, lead(frame_id) OVER (PARTITION BY seq, track_id ORDER BY frame_id) AS after FROM bx) WHERE after IS NULL OR after > frame_id + 2) SELECT * FROM ev WHERE {CLOSED}""")
def _(v):
    leg = F.floor(F.col("frame_id") / 24)
    rows = v.num.where("event_type <> 'view'")
    boxes = rows.select("seq", "frame_id", (F.col("track_id") + 1000 * F.floor(F.col("frame_id") / 12)).alias("track_id"), (F.col("event_id") % 100 / 100).alias("score"), (60.0 * leg + F.col("event_id") % 5).alias("x"), (10_000.0 * (F.col("track_id") % 22)).alias("y"), F.lit(40.0).alias("w"), F.lit(80.0).alias("h"))
    return O.replayed(arriving(boxes), "arrives", lambda s: S.lifecycle(s, ttl=2, delay=DELAY), parts=4, settings=S.PROVIDER)


@query("k4_temporal_mode", "WITH l AS (SELECT seq, track_id, frame_id, list(event_id % 4) OVER (PARTITION BY seq, track_id ORDER BY frame_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w FROM v_num), u AS (SELECT seq, track_id, frame_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM l), c AS (SELECT seq, track_id, frame_id, x, count(*) AS n, max(i) AS last FROM u GROUP BY ALL) SELECT seq, track_id, frame_id, arg_max(x, (n, last)) AS mode FROM c GROUP BY ALL")
def _(v):
    rows = v.num.select("seq", "track_id", "frame_id", (F.col("event_id") % 4).alias("value"))
    return O.replayed(rows, "frame_id", lambda s: O.online_mode(s, idle_ms=None))


def telemetry(v):
    """Each user's experiment: it starts anew now and then, whether it ended, failed or ran."""
    e = v.table("events")
    signup = F.col("event_type") == "signup"
    event = F.when(signup & (F.col("event_id") % 2 == 0), "train_start").when(signup, "train_end").when((F.col("event_type") == "error") & (F.col("user_id") % 5 == 1), "error").otherwise("epoch_end")
    return e.select(F.col("user_id").cast("string").alias("experiment"), event.alias("event"), F.col("event_id").alias("epoch"), F.col("value").alias("metric"), (F.col("event_id") % 4).alias("value"))


#: Events that set a status, with how often the experiment had started by then.
RUNS = """ev AS (SELECT CAST(user_id AS VARCHAR) AS experiment, event_id AS epoch, CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'training' WHEN event_type = 'signup' THEN 'complete' WHEN event_type = 'error' AND user_id % 5 = 1 THEN 'error' END AS after, value FROM events),
rn AS (SELECT *, count(*) FILTER (after = 'training') OVER (PARTITION BY experiment ORDER BY epoch) AS run FROM ev),
ep AS (SELECT *, count(*) FILTER (after IS NULL) OVER (PARTITION BY experiment, run ORDER BY epoch) AS epochs FROM rn),
ch AS (SELECT *, lag(after) OVER (PARTITION BY experiment ORDER BY epoch) AS before FROM ep WHERE after IS NOT NULL AND run > 0)"""


@query("k5_telemetry_state", f"WITH {RUNS} SELECT experiment, count(*) AS n_events, max(epoch) AS last_epoch, round(max_by(value, epoch), 4) AS last_metric, round(max(value), 4) AS best_metric, coalesce(any_value(after), 'unknown') AS status FROM (SELECT ev.experiment, epoch, value, l.after FROM ev LEFT JOIN (SELECT experiment, arg_max(after, epoch) AS after FROM ch GROUP BY experiment) l USING (experiment)) GROUP BY experiment")
def _(v):
    t = O.replayed(telemetry(v), "epoch", O.telemetry, "complete")
    return t.select("experiment", "n_events", "last_epoch", F.round("last_metric", 4).alias("last_metric"), F.round("best_metric", 4).alias("best_metric"), "status")


@query("k5_status_changes", f"WITH {RUNS} SELECT experiment, row_number() OVER (PARTITION BY experiment ORDER BY epoch) AS number, epoch, run, before, after, epochs FROM ch WHERE after = 'training' OR after IS DISTINCT FROM before")
def _(v):
    """What a listener gets: each change of status, in order."""
    return O.replayed(telemetry(v), "epoch", S.status_changes, settings=S.PROVIDER)


@query("k5_telemetry_log", "SELECT CAST(user_id AS VARCHAR) AS experiment, event_id AS epoch, value AS metric FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def _(v):
    """The last 20 rows of each experiment's log."""
    sent = O.replayed(telemetry(v), "epoch", lambda s: O.telemetry_log(s, 20, None))
    last = Window.partitionBy("experiment")
    return sent.withColumn("_last", F.max("version").over(last)).where("version = _last").select("experiment", "epoch", "metric")


@query("f16_running_majority", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS experiment, event_id AS epoch, event_id % 4 AS v, value AS metric FROM events), c AS (SELECT a.experiment, a.epoch, a.metric, b.v, count(*) AS n FROM e a JOIN e b ON a.experiment = b.experiment AND b.epoch <= a.epoch GROUP BY ALL)
SELECT experiment, epoch, metric, arg_max(v, (n, -v)) AS majority FROM c GROUP BY experiment, epoch, metric""")
def _(v):
    return O.replayed(telemetry(v), "epoch", lambda s: O.running_majority(s, idle_ms=None))


@query("f16_last_metric_by_epoch", "SELECT CAST(user_id AS VARCHAR) AS experiment, max(event_id) AS last_epoch, max_by(value, event_id) AS last_metric FROM events GROUP BY 1")
def _(v):
    return O.replayed(telemetry(v), "epoch", O.telemetry, "complete").select("experiment", "last_epoch", "last_metric")


@query("k6_sliding_windows", "SELECT seq, track_id, wend AS \"end\", count(*) AS n FROM v_num JOIN (SELECT unnest(range(0, 1000, 40)) AS wend) ON frame_id >= wend - 220 AND frame_id < wend GROUP BY ALL")
def _(v):
    return O.replayed(v.num.select("seq", "track_id", "frame_id"), "frame_id", O.sliding_counts, "complete")


@query("k6_online_hysteresis", f"WITH RECURSIVE {PROPOSED}, {HOLD} SELECT seq, wend AS \"end\", now AS keeper FROM hd")
def _(v):
    return O.replayed(proposals(v), "end", lambda s: O.online_hysteresis(s, idle_ms=None)).select("seq", "end", "keeper")


@query("k7_hourly_events", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL")
def _(v):
    rows = v.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return O.replayed(rows, "ts", O.hourly).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("k7_user_sessions", """WITH g AS (SELECT user_id, ts, value, CASE WHEN user_id % 2 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 12 HOUR END AS gap FROM events),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= gap THEN 0 ELSE 1 END AS fresh FROM g))
SELECT user_id, min(ts) AS start, max(ts) + any_value(gap) AS "end", count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, island HAVING max(ts) + any_value(gap) <= (SELECT max(ts) - INTERVAL 48 HOUR FROM events)""")
def _(v):
    """Events come up to 40 hours after others that are later, in any batch."""
    rows = v.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 5 * 36_000).alias("arrives"))
    gap = F.when(F.col("user_id") % 2 == 0, "6 hours").otherwise("12 hours")
    got = O.replayed(rows, "arrives", lambda s: S.sessions(s, gap, "48 hours", "user_id"), parts=5)
    return got.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n", F.round("total", 4).alias("total"))


#: Windows of 48 frames, every 8, as far as the watermark came.
CLOSING = CANDIDATES.format(rarity="0").replace(" UNION SELECT seq, last FROM lf", " WHERE true").replace("range(40, last + 1, 40)", "range(8, last + 48, 8)").replace("wend - 220", "wend - 48").replace("st AS (", "el AS (SELECT seq, wend FROM en WHERE wend <= (SELECT max(last) - 2 FROM lf)), st AS (").replace("JOIN en ON", "JOIN el en ON")


@query("k6_window_keepers", f"WITH RECURSIVE {CLOSING}, {HOLD} SELECT seq, side, wend AS \"end\", now AS keeper FROM hd")
def _(v):
    boxes = F.sort_array(F.collect_list(F.struct("track_id", "team_id", "x", "y")))
    frames = v.box.groupBy("seq", "frame_id").agg(boxes.alias("boxes"))
    return O.replayed(frames, "frame_id", lambda s: S.window_keepers(s, W, H, every=8, length=48), settings=S.PROVIDER)
