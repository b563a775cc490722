"""Column functions. All stay in generated code: no Python runs for a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pitch in metres, its accepted margin, speeds in km/h.
PITCH_X, PITCH_Y, MARGIN = 105.0, 68.0, 5.0
RUN_KMH, SPRINT_KMH, MAX_KMH = 20.0, 25.2, 40.0
OUTLIER_M, SPRINT_FRAMES = 3.0, 5


def number(c: Column) -> Column:
    """Lenient numbers: null for empty or bad text."""
    return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")


def valid_player() -> Column:
    return (F.col("entity_type") == "player") & F.col("visible") & (F.col("team_id") >= 0) & F.col("x_m").isNotNull() & F.col("y_m").isNotNull()


def outfield() -> Column:
    return valid_player() & ~F.col("role").isin("goalkeeper", "referee")


def seconds(frame: Column, fps: float) -> Column:
    return F.round((frame - 1) / fps, 3)


def anchor(x: Column, y: Column, w: Column, h: Column, is_ball: Column) -> Column:
    """Box centre for a ball, bottom centre for others, as struct (x, y)."""
    return F.struct((x + w / 2).alias("x"), F.when(is_ball, y + h / 2).otherwise(y + h).alias("y"))


def project(h: Column, x: Column, y: Column) -> Column:
    """Pitch point of an image point by a 3x3 homography (9 numbers, row by
    row); null at infinity or outside the accepted band."""
    row = [h[3 * i] * x + h[3 * i + 1] * y + h[3 * i + 2] for i in range(3)]
    px, py = row[0] / row[2] + PITCH_X / 2, row[1] / row[2] + PITCH_Y / 2
    inside = px.between(-MARGIN, PITCH_X + MARGIN) & py.between(-MARGIN, PITCH_Y + MARGIN)
    return F.when((F.abs(row[2]) >= 1e-9) & inside, F.struct(px.alias("x_m"), py.alias("y_m")))


def minimap(x: Column, y: Column, scale: float, margin: int) -> Column:
    """Pixel of a pitch point, null off the map."""
    px, py = (x * scale).cast("int") + margin, (y * scale).cast("int") + margin
    width, height = int(PITCH_X * scale) + 2 * margin, int(PITCH_Y * scale) + 2 * margin
    return F.when((px >= 0) & (px < width) & (py >= 0) & (py < height), F.struct(px.alias("px"), py.alias("py")))


def inverse3(h: Column) -> Column:
    """Inverse of a 3x3 matrix (9 numbers, row by row), null if singular."""
    a, b, c, d, e, f, g, i, j = (h[k] for k in range(9))
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    adj = (e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d)
    return F.when(F.abs(det) > 1e-15, F.array(*[x / det for x in adj]))


def ground_homography(fx: Column, fy: Column, cx: Column, cy: Column, r: Column, t: Column) -> Column:
    """Ground-plane homography K (r1, r2, -R t) of a camera: r is the rotation
    (9 numbers, row by row), t its position."""
    moved = [-(r[3 * i] * t[0] + r[3 * i + 1] * t[1] + r[3 * i + 2] * t[2]) for i in range(3)]
    cols = [[r[3 * i], r[3 * i + 1], moved[i]] for i in range(3)]
    return F.array(*[fx * cols[0][k] + cx * cols[2][k] for k in range(3)], *[fy * cols[1][k] + cy * cols[2][k] for k in range(3)], *[cols[2][k] for k in range(3)])


def overlap(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """(intersection, union) areas of two boxes x, y, w, h (corner and size)."""
    iw = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    ih = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inter = iw * ih
    return inter, a["w"] * a["h"] + b["w"] * b["h"] - inter


def iou(a: dict[str, Column], b: dict[str, Column], rule: str = "zero") -> Column:
    """Intersection over union. rule: "zero" gives 0 for an empty union;
    "floor6" and "floor8" divide by at least 1e-6 or 1e-8; "add6" adds 1e-6."""
    inter, union = overlap(a, b)
    return {
        "zero": F.when(union == 0, F.lit(0.0)).otherwise(inter / F.when(union != 0, union)),
        "floor6": inter / F.greatest(union, F.lit(1e-6)),
        "floor8": inter / F.greatest(union, F.lit(1e-8)),
        "add6": inter / (union + 1e-6),
    }[rule]


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in "xywh"}


def centred(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x": cx - w / 2, "y": cy - h / 2, "w": w, "h": h}


def normalised(x: Column, y: Column, w: Column, h: Column, width: float, height: float) -> Column:
    """Centre-format box in fractions of the image."""
    return F.struct(((x + w / 2) / width).alias("cx"), ((y + h / 2) / height).alias("cy"), (w / width).alias("nw"), (h / height).alias("nh"))


def centre_crop(cx: Column, cy: Column, w: Column, h: Column, keep: float) -> Column:
    """A normalised box after cropping the image's central `keep` in both
    directions: null if its centre falls outside; sizes at most 1."""
    low = (1 - keep) / 2
    nx, ny = (cx - low) / keep, (cy - low) / keep
    inside = nx.between(0, 1) & ny.between(0, 1)
    return F.when(inside, F.struct(nx.alias("cx"), ny.alias("cy"), F.least(w / keep, F.lit(1.0)).alias("nw"), F.least(h / keep, F.lit(1.0)).alias("nh")))


def class_3of6(cls: Column) -> Column:
    """Six ground-truth classes to three; a ball is null."""
    return F.when(cls.isin(0, 1), 0).when(cls.isin(2, 3), 1).when(cls == 4, 2)


def digits(n: Column) -> Column:
    """(length, tens, ones) of a shirt number."""
    return F.struct(F.when(n <= 9, 0).otherwise(1).alias("length"), F.when(n <= 9, 0).otherwise(F.floor(n / 10)).cast("int").alias("tens"), (n % 10).cast("int").alias("ones"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def let(v: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: a lambda's variable is bound, where
    an expression used twice would run twice for each element."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def softmax(v: Column) -> Column:
    e = let(v, lambda a: let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m))))
    return let(e, lambda a: let(total(a), lambda s: F.transform(a, lambda x: x / s)))


def renormalised(v: Column, least: float = 1e-8) -> Column:
    """v over its sum; zeros where the sum is at most `least`."""
    return let(v, lambda a: let(total(a), lambda s: F.transform(a, lambda x: F.when(s > least, x / F.when(s > least, s)).otherwise(F.lit(0.0)))))


def number_vector(length: Column, tens: Column, ones: Column) -> Column:
    """Probabilities of 1 to 99 from digit heads (length 2, tens and ones 10)."""
    at = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda n: F.when(n <= 9, F.get(length, F.lit(0)) * F.get(ones, n)).otherwise(F.get(length, F.lit(1)) * F.get(tens, F.floor(n / 10).cast("int")) * F.get(ones, (n % 10).cast("int"))))
    return renormalised(at)


def masked(probs: Column, roster: Column) -> Column:
    """Mass on numbers outside the roster removed, the rest renormalised."""
    return renormalised(F.transform(probs, lambda p, i: F.when(F.array_contains(roster, i + 1), p).otherwise(F.lit(0.0))))


def top1(probs: Column) -> Column:
    """(number, p) of the first largest, null below 1e-6."""
    m = F.array_max(probs)
    return F.when(m >= 1e-6, F.struct(F.array_position(probs, m).cast("int").alias("number"), m.alias("p")))


def margin(probs: Column) -> Column:
    """Largest less second largest."""
    s = F.sort_array(probs, asc=False)
    return F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def lock_state(p1: Column, gap: Column, p1_threshold: float, margin_threshold: float) -> Column:
    return F.when((p1 >= p1_threshold) & (gap >= margin_threshold), "locked").when((p1 >= 0.40) & (gap >= 0.10), "tentative").otherwise("unknown")


def alternatives(probs: Column, k: int = 5) -> Column:
    """The k likeliest (number, p), ties to the lower number."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("q"), (i + 1).alias("number")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["number"].alias("number"), (-s["q"]).alias("p")))


def tempered(probs: Column, t: float) -> Column:
    return probs if t == 1 or t <= 0 else renormalised(F.transform(probs, lambda p: F.pow(p, F.lit(1 / t))))


def hash_fold(key: Column, modulus: int = 100) -> Column:
    """The MD5 of a key, as a number, modulo `modulus`."""
    hexes = F.split(F.md5(key), "")
    return F.aggregate(F.filter(hexes, lambda c: c != ""), F.lit(0), lambda a, c: ((a * 16 + F.conv(c, 16, 10).cast("int")) % modulus).cast("int"))


def hue_name(h: Column) -> Column:
    """Colour of a hue in degrees of 0 to 180."""
    return F.when((h < 10) | (h >= 170), "red").when(h < 25, "orange").when(h < 35, "yellow").when(h < 85, "green").when(h < 130, "blue").otherwise("purple")


def foot_zone(bx: Column, by: Column, b: dict[str, Column], share: float = 0.3) -> Column:
    """Whether a point lies in the bottom `share` of a box."""
    return bx.between(b["x"], b["x"] + b["w"]) & by.between(b["y"] + b["h"] * (1 - share), b["y"] + b["h"])


def kinematic_cost(dist: Column, delta: float) -> Column:
    return F.when(dist > delta, F.lit(float("inf"))).otherwise(F.pow(dist / delta, 2))


def safe_rate(num: Column, den: Column) -> Column:
    """num / den, 0 if den is not positive; raises if num is outside 0..den."""
    bad = (num < 0) | ((den > 0) & (num > den))
    return F.when(bad, F.raise_error(F.lit("a rate outside 0 to 1"))).when(den <= 0, F.lit(0.0)).otherwise(num / F.when(den > 0, den))


def legibility_label(q: Column, pred: Column, gt: Column, conf: Column) -> Column:
    return F.when((q >= 0.35) & (pred == gt) & (conf >= 0.70), 1).when(q < 0.15, 0)


def display_label(number: Column, state: Column, track: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(number.cast("string"), F.when(state == "tentative", "?").otherwise(""))).otherwise(F.concat(F.lit("#"), track.cast("string")))


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))
