"""Reports over sequences: scores, descriptions, histograms, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.operators.running import running


def composite(rows: DataFrame) -> DataFrame:
    """Composite score of each sequence. The largest RMSE is a scalar subquery,
    so no window gathers the table."""
    top = rows.agg(F.max("rmse")).scalar()
    s = 0.30 * F.col("f1") + 0.25 * F.col("mota") + 0.20 * F.col("team_accuracy") + 0.15 * (1 - F.col("rmse") / top) + 0.10 * F.col("idf1")
    return rows.withColumn("composite", s)


def best(rows: DataFrame, metric: str, k: int) -> DataFrame:
    """The k best rows with their rank: a bounded sort, then a numbering of k."""
    top = rows.orderBy(F.desc(metric), "seq").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), "seq")))


def ranked(rows: DataFrame, metric: str) -> DataFrame:
    """All rows with their rank, by running counts in ranges."""
    return running(rows.withColumn("_one", F.lit(1)), [], [F.desc(metric), F.col("seq")], rank="_one").drop("_one").withColumn("rank", F.col("rank").cast("int"))


def top_lines(rows: DataFrame, metric: str, k: int = 5) -> DataFrame:
    line = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" seq "), F.col("seq").cast("string"), F.lit(f" {metric} "), F.printf(F.lit("%.3f"), F.col(metric)))
    return best(rows, metric, k).select("seq", line.alias("line"))


def described(rows: DataFrame, *metrics: str) -> DataFrame:
    """mean, median, std (sample), min, max of each metric, one row each."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("r")).select("r.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def binned(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    b = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def density(rows: DataFrame, column: str, grid: list[float], bandwidth: float) -> DataFrame:
    """Gaussian kernel density at a few grid points, summed in one pass."""
    c = F.col(column)
    kernel = [F.avg(F.exp(-((c - g) ** 2) / (2 * bandwidth**2))).alias(f"k{i}") for i, g in enumerate(grid)]
    one = rows.agg(*kernel)
    scale = bandwidth * (2 * 3.141592653589793) ** 0.5
    points = F.array(*[F.struct(F.lit(g).alias("x"), (F.col(f"k{i}") / scale).alias("density")) for i, g in enumerate(grid)])
    return one.select(F.explode(points).alias("p")).select("p.*")


def trend(rows: DataFrame, y: str, x: str) -> DataFrame:
    return rows.agg(F.corr(y, x).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def quartiles(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(*[F.percentile(column, q).alias(n) for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])


def quality_metrics(rows: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Accuracies of number heads against the truth."""
    p, t = F.col(pred), F.col(truth)
    same = lambda a, b: F.avg((a == b).cast("double"))
    return rows.agg(same(p > 9, t > 9).alias("length_acc"), same(F.floor(p / 10), F.floor(t / 10)).alias("tens_acc"), same(p % 10, t % 10).alias("ones_acc"), same(p, t).alias("number_acc"))
