"""Mixing sources to target weights by Sainte-Laguë apportionment.

DataFrame functions only. Each source's target is a number of words. The mix is
made of blocks of equally many words; how many of them a source gives is
apportioned by highest quotients (target divided by 1, 3, 5, ...), then in the
same way to the source's shards. A shard lays its documents, in seeded order,
on a tape twice; which blocks of the tape are taken is a seeded choice too, and
a document gives the words that lie in taken blocks: at most two copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import WORD, attached, running_start, written

#: Weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows up to which a running sum is one window; more are summed in ranges.
PLAIN = 100_000


def sums_before(rows: DataFrame, order: list[Column], value: str, name: str, many: bool) -> DataFrame:
    """rows with `start`, the sum of `value` over all rows before it."""
    if many:
        return running_start(rows, order, value, name).drop("part")
    return rows.withColumn("start", F.coalesce(F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def n_words(text: Column) -> Column:
    """The number of runs of characters that aren't ASCII blanks; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: str, *columns: str) -> Column:
    """60 bits of an MD5 of the seed and the columns."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """Adds `target` to (source, source_size), a row for each source.

    Weights follow the sources in code point order, null last. The targets are
    weight * level, but at most `most` times the source's size; the level is
    such that they sum to share times all sizes. The sources that stop at
    their limit are those with the smallest limit / weight, so the level needs
    sums over the sources in that order and no rounds of resharing.
    """
    many = sources.count() > PLAIN
    ranked = sums_before(sources.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], "_one", "ranks", many)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("start"), F.lit(len(weights))).cast("int"))
    rows = ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("limit"))
    at = F.col("limit") / F.col("weight")
    by_limit = [at.asc(), F.col("source").asc_nulls_last()]
    used = sums_before(rows, by_limit, "limit", "used", many).withColumnRenamed("start", "used")
    both = sums_before(used, by_limit, "weight", "weights", many)
    all_ = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    total, left = F.lit(all_["size"] * float(share)), F.lit(all_["weight"]) - F.col("start")
    # the first source in the order whose limit isn't reached sets the level
    level = both.where(F.col("weight") * (total - F.col("used")) / left <= F.col("limit")).agg(F.min(F.struct(at.alias("at"), F.col("used").alias("used"), left.alias("weights"))).alias("l")).first()["l"]
    wanted = F.col("weight") * (total - F.lit(level["used"])) / F.lit(level["weights"]) if level else F.col("limit").cast("double")
    return rows.select("source", "source_size", F.coalesce(F.least(wanted, F.col("limit").cast("double")), F.lit(0.0)).alias("target"))


def apportioned(parties: DataFrame, within: list[str], tie: list[str], votes: str, seats: str, limit: str) -> DataFrame:
    """Adds `quota`: `seats` divided among the rows of each group `within` in
    proportion to `votes`, by highest quotients votes / 1, / 3, / 5, ..., ties
    in the order of `tie`; no row gets more than `limit`.

    Seats that any outcome gives a row are counted outright: with V votes, S
    seats and n rows, quotients of at least V / (2 (S - n / 2)) are all taken.
    Only the quotients about the boundary, a few for each row, are ranked, by
    running counts over ranges of all of them: a group with most of the rows
    is many tasks.
    """
    keys = list(dict.fromkeys([*within, *tie]))
    rows = attached(parties, parties.groupBy(*within).agg(F.count("*").alias("_n"), F.sum(votes).alias("_votes")), within)
    safe = F.col(seats) - F.col("_n") / 2
    # the seats x with votes / (2 x - 1) above the bound
    sure = F.when((safe > 0) & (F.col("_votes") > 0), F.floor(F.col(votes) * safe / F.col("_votes") + 0.5 - 1e-9)).otherwise(F.lit(0)).cast("long")
    rows = written(rows.withColumn("_sure", F.least(F.greatest(sure - 1, F.lit(0).cast("long")), F.col(limit))), "sure")
    some = F.when(F.col("_votes") > 0, F.ceil(F.col(votes) / F.col("_votes") * (2 * F.col("_n") + 2))).otherwise(F.lit(0)).cast("long") + 4
    seat = F.explode_outer(F.when(F.col(votes) > 0, F.sequence(F.col("_sure") + 1, F.least(F.col("_sure") + some, F.greatest(F.col(limit), F.col("_sure") + 1)))))
    asked = rows.select(*keys, votes, limit, seat.alias("_seat"))
    asked = asked.where(F.col("_seat") <= F.col(limit)).select(*keys, (F.col(votes) / (2 * F.col("_seat") - 1)).alias("_q"), F.lit(1).alias("_one"))
    order = [*[F.col(c).asc_nulls_first() for c in within], F.desc("_q"), *[F.col(c).asc_nulls_last() for c in tie]]
    ranked = sums_before(asked, order, "_one", "quotients", asked.count() > PLAIN)
    first = ranked.groupBy(*within).agg(F.min("start").alias("_first"))
    open_ = rows.groupBy(*within).agg((F.first(seats) - F.sum("_sure")).cast("long").alias("_open"))
    last = attached(open_, first, within)
    won = attached(ranked, last, within).where(F.col("start") - F.col("_first") < F.col("_open")).groupBy(*keys).agg(F.count("*").alias("_won"))
    return attached(rows, won, keys).select(*parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, block: int = 256, shard_rows: int = 4_000, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    size is the text's number of words (null: 0); target is the source's; taken
    is how many words the mix takes from the row, repeats counted, at most
    `most` times its size. A source's taken words differ from its target by
    less than a block for the source and one for each of its shards' ends.
    Null sources form a source of their own, last in order. Repeated rows are
    separate rows. An empty table gives no rows. Further columns are ignored.

    A source's rows are dealt into shards of about `shard_rows` by hash, so one
    source with a third of all rows is many tasks. The hash is of doc_id and
    size; rows that agree in both share a shard and stand side by side there,
    in any order, as what the mix takes of them together doesn't depend on it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    rows = written(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    planned = targets(sources.drop("n"), share, most, weights)
    per_source = apportioned(planned.withColumn("_all", F.lit(1)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")).withColumn("limit", F.ceil(F.col("source_size") * most / block).cast("long")), ["_all"], ["source"], "target", "seats", "limit")
    shards = sources.select("source", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"))
    shards = shards.withColumnRenamed("source", "_source")
    plan = written(per_source.join(shards, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("source").alias("_source"), "source_size", "target", F.col("quota").alias("source_quota"), "shards"), "plan")
    # a row for each source; beyond this many, Spark may shuffle it instead
    small = F.broadcast(plan) if plan.count() <= 100_000 else plan
    own = rows.withColumn("_h", seeded(seed, "doc_id", "size"))
    dealt = own.join(small, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "_h", "source_size", "target", "source_quota", F.pmod(F.col("_h"), F.col("shards")).cast("int").alias("shard"))
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").cast("long").alias("cell_size"), F.first("source_quota").alias("source_quota"))
    cells = cells.withColumn("votes", F.col("cell_size").cast("double")).withColumn("limit", F.ceil(F.col("cell_size") * most / block).cast("long"))
    quotas = written(apportioned(cells, ["source"], ["shard"], "votes", "source_quota", "limit"), "quotas")
    # seeded choice of each shard's blocks
    blocks = quotas.where("limit > 0").select("source", "shard", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("limit") - 1)).alias("block"))
    chance = Window.partitionBy("source", "shard").orderBy("_b", "block")
    chosen = blocks.withColumn("_b", seeded(seed + "-blocks", "source", "shard", "block")).withColumn("_r", F.row_number().over(chance)).where("_r <= quota").select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), F.col("block").alias("_block"))
    # where a document lies on its shard's tape, once for each copy
    before = Window.partitionBy("source", "shard").orderBy("_h", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_from", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = written(placed, "placed")
    tape = quotas.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "cell_size")
    on = placed.join(F.broadcast(tape) if quotas.count() <= 100_000 else tape, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).select("_row", "source", "shard", "_from", "size", "cell_size")
    copies = on.where("size > 0").select("_row", "source", "shard", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda c: F.col("_from") + c * F.col("cell_size"))).alias("_from"))
    touched = copies.select("_row", "source", "shard", "_from", (F.col("_from") + F.col("size")).alias("_to"), F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("size") - 1) / block))).alias("block"))
    # blocks are many times their shards' rows, which Spark's estimate misses: never broadcast them
    met = touched.join(chosen.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")) & (F.col("block") == F.col("_block")), "left_semi")
    inside = F.least("_to", (F.col("block") + 1) * block) - F.greatest("_from", F.col("block") * block)
    taken = met.groupBy("_row").agg(F.sum(inside).cast("long").alias("taken"))
    return placed.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
