"""From raw documents to packed sequences: quality, near-duplicates, repeated
passages, source mix, packing. Each stage calls one operator of touchline.llm
on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm import mixing, packing, quality, simhash, substring
from touchline.llm.common import WORD, table_path, written
from touchline.llm.queries import table, tokenizer

#: No SQL: tokenizers, hashed models and SimHash can't be written in it.
ORACLE_SQL = None


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with its columns named so that no operator has names of its own for
    them, but for the needed ones; toDF(*docs.columns) names them back."""
    return docs.toDF(*[c if c in needed else f"passed_{i}" for i, c in enumerate(docs.columns)])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the others go.

    Null and empty texts have weight one, and like very long ones, which count
    whole, stay or go by their key. Ties in the key go to the smaller doc_id;
    repeated rows have one key and stay or go together. Without labels of both
    kinds all documents stay; an empty table gives an empty one. All columns
    pass, whatever their names."""
    own = aside(docs, "doc_id", "text")
    return quality.select(own, table(spark, sf_dir, "labels")).select(own.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest
    doc_id.

    Documents without doc_id stay; rows of one doc_id stay or go together.
    Null, empty and blank texts are one group. Very long texts are compared
    whole. An empty table gives an empty one. All columns pass, whatever their
    names."""
    groups = simhash.similar_groups(docs, shingle=5, similarity=0.8)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    same = docs["doc_id"].cast("long") == gone["_gone"]
    return docs.join(gone, same, "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words and more that stand elsewhere too.

    Every document stays: one that is all repeats with an empty text, null and
    empty texts as they are, repeated rows without what they repeat. n_chars
    follows the text where something went. An empty table gives an empty one.
    All columns pass, whatever their names."""
    own = aside(docs, "doc_id", "text")
    kept = substring.remove_repeats(own, window=35)
    texts = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        count = own.columns[docs.columns.index("n_chars")]
        texts[count] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(count)).cast(docs.schema["n_chars"].dataType)
    return kept.withColumns(texts).select(own.columns).toDF(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: one of which it takes t of n
    words stands floor(t / n) times or once more, t / n times on average, and
    at most twice.

    A mix is of words: documents without any (null, empty, blank) aren't in it.
    Repeated rows of one doc_id share their count, rows without doc_id draw
    each for itself. An empty table gives an empty one. All columns pass,
    whatever their names."""
    own = aside(docs, "doc_id", "text", "source")
    return copied(own, mixing.mix(own, share=1.5, most=2)).toDF(*docs.columns)


def copied(docs: DataFrame, mixed: DataFrame, shard_rows: int = 4_000) -> DataFrame:
    """docs with whole copies of what `mixed` (doc_id, size, source_size,
    target, taken) takes. Shares of copies are summed in shards of a source,
    documents of like size in a row, and a copy falls where the sum passes a
    whole number: a shard's words differ from those taken by about its longest
    document. Rows without doc_id draw by their text, each for itself. docs has
    no columns of names that begin with an underscore."""
    one = 1 << 32
    rate = F.floor(F.sum("taken") / F.sum("size") * one).cast("long").alias("_rate")
    rates = mixed.where("size > 0").groupBy("doc_id").agg(rate, F.max("size").alias("_size"), F.min(F.struct("source_size", "target")).alias("_source"))
    rates = written(rates, "rates").withColumnRenamed("doc_id", "_doc_id")
    # a row for each source; beyond this many, Spark may shuffle it instead
    counts = rates.groupBy("_source").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("_shards"))
    counts = F.broadcast(counts) if counts.count() <= 100_000 else counts
    shard = F.pmod(F.xxhash64(F.lit("shard"), "_doc_id"), F.col("_shards"))
    by_size = Window.partitionBy("_source", "_shard").orderBy("_size", F.xxhash64("_doc_id"), "_doc_id")
    start = F.pmod(F.xxhash64(F.lit("start"), "_source", "_shard"), F.lit(one))
    end = start + F.sum("_rate").over(by_size)
    whole = F.floor(end / one) - F.floor((end - F.col("_rate")) / one)
    planned = rates.join(counts, "_source").withColumn("_shard", shard).select("_doc_id", "_rate", whole.cast("int").alias("_times"))
    drawn = F.floor((F.col("_rate") + F.pmod(F.xxhash64(F.lit("copy"), "text"), F.lit(one))) / one).cast("int")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id"))
    words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD)
    found = docs.where(words).join(planned.where("_rate > 0"), same).withColumn("_times", F.when(F.col("_doc_id").isNull(), drawn).otherwise(F.col("_times")))
    return found.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents with their sequences of 2048 tokens.

    Copies of a document are packed each; null and empty texts give one piece
    of the end id, very long ones many. An empty table gives no pieces. Columns
    besides doc_id and text are left out."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", source_mix),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = table_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
