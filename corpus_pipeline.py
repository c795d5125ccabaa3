"""A corpus pipeline of five stages; each one's rows are written as Parquet and read by the next.

Every function takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import decontaminate, minhash, mixing, quality, token_output
from lakewright.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is among ids (null: kept, as no decision names it)."""
    return docs.join(ids, "doc_id", "left_semi").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    found = quality.scores(docs, table(spark, sf_dir, "labels"))
    return _with(docs, found.where("predicted = 1").select("doc_id").distinct())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id, once."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    kept = _with(docs, found.where("kept").select("doc_id").distinct())
    once = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return once.union(kept.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; the others stay whole."""
    found = decontaminate.digest(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))
    return _with(docs, found.where("not contaminated").select("doc_id").distinct())


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, dealt to shards and shuffled within them.

    Rows without doc_id get a row number, so that each has its own place, shards and key (null: no part of a hash).
    """
    unnamed = written(docs.where("doc_id is null").withColumn("row", F.monotonically_increasing_id()), "mix-unnamed")
    docs = docs.where("doc_id is not null").withColumn("row", F.lit(None).cast("long")).unionByName(unnamed)
    _, drawn = mixing.draws(docs, keep=("row",))
    # rows of one doc_id, which near_dedup leaves none of, each stand where the first one does
    found = drawn.groupBy("doc_id", "row").agg(F.min("rid").alias("rid")).join(drawn.drop("doc_id", "row"), "rid")
    found = found.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "shard", "block", "place")
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("row").eqNullSafe(F.col("_row")))
    part = F.pmod(F.xxhash64("shard", F.floor(F.col("block") / 64)), F.lit(1 << 20))
    return rows.repartition("shard", part).sortWithinPartitions("shard", "block", "place").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences at their slots of the training order, read back from their shards."""
    return token_output.materialised(docs)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix", source_mix), ("tokens", tokens)]
#: Classifier and permutation have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
