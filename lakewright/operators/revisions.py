"""Sources over time: revisions with the span in which each held, merged with a new snapshot by one full join.

A history has a row for each revision: source, revision (its number within the source), content (a fingerprint), valid_from, valid_to
(null while it holds) and active. A snapshot closes the revisions of sources that changed or are gone, opens one for those that
are new, changed or back, and leaves the rest alone. Closed rows stay, so what was derived from them can be retired or traced.
Of a source that a snapshot names twice the greatest content counts. Sources without name are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def empty_history(spark: SparkSession, source: str = "long") -> DataFrame:
    return spark.createDataFrame([], f"source {source}, revision long, content string, valid_from timestamp, valid_to timestamp, active boolean")


def merged(history: DataFrame, snapshot: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(the new history, its changes). snapshot: source, content. changes: source, change, previous, current -- numbers of revisions."""
    last = history.groupBy("source").agg(F.max(F.struct("revision", "content", "active")).alias("last"))
    seen = snapshot.where("source is not null").groupBy(F.col("source").alias("_source")).agg(F.max("content").alias("now"), F.lit(True).alias("here"))
    both = last.join(seen, F.col("source") == F.col("_source"), "full").select(F.coalesce("source", "_source").alias("source"), "last", "now", "here")
    open_ = F.coalesce(F.col("last.active"), F.lit(False))
    here = F.coalesce("here", F.lit(False))
    change = F.when(here & ~open_, "added").when(~here & open_, "removed").when(here & ~F.col("now").eqNullSafe(F.col("last.content")), "changed").when(here, "unchanged")
    both = both.withColumn("change", change).where("change is not null")
    previous = F.when(open_, F.col("last.revision"))
    following = F.coalesce(F.col("last.revision"), F.lit(0)) + 1
    current = F.when(F.col("change").isin("added", "changed"), following).when(F.col("change") == "unchanged", F.col("last.revision"))
    both = both.select("source", "now", "change", previous.alias("previous"), current.cast("long").alias("current"))
    ends = both.where("change in ('changed', 'removed')").select(F.col("source").alias("_source"), F.lit(True).alias("ends"))
    kept = history.join(ends, F.col("source") == F.col("_source"), "left").withColumn("ends", F.coalesce("ends", F.lit(False)) & F.col("active"))
    kept = kept.select("source", "revision", "content", "valid_from", F.when(F.col("ends"), at).otherwise(F.col("valid_to")).alias("valid_to"), (F.col("active") & ~F.col("ends")).alias("active"))
    none = F.lit(None).cast("timestamp")
    begun = both.where("change in ('added', 'changed')").select("source", F.col("current").alias("revision"), F.col("now").alias("content"), at.alias("valid_from"), none.alias("valid_to"), F.lit(True).alias("active"))
    return kept.unionByName(begun), both.select("source", "change", "previous", "current")


def packet_states(history: DataFrame, packets: DataFrame) -> DataFrame:
    """(packet, source, state): packets (packet, source, revision) of an active revision are current, those of a closed one retired, others unknown."""
    known = history.select("source", "revision", "active")
    state = F.when(F.col("active"), "current").when(F.col("active").isNotNull(), "retired").otherwise("unknown")
    return packets.join(known, ["source", "revision"], "left").select("packet", "source", state.alias("state"))
