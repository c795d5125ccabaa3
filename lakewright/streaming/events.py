"""Structured Streaming forms: windowed counts with watermarks, latest state, attempts, incremental refresh."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_table(spark: SparkSession, path: str, per_trigger: int | None = 1) -> DataFrame:
    """A folder or file of Parquet as a stream, with the schema that a batch read finds. A lone file has to be named by a pattern.

    per_trigger: files of a batch; None takes all that are there in one. Where late rows are dropped, files that are not in the
    order of their time have to come together, as each batch moves the watermark to the end of its own.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(pattern)


def tumbling_counts(events: DataFrame, at: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped."""
    t = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    out = t.groupBy(F.window("_at", width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def session_counts(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    t = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    out = t.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def attempts(results: DataFrame, key: str, ok: str, most: int = 3) -> DataFrame:
    """(key, tries, state) after each batch: done on success, failed after `most` tries, else pending. Later results of a settled key do not count."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries, now = state.get if state.exists else (0, "pending")
        for batch in batches:
            for good in batch[ok]:
                if now == "pending":
                    tries += 1
                    now = "done" if good else "failed" if tries >= most else "pending"
        state.update((tries, now))
        yield pd.DataFrame({key: [k[0]], "tries": [tries], "state": [now]})

    kind = dict(results.dtypes)[key]
    return results.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, tries long, state string", "tries long, state string", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs over what is there now, into an in-memory table. For results of bounded size."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def changed(previous: DataFrame, current: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of current that are new or whose content hash differs: what an incremental refresh has to redo."""
    h = lambda d: d.select(key, F.sha2(text, 256).alias("h"))
    return current.join(h(previous).withColumnRenamed("h", "_old"), key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.sha2(text, 256))).drop("_old")


def superseded(journal: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins for each key; a single aggregation, no window."""
    rest = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")
