"""Queries that run as streams over what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.stored import shared_folder
from ..streaming import events, retries
from .registry import Registry, Tables

R = Registry()


@R.add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def stream_hourly_counts(t: Tables):
    s = events.stream_table(t.spark, f"{t.sf_dir}/events.parquet")
    out = events.run_to_end(events.tumbling_counts(s, "ts", "event_type", "value"), "lw_hourly")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("SELECT event_id, props FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0")
def incremental_refresh(t: Tables):
    old = t.events.where("event_id % 5 <> 0").select("event_id", F.when(F.col("event_id") % 7 == 0, "stale").otherwise(F.col("props")).alias("props"))
    return events.changed(old, t.events.select("event_id", "props"), "event_id", "props")


@R.add("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_write_wins(t: Tables):
    return events.superseded(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


_OUTCOMES = """e AS (SELECT user_id AS item, epoch_ms(ts) AS ms, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'started' END AS outcome, event_type = 'error' AND value < 60 AS transient FROM events)"""


@R.add(f"""WITH {_OUTCOMES}, f AS (SELECT item, ms, outcome, transient, row_number() OVER (PARTITION BY item, outcome = 'failed' AND transient ORDER BY ms) AS nth FROM e),
    z AS (SELECT item, min(ms) FILTER (outcome = 'completed' OR (outcome = 'failed' AND (NOT transient OR nth = 3))) AS settled FROM f GROUP BY item), k AS (SELECT f.*, settled FROM f JOIN z USING (item) WHERE settled IS NULL OR ms <= settled),
    g AS (SELECT item, count(*) FILTER (outcome <> 'started') AS attempts, max(ms) AS at_ms, first(outcome ORDER BY ms DESC) AS outcome, any_value(settled) AS settled FROM k GROUP BY item), w AS (SELECT max(ms) - 600000 AS mark FROM e),
    s AS (SELECT *, CASE WHEN settled IS NULL AND outcome = 'failed' THEN at_ms + 60000 * CAST(pow(2, attempts - 1) AS BIGINT) END AS due FROM g)
    SELECT item, attempts, CASE WHEN due <= mark THEN 'pending' WHEN outcome = 'started' THEN 'in_progress' ELSE outcome END AS status, settled IS NULL AS retryable, CASE WHEN due > mark THEN due END AS due_ms FROM s, w""", covers=("X07",))  # fmt: skip
def attempt_states(t: Tables):
    """Users' events as attempts at items: purchases complete, errors fail, of which small ones are timeouts; the last state of each."""
    s = events.stream_table(t.spark, f"{t.sf_dir}/events.parquet", per_trigger=None)
    outcome = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("started")
    message = F.when(F.col("value") < 60, "Request timeout").otherwise("invalid input")
    folder = f"{shared_folder(t.spark)}/attempts-{uuid.uuid4().hex[:12]}"
    rows = retries.run_into(retries.transitions(s, "user_id", "ts", outcome, message), f"{folder}/rows", f"{folder}/checkpoint")
    return retries.latest(rows).select("item", "attempts", "status", "retryable", F.unix_millis("due").alias("due_ms"))
