"""Queries over logged sessions, file dates and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions
from .registry import Registry, Tables

R = Registry()
_WINDOWS = {"m/0": 128_000, "m/1": 200_000, "m/2": 100_000}


def _contexts(t: Tables):
    """Events stand in for a session log: the user is the session."""
    i = F.col("event_id")
    kind = F.when(i % 11 == 0, "compaction").when(i % 3 == 1, "user").otherwise("assistant")
    model = F.concat(F.lit("m/"), (i % 4).cast("string"))
    tokens = F.when(i % 13 != 5, i * 37 % 150_000 + 1)
    entries = t.events.select(F.col("user_id").alias("session"), i.alias("place"), F.col("ts").alias("at"), kind.alias("kind"), model.alias("model"), tokens.alias("tokens"))
    return sessions.session_contexts(entries, t.spark.createDataFrame(list(_WINDOWS.items()), "model string, window long"))


_CONTEXTS = """e AS (SELECT user_id AS session, event_id AS place, ts, CASE WHEN event_id % 11 = 0 THEN 'compaction' WHEN event_id % 3 = 1 THEN 'user' ELSE 'assistant' END AS kind, 'm/' || (event_id % 4) AS model, CASE WHEN event_id % 13 <> 5 THEN event_id * 37 % 150000 + 1 END AS tok FROM events),
  x AS (SELECT *, CASE WHEN kind = 'assistant' THEN CASE model WHEN 'm/0' THEN 128000 WHEN 'm/1' THEN 200000 WHEN 'm/2' THEN 100000 END END AS win, min(CASE WHEN kind = 'compaction' THEN place END) OVER (PARTITION BY session) AS cut FROM e),
  s AS (SELECT session, coalesce(arg_max(model, place) FILTER (kind = 'assistant'), '[unknown]/[unknown]') AS model, arg_max(win, place) FILTER (win IS NOT NULL) AS win, max(tok) FILTER (kind <> 'user') AS most_tokens,
    arg_max(tok, place) FILTER (kind <> 'user' AND tok IS NOT NULL AND (cut IS NULL OR place <= cut)) AS first_tokens, count(*) FILTER (kind = 'user') AS turns, count(*) FILTER (kind = 'assistant') AS answers, count(*) FILTER (kind = 'compaction') AS compactions,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000::DOUBLE AS minutes FROM x GROUP BY session),
  c AS (SELECT *, most_tokens / win::DOUBLE * 100 AS most_share, first_tokens / win::DOUBLE * 100 AS first_share FROM s)"""


@R.add(
    f"""WITH {_CONTEXTS} SELECT model, count(*) AS sessions, sum(answers)::BIGINT AS answers, round(avg(turns), 4) AS avg_turns, round(avg(minutes), 4) AS avg_minutes, round(avg(most_tokens), 4) AS avg_most_tokens, round(quantile_cont(most_tokens::DOUBLE, 0.5), 4) AS median_most_tokens,
    round(avg(most_share), 4) AS avg_most_share, round(quantile_cont(most_share, 0.5), 4) AS median_most_share, round(quantile_cont(first_share, 0.5), 4) AS median_first_share, count(most_share) AS known, count(*) FILTER (compactions > 0) AS compacted, sum(compactions)::BIGINT AS compactions,
    round(count(*) FILTER (compactions > 0) / count(*) * 100, 4) AS compaction_rate, count(*) FILTER (most_share >= 80) AS over_80, count(*) FILTER (most_share >= 90) AS over_90, count(*) FILTER (most_share >= 100) AS over_100 FROM c GROUP BY model""",
    covers=("A15",),
)
def context_rollup(t: Tables):
    return sessions.context_summary(_contexts(t))


@R.add(f"""WITH {_CONTEXTS} SELECT session, model FROM c WHERE (starts_with(model, 'm/1') OR starts_with(model, 'm/2')) AND session IN (SELECT user_id FROM events WHERE contains(lower(props), '"k": 7'))""", covers=("P06",))
def filtered_sessions(t: Tables):
    commands = t.events.select(F.col("user_id").alias("session"), F.col("props").alias("command"))
    return sessions.filter_sessions(_contexts(t).select("session", "model"), commands, "M/", ("M/1", "m/2"), ('"K": 7',))


@R.add(
    """WITH f AS (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE least((o_orderkey % 4)::INT, 5) END AS gap FROM orders), g AS (SELECT day, CASE WHEN day IS NOT NULL THEN gap END AS gap FROM f),
    d AS (SELECT day, count(*) AS n FROM g WHERE day IS NOT NULL GROUP BY 1 ORDER BY n DESC, day LIMIT 5), a AS (SELECT max(n) AS top, list(day::VARCHAR || '=' || n ORDER BY n DESC, day) AS top_days FROM d),
    c AS (SELECT count(*) AS files, count(day) AS with_birth, count(gap) AS labelled, count(*) FILTER (gap = 0) AS same_day, count(*) FILTER (gap <= 1) AS within_a_day FROM g)
    SELECT files, with_birth, labelled, same_day, within_a_day, round(same_day / labelled, 4) AS agreement, round(within_a_day / labelled, 4) AS loose_agreement, round(top / with_birth, 4) AS clustered, top_days FROM c, a""",
    covers=("A26",),
)
def birth_agreement(t: Tables):
    day, k = F.to_date("o_orderdate"), (F.col("o_orderkey") % 4).cast("int")
    stated = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<date>")).otherwise(F.array(F.date_add(day, k), F.date_sub(day, 5)))
    return sessions.birth_calibration(t.orders.select(F.when(F.col("o_orderkey") % 10 != 0, day).alias("birth"), stated.alias("stated")), "birth", "stated")


@R.add(covers=("R13",))
def relevant_paragraphs(t: Tables):
    text = F.regexp_replace("text", "\n", "\n\n")
    return t.documents.select("doc_id", sessions.relevant_text(text, ["tion", "that", "nicht", "where"], 1200).alias("text"))
