"""Queries of checked arguments and items, near spellings, bridges and chart lines. covers: ids of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validation as C
from ..operators import terms
from ..sources import sinks
from .registry import Registry, Tables

R = Registry()

#: Tool arguments as models send them, in turn.
ARGUMENTS = ('{"limit": "12", "all": null, "path": 7}', '{"limit": 2.5, "all": "true", "path": "x"}', '{"limit": true, "all": 1, "path": null}', '{"limit": "abc", "all": "yes"}', "{")
SCHEMA = {"limit": "integer", "all": "boolean", "path": "string"}


@R.add("""SELECT event_id, ['', 'limit: integer', '', 'limit: integer,all: boolean,path: missing', 'malformed'][k + 1] AS problems, CASE k WHEN 0 THEN '12' WHEN 2 THEN '1' END AS arg_limit,
    CASE k WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN 'true' END AS arg_all, CASE k WHEN 0 THEN '7' WHEN 1 THEN 'x' WHEN 2 THEN '' END AS arg_path FROM (SELECT event_id, (event_id % 5)::INT AS k FROM events)""", covers=("M07",))
def tool_arguments(t: Tables):
    sent = F.element_at(F.array(*[F.lit(a) for a in ARGUMENTS]), (F.col("event_id") % 5 + 1).cast("int"))
    out = C.tool_arguments(sent, SCHEMA, ("limit", "path"))
    rows = t.events.select("event_id", out["problems"].alias("p"), out["values"].alias("v"))
    return rows.select("event_id", F.concat_ws(",", "p").alias("problems"), *[F.col("v")[k].alias(f"arg_{k}") for k in SCHEMA])


@R.add("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'item_type' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'date' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'date of no exact kind'
    WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 3 = 0 THEN 'trigger' WHEN o_orderkey % 7 = 0 THEN 'direct_quotes' END AS problem FROM orders""", covers=("M08",))
def item_problems(t: Tables):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    item = {
        "item_type": F.when(F.col("o_orderpriority") == "5-LOW", "wish").otherwise("task"),
        "title": F.concat(F.lit(" Order "), key),
        "date_kind": F.when(status == "F", "exact").when(status == "O", F.lit(" ")).otherwise("relative"),
        "date": F.when(status == "F", F.when(key % 2 == 0, "2024-02-30").otherwise(day)).when((status == "O") & (key % 2 == 0), day),
        "trigger": F.when(key % 3 != 0, "on delivery"),
        "direct_quotes": F.when(key % 7 == 0, F.array(F.lit("said"), F.lit(" "))).otherwise(F.array(F.lit("said"))),
    }
    return t.orders.select("o_orderkey", C.item_problem(C.item_defaults(item)).alias("problem"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS created FROM orders", covers=("T10",))
def legacy_dates(t: Tables):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("title: a\nCreated-At: '"), day, F.lit("'\n"))).when(k == 1, F.concat(F.lit("created: soon\n date created : "), day, F.lit("T10:00\n"))).otherwise(F.concat(F.lit("updated: "), day))
    return t.orders.select("o_orderkey", C.legacy_created(text).alias("created"))


@R.add("""WITH p AS (SELECT DISTINCT least(q.vec_id, r.vec_id) AS left_id, greatest(q.vec_id, r.vec_id) AS right_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 3) AS similarity FROM embeddings q JOIN embeddings r ON q.label <> r.label WHERE q.vec_id % 50 = 0)
    SELECT left_id, a.label AS left_corpus, right_id, b.label AS right_corpus, similarity FROM p JOIN embeddings a ON a.vec_id = left_id JOIN embeddings b ON b.vec_id = right_id WHERE similarity >= 0.3 ORDER BY similarity DESC, left_id, right_id LIMIT 200""", covers=("J08",))
def corpus_bridges(t: Tables):
    q = t.embeddings.where("vec_id % 50 = 0")  # the stated query set, against all rows
    return terms.bridges(q, t.embeddings, "vec_id", "embedding", "label", least=0.3)


#: A stated lexicon and roster over the words of the tables.
LEXICON = ["pipeline", "spark", "shuffle", "partition", "customer", "streaming", "vectors", "catalyst"]
ROSTER = [{"name": "Ada Catalyst", "aliases": ["the optimiser"]}, {"name": "Max Stream", "appears": "sometimes"}, {"name": "Host", "appears": "always"}, {"name": "Partition", "appears": "never"}]


@R.add(covers=("R09",))
def near_miss_terms(t: Tables):
    return terms.near_miss_terms(t.documents, "doc_id", "text", LEXICON)


@R.add(covers=("R10",))
def mentioned_speakers(t: Tables):
    return terms.mentioned_speakers(t.documents, "doc_id", "text", ROSTER)


@R.add("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN replace(o_orderpriority, '-', ':') END AS s, strftime(o_orderdate, '%Y-%m-%d') AS a, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') END AS b FROM orders), k AS (SELECT id, coalesce(s, 'Unassigned') AS section, a, b FROM r)
    SELECT section, 1 AS at, id, '    Order  - ' || id || ' :' || CASE WHEN b IS NULL THEN 'milestone, ' || id || ', ' || a || ', 0d' ELSE id || ', ' || a || ', ' || b END AS line FROM k UNION ALL SELECT DISTINCT section, 0, NULL, '    section ' || replace(section, ':', ' - ') FROM k""", covers=("K07",))
def gantt_lines(t: Tables):
    section = F.when(F.col("o_orderstatus") != "P", F.translate("o_orderpriority", "-", ":"))
    stop = F.when(F.col("o_orderkey") % 2 == 0, F.date_add("o_orderdate", 3))
    rows = t.orders.select("o_orderkey", F.concat(F.lit("Order :"), "o_orderkey").alias("title"), section.alias("part"), F.to_date("o_orderdate").alias("start"), stop.alias("stop"))
    return sinks.gantt_lines(rows, "o_orderkey", "title", "part", "start", "stop")


@R.add("SELECT p_partkey, '| ' || coalesce(p_name, '') || ' | ' || p_partkey || ' | a\\|b |' AS line FROM part", covers=("K06",))
def report_rows(t: Tables):
    return t.part.select("p_partkey", sinks.markdown_row([F.col("p_name"), F.col("p_partkey"), F.lit("a|b")]).alias("line"))
