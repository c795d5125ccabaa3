"""Queries of record-level rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import identity, profiling, ranking, records, relating
from .registry import Registry, Tables

R = Registry()


@R.add("""SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_orderstatus IN ('O', 'F') AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'""")
def scope_filter(t: Tables):
    keep = records.in_scope("High", F.col("o_orderpriority"), ["O", "F"], F.col("o_orderstatus"), F.col("o_orderdate"), "1995-01-01", "1996-12-31")
    return t.orders.where(keep).select("o_orderkey")


@R.add("""SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'licensed under') THEN 'excluded' WHEN regexp_matches(lower(coalesce(text, '')), 'token|secret') THEN 'included' WHEN regexp_matches(lower(coalesce(text, '')), 'tion the') THEN 'focus' WHEN regexp_matches(lower(coalesce(text, '')), 'que|der') THEN 'related' ELSE 'dropped' END AS decision FROM documents""")
def scope_decision(t: Tables):
    return t.documents.select("doc_id", records.scope_decision(F.col("text"), "licensed under", "token|secret", "tion the", "que|der").alias("decision"))


@R.add(r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents WHERE regexp_matches(text, 'ation\.$|token')),
    h AS (SELECT *, regexp_matches(line, 'ation\.$|token') AS is_match FROM l), n AS (SELECT *, bool_or(is_match) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h)
    SELECT id, line_no, substr(line, 1, 500) AS line, is_match FROM n WHERE near""")
def grep_with_context(t: Tables):
    return records.grep(t.documents, "doc_id", "text", "ation\\.$|token", context=1)


@R.add("""SELECT o_orderkey, coalesce('OWNER ' || c_custkey, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 9000) ON c_custkey = o_orderkey""")
def overlay_owned_columns(t: Tables):
    owned = t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_orderkey"), F.concat(F.lit("OWNER "), F.col("c_custkey").cast("string")).alias("o_orderstatus"))
    return records.overlay(t.orders.select("o_orderkey", "o_orderstatus"), owned, "o_orderkey", ["o_orderstatus"])


@R.add("""SELECT o_orderkey, CAST(coalesce(s, f) AS DATE) AS start, CAST(coalesce(f, s) AS DATE) AS stop, (CAST(coalesce(f, s) AS DATE) - CAST(coalesce(s, f) AS DATE))::INT + 1 AS days, CASE WHEN s IS NOT NULL THEN 'source' WHEN f IS NOT NULL THEN 'forecast' ELSE 'none' END AS basis
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS s, m AS f FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) ON l_orderkey = o_orderkey)""")
def schedule_rows(t: Tables):
    ship = t.lineitem.where("l_linenumber > 2").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("forecast_stop"))
    rows = t.orders.join(ship, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("source_start"), "forecast_stop", F.lit(None).cast("timestamp").alias("none"))
    return records.schedule(rows, ("source_start", "none"), ("none", "forecast_stop")).select("o_orderkey", "start", "stop", "days", "basis")


@R.add("""WITH e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS rank, CAST(ts AS DATE) AS date, event_id AS path FROM events), b AS (SELECT user_id, min(rank) AS b FROM e GROUP BY 1),
    t AS (SELECT e.* FROM e JOIN b ON e.user_id = b.user_id AND rank = b)
    SELECT user_id, min(date) AS date, arg_min(path, (date, path)) AS path, CASE WHEN count(DISTINCT date) > 1 THEN 'medium' WHEN any_value(rank) = 0 THEN 'high' ELSE 'low' END AS confidence FROM t GROUP BY 1""")
def date_evidence(t: Tables):
    rank = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return records.evidence_decision(t.events.select("user_id", rank.alias("rank"), F.to_date("ts").alias("date"), F.col("event_id").alias("path")), "user_id")


@R.add("""SELECT l_returnflag, m AS month_first, d AS day_first, CASE WHEN m > 0 AND d = 0 THEN 'month first' WHEN d > 0 AND m = 0 THEN 'day first' END AS convention FROM (SELECT l_returnflag, count(*) FILTER (l_linenumber <= 12 AND l_quantity > 12) AS m, count(*) FILTER (l_linenumber > 12 AND l_quantity <= 12) AS d FROM lineitem GROUP BY 1)""")
def date_convention_vote(t: Tables):
    v = records.convention_vote(F.col("l_linenumber"), F.col("l_quantity"))
    return t.lineitem.groupBy("l_returnflag").agg(*[c.alias(n) for n, c in v.items()])


_PASS = """s AS (SELECT event_type, count(*) AS items, count(*) FILTER (a) AS passed, count(*) FILTER (o AND NOT a) AS unstable FROM (SELECT event_type, user_id, bool_and(value > 5) AS a, bool_or(value > 5) AS o FROM events GROUP BY 1, 2) GROUP BY 1)"""


@R.add(f"WITH {_PASS} SELECT *, passed / items AS rate FROM s")
def pass_summary(t: Tables):
    return records.pass_summary(t.events, "event_type", "user_id", F.col("value") > 5)


@R.add(f"WITH {_PASS} SELECT *, passed / items AS rate FROM s WHERE abs(passed / items - 0.6) <= 1.0 / items OR unstable > 0")
def undecided_groups(t: Tables):
    return records.undecided(records.pass_summary(t.events, "event_type", "user_id", F.col("value") > 5), 0.6)


@R.add(r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS k, CASE WHEN page_id % 3 = 0 THEN [] ELSE [page_id % 2] END AS c FROM pages),
    x AS (SELECT a.k, count(*) AS pairs FROM p a JOIN p b ON a.k = b.k AND a.page_id < b.page_id WHERE len(a.c) = 0 OR len(b.c) = 0 OR (len(a.c) = 1 AND a.c = b.c) GROUP BY 1)
    SELECT k, n, silent, coalesce(pairs, 0) AS pairs FROM (SELECT k, count(*) AS n, count(*) FILTER (len(c) = 0) AS silent FROM p GROUP BY 1) LEFT JOIN x USING (k)""")
def ambiguous_classes(t: Tables):
    c = F.when(F.col("page_id") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("page_id") % 2))
    return records.pair_classes(t.pages.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("k"), c.alias("c")), "page_id", "k", "c")


@R.add(r"""SELECT source, count(*) AS size, count(DISTINCT lang) > 1 AS cross_document, count(DISTINCT regexp_matches(lower(text), '(^|[^a-z])(not|no|never|without|cannot|n''t|fails to|failed to|lack|absence of|insignificant|no significant|no effect|did not|does not)([^a-z]|$)')) > 1 AS mixed_negation FROM documents GROUP BY 1""")
def negation_conflicts(t: Tables):
    return records.negation_conflicts(t.documents.select("source", "lang", X.has_negation(F.col("text")).alias("negated")), "source", "lang", "negated")


@R.add("""SELECT source, doc_id, n_chars, row_number() OVER (ORDER BY turn, n_chars DESC, doc_id) AS place FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1 THEN 0 ELSE 1 END AS turn FROM documents) ORDER BY place LIMIT 30""")
def diverse_first(t: Tables):
    return records.diverse_first(t.documents.select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 30)


@R.add("""SELECT c_custkey AS id, unnest(list_filter([CASE WHEN b IS NULL THEN 'owner' END, CASE WHEN s IS NULL THEN 'segment' END], lambda x: x IS NOT NULL)) AS missing FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name END AS b, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS s FROM customer)""")
def gaps_and_conflicts(t: Tables):
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("owner"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return records.gaps_and_conflicts(rows, "c_custkey", ["owner", "segment"])


@R.add("""SELECT o_orderkey, greatest(0, p - c) AS fresh, CASE WHEN p > 0 THEN c / p END AS cache_share, CASE WHEN ms > 0 THEN p * 1000.0::DOUBLE / ms END AS per_second FROM (SELECT o_orderkey, o_orderkey % 100 AS p, o_custkey % 120 AS c, o_orderkey % 7 AS ms FROM orders)""")
def telemetry_rows(t: Tables):
    p, c, ms = F.col("o_orderkey") % 100, F.col("o_custkey") % 120, F.col("o_orderkey") % 7
    return t.orders.select("o_orderkey", *[v.alias(k) for k, v in records.telemetry(p, c, F.lit(0), p, ms).items()])


@R.add("""SELECT floor(log2(value + 1))::INT AS bucket, event_type, count(*) AS n, avg(value) AS mean, count(*) FILTER (value > 10) AS above_10, count(*) FILTER (value > 50) AS above_50 FROM events GROUP BY 1, 2""")
def call_histogram(t: Tables):
    b = F.floor(F.log2(F.col("value") + 1)).cast("int")
    return t.events.groupBy(b.alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if(F.col("value") > 10).alias("above_10"), F.count_if(F.col("value") > 50).alias("above_50"))


@R.add("""SELECT day, hour, quantile_cont(n, 0.5) AS median FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, hour(ts)::INT AS hour, user_id, count(*) AS n FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def bucket_medians(t: Tables):
    n = t.events.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("day", "hour").agg(F.percentile("n", F.lit(0.5)).alias("median"))


@R.add("""SELECT l_orderkey, count(*) AS calls, count(DISTINCT l_suppkey) AS files, count(*) / count(DISTINCT l_suppkey) AS ratio FROM lineitem GROUP BY 1 HAVING count(*) >= 2""")
def multi_call_groups(t: Tables):
    g = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("calls"), F.count_distinct("l_suppkey").alias("files")).where("calls >= 2")
    return g.withColumn("ratio", F.col("calls") / F.col("files"))


@R.add("""SELECT c.c_custkey AS l, s.s_suppkey AS r, c.c_nationkey AS k FROM (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal > 9500 GROUP BY 1 HAVING count(*) = 1) c JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1) s ON c.c_nationkey = s.s_nationkey""")
def unique_pairs_by_nation(t: Tables):
    left = t.customer.where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("l"))
    return relating.unique_on_both(left, t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("r")), "k", "l", "r")


@R.add(r"""WITH u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS u, page_id % 4 AS p FROM pages), f AS (SELECT u, min(p) AS f FROM u GROUP BY 1) SELECT page_id, row_number() OVER (ORDER BY p, page_id, u.u) AS "order" FROM u JOIN f ON u.u = f.u AND p = f""")
def first_provider_wins(t: Tables):
    rows = t.pages.select("page_id", "url")
    return identity.first_provider(rows, F.regexp_extract("url", "://([^/?#]*)", 1), F.col("page_id") % 4, F.col("page_id")).select("page_id", "order")


@R.add("""SELECT n_name, r_name, coalesce(c, 0) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey""")
def dimension_lookup(t: Tables):
    c = t.customer.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_name", "r_name", F.coalesce("c", F.lit(0)).alias("customers"))


@R.add("""SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'orphan result' WHEN b.event_id IS NULL THEN 'unanswered' ELSE 'paired' END AS state FROM (SELECT event_id FROM events WHERE event_id % 3 <> 0) a FULL JOIN (SELECT event_id FROM events WHERE event_id % 5 <> 0) b USING (event_id)""")
def call_result_pairs(t: Tables):
    a = t.events.where("event_id % 3 <> 0").select("event_id", F.lit(True).alias("a"))
    b = t.events.where("event_id % 5 <> 0").select("event_id", F.lit(True).alias("b"))
    return a.join(b, "event_id", "full").select("event_id", F.when(F.col("a").isNull(), "orphan result").when(F.col("b").isNull(), "unanswered").otherwise("paired").alias("state"))


@R.add("""SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, list_slice(list_sort(list(doc_id)), 1, 3) AS samples FROM documents GROUP BY 1""")
def folder_profile(t: Tables):
    first = ranking.top_per_group(t.documents.select("lang", "doc_id"), ["lang"], [F.col("doc_id")], 3)  # three rows of a group leave a task
    samples = first.groupBy("lang").agg(F.array_sort(F.collect_list("doc_id")).alias("samples")).withColumnRenamed("lang", "_l")
    totals = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return totals.join(samples, F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")


@R.add("""SELECT count(*) AS n, count(*) FILTER (quality = 1) AS ok, count(*) FILTER (toxic = 1) AS flagged, count(*) FILTER (quality = 0 AND toxic = 1) AS escalated FROM labels""")
def verdict_rollup(t: Tables):
    q, x = F.col("quality"), F.col("toxic")
    return t.labels.agg(F.count("*").alias("n"), F.count_if(q == 1).alias("ok"), F.count_if(x == 1).alias("flagged"), F.count_if((q == 0) & (x == 1)).alias("escalated"))


@R.add("""SELECT 'c' AS side, c_custkey AS k, c_acctbal AS v FROM customer ORDER BY v DESC, k LIMIT 10""")
def largest_rows(t: Tables):
    return t.customer.select(F.lit("c").alias("side"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")).orderBy(F.desc("v"), "k").limit(10)


@R.add("""SELECT "column", kind FROM (VALUES ('c_custkey', 'integer'), ('c_name', 'text'), ('c_acctbal', 'number'), ('c_mktsegment', 'text')) t("column", kind)""")
def customer_types(t: Tables):
    return profiling.infer_types(t.customer, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
