"""Queries over the driver's tables: sources, profiles, joins, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import identity, profiling, relating
from .registry import Registry, Tables

R = Registry()
LINEITEM = ["l_quantity", "l_discount", "l_returnflag", "l_shipdate"]


def _long(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {table}" for c in columns)


@R.add(
    """SELECT n_name, count(*) AS orders, sum(o_totalprice) AS total, max(o_orderdate) AS latest
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus <> 'P' GROUP BY n_name"""
)
def flagship_orders_by_nation(t: Tables):
    o = t.orders.where("o_orderstatus <> 'P'").select("o_custkey", "o_totalprice", "o_orderdate")
    c = t.customer.select("c_custkey", "c_nationkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("latest"))


@R.add(f"""SELECT "column", count(*) AS n, sum(CASE WHEN value IS NULL OR trim(value) = '' THEN 1 ELSE 0 END)::BIGINT AS missing,
    count(DISTINCT CASE WHEN trim(value) <> '' THEN value END) AS distinct_values FROM ({_long("customer", ["c_name", "c_nationkey", "c_mktsegment"])}) GROUP BY 1""")
def table_profile(t: Tables):
    return profiling.profile(t.customer, ["c_name", "c_nationkey", "c_mktsegment"])


@R.add("""SELECT 'event_type' AS "column", 'text' AS kind UNION ALL SELECT 'user_id', 'integer' UNION ALL SELECT 'event_id', 'integer' UNION ALL SELECT 'value', 'number'""")
def type_inference(t: Tables):
    return profiling.infer_types(t.events, ["event_type", "user_id", "event_id", "value"])


@R.add(f"""SELECT "column", value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM (
    SELECT "column", value, count(*) AS n FROM ({_long("part", ["p_brand", "p_type", "p_size"])}) WHERE trim(value) <> '' GROUP BY 1, 2)) WHERE rank <= 5""")
def top_values(t: Tables):
    return profiling.top_values(t.part, ["p_brand", "p_type", "p_size"], 5)


@R.add("""SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, avg(l_extendedprice) AS mean,
    quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1""")
def numeric_distribution(t: Tables):
    return profiling.distribution(t.lineitem, ["l_returnflag"], "l_extendedprice")


@R.add("""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b, count(*) AS n FROM orders GROUP BY 1),
    x AS (SELECT o.o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o.o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rank
      FROM orders o JOIN q USING (o_orderpriority) WHERE n >= 4 AND (o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a)))
    SELECT * FROM x WHERE rank <= 10""")
def iqr_outliers(t: Tables):
    return profiling.outliers(t.orders, ["o_orderpriority"], "o_totalprice", ["o_orderkey"], fence=0.5)


@R.add("""WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), w AS (SELECT sum(n)::BIGINT AS total, count(*) AS kinds FROM c)
    SELECT p_type, n, total FROM c, w WHERE total >= 10 AND kinds * 2 <= total AND n <= 0.05 * total""")
def rare_values(t: Tables):
    return profiling.rare_values(t.part, "p_type")


@R.add("SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM documents WHERE trim(text) <> '' OR trim(lang) <> '' GROUP BY text, lang)")
def duplicate_rows(t: Tables):
    return profiling.duplicate_rows(t.documents, ["text", "lang"])


@R.add("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS groups, sum(value) AS total FROM events
    GROUP BY ROLLUP (CAST(ts AS DATE), event_type)""")
def usage_rollup(t: Tables):
    rows = t.events.select(F.to_date("ts").alias("day"), "event_type", "user_id", "value")
    return profiling.rollup_counts(rows, ["day", "event_type"], {"total": "value"}, "user_id")


@R.add("""SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS done, count(*) FILTER (c_acctbal > 0) / count(*) AS share, count(*) FILTER (c_acctbal > 0) = count(*) AS complete FROM customer GROUP BY 1""")
def coverage_summary(t: Tables):
    return profiling.coverage(t.customer, "c_mktsegment", F.when(F.col("c_acctbal") > 0, "done").otherwise("open"), "done")


@R.add("""SELECT s.x AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) s(x) LEFT JOIN orders ON o_orderstatus = s.x GROUP BY 1""")
def status_report(t: Tables):
    return profiling.status_report(t.orders, "o_orderstatus", ["O", "F", "P", "X"])


@R.add("""WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT count(*) AS shared, avg(a.v) AS mean_before, avg(b.v) AS mean_after, count(*) FILTER (b.v > a.v) AS improved, count(*) FILTER (b.v < a.v) AS regressed FROM a JOIN b USING (user_id)""")
def paired_deltas(t: Tables):
    mean = lambda kind: t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias("v"))
    return profiling.paired_deltas(mean("view"), mean("click"), ["user_id"], "v")


@R.add("""SELECT bucket, count(*) AS n, avg(l_discount) AS rate FROM (SELECT l_discount, CASE WHEN l_quantity < 4 THEN 'under 4' WHEN l_quantity < 10 THEN '4 to 10' WHEN l_quantity < 25 THEN '10 to 25' ELSE '25 and more' END AS bucket FROM lineitem) GROUP BY 1""")
def threshold_buckets(t: Tables):
    b = V.bucket_label(F.col("l_quantity"), [4, 10, 25], ["under 4", "4 to 10", "10 to 25", "25 and more"])
    return t.lineitem.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("rate"))


@R.add("""SELECT c_nationkey, coalesce(max(n) FILTER (c_mktsegment = 'BUILDING'), 0) AS building, coalesce(max(n) FILTER (c_mktsegment = 'MACHINERY'), 0) AS machinery
    FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""")
def pivot_matrix(t: Tables):
    p = t.customer.groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return p.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@R.add("""SELECT day, n FROM (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1) WHERE n > 12""")
def busy_days(t: Tables):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("n")).where("n > 12")


@R.add("""WITH x AS (SELECT lang, count(*) FILTER (quality = 0 AND toxic = 0) AS improved, count(*) FILTER (toxic = 1 AND quality = 1) AS regressed FROM labels JOIN documents USING (doc_id) GROUP BY lang),
    s AS (SELECT lang, improved, regressed, (SELECT sum(exp(lgamma(improved + regressed + 1.0) - lgamma(i + 1.0) - lgamma(improved + regressed - i + 1.0) - (improved + regressed) * ln(2.0))) FROM range(0, least(improved, regressed) + 1) r(i)) AS tail FROM x)
    SELECT lang, improved, regressed, round(least(1.0, 2 * tail), 6) AS p, improved + regressed < 6 AS underpowered FROM s""")
def mcnemar_by_language(t: Tables):
    x = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("improved"), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 1)).alias("regressed"))
    return x.select("lang", "improved", "regressed", F.round(V.mcnemar(F.col("improved"), F.col("regressed")), 6).alias("p"), (F.col("improved") + F.col("regressed") < 6).alias("underpowered"))


@R.add("""SELECT lang, CASE WHEN quality IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'gated' WHEN quality = 0 THEN 'silent' ELSE 'clean' END AS severity, count(*) AS n
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def severity_by_language(t: Tables):
    s = F.when(F.col("quality").isNull(), "unknown").when(F.col("toxic") == 1, "gated").when(F.col("quality") == 0, "silent").otherwise("clean")
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").groupBy("lang", s.alias("severity")).agg(F.count("*").alias("n"))


@R.add("""SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 15.0 WHEN 'click' THEN 0.3 END * value / 1000000), 9) AS cost FROM events WHERE event_type IN ('purchase', 'signup', 'click') GROUP BY 1""")
def usage_cost(t: Tables):
    prices = t.spark.createDataFrame([("purchase", 3.0), ("signup", 15.0), ("click", 0.3)], "event_type string, price double")
    return t.events.join(F.broadcast(prices), "event_type").groupBy("user_id").agg(F.round(F.sum(F.col("price") * F.col("value") / 1000000), 9).alias("cost"))  # three price rows


@R.add("""SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus <> 'F') AS median, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1""")
def filtered_medians(t: Tables):
    own = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    return t.orders.groupBy("o_orderpriority").agg(V.quantile(own, 0.5).alias("median"), V.quantile(F.col("o_totalprice"), 0.95).alias("p95"))


@R.add("""SELECT coalesce(a.l_orderkey, o.o_orderkey) AS order_key, CASE WHEN a.l_orderkey IS NULL THEN 'added' WHEN o.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) a FULL JOIN (SELECT o_orderkey, CAST(extract(month FROM o_orderdate) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'O') o ON a.l_orderkey = o.o_orderkey
    WHERE a.l_orderkey IS NULL OR o.o_orderkey IS NULL OR a.n <> o.n""")
def manifest_diff(t: Tables):
    old = t.lineitem.where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count("*").alias("n"))
    new = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_key"), F.month("o_orderdate").cast("long").alias("n"))
    return relating.manifest_diff(old, new, "order_key", "n")


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def pending_customers(t: Tables):
    return relating.pending(t.customer.select("c_custkey", "c_name"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@R.add("SELECT DISTINCT user_id AS key, r AS reference FROM (SELECT user_id, unnest([user_id, user_id + 120]) AS r FROM events) WHERE r NOT IN (SELECT c_custkey FROM customer)")
def unknown_references(t: Tables):
    rows = t.events.select(F.col("user_id").alias("key"), F.array(F.col("user_id"), F.col("user_id") + 120).alias("refs"))
    return relating.unknown_references(rows, "key", "refs", t.customer, "c_custkey")


@R.add("""SELECT k, doc_id, page_id FROM (SELECT n_chars AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) = 1) JOIN (SELECT strlen(html)::BIGINT AS k, min(page_id) AS page_id FROM pages GROUP BY 1 HAVING count(*) = 1) USING (k)""")
def unique_key_matches(t: Tables):
    return relating.unique_on_both(t.documents.select(F.col("n_chars").alias("k"), "doc_id"), t.pages.select(F.octet_length("html").cast("long").alias("k"), "page_id"), "k", "doc_id", "page_id")


@R.add("""SELECT e.event_id, e.user_id, (SELECT arg_max(f.value, f.ts) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'view' AND f.ts <= e.ts) AS value
    FROM events e WHERE e.event_type = 'purchase'""")
def asof_last_view(t: Tables):
    e = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    f = t.events.where("event_type = 'view'").select("user_id", "ts", "value")
    return relating.nearest_before(e, f, "user_id", "ts", "value", "event_id")


@R.add("""SELECT e.event_id, (SELECT min(abs(epoch(e.ts) - epoch(f.ts))) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'click') AS distance FROM events e WHERE e.event_type = 'error'""")
def nearest_click(t: Tables):
    # microseconds as the session keeps them; NTZ has no epoch of its own, so UTC
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return relating.nearest_value(t.events.where("event_type = 'error'"), t.events.where("event_type = 'click'"), "user_id", at, at, "event_id")


@R.add("""SELECT a.o_orderkey AS range_id, b.event_id AS mark_id FROM orders a JOIN events b ON a.o_custkey = b.user_id AND b.event_id % 97 < a.o_orderkey % 89 + 5 AND a.o_orderkey % 89 < b.event_id % 97 + 3""")
def range_overlaps(t: Tables):
    r = t.orders.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("range_id"), (F.col("o_orderkey") % 89).alias("start"), (F.col("o_orderkey") % 89 + 5).alias("stop"))
    m = t.events.select(F.col("user_id").alias("g"), F.col("event_id").alias("mark_id"), (F.col("event_id") % 97).alias("start"), (F.col("event_id") % 97 + 3).alias("stop"))
    return relating.overlapping(r, m, "g", 16)


@R.add("""WITH a AS (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part WHERE p_size <= 25), b AS (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part WHERE p_size > 25)
    SELECT w AS word, count(*) AS extra FROM (SELECT w FROM b EXCEPT ALL SELECT w FROM a) GROUP BY 1""")
def multiset_difference(t: Tables):
    words = lambda d: d.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return relating.multiset_extra(words(t.part.where("p_size <= 25")), words(t.part.where("p_size > 25"))).groupBy("word").agg(F.count("*").alias("extra"))


@R.add("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def union_of_records(t: Tables):
    return relating.union_by_name(
        t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    )


@R.add("""SELECT doc_id AS id, winner, n FROM documents JOIN (SELECT text, min(doc_id) AS winner, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) USING (text)""")
def exact_duplicates(t: Tables):
    return identity.exact_groups(t.documents, "doc_id", F.sha2("text", 256))


@R.add("""SELECT doc_id AS id, winner, n FROM documents JOIN (SELECT text, min(doc_id) AS winner, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) USING (text)""")
def two_stage_duplicates(t: Tables):
    return identity.two_stage_groups(t.documents, "doc_id", F.length("text"), F.col("text"))


@R.add(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g')) AS h FROM documents""")
def body_hashes(t: Tables):
    return t.documents.select("doc_id", identity.body_hash(F.col("text")).alias("h"))


_BLOCKS = """k AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest([substr(text, 1, 40), source || n_chars]) AS k FROM documents) WHERE k <> '')"""


@R.add(f"""WITH {_BLOCKS}, s AS (SELECT k FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.k = b.k AND a.doc_id < b.doc_id WHERE a.k IN (SELECT k FROM s)""")
def blocked_pairs(t: Tables):
    return identity.blocked_pairs(t.documents, "doc_id", [F.substring("text", 1, 40), F.concat("source", F.col("n_chars").cast("string"))])


@R.add(f"WITH {_BLOCKS} SELECT k, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 3")
def common_block_keys(t: Tables):
    return identity.common_keys(t.documents, [F.substring("text", 1, 40), F.concat("source", F.col("n_chars").cast("string"))], 3)


@R.add()
def order_components(t: Tables):
    # every order is a link; linked ids wrap at the table's largest. The recursive SQL would make all pairs of a component
    ids = t.customer.agg((F.max("c_custkey") + 1).alias("ids"))  # one row
    e = t.orders.crossJoin(ids).select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % F.col("ids")).alias("b")).distinct()
    known = t.customer.select(F.col("c_custkey").alias("b"))
    return identity.contraction_components(e.join(known, "b", "left_semi"), t.customer, "c_custkey")


@R.add("SELECT user_id, arg_min(value, (CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id)) AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def preferred_values(t: Tables):
    p = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return identity.preferred(t.events, "user_id", F.struct(p.alias("p"), "event_id"), "value")


@R.add("SELECT o_custkey, list_sort(list_distinct(flatten(list([o_orderpriority, o_orderstatus])))) AS \"values\" FROM orders GROUP BY 1")
def merged_lists(t: Tables):
    return identity.merged_lists(t.orders.select("o_custkey", F.array("o_orderpriority", "o_orderstatus").alias("x")), "o_custkey", "x")


@R.add("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM c)
    SELECT p_brand, sum(n)::BIGINT AS weight, max(p_type) FILTER (rank = 1) AS layer FROM r GROUP BY 1""")
def weighted_groups(t: Tables):
    c = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    best = F.min_by("p_type", F.struct(-F.col("n"), "p_type"))
    return c.groupBy("p_brand").agg(F.sum("n").alias("weight"), best.alias("layer"))
