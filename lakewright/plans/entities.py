"""Queries of works, links, mentions, candidates and corpora over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching, values
from ..operators import entities, identity, sequences
from .registry import Registry, Tables

R = Registry()


@R.add(r"""SELECT doc_id, coalesce(
      CASE WHEN regexp_full_match(regexp_replace(lower(trim(d)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', ''), '10\.[0-9]{4,9}/\S+') THEN 'doi:' || regexp_replace(lower(trim(d)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '') END,
      CASE WHEN trim(p) <> '' THEN 'pmid:' || p END,
      CASE WHEN k <> '' THEN 'title:' || k || '|' || coalesce(y::VARCHAR, '') || '|' || coalesce(lang, '') END) AS work_key
    FROM (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN 'doi:10.' || (1000 + doc_id % 50) || '/X' WHEN 1 THEN 'not one' END AS d, CASE WHEN doc_id % 4 = 2 THEN doc_id::VARCHAR END AS p, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS k, CASE WHEN doc_id % 3 > 0 THEN 2000 + doc_id % 20 END AS y FROM documents)""")
def work_keys(t: Tables):
    i = F.col("doc_id")
    doi = F.when(i % 4 == 0, F.concat(F.lit("doi:10."), (1000 + i % 50).cast("string"), F.lit("/X"))).when(i % 4 == 1, "not one")
    pmid = F.when(i % 4 == 2, i.cast("string"))
    year = F.when(i % 3 > 0, 2000 + i % 20)
    return t.documents.select("doc_id", entities.work_key(doi, pmid, F.lit(None).cast("string"), F.col("source"), year, F.col("lang")).alias("work_key"))


_RECORDS = "r AS (SELECT event_id % 500 AS k, event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, CASE WHEN event_id % 5 > 1 THEN user_id END AS who, [event_type, CAST(user_id % 4 AS VARCHAR)] AS tags FROM events)"


def _records(t: Tables):
    i = F.col("event_id")
    return t.events.select((i % 500).alias("k"), "event_id", F.when(i % 3 > 0, F.col("event_type")).alias("kind"), F.when(i % 5 > 1, F.col("user_id")).alias("who"), F.array("event_type", (F.col("user_id") % 4).cast("string")).alias("tags"))


@R.add(f"""WITH {_RECORDS}, e AS (SELECT k, v, min((event_id, p)) AS seen FROM (SELECT k, event_id, unnest(tags) AS v, generate_subscripts(tags, 1) AS p FROM r) GROUP BY 1, 2)
    SELECT k, records, kind, who, tags FROM (SELECT k, count(*) AS records, arg_min(kind, event_id) FILTER (kind IS NOT NULL) AS kind, arg_min(who, event_id) FILTER (who IS NOT NULL) AS who FROM r GROUP BY 1) JOIN (SELECT k, list(v ORDER BY seen) AS tags FROM e GROUP BY 1) USING (k)""")
def merged_works(t: Tables):
    return entities.merged_records(_records(t), "k", ["event_id"], ["kind", "who"], ["tags"])


@R.add(f"""WITH {_RECORDS}, f AS (SELECT k, event_id, 'kind' AS field, kind AS value FROM r UNION ALL SELECT k, event_id, 'who', CAST(who AS VARCHAR) FROM r)
    SELECT k, field, value, row_number() OVER (PARTITION BY k, field ORDER BY event_id) = 1 AS chosen FROM f WHERE value IS NOT NULL""")
def field_origins(t: Tables):
    return entities.field_origins(_records(t), "k", ["event_id"], ["kind", "who"])


@R.add("""WITH w AS (SELECT p_partkey AS i, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' || p_brand AS k, p_size % 8 AS y, p_partkey % 2 = 0 AS p FROM part)
    SELECT a.i AS preprint_id, b.i AS article_id FROM w a JOIN w b ON a.k = b.k AND a.p AND NOT b.p AND abs(a.y - b.y) <= 1""")
def related_works(t: Tables):
    return entities.related_works(t.part, "p_partkey", F.concat_ws(" ", "p_name", F.lower("p_brand")), F.col("p_size") % 8, F.col("p_partkey") % 2 == 0)


@R.add(r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, sha256(html) AS h, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS w FROM pages),
    x AS (SELECT page_id, min(page_id) OVER (PARTITION BY u) AS mu, min(page_id) OVER (PARTITION BY h) AS mh, min(page_id) OVER (PARTITION BY w) AS mw FROM p)
    SELECT page_id AS id, CASE WHEN mu < page_id THEN mu WHEN mh < page_id THEN mh ELSE mw END AS duplicate_of, CASE WHEN mu < page_id THEN 'url' WHEN mh < page_id THEN 'checksum' ELSE 'title' END AS matched_by FROM x WHERE mu < page_id OR mh < page_id OR mw < page_id""")
def first_match_duplicates(t: Tables):
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return entities.first_match(t.pages, "page_id", {"url": F.regexp_replace("url", "[?#].*$", ""), "checksum": F.sha2("html", 256), "title": title})


_MENTIONS = "m AS (SELECT doc_id AS source, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}'))) AS target FROM documents)"


def _mentions(t: Tables):
    return t.documents.select(F.col("doc_id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))).alias("target"))


@R.add(f"""WITH {_MENTIONS}, k AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS k FROM part)
    SELECT lower(target) AS key, arg_min(target, (source, target)) AS display, count(DISTINCT source) AS sources FROM m WHERE lower(target) NOT IN (SELECT k FROM k) GROUP BY 1 HAVING count(DISTINCT source) >= 3""")
def mention_candidates(t: Tables):
    return entities.mentions(_mentions(t), t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")), 3)


@R.add("""WITH a AS (SELECT 'Nation ' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS role FROM nation WHERE n_nationkey % 3 > 0), b AS (SELECT 'NATION ' || n_nationkey AS name, 'region ' || n_regionkey AS role FROM nation WHERE n_nationkey % 5 > 0)
    SELECT coalesce(a.name, b.name) AS name, coalesce(a.role, b.role) AS role FROM a FULL JOIN b ON lower(a.name) = lower(b.name)""")
def merged_roster(t: Tables):
    k = F.col("n_nationkey").cast("string")
    a = t.nation.where("n_nationkey % 3 > 0").select(F.concat(F.lit("Nation "), k).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("role"))
    b = t.nation.where("n_nationkey % 5 > 0").select(F.concat(F.lit("NATION "), k).alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("role"))
    return entities.roster(a, b, "name", ["role"])


@R.add("""WITH l AS (SELECT o_orderkey AS source, 'N' || o_custkey % 60 AS target FROM orders), a AS (SELECT lower('N' || n_nationkey) AS k, count(DISTINCT n_nationkey) AS n, min(n_nationkey) AS e FROM nation GROUP BY 1), b AS (SELECT lower('n' || s_suppkey % 40) AS k, count(DISTINCT s_suppkey::INT) AS n, min(s_suppkey)::INT AS e FROM supplier GROUP BY 1)
    SELECT source, target, CASE WHEN coalesce(a.n, b.n) IS NULL THEN 'unresolved' WHEN coalesce(a.n, b.n) > 1 THEN 'ambiguous' ELSE 'resolved' END AS state, CASE WHEN coalesce(a.n, b.n) = 1 THEN coalesce(a.e, b.e) END AS entry FROM l LEFT JOIN a ON lower(target) = a.k LEFT JOIN b ON lower(target) = b.k""")
def resolved_links(t: Tables):
    links = t.orders.select(F.col("o_orderkey").alias("source"), F.concat(F.lit("N"), (F.col("o_custkey") % 60).cast("string")).alias("target"))
    paths = t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").alias("entry"))
    aliases = t.supplier.select(F.concat(F.lit("n"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.col("s_suppkey").cast("int").alias("entry"))
    return entities.resolve_in_tiers(links, [paths, aliases])


@R.add("""WITH m AS (SELECT user_id AS entry, CASE event_type WHEN 'signup' THEN 'hub' WHEN 'purchase' THEN 'folder' WHEN 'error' THEN 'embed' ELSE 'transcript' END AS role FROM events), x AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    SELECT entry, CASE min(CASE role WHEN 'hub' THEN 1 WHEN 'folder' THEN 2 WHEN 'embed' THEN 3 ELSE 4 END) WHEN 1 THEN 'hub' WHEN 2 THEN 'folder' WHEN 3 THEN 'embed' ELSE 'transcript' END AS role, count(DISTINCT role) AS roles FROM m WHERE entry NOT IN (SELECT c_custkey FROM x) GROUP BY 1""")
def corpus_members(t: Tables):
    role = F.when(F.col("event_type") == "signup", "hub").when(F.col("event_type") == "purchase", "folder").when(F.col("event_type") == "error", "embed").otherwise("transcript")
    return entities.corpus(t.events.select(F.col("user_id").alias("entry"), role.alias("role")), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("entry")))


_TAKEN = "t AS (SELECT DISTINCT p_brand AS parent, p_size AS number FROM part WHERE p_partkey % 3 = 0)"


def _taken(t: Tables):
    return t.part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("parent"), F.col("p_size").alias("number"))


@R.add(f"WITH {_TAKEN} SELECT parent, n::INT AS number FROM (SELECT DISTINCT parent FROM t), range(1, 100) r(n) WHERE (parent, n) NOT IN (SELECT (parent, number) FROM t)")
def free_numbers(t: Tables):
    return entities.free_numbers(_taken(t), "parent", "number")


@R.add(f"""WITH {_TAKEN}, x AS (SELECT parent, number, row_number() OVER (PARTITION BY parent ORDER BY number) AS p FROM t WHERE number >= 5)
    SELECT parent, number, number + 1 AS moved_to FROM x WHERE number = 5 + p - 1""")
def renumbered_run(t: Tables):
    return entities.renumbered(_taken(t), "parent", "number", 5)


_CANDIDATE = """k AS (SELECT p_partkey, p_size, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part), w AS (SELECT *, list_filter(string_split(k, ' '), lambda x: x <> '') AS w FROM k)"""


@R.add(f"""WITH {_CANDIDATE} SELECT p_partkey, round((CASE WHEN k = 'part 12' THEN 100.0 ELSE CASE WHEN contains(' ' || k || ' ', ' part 12 ') THEN 45.0 ELSE 0 END + 15.0 * len(list_intersect(['part', '12'], w)) / 2.0 + CASE WHEN starts_with(k, 'part 12') THEN 25.0 ELSE 0 END + greatest(-20.0, -8.0 * greatest(0, len(w) - 2)) END
      + CASE WHEN p_size = 10 THEN 20.0 WHEN abs(p_size - 10) = 1 THEN 8.0 ELSE -10.0 END)::DOUBLE, 6) AS score FROM w""")
def candidate_scores(t: Tables):
    return t.part.select("p_partkey", F.round(entities.candidate_score(F.col("p_name"), "Part #12", years_off=F.col("p_size") - 10), 6).alias("score"))


@R.add(r"""WITH p AS (SELECT page_id, 200 + 101 * (page_id % 3) AS status, lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS t FROM pages),
    f AS (SELECT page_id, status NOT BETWEEN 200 AND 299 AS a, length(trim(t)) < 120 AS b, regexp_matches(t, 'captcha|verify you are human|unusual traffic') AS c, regexp_matches(t, 'sign in to continue|log in to continue|please log in') AS d, regexp_matches(t, 'enable javascript|javascript is required') AS e FROM p)
    SELECT page_id, round(greatest(0, 1.0 - (a::INT * 0.5 + b::INT * 0.3 + c::INT * 0.5 + d::INT * 0.3 + e::INT * 0.3)), 2)::DOUBLE AS quality, list_filter([CASE WHEN a THEN 'status' END, CASE WHEN b THEN 'short_text' END, CASE WHEN c THEN 'bot_wall' END, CASE WHEN d THEN 'login_wall' END, CASE WHEN e THEN 'script_wall' END], lambda x: x IS NOT NULL) AS faults FROM f""")
def acquisition_quality(t: Tables):
    q = entities.acquisition_quality(200 + 101 * (F.col("page_id") % 3), F.regexp_replace("html", "<[^>]*>", " "))
    return t.pages.select("page_id", *[c.alias(n) for n, c in q.items()])


@R.add(r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE contains(text, 'http')),
    u AS (SELECT id, n, line, regexp_replace(regexp_extract(line, 'https?://[^\s<>"'')\]]+'), '[.,;:]+$', '') AS url, length(regexp_replace(regexp_replace(line, 'https?://[^\s<>"'')\]]+', '', 'g'), '[^A-Za-z0-9]', '', 'g')) AS rest FROM l)
    SELECT url, arg_min(id, (id, n)) AS id, arg_min(n, (id, n))::INT AS line_no, arg_min(substr(trim(line), 1, 300), (id, n)) AS excerpt FROM u WHERE url <> '' AND rest >= 20 GROUP BY 1""")
def cited_lines(t: Tables):
    return entities.cited_lines(t.documents, "doc_id", "text")


@R.add("""WITH e AS (SELECT l_orderkey AS c, l_linenumber AS pos, l_orderkey * 10 + l_linenumber AS e, min(l_partkey) AS s FROM lineitem GROUP BY 1, 2, 3), f AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), x AS (SELECT o_orderkey AS c FROM orders WHERE o_orderkey NOT IN (SELECT id FROM f)),
    h AS (SELECT e.c, pos, CASE WHEN p_size > 20 THEN p_name ELSE '' END AS url FROM e JOIN x USING (c) LEFT JOIN part ON p_partkey = s WHERE e.e NOT IN (SELECT id FROM f))
    SELECT c AS claim_id, count(*) AS supports, arg_min(url, pos) FILTER (url <> '') AS url FROM h GROUP BY 1""")
def claim_units(t: Tables):
    e = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id")
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    lists = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", e))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    claims = t.orders.select(F.col("o_orderkey").alias("claim_id")).join(lists.withColumnRenamed("l_orderkey", "claim_id"), "claim_id")
    evidence = lines.select(e, F.col("l_partkey").alias("source_id"))
    sources = t.part.select(F.col("p_partkey").alias("source_id"), F.when(F.col("p_size") > 20, F.col("p_name")).otherwise("").alias("url"))
    return entities.claim_units(claims, evidence, sources, t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))


@R.add("""WITH p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.text AS s, b.text AS l FROM documents a JOIN documents b ON a.source = b.source AND a.n_chars = b.n_chars AND a.doc_id < b.doc_id),
    x AS (SELECT a, b, list_filter(list_transform(string_split(s, chr(10)), lambda v: trim(v, ' ')), lambda v: v <> '') AS x, list_filter(list_transform(string_split(l, chr(10)), lambda v: trim(v, ' ')), lambda v: v <> '') AS y FROM p)
    SELECT a, b, CASE WHEN len(x) > 0 THEN list_sum(list_transform(list_distinct(x), lambda v: least(len(list_filter(x, lambda w: w = v)), len(list_filter(y, lambda w: w = v))))) / len(x) ELSE 0 END::DOUBLE AS share FROM x""")
def line_containment(t: Tables):
    own = t.documents.select("source", "n_chars", "doc_id", "text")
    a, b = (own.select("source", "n_chars", F.col("doc_id").alias(n), F.col("text").alias(f"t{n}")) for n in "ab")
    return a.join(b, ["source", "n_chars"]).where("a < b").select("a", "b", identity.line_containment(F.col("ta"), F.col("tb")).alias("share"))


@R.add("""SELECT doc_id, 2 * m + CASE WHEN y > 1 THEN 1 ELSE 0 END AS code FROM (SELECT doc_id, doc_id % 12 + 1 AS m, doc_id % 3 AS y FROM documents)""")
def stated_dates(t: Tables):
    i = F.col("doc_id")
    text = F.concat(F.lit("on "), (i % 12 + 1).cast("string"), F.when(i % 3 > 1, "/25/2021").otherwise("/2021"), F.lit(" and 2020-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("-03"))
    dates = matching.dates_in_text(text)
    return t.documents.select("doc_id", (F.month(F.get(dates, F.lit(0))) * 2 + F.size(dates) - 1).cast("long").alias("code"))


@R.add("""SELECT conv_id, turn, role, CASE WHEN lag(o) OVER w IS NULL OR lag(o) OVER w <= o THEN true ELSE false END AS in_order FROM (SELECT conv_id, turn, role, turn * 65 % 200 AS o FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def clock_order(t: Tables):
    clock = F.format_string("%d:%02d", F.floor(F.col("turn") * 65 % 200 / 60), F.pmod(F.col("turn") * 65 % 200, F.lit(60)))
    rows = t.conversations.select("conv_id", "turn", "role", values.clock_seconds(clock).alias("at"))
    return sequences.marked_order(rows, "conv_id", "turn", "at")


@R.add("""SELECT conv_id, count(*) AS messages, arg_min(text, turn) FILTER (role = 'user') AS first_text, max(turn) FILTER (role IN ('user', 'assistant')) AS modified FROM conversations GROUP BY 1""")
def session_infos(t: Tables):
    user = F.when(F.col("role") == "user", F.col("turn"))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min_by("text", user).alias("first_text"), F.max(F.when(F.col("role").isin("user", "assistant"), F.col("turn"))).alias("modified"))


@R.add("""WITH c AS (SELECT conv_id, turn, role, ceil(length(text) / 4.0) AS n FROM conversations), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM c),
    m AS (SELECT conv_id, max(turn) FILTER (used >= 60) AS reached, min(turn) FILTER (role = 'user') AS first_valid FROM r GROUP BY 1)
    SELECT m.conv_id, coalesce(min(turn) FILTER (role = 'user' AND turn >= reached), any_value(first_valid)) AS cut FROM m JOIN c USING (conv_id) GROUP BY 1""")
def context_cuts(t: Tables):
    rows = t.conversations.select("conv_id", "turn", "role", F.ceil(F.length("text") / 4.0).alias("n"))
    return sequences.cut_points(rows, "conv_id", "turn", F.col("n"), F.col("role") == "user", 60)


@R.add("""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND length(text) >= 20)
    SELECT b.conv_id, b.turn, min(a.turn) AS earlier FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.turn < b.turn AND contains(b.text, a.text) GROUP BY 1, 2""")
def repeated_user_texts(t: Tables):
    return sequences.repeated_texts(t.conversations.where("role = 'user'"), "conv_id", "turn", "text", 20)


@R.add("""SELECT event_id, day, seconds, (floor(seconds / 3600))::INT || ':' || lpad((floor(seconds / 60) % 60)::INT::VARCHAR, 2, '0') || ':' || lpad((seconds % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT event_id, CAST(ts AS DATE) AS day, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS seconds FROM events)""")
def wall_clocks(t: Tables):
    s = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long")
    return t.events.select("event_id", F.to_date("ts").alias("day"), s.alias("seconds")).withColumn("clock", values.format_clock(F.col("seconds")))


@R.add("""WITH RECURSIVE c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
    s AS (SELECT user_id, p, 4.0::DOUBLE * 0.7::DOUBLE + 0.3::DOUBLE * greatest(2.5, least(5.0, value / 10))::DOUBLE AS estimate FROM c WHERE p = 1 UNION ALL SELECT s.user_id, c.p, 0.7::DOUBLE * estimate + 0.3::DOUBLE * greatest(2.5, least(5.0, value / 10))::DOUBLE FROM s JOIN c ON c.user_id = s.user_id AND c.p = s.p + 1)
    SELECT user_id, count(*) AS n, round(arg_max(estimate, p), 6) AS estimate FROM s GROUP BY 1""")
def smoothed_estimates(t: Tables):
    out = sequences.smoothed(t.events, "user_id", ["event_id"], F.col("value") / 10, prior=4.0, low=2.5, high=5.0)
    return out.select("user_id", "n", F.round("estimate", 6).alias("estimate"))
