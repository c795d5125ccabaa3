"""Queries over texts, pages, vectors and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import checking, graphs, ranking, relating, sequences
from .registry import Registry, Tables

R = Registry()
QUERY = "the and of tion the"
_TOK = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_-]+')"
_LEX = f"""q AS (SELECT term, count(*) AS times FROM (SELECT unnest({_TOK.format(c=f"'{QUERY}'")}) AS term) GROUP BY 1),
  w AS (SELECT doc_id AS id, {_TOK.format(c="text")} AS w FROM documents), n AS (SELECT count(*) AS n FROM w),
  h AS (SELECT id, len(w) AS length, q.term, times, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM w) x JOIN q USING (term) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
  lex AS (SELECT id, sum((1 + ln((n + 1) / (df + 1))) * (tf / (tf + 1.2 * (0.25 + 0.75 * length / 200.0))) * times) AS score FROM h JOIN f USING (term), n GROUP BY 1)"""


@R.add(f"WITH {_LEX} SELECT id, round(score, 6) AS score FROM lex")
def lexical_search(t: Tables):
    s = ranking.lexical_scores(t.documents, "doc_id", "text", QUERY)
    return s.select("id", F.round("score", 6).alias("score"))


@R.add("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q""")
def semantic_search(t: Tables):
    q = t.embeddings.where("vec_id = 7").select(F.col("embedding").alias("e"))  # the one query vector
    return t.embeddings.crossJoin(q).select(F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


@R.add(f"""WITH {_LEX}, l AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM lex QUALIFY rank <= 100),
  m AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100),
  b AS (SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'tion the'))
  SELECT id, round(sum(part), 8) AS score FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS part FROM l UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM m UNION ALL SELECT id, 0.25 FROM b) GROUP BY 1""")
def fused_search(t: Tables):
    s = ranking.lexical_scores(t.documents, "doc_id", "text", QUERY).select("id", F.round("score", 6).alias("score"))
    long_ = t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    boost = t.documents.where(F.contains(F.lower("text"), F.lit("tion the"))).select(F.col("doc_id").alias("id"), F.lit(ranking.TITLE_BOOST).alias("boost"))
    return ranking.fuse_ranks(ranking.ranked(s, 100), ranking.ranked(long_, 100), boost=boost)


@R.add("""SELECT query, id, similarity, rank FROM (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
    FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def nearest_neighbours(t: Tables):
    q = t.embeddings.where("vec_id % 50 = 0")  # the stated query set, against all rows
    n = ranking.nearest(q, t.embeddings, "vec_id", "embedding", 5)
    return n.withColumn("similarity", F.round("similarity", 6))


@R.add("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.1""")
def label_similar_pairs(t: Tables):
    p = relating.all_similar_pairs(t.embeddings, "vec_id", "embedding", "label", 0.1)
    return p.withColumn("similarity", F.round("similarity", 6))


@R.add("""SELECT CAST(floor(s * 20) AS BIGINT) AS bucket, count(*) AS n FROM (SELECT list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) GROUP BY 1""")
def label_similarity_histogram(t: Tables):
    return relating.all_similarity_counts(t.embeddings, "vec_id", "embedding", "label", 20)


@R.add("""SELECT source, doc_id, n_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3""")
def longest_per_source(t: Tables):
    return ranking.top_per_group(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)


@R.add("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS turn FROM documents")
def balanced_order(t: Tables):
    return ranking.round_robin(t.documents.select("doc_id", "lang", "n_chars"), ["lang"], [F.col("n_chars"), F.col("doc_id")]).drop("n_chars")


@R.add(f"""SELECT doc_id, len(list_intersect({_TOK.format(c="text")}, ['the', 'tion', 'was'])) / 3 AS score FROM documents""")
def question_overlap(t: Tables):
    return t.documents.select("doc_id", ranking.overlap_score("The tion was the", F.col("text")).alias("score"))


@R.add("""SELECT doc_id FROM documents ORDER BY sha256('s|' || doc_id), doc_id LIMIT 25""")
def seeded_sample(t: Tables):
    return ranking.seeded_sample(t.documents.select("doc_id"), F.col("doc_id"), "s", 25)


@R.add("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, greatest(1, floor(count(*) OVER (PARTITION BY lang) / 10)) AS step FROM documents) WHERE pos % step = 0 AND pos < step * 10""")
def evenly_spaced_sample(t: Tables):
    return ranking.evenly_spaced(t.documents.select("lang", "doc_id"), ["lang"], [F.col("doc_id")], 10)


@R.add("""SELECT event_id, user_id, gap FROM (SELECT event_id, user_id, date_diff('second', lag(ts) OVER w, ts) - CASE WHEN ts < lag(ts) OVER w + to_seconds(date_diff('second', lag(ts) OVER w, ts)) THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap > 86400""")
def session_gaps(t: Tables):
    return sequences.gaps(t.events, "user_id", "ts", "event_id", 86400).select("event_id", "user_id", "gap")


@R.add("""SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 86401 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def sessionized_events(t: Tables):
    return sequences.sessions(t.events, "user_id", "ts", "event_id", 86400).select("event_id", "user_id", "session")


@R.add("""WITH r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL THEN 0 ELSE 1 END AS new FROM conversations))
    SELECT conv_id, role, min(turn) AS first, count(*) AS rows, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role""")
def collapsed_turns(t: Tables):
    return sequences.islands(t.conversations, "conv_id", "turn", "role", "text")


@R.add("""SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 90) AS errors FROM events GROUP BY 1, 2 HAVING count(*) >= 3 OR (count(*) >= 2 AND count(*) FILTER (value > 90) > 0)""")
def retry_loops(t: Tables):
    return sequences.repeats(t.events, ["user_id", "event_type"], F.col("value") > 90)


@R.add("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
    p AS (SELECT conv_id, turn, pos, size AS used, 1 AS packet FROM r WHERE pos = 1 UNION ALL SELECT r.conv_id, r.turn, r.pos, CASE WHEN used > 0 AND used + size > 800 THEN size ELSE used + size END, CASE WHEN used > 0 AND used + size > 800 THEN packet + 1 ELSE packet END FROM p JOIN r ON r.conv_id = p.conv_id AND r.pos = p.pos + 1)
    SELECT conv_id, turn, packet FROM p""")
def budget_packets(t: Tables):
    rows = t.conversations.select("conv_id", "turn", "text")
    return sequences.packed(rows, "conv_id", ["turn"], F.length("text"), 800).select("conv_id", "turn", "packet")


@R.add("""SELECT conv_id, turn FROM (SELECT conv_id, turn, coalesce(sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations) WHERE used < 200""")
def context_suffix(t: Tables):
    rows = t.conversations.withColumn("size", X.estimate_tokens(F.col("text")))
    return sequences.budget_suffix(rows, "conv_id", "turn", F.col("size"), 200).select("conv_id", "turn")


@R.add("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(t: Tables):
    return sequences.latest(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")]).drop("ts")


@R.add("""SELECT p_partkey, CASE WHEN k = 1 THEN p_brand ELSE p_brand || ' (' || k || ')' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS k FROM part)""")
def unique_names(t: Tables):
    return sequences.counter_names(t.part, "p_brand", ["p_partkey"]).select("p_partkey", "unique_name")


@R.add("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def daily_groups(t: Tables):
    return sequences.daily_groups(t.events, "ts", "event_type")


@R.add("""WITH v AS (SELECT count(*) FILTER (m AND e) AS y, count(*) FILTER (m AND NOT e) AS n FROM (SELECT regexp_matches(trim(text), '\\s') AS m, ends_with(text, '.') AS e FROM benchmark))
    SELECT item_id, CASE WHEN m AND NOT e AND y > n AND n > 0 THEN text || '.' WHEN m AND e AND n > y AND y > 0 THEN substr(text, 1, length(text) - 1) ELSE text END AS text FROM (SELECT *, regexp_matches(trim(text), '\\s') AS m, ends_with(text, '.') AS e FROM benchmark), v""".replace("\\\\s", "\\s"))
def harmonised_endings(t: Tables):
    return sequences.majority_ending(t.benchmark, "item_id", "text")


_PAIRS = "p AS (SELECT a.item_id AS id, a.text AS s, b.text AS o FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


def _pairs(t: Tables):
    nxt = t.benchmark.select((F.col("item_id") - 1).alias("id"), F.col("text").alias("o"))
    return t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("s")).join(nxt, "id")


@R.add(f"""WITH {_PAIRS}, a AS (SELECT id, w, count(*) AS na FROM (SELECT id, unnest({_TOK.format(c="s")}) AS w FROM p) GROUP BY 1, 2), b AS (SELECT id, w, count(*) AS nb FROM (SELECT id, unnest({_TOK.format(c="o")}) AS w FROM p) GROUP BY 1, 2),
    c AS (SELECT id, sum(least(na, coalesce(nb, 0))) / sum(na) AS coverage FROM a LEFT JOIN b USING (id, w) GROUP BY 1) SELECT p.id, coalesce(coverage, 1.0)::DOUBLE AS coverage FROM p LEFT JOIN c USING (id)""")
def content_coverage(t: Tables):
    return checking.content_coverage(_pairs(t), "id", "s", "o")


@R.add(f"""WITH {_PAIRS}, a AS (SELECT id, w, count(*) AS na FROM (SELECT id, unnest({_TOK.format(c="s")}) AS w FROM p) GROUP BY 1, 2), b AS (SELECT id, w, count(*) AS nb FROM (SELECT id, unnest({_TOK.format(c="o")}) AS w FROM p) GROUP BY 1, 2)
    SELECT id, w AS word, nb - coalesce(na, 0) AS extra FROM b LEFT JOIN a USING (id, w) WHERE nb > coalesce(na, 0)""")
def added_words(t: Tables):
    return checking.added_words(_pairs(t), "id", "s", "o")


@R.add(r"""SELECT doc_id, regexp_extract_all(text, '(?m)^#{1,6} ').len() AS headings, regexp_extract_all(text, '(?m)^\|.*\|[ ]*$').len() AS table_rows, regexp_extract_all(text, '\[\^[^\]]+\]').len() AS footnotes, regexp_extract_all(text, 'https?://').len() AS urls FROM documents""")
def document_structure(t: Tables):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in checking.structure(F.col("text")).items()])


@R.add(r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    y AS (SELECT doc_id, length(regexp_replace(t, '[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]', '', 'g')) AS n, len(regexp_extract_all(t, '[\p{L}\p{N}]')) AS a, len(regexp_extract_all(t, '\p{L}{3,}')) AS w,
      len(regexp_extract_all(t, '[.!?,;:$%#&*()]')) AS p, coalesce(list_sum(list_transform(regexp_extract_all(t, '\.{3,}'), lambda s: length(s))), 0) AS d FROM x),
    z AS (SELECT *, CASE WHEN n > 0 THEN a / n ELSE 0 END AS ar, CASE WHEN n > 0 THEN p / n ELSE 0 END AS pr, CASE WHEN n > 0 THEN d / n ELSE 0 END AS dr FROM y)
    SELECT doc_id, round(ar, 4)::DOUBLE AS alnum_share, round(pr, 4)::DOUBLE AS mark_share, round(dr, 4)::DOUBLE AS dot_share,
      round(least(1.0::DOUBLE, ar / 0.7::DOUBLE) * 0.55::DOUBLE + least(1.0::DOUBLE, w / 20.0::DOUBLE) * 0.25::DOUBLE + greatest(0.0::DOUBLE, 1 - pr / 0.55::DOUBLE) * 0.1::DOUBLE + greatest(0.0::DOUBLE, 1 - dr / 0.2::DOUBLE) * 0.1::DOUBLE, 4) AS score,
      list_filter([CASE WHEN a < 40 THEN 'low-text' END, CASE WHEN n > 100 AND ar < 0.2 THEN 'low-alphanumeric-ratio' END, CASE WHEN n > 100 AND pr > 0.55 THEN 'punctuation-heavy' END, CASE WHEN n > 100 AND dr > 0.2 THEN 'dot-run-heavy' END, CASE WHEN a >= 40 AND w < 3 THEN 'insufficient-word-like-text' END], lambda r: r IS NOT NULL) AS reasons FROM z""")
def text_quality(t: Tables):
    q = X.text_quality(F.col("text"))
    return t.documents.select("doc_id", *[q[k].alias(k) for k in ("alnum_share", "mark_share", "dot_share", "score", "reasons")])


@R.add(r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'))) AS names, len(list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'))) AS numbers FROM documents""")
def named_specifics(t: Tables):
    return t.documents.select("doc_id", F.array_sort(checking.capital_names(F.col("text"))).alias("names"), F.size(checking.numbers_in(F.col("text"))).cast("long").alias("numbers"))


@R.add(r"""SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z])(not|no|never|without|cannot|n''t|fails to|failed to|lack|absence of|insignificant|no significant|no effect|did not|does not)([^a-z]|$)') AS negated, ceil(length(text) / 4.0)::BIGINT AS tokens, 'doc-' || substr(sha256(text), 1, 12) AS stable_id FROM documents""")
def text_scalars(t: Tables):
    c = F.col("text")
    return t.documents.select("doc_id", X.has_negation(c).alias("negated"), X.estimate_tokens(c).alias("tokens"), X.stable_id("doc", c).alias("stable_id"))


@R.add(r"""SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')) AS title_key, regexp_replace(substr(regexp_replace(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM part""")
def name_keys(t: Tables):
    c = F.col("p_name")
    return t.part.select("p_partkey", X.title_key(c).alias("title_key"), X.slug(c).alias("slug"))


_FOLDED = "replace(lower(strip_accents(coalesce(text, ''))), 'ß', 'ss')"


@R.add(rf"""SELECT doc_id, md5(trim(regexp_replace({_FOLDED}, '[^a-z0-9]+', ' ', 'g'))) AS title_md5, md5(regexp_replace({_FOLDED}, '[^a-z]', '', 'g')) AS letters_md5,
    coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace({_FOLDED}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', ''), ''), 'item') AS slug FROM documents""", covers=("F04", "F05", "F08"))
def folded_texts(t: Tables):
    digest = lambda x: F.md5(x.cast("binary"))
    # one argument, folded once: the key has all that the letters and the slug need
    both = lambda k: F.struct(digest(k).alias("title_md5"), digest(X.letters_of(k)).alias("letters_md5"), X.slug_of(k).alias("slug"))
    found = X.once(X.title_key(F.coalesce("text", F.lit(""))), both)
    return t.documents.select("doc_id", found.alias("x")).select("doc_id", "x.title_md5", "x.letters_md5", "x.slug")


@R.add(r"""WITH m AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^m\.', ''), '^amp\.', ''), ':(80|443)$', '') AS h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p,
      list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_.*|fbclid|gclid|igshid|mc_cid|mc_eid|mkt_tok|msclkid|ref|ref_src|spm|yclid)$')) AS q FROM pages),
    k AS (SELECT *, list_transform(list_sort(list_transform(q, lambda x, i: {'name': split_part(x, '=', 1), 'at': i, 'x': x})), lambda e: e.x) AS o FROM m)
    SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' WHEN p = '/' THEN p ELSE regexp_replace(p, '/$', '') END || CASE WHEN len(o) > 0 THEN '?' || array_to_string(o, '&') ELSE '' END AS url, h AS host FROM k""")
def canonical_urls(t: Tables):
    return t.pages.select("page_id", X.canonical_url(F.col("url")).alias("url"), F.regexp_replace(X.url_host(F.col("url")), "^(m|amp)\\.", "").alias("host"))


@R.add(r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<meta\s[^>]*property=["'']og:title["''][^>]*content=["'']([^"'']*)["'']', 1), ''), nullif(regexp_extract(html, '(?is)<meta\s[^>]*name=["'']citation_title["''][^>]*content=["'']([^"'']*)["'']', 1), ''), nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')) AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"''#]+)', 1)) AS links FROM pages""")
def page_titles(t: Tables):
    return t.pages.select("page_id", X.html_title(F.col("html")).alias("title"), F.size(X.html_links(F.col("html"))).cast("long").alias("links"))


@R.add()
def page_texts(t: Tables):
    return t.pages.select("page_id", X.readable_html(F.col("html")).alias("text"))


@R.add(r"""SELECT page_id AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"''#]+)', 1)) AS target FROM pages""")
def page_links(t: Tables):
    return graphs.links(t.pages, "page_id", "html")


@R.add("""SELECT r_regionkey * 1000 AS id, 0 AS depth, r_name AS path FROM region UNION ALL SELECT n_nationkey + 1000000, 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def hierarchy_paths(t: Tables):
    top = t.region.select((F.col("r_regionkey") * 1000).alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("label"))
    low = t.nation.select((F.col("n_nationkey") + 1000000).alias("id"), (F.col("n_regionkey") * 1000).alias("parent"), F.col("n_name").alias("label"))
    top.union(low).createOrReplaceTempView("lw_hierarchy")
    return graphs.paths(t.spark, "lw_hierarchy", "id", "parent", "label")


@R.add("""SELECT event_id AS id, CAST(event_id % 64 AS BIGINT) AS root FROM events""")
def thread_roots(t: Tables):
    m = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") >= 64, F.col("event_id") - F.greatest(F.lit(64), F.floor(F.col("event_id") / 128) * 64)).alias("parent"))
    m.createOrReplaceTempView("lw_threads")
    return graphs.thread_roots(t.spark, "lw_threads", "id", "parent")


@R.add("""SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def without_incoming(t: Tables):
    e = t.customer.where("c_acctbal > 9900").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst"))
    return graphs.without_incoming(t.nation.select("n_nationkey"), "n_nationkey", e)


@R.add("SELECT event_id, date_trunc('week', ts) AS week, date_trunc('hour', ts) AS hour, CAST(hour(ts) AS INT) AS hour_of_day FROM events")
def time_buckets(t: Tables):
    return t.events.select("event_id", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.hour("ts").alias("hour_of_day"))


@R.add("""SELECT event_id, list_transform(range(0, ((e - s) % 12 + 12) % 12 + 1), lambda i: ((s - 1 + i) % 12 + 1)::INT) AS months FROM (SELECT event_id, (user_id % 12 + 1)::INT AS s, (event_id % 12 + 1)::INT AS e FROM events)""")
def month_windows(t: Tables):
    s, e = (F.col("user_id") % 12 + 1).cast("int"), (F.col("event_id") % 12 + 1).cast("int")
    return t.events.select("event_id", V.months_in(s, e).alias("months"))


@R.add("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding)::INT AS dims FROM embeddings""")
def vector_norms(t: Tables):
    return t.embeddings.select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").alias("dims"))


@R.add("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@R.add("""SELECT item_id, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(text) - length(replace(lower(text), c, '')))::DOUBLE) AS letters FROM benchmark""")
def letter_vectors(t: Tables):
    return t.benchmark.select("item_id", V.letter_vector(F.col("text")).alias("letters"))
