"""Queries on the vector index: packet duplicates, archive matches, note plans, connections and reuse. covers: ids of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import identity, vectors
from .registry import Registry, Tables

R = Registry()

#: Least similarity of packets to review, of a note's archive copy, of notes to review; least share of lines; least characters of a body (fixed values).
PACKETS, NOTES, REVIEW, CONTAINED, LEAST_CHARACTERS = 0.985, 0.97, 0.90, 0.90, 100
#: What a pair of two domains, of two sources and of one folder gains or loses in rank, and the similarity of reused answers (fixed values).
TWO_DOMAINS, TWO_SOURCES, ONE_FOLDER, REUSED = 0.06, 0.02, 0.04, 0.92

_BODY = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g')"


def _vectors_sql(rows: str) -> str:
    """v(id, u): the unit word vectors of rows (id, t)."""
    return rf"""wd AS (SELECT id, md5(unnest(list_distinct(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_-]+')))) AS h FROM {rows}),
    hs AS (SELECT id, ('0x' || h[1:2])::INT % 64 AS d, sum(CASE WHEN ('0x' || h[3:3])::INT < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM wd GROUP BY ALL),
    nz AS (SELECT id, sqrt(sum(s * s)) AS n FROM hs GROUP BY id HAVING sum(s * s) > 0),
    v AS MATERIALIZED (SELECT id, list(coalesce(s, 0.0::DOUBLE) / n ORDER BY d) AS u FROM (SELECT nz.id, n, d.d FROM nz, (SELECT unnest(range(64))::INT AS d) d) LEFT JOIN hs USING (id, d) GROUP BY id)"""


_CONTAINED = """list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))) / len({a})::DOUBLE"""
_LINES = "list_filter(string_split({t}, chr(10)), lambda x: trim(x, chr(32) || chr(9)) <> '')"


def _shared_lines(a: str, b: str) -> str:
    """Share of the shorter text's lines, from the columns {a}_t, {a}_l, {b}_t, {b}_l."""
    one, two = (_CONTAINED.format(a=f"{x}_l", b=f"{y}_l") for x, y in ((a, b), (b, a)))
    return f"coalesce(CASE WHEN length({a}_t) <= length({b}_t) THEN {one} ELSE {two} END, 0)"


@R.add(f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS canonical_id FROM documents), c AS (SELECT doc_id AS id, t FROM p WHERE doc_id = canonical_id), {_vectors_sql('c')},
    s AS (SELECT a.id, b.id AS hit, round(list_dot_product(a.u, b.u), 9) AS x FROM v a JOIN v b ON a.id <> b.id WHERE round(list_dot_product(a.u, b.u), 9) >= {PACKETS})
    SELECT doc_id, canonical_id, CASE WHEN doc_id <> canonical_id THEN 'duplicate_source' WHEN n > 0 THEN 'review_candidate' ELSE 'alone' END AS disposition, coalesce(n, 0) AS n_candidates, nearest_id, similarity
    FROM p LEFT JOIN (SELECT id, count(*) AS n, first(hit ORDER BY x DESC, hit) AS nearest_id, round(max(x), 6) AS similarity FROM s GROUP BY id) ON id = doc_id""", covers=("D18",))  # fmt: skip
def packet_duplicates(t: Tables):
    """Every document as a packet: its first exact copy, and among first copies how many others are similar, and the nearest."""
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("canonical_id"))
    rows = keyed.join(first, "key").select("doc_id", "canonical_id")
    texts = docs.join(first.select(F.col("canonical_id").alias("doc_id")), "doc_id").withColumn("v", vectors.word_vector(F.col("text")))
    reps, members = vectors.distinct_vectors(texts, "doc_id", "v")
    index = vectors.build(reps)
    found, _ = vectors.link_counts(index, None, PACKETS)
    found = members.join(found.withColumnRenamed("id", "stands_for"), "stands_for", "left")
    # packets of one vector are candidates of each other
    twin = F.when(F.col("weight") > 1, F.struct(F.lit(-1.0).alias("s"), F.when(F.col("id") == F.col("stands_for"), F.col("second")).otherwise(F.col("stands_for")).alias("hit")))
    best = F.least(F.when(F.col("hit").isNotNull(), F.struct((-F.col("similarity")).alias("s"), "hit")), twin)
    found = found.select(F.col("id").alias("doc_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), best.alias("x"))
    out = rows.join(found, "doc_id", "left")
    kind = F.when(F.col("doc_id") != F.col("canonical_id"), "duplicate_source").when(F.col("n") > 0, "review_candidate").otherwise("alone")
    return out.select("doc_id", "canonical_id", kind.alias("disposition"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"), F.col("x.hit").alias("nearest_id"), F.round(-F.col("x.s"), 6).alias("similarity"))


def _bodies(t: Tables):
    """(id, body) of documents long enough to compare."""
    rows = t.documents.select(F.col("doc_id").alias("id"), X.normalize_body(F.coalesce("text", F.lit(""))).alias("body"))
    return rows.where(F.length("body") >= LEAST_CHARACTERS)


@R.add(f"""WITH d AS (SELECT doc_id AS id, {_BODY} AS t FROM documents), b AS MATERIALIZED (SELECT id, t, {_LINES.format(t='t')} AS l FROM d WHERE length(t) >= {LEAST_CHARACTERS}), {_vectors_sql('b')},
    s AS MATERIALIZED (SELECT a.id, c.id AS hit, round(list_dot_product(a.u, c.u), 9) AS x FROM v a JOIN v c ON a.id <> c.id WHERE a.id % 50 = 0 AND round(list_dot_product(a.u, c.u), 9) >= {NOTES}),
    k AS (SELECT s.id, hit, x, a.t AS a_t, a.l AS a_l, c.t AS c_t, c.l AS c_l FROM s JOIN b a ON a.id = s.id JOIN b c ON c.id = hit)
    SELECT id AS doc_id, first(hit ORDER BY x DESC, hit) AS match_id, round(max(x), 6) AS similarity FROM k WHERE {_shared_lines('a', 'c')} >= {CONTAINED} GROUP BY id""", covers=("J10",))  # fmt: skip
def archive_matches(t: Tables):
    """For every 50th document the most similar other one, if it holds nine tenths of the shorter one's lines."""
    bodies = vectors.stored(_bodies(t).withColumn("key", F.sha2("body", 256)), "notes")
    first = bodies.groupBy("key").agg(F.min("id").alias("first"))
    twins = bodies.select("id", "key").join(first, "key")
    second = twins.where("id <> first").groupBy("key").agg(F.min("id").alias("second"))
    reps = vectors.stored(bodies.join(first, bodies["id"] == first["first"], "left_semi").withColumn("v", vectors.word_vector(F.col("body"))), "note-reps")
    index = vectors.build(vectors.unit_rows(reps, "id", "v"))
    asked = twins.where("id % 50 = 0").join(second, "key", "left").select(F.col("id").alias("note"), "first", "second")  # the stated query set
    searches = index.rows.join(asked.select(F.col("first").alias("id")).distinct(), "id").select("id", "u")

    def accepted(c):
        # the bodies that are named, so that only these meet
        named = c.select("id").union(c.select("hit")).distinct()
        bodies_of = vectors.stored(reps.select("id", "body").join(named, "id", "left_semi"), "note-bodies")
        a, b = (bodies_of.select(F.col("id").alias(k), F.col("body").alias(f"{k}_body")) for k in ("id", "hit"))
        rows = c.join(a, "id").join(b, "hit")
        mine = F.length("id_body") <= F.length("hit_body")
        short, long_ = (F.when(mine, F.col(x)).otherwise(F.col(y)) for x, y in (("id_body", "hit_body"), ("hit_body", "id_body")))
        return rows.where(identity.line_containment(short, long_, trim=False) >= CONTAINED).select("id", "hit", "place")

    found = vectors.best_accepted(index, searches, NOTES, accepted).withColumnRenamed("id", "first")
    known = index.rows.select(F.col("id").alias("first"), F.lit(True).alias("known"))
    rows = asked.join(found, "first", "left").join(known, "first")
    copy = F.when(F.col("first") != F.col("note"), F.col("first")).otherwise(F.col("second"))
    best = F.least(F.when(F.col("hit").isNotNull(), F.struct((-F.col("similarity")).alias("s"), "hit")), F.when(copy.isNotNull(), F.struct(F.lit(-1.0).alias("s"), copy.alias("hit"))))
    return rows.select(F.col("note").alias("doc_id"), best.alias("x")).where("x is not null").select("doc_id", F.col("x.hit").alias("match_id"), F.round(-F.col("x.s"), 6).alias("similarity"))


_LINE = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, chr(32) || chr(9))), lambda x: x <> '')"


@R.add(f"""WITH d AS (SELECT doc_id AS id, {_BODY} AS t FROM documents), b AS MATERIALIZED (SELECT id, t, sha256(t) AS h, {_LINES.format(t='t')} AS l, {_LINE} AS k FROM d WHERE length(t) >= {LEAST_CHARACTERS}), {_vectors_sql('b')},
    f AS (SELECT DISTINCT id, unnest(['first ' || k[1], 'last ' || k[-1]]) AS k FROM b), o AS (SELECT k FROM f GROUP BY k HAVING count(*) BETWEEN 2 AND 50),
    p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM f x JOIN f y ON x.k = y.k AND x.id < y.id WHERE x.k IN (SELECT k FROM o)),
    s AS (SELECT p.a, p.b, list_dot_product(v1.u, v2.u) AS x, b1.t AS a_t, b1.l AS a_l, b2.t AS b_t, b2.l AS b_l FROM p JOIN v v1 ON v1.id = a JOIN v v2 ON v2.id = b JOIN b b1 ON b1.id = a JOIN b b2 ON b2.id = b WHERE b1.h <> b2.h AND round(x, 9) >= {REVIEW}),
    r AS (SELECT a, b, x, {_shared_lines('a', 'b')} AS c FROM s)
    SELECT a AS left_id, b AS right_id, round(x, 4) AS score, round(c, 4) AS containment, CASE WHEN round(x, 9) >= {NOTES} AND c >= {CONTAINED} THEN 'duplicate' WHEN round(x, 9) < {NOTES} THEN 'borderline similarity' ELSE 'low containment' END AS decision FROM r""", covers=("D04", "D05", "D06"))  # fmt: skip
def note_dedupe_plan(t: Tables):
    """Pairs of documents with one first or last line: duplicates by vector and lines, or the reason for which somebody has to look."""
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x, F.lit(" \t"))), lambda x: x != "")
    rows = vectors.stored(_bodies(t).withColumn("h", F.sha2("body", 256)).withColumn("lines", lines), "plan-notes")
    rows = rows.select("id", "body", "h", F.concat(F.lit("first "), F.element_at("lines", 1)).alias("a"), F.concat(F.lit("last "), F.element_at("lines", -1)).alias("b"))
    pairs = identity.blocked_pairs(rows, "id", [F.col("a"), F.col("b")])
    known = vectors.unit_rows(rows.withColumn("v", vectors.word_vector(F.col("body"))), "id", "v").join(rows.select("id", "body", "h"), "id")
    known = vectors.stored(known, "plan-vectors")
    side = lambda k: known.select(*[F.col(c).alias(f"{k}_{c}") for c in known.columns])
    met = pairs.join(side("l"), F.col("a") == F.col("l_id")).join(side("r"), F.col("b") == F.col("r_id")).where("l_h <> r_h")
    met = met.withColumn("x", F.aggregate(F.zip_with("l_u", "r_u", lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)).where(F.round("x", 9) >= REVIEW)
    mine = F.length("l_body") <= F.length("r_body")
    short, long_ = (F.when(mine, F.col(x)).otherwise(F.col(y)) for x, y in (("l_body", "r_body"), ("r_body", "l_body")))
    met = met.withColumn("c", identity.line_containment(short, long_, trim=False))
    decision = F.when((F.round("x", 9) >= NOTES) & (F.col("c") >= CONTAINED), "duplicate").when(F.round("x", 9) < NOTES, "borderline similarity").otherwise("low containment")
    return met.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.round("x", 4).alias("score"), F.round("c", 4).alias("containment"), decision.alias("decision"))


@R.add(f"""WITH n AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS x, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS r
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.25), p AS (SELECT DISTINCT least(a, b) AS l, greatest(a, b) AS r, x FROM n WHERE r <= 5)
    SELECT l AS left_id, r AS right_id, round(x, 6) AS similarity, x >= 0.4 AS near_duplicate, CASE WHEN x < 0.4 THEN round(x + CASE WHEN p1.label <> p2.label THEN {TWO_DOMAINS} ELSE 0 END - CASE WHEN l // 100 = r // 100 THEN {ONE_FOLDER} ELSE 0 END, 6) END AS priority
    FROM p JOIN embeddings p1 ON p1.vec_id = l JOIN embeddings p2 ON p2.vec_id = r""", covers=("R06",))  # fmt: skip
def connection_candidates(t: Tables):
    """The five nearest vectors of each, either way: too similar ones apart, the others ranked with a bonus for another label and less within one hundred of ids."""
    return vectors.connections(t.embeddings, "vec_id", "embedding", 5, 0.25, 0.4, domain=F.col("label"), folder=F.floor(F.col("vec_id") / 100), two_domains=TWO_DOMAINS, one_folder=ONE_FOLDER)


@R.add(f"""WITH RECURSIVE c AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), {_vectors_sql('c')}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE round(list_dot_product(a.u, b.u), 9) >= {REUSED}),
    g AS (SELECT id, id AS low FROM c UNION SELECT e.a, g.low FROM g JOIN e ON e.b = g.id AND g.low < e.a), r AS (SELECT id, min(low) AS representative FROM g GROUP BY id), s AS (SELECT id, representative, count(*) OVER (PARTITION BY representative) AS members FROM r),
    o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM s WHERE members = 1), q AS (SELECT greatest(0, 40 - count(*)) AS room FROM s WHERE members > 1 AND id = representative),
    y AS (SELECT id FROM o, q WHERE room > 0 AND pos % greatest(1, n // room) = 0 AND pos // greatest(1, n // room) < room)
    SELECT s.id AS doc_id, representative, members, length(c.t) AS answer, s.id <> representative AS reused, (members > 1 AND s.id = representative) OR s.id IN (SELECT id FROM y) AS reviewed FROM s JOIN c ON c.id = representative""", covers=("D15",))  # fmt: skip
def semantic_reuse(t: Tables):
    """Documents of one meaning share the answer of the first (here: its length); reviewed are all first ones that are shared, and an even spread of the rest up to 40."""
    docs = t.documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    return vectors.reused(docs.withColumn("v", vectors.word_vector(F.col("t"))), "id", "v", F.length("t").cast("long"), REUSED, 40).withColumnRenamed("id", "doc_id")
