"""The training-data queries and, where SQL can express one, its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, fill_in_middle, html_extract, merkle, minhash, mixing, quality, secret_scan, sharding, substring_dedup, token_output, toxicity
from .common import table


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialised(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("hits")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(table(spark, sf_dir, "documents"), keep_output=False)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered=merkle.without_newlines(docs)).proofs(keep_path=False)


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output, op2_secret_scan, op3_substring_dedup, op4_quality, op5_source_mix, op6_near_duplicates, op7_byte_shards, op8_near_vectors, op9_decontamination, op10_toxicity,
        op11_fill_in_middle, op12_merkle_manifest, op13_html_extract,
    )
}


def _spans_sql(kind: str, order: int, regex: str, group: int, least: int, flags: str) -> str:
    regex = regex.replace("'", "''")
    gaps, hits = f"string_split_regex(t, '{flags}{regex}')", f"regexp_extract_all(t, '{flags}{regex}')"
    part = f"regexp_extract_all(t, '{flags}{regex}', {group})"
    start = "list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(h[1:i-1], lambda s: length(s))), 0)"
    return f"""SELECT r, {order} AS ord, '{kind}' AS kind, ({start})::BIGINT AS start, ({start} + length(h[i]))::BIGINT AS stop
      FROM (SELECT r, {gaps} AS g, {hits} AS h, {part} AS p FROM d), range(1, len(h) + 1) q(i) WHERE length(p[i]) >= {least}"""


def _op2_sql() -> str:
    parts = " UNION ALL ".join(_spans_sql(r.kind, k, r.pattern.replace("\\x20", " "), r.group, r.min_len, "(?i)" if r.any_case else "") for k, r in enumerate(secret_scan.RULES))
    text = "kind || ':' || start || ':' || stop"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ({parts})
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        sha256(coalesce(string_agg({text}, ',' ORDER BY start, ord) FILTER (ord < 3), '')) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY start, ord), '') AS spans
      FROM d LEFT JOIN s USING (r) GROUP BY d.r, doc_id"""


_OP5_SQL = f"""WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> ''))::BIGINT AS size, md5('{mixing.SEED}|' || doc_id) AS h FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
  c AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((sid - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
  l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
  t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
  p AS (SELECT doc_id, size, h, t.source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  x AS (SELECT *, target - whole * source_size AS rest, before + size / 2.0::DOUBLE < target - whole * source_size AS extra FROM p),
  g AS (SELECT source, max(rest) - sum(CASE WHEN extra THEN size ELSE 0 END)::DOUBLE AS gap FROM x GROUP BY source),
  y AS (SELECT x.*, gap, abs(abs(gap) - size) AS near FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.source),
  f AS (SELECT source, arg_min(before, (near, h, before)) AS turned FROM y WHERE near < abs(gap) AND size > 0 AND extra = (gap <= 0) GROUP BY source)
  SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN extra <> (size > 0 AND coalesce(before = turned, false)) THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM y LEFT JOIN f ON y.source IS NOT DISTINCT FROM f.source"""

_OP11_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  u AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d),
  f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
  p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM p"""

_ENCODED = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in merkle.COLUMNS)
_CRC = "list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [1::BIGINT, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
_OP12_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, source, doc_id, sha256({_ENCODED}) AS h, sha256({_ENCODED.replace("text::VARCHAR", "replace(text, chr(10), '')")}) AS cut, xor({_CRC}, 4294967295) % 2 = 0 AS even FROM documents),
  n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS cnt FROM d),
  lv AS (SELECT source, 0 AS lvl, pos, cnt, h FROM n UNION ALL SELECT source, any_value(lvl) + 1, pos // 3, any_value((cnt + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE cnt > 1 GROUP BY source, pos // 3),
  subs AS MATERIALIZED (SELECT source, lvl AS top, h AS subroot FROM lv WHERE cnt = 1),
  t0 AS MATERIALIZED (SELECT source, top, subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS cnt FROM subs),
  tv AS (SELECT 0 AS lvl, pos, cnt, subroot AS h FROM t0 UNION ALL SELECT any_value(lvl) + 1, pos // 3, any_value((cnt + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM tv WHERE cnt > 1 GROUP BY pos // 3),
  alln AS MATERIALIZED (SELECT coalesce('+' || source, '-') AS seq, lvl, pos, h FROM lv WHERE cnt > 1 UNION ALL SELECT '', lvl, pos, h FROM tv WHERE cnt > 1),
  runs AS MATERIALIZED (SELECT seq, lvl, pos // 3 AS up, list(h ORDER BY pos) AS hs FROM alln GROUP BY ALL),
  f AS (SELECT n.r, 0 AS step, top, CASE WHEN top = 0 THEN '' ELSE coalesce('+' || n.source, '-') END AS seq, 0 AS lvl, CASE WHEN top = 0 THEN t0.pos ELSE n.pos END AS pos, t0.pos AS top_at, CASE WHEN even THEN cut ELSE h END AS h, '' AS sibs FROM n JOIN t0 ON n.source IS NOT DISTINCT FROM t0.source
    UNION ALL SELECT f.r, step + 1, top, CASE WHEN step + 1 >= top THEN '' ELSE f.seq END, CASE WHEN step + 1 >= top THEN step + 1 - top ELSE step + 1 END, CASE WHEN step + 1 = top THEN top_at ELSE f.pos // 3 END, top_at,
      sha256(list_aggregate(list_transform(hs, lambda x, i: CASE WHEN i = f.pos % 3 + 1 THEN h ELSE x END), 'string_agg', '')), sibs || coalesce(list_aggregate(list_filter(hs, lambda x, i: i <> f.pos % 3 + 1), 'string_agg', ''), '')
      FROM f JOIN runs ON runs.seq = f.seq AND runs.lvl = f.lvl AND runs.up = f.pos // 3),
  g AS (SELECT r, arg_max(h, step) AS folded_root, sha256(arg_max(sibs, step)) AS proof_sha256 FROM f GROUP BY r),
  w AS (SELECT h AS root FROM tv WHERE cnt = 1)
  SELECT doc_id, h AS leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM n JOIN g USING (r) JOIN t0 ON n.source IS NOT DISTINCT FROM t0.source, w"""

_OP13_SQL = """WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's'), '</?(?:p|h1)>', chr(30), 'g') AS x FROM pages),
  b AS (SELECT page_id, url, list_transform(string_split(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), chr(30)), lambda s:
    trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', chr(31), 'g'), chr(31), '&'), '[ \t-\r]+', ' ', 'g'))) AS l FROM a)
  SELECT page_id, url, coalesce(list_aggregate(list_filter(l, lambda s: s <> ''), 'string_agg', chr(10)), '') AS text, length(coalesce(list_aggregate(list_filter(l, lambda s: s <> ''), 'string_agg', chr(10)), '')) AS n_chars FROM b"""

ORACLE = {"op2_secret_scan": _op2_sql(), "op5_source_mix": _OP5_SQL, "op11_fill_in_middle": _OP11_SQL, "op12_merkle_manifest": _OP12_SQL, "op13_html_extract": _OP13_SQL}
