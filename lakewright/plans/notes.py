"""Queries of reductions, near-verbatim edits, searches, revisions, mail threads, pasted texts and partial JSON. covers: ids of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits, partial_json, search
from ..functions import text as X
from ..operators import graphs, pasted, reduction, revisions
from .registry import Registry, Tables

R = Registry()

#: Tokens of a packet and of the final context, and a memo's length: a fifth of its packet and a heading.
TARGET, BUDGET = 4000, 4000


def _reduction_sql(levels: int = 8) -> str:
    parts = ["i1 AS (SELECT doc_id AS item, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM documents)"]
    for k in range(1, levels + 1):
        parts.append(f"""p{k} AS MATERIALIZED (SELECT item, tokens, row_number() OVER w AS pos, sum(tokens) OVER w AS upto FROM i{k} WINDOW w AS (ORDER BY item ROWS UNBOUNDED PRECEDING)),
    x{k} AS MATERIALIZED (SELECT a.pos, min(b.pos) AS nx FROM p{k} a JOIN p{k} b ON b.pos > a.pos AND b.upto > a.upto - a.tokens + {TARGET} GROUP BY 1),
    s{k} AS (SELECT 1::BIGINT AS pos WHERE EXISTS (FROM p{k}) UNION ALL SELECT nx FROM s{k} JOIN x{k} USING (pos)),
    c{k} AS (SELECT item, tokens, (SELECT count(*) FROM s{k} WHERE s{k}.pos <= p{k}.pos) - 1 AS packet FROM p{k}),
    l{k} AS MATERIALIZED (SELECT packet, min(item) AS first, count(*) AS items, sum(tokens)::BIGINT AS tokens, (ceil(sum(tokens) / 5.0) + 50)::BIGINT AS memo_tokens FROM c{k} GROUP BY 1),
    i{k + 1} AS (SELECT packet AS item, memo_tokens AS tokens FROM l{k} WHERE (SELECT sum(memo_tokens) FROM l{k}) > {BUDGET})""")
    return f"WITH RECURSIVE {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS level, packet, first, items, tokens, memo_tokens FROM l{k}" for k in range(1, levels + 1))


@R.add(_reduction_sql(), covers=("G08", "W09"))
def reduction_levels(t: Tables):
    """Documents in packets of a token budget, their memos in packets, and so on until a level's memos fit the final context."""
    return reduction.reduced(t.documents, "doc_id", X.estimate_tokens(F.col("text")), TARGET, BUDGET, lambda tokens, items: F.ceil(tokens / 5.0) + 50)


_FOLD = """replace(replace(regexp_replace(replace({c}, chr(160), ' '), '[ \\t]+(\\n|$)', '\\1', 'g'), chr(8217), chr(39)), chr(8211), '-')"""


@R.add(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), q AS (SELECT doc_id, t, substring(t, 6, 60) AS s FROM d WHERE length(t) >= 70),
    o AS (SELECT doc_id, t, CASE doc_id % 4 WHEN 0 THEN s WHEN 1 THEN replace(replace(s, ' ', chr(160)), '-', chr(8211)) WHEN 2 THEN replace(s, chr(10), '  ' || chr(10)) ELSE reverse(s) END AS o FROM q),
    f AS (SELECT doc_id, instr(t, o) AS e, {_FOLD.format(c='t')} AS ft, {_FOLD.format(c='o')} AS fo, length(o) AS n FROM o)
    SELECT doc_id, e > 0 OR instr(ft, fo) > 0 AS found, e = 0 AND instr(ft, fo) > 0 AS fuzzy, CASE WHEN e > 0 THEN e - 1 ELSE instr(ft, fo) - 1 END::INT AS "index", CASE WHEN e > 0 THEN n WHEN instr(ft, fo) > 0 THEN length(fo) ELSE 0 END::INT AS length FROM f""", covers=("Q16",))  # fmt: skip
def edit_locations(t: Tables):
    """Where a passage stands in its document when it comes back with other spaces, dashes or line ends, or turned round."""
    rows = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") >= 70).withColumn("s", F.substring("text", 6, 60))
    k = F.col("doc_id") % 4
    other = F.replace(F.replace(F.col("s"), F.lit(" "), F.lit("\u00a0")), F.lit("-"), F.lit("\u2013"))
    old = F.when(k == 0, F.col("s")).when(k == 1, other).when(k == 2, F.replace(F.col("s"), F.lit("\n"), F.lit("  \n"))).otherwise(F.reverse("s"))
    return rows.select("doc_id", edits.located(F.col("text"), old).alias("x")).select("doc_id", "x.found", "x.fuzzy", "x.index", "x.length")


#: A pattern, a phrase with a word, a quote that is not closed, and a pattern that is none.
SEARCHES = ("re:\\bth[a-z]+ing\\b", '"of the" qu', 'zx "', "re:(")
_WORD = """(instr({t}, '{a}')) AS i, CASE WHEN instr({t}, '{a}') > 0 AND instr(substring({t}, instr({t}, '{a}') + 1), '{b}') > 0 THEN instr({t}, '{a}') + instr(substring({t}, instr({t}, '{a}') + 1), '{b}') END AS j"""
_BEGINS = "(k = 1 OR regexp_matches(substring(t, (k - 1)::INT, 1), '[\\s\\-_./:]'))"
_SCORE = f"""(CASE WHEN i = 1 THEN -5 ELSE 0 END + CASE WHEN {_BEGINS.replace('k', 'i')} THEN -10 ELSE 0 END + (i - 1) * 0.1::DOUBLE
    + CASE WHEN j = i + 1 THEN -5 * (CASE WHEN i = 1 THEN 2 ELSE 1 END) ELSE (j - i - 1) * 2 END + CASE WHEN {_BEGINS.replace('k', 'j')} THEN -10 ELSE 0 END + (j - 1) * 0.1::DOUBLE)"""


@R.add(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, lower(coalesce(text, '')) AS t, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS p FROM documents),
    a AS (SELECT 0 AS search, doc_id, length(string_split_regex(x, '(?i)\\bth[a-z]+ing\\b')[1]) * 0.1::DOUBLE AS score FROM d WHERE regexp_matches(x, '(?i)\\bth[a-z]+ing\\b')),
    b AS (SELECT 1 AS search, doc_id, (instr(p, 'of the') - 1) * 0.1::DOUBLE + {_SCORE} AS score FROM (SELECT *, {_WORD.format(t='t', a='q', b='u')} FROM d) WHERE instr(p, 'of the') > 0 AND j IS NOT NULL),
    c AS (SELECT 2 AS search, doc_id, {_SCORE} + (instr(t, '"') - 1) * 0.1::DOUBLE + CASE WHEN instr(t, '"') = 1 THEN -15 WHEN regexp_matches(substring(t, (instr(t, '"') - 1)::INT, 1), '[\\s\\-_./:]') THEN -10 ELSE 0 END AS score FROM (SELECT *, {_WORD.format(t='t', a='z', b='x')} FROM d) WHERE j IS NOT NULL AND contains(t, '"'))
    SELECT search, doc_id, round(score, 6) AS score FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""", covers=("R18", "R08"))  # fmt: skip
def document_search(t: Tables):
    out = None
    for k, query in enumerate(SEARCHES):
        found = search.search(t.documents, F.col("text"), query, F.col("doc_id")).select(F.lit(k).alias("search"), "doc_id", F.round("score", 6).alias("score"))
        out = found if out is None else out.union(found)
    return out


@R.add("""WITH d AS (SELECT doc_id, source, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS t FROM documents), l AS (SELECT * FROM d WHERE length(t) >= 80),
    e AS (SELECT 'text' AS kind, source, doc_id AS earlier, t AS o FROM l UNION ALL SELECT 'error', source, doc_id, substring(t, 1, 120) FROM l WHERE doc_id % 3 = 0)
    SELECT l.source, doc_id, kind, min(earlier) AS earlier FROM l JOIN e ON l.source IS NOT DISTINCT FROM e.source AND earlier < doc_id AND contains(l.t, o) GROUP BY 1, 2, 3""", covers=("W03",))  # fmt: skip
def pasted_texts(t: Tables):
    """Documents that hold an earlier one of their source, or the beginning of an earlier one with a number divisible by three, taken as error messages."""
    errors = t.documents.where("doc_id % 3 = 0").select("source", "doc_id", "text")
    return pasted.pasted(t.documents, "source", "doc_id", F.col("text"), errors)


_HEADERS = """m AS (SELECT conv_id * 100 + turn AS id, 'm' || conv_id || '.' || turn AS message_id, CASE WHEN turn > 0 AND length(text) % 3 = 0 THEN ['gone' || turn, 'm' || conv_id || '.' || (turn - 1)] ELSE [] END AS in_reply_to,
    CASE WHEN turn > 0 AND length(text) % 3 = 1 THEN ['m' || conv_id || '.0', 'm' || conv_id || '.' || (turn // 2)] WHEN turn = 0 AND conv_id % 5 = 1 THEN ['m' || (conv_id - 1) || '.0'] ELSE [] END AS refs FROM conversations WHERE turn < 100)"""


@R.add(f"""WITH RECURSIVE {_HEADERS}, s AS (SELECT id, unnest(list_concat(in_reply_to, list_reverse(refs))) AS named, unnest(range(len(in_reply_to) + len(refs))) AS pos FROM m),
    p AS MATERIALIZED (SELECT s.id, first(k.id ORDER BY pos) AS parent FROM s JOIN m k ON k.message_id = s.named AND k.id <> s.id GROUP BY s.id), r AS (SELECT id, id AS root FROM m WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT p.id, r.root FROM r JOIN p ON p.parent = r.id)
    SELECT id, parent, root, 'thread-' || sha256(root::VARCHAR)[1:16] AS thread FROM r LEFT JOIN p USING (id)""", covers=("J15", "G03"))  # fmt: skip
def mail_threads(t: Tables):
    """Turns as mails: some name the turn before and one that is gone, some only references, some nothing; some conversations answer the one before."""
    name = lambda c, n: F.concat(F.lit("m"), c.cast("string"), F.lit("."), n.cast("string"))
    conv, turn, kind = F.col("conv_id"), F.col("turn"), F.length("text") % 3
    none = F.array().cast("array<string>")
    reply = F.when((turn > 0) & (kind == 0), F.array(F.concat(F.lit("gone"), turn.cast("string")), name(conv, turn - 1))).otherwise(none)
    first, half = F.lit(0), F.floor(turn / 2)
    refs = F.when((turn > 0) & (kind == 1), F.array(name(conv, first), name(conv, half))).when((turn == 0) & (conv % 5 == 1), F.array(name(conv - 1, first))).otherwise(none)
    mails = t.conversations.where("turn < 100").select((conv * 100 + turn).alias("id"), name(conv, turn).alias("message_id"), reply.alias("in_reply_to"), refs.alias("refs"))
    return graphs.mail_threads(mails, "id", "message_id", "in_reply_to", "refs")


_SNAPSHOTS = ("doc_id % 10 <> 3", "doc_id % 7 <> 2", "doc_id % 11 <> 5")


@R.add("""WITH s AS (SELECT doc_id AS source, 1 AS n, sha256(coalesce(text, '')) AS c FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id, 2, sha256(CASE WHEN n_chars % 4 = 0 THEN lang || coalesce(text, '') ELSE coalesce(text, '') END) FROM documents WHERE doc_id % 7 <> 2
      UNION ALL SELECT doc_id, 3, sha256(CASE WHEN n_chars % 6 = 0 THEN lang || coalesce(text, '') ELSE coalesce(text, '') END) FROM documents WHERE doc_id % 11 <> 5),
    g AS (SELECT *, lag(n) OVER w AS pn, lag(c) OVER w AS pc FROM s WINDOW w AS (PARTITION BY source ORDER BY n)), b AS (SELECT *, (pn IS NULL OR pn < n - 1 OR pc <> c)::INT AS starts FROM g),
    r AS (SELECT *, sum(starts) OVER (PARTITION BY source ORDER BY n) AS revision FROM b)
    SELECT source, revision::BIGINT AS revision, c AS content, min(n)::BIGINT AS valid_from, CASE WHEN max(n) < 3 THEN max(n) + 1 END::BIGINT AS valid_to, max(n) = 3 AS active FROM r GROUP BY 1, 2, 3""", covers=("X05",))  # fmt: skip
def source_revisions(t: Tables):
    """Three snapshots of the documents, each without some and with some changed, as days 1 to 3 of one history."""
    text = F.coalesce("text", F.lit(""))
    changed = lambda k: F.when(F.col("n_chars") % k == 0, F.concat("lang", text)).otherwise(text)
    history = revisions.empty_history(t.spark)
    for day, (kept, content) in enumerate(zip(_SNAPSHOTS, (text, changed(4), changed(6)), strict=True), 1):
        snapshot = t.documents.where(kept).select(F.col("doc_id").alias("source"), F.sha2(content, 256).alias("content"))
        history, _ = revisions.merged(history, snapshot, F.timestamp_seconds(F.lit(day)))
    return history.select("source", "revision", "content", F.unix_seconds("valid_from").alias("valid_from"), F.unix_seconds("valid_to").alias("valid_to"), "active")


@R.add("""WITH e AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') AS s FROM documents),
    c AS (SELECT *, rtrim(substring(s, 1, doc_id * 37 % (length(s) + 1))) AS cut FROM e), h AS (SELECT *, len(regexp_extract(cut, '\\\\*$')) AS slashes FROM c), w AS (SELECT *, CASE WHEN slashes % 2 = 1 THEN substring(cut, 1, length(cut) - 1) ELSE cut END AS whole FROM h)
    SELECT doc_id, lang, md5(CASE WHEN doc_id % 2 = 1 THEN t ELSE replace(replace(replace(replace(whole, chr(92) || chr(92), chr(1)), chr(92) || '"', '"'), chr(92) || 'n', chr(10)), chr(1), chr(92)) END) AS text_md5 FROM w""", covers=("M06",))  # fmt: skip
def partial_records(t: Tables):
    """Documents as JSON: of even ids cut off within the text, of odd ids with raw line ends in it. What is read of them is what was there."""
    mask = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    quoted = mask(mask(F.coalesce("text", F.lit("")), "\\", "\\\\"), '"', '\\"')
    head = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), F.coalesce("lang", F.lit("")), F.lit('", "text": "'))
    escaped = mask(quoted, "\n", "\\n")
    cut = F.substring(escaped, F.lit(1), (F.col("doc_id") * 37 % (F.length(escaped) + 1)).cast("int"))
    sent = F.when(F.col("doc_id") % 2 == 1, F.concat(head, quoted, F.lit('"}'))).otherwise(F.concat(head, cut))
    read = F.from_json(partial_json.tolerant_json(sent), "doc_id long, lang string, text string")
    return t.documents.select(read.alias("r")).select("r.doc_id", "r.lang", F.md5(F.col("r.text").cast("binary")).alias("text_md5"))
