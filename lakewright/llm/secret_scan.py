"""Secret scans over whole texts with a trigram inverted index (DataFrame functions only).

Index. `build_index` writes postings (gram, key) of every trigram of every lower-cased text, each file sorted
by a hash of the gram, so it serves any set of rules; building it shuffles nothing. A key is a hash of doc_id
and text: rows that share one are verified together.

Search. Each rule's regular expression yields a Boolean trigram query: what any match must hold. Only the
pages of the index that can hold a gram of the queries are read. Intersecting their postings gives each rule's candidate
keys, and their texts alone are verified with the regular expression. A rule without a mandatory trigram
(a character class, say) scans every text.

Null or empty texts have no spans; long ones are indexed whole. Repeated rows each get their
result, rows without doc_id too; an empty table gives none; extra columns are ignored, whatever their names.
Spans are in code points, end exclusive. Matches are leftmost and non-overlapping for each rule, before
`min_len` drops those whose `group` is too short.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    min_len: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The base rules. A hex run of 24 or more is one maximal run, so the bound stands in the pattern.
BASE_RULES = [
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),
]
#: Further public token shapes.
MORE_RULES = [
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("gitlab", "glpat-[A-Za-z0-9_-]{20,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "(sk|rk)_live_[A-Za-z0-9]{24,}"),
    Rule("npm", "npm_[A-Za-z0-9]{36}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("database", "(postgres|postgresql|mysql|mongodb)://[A-Za-z0-9_.-]+:[^@\\x20]+@"),
]
RULES = BASE_RULES + MORE_RULES
#: At most so many strings are told apart in one place of a pattern; more count as "anything".
MOST_STRINGS = 16


def _strings(items) -> list[set[str] | None]:
    """For each item of a parsed pattern: the strings that it can be (None: anything)."""
    out = []
    for op, arg in items:
        if op is rc.LITERAL:
            out.append({chr(arg).lower()})
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
            out.append({chr(a).lower() for _, a in arg})
        elif op is rc.AT:
            out.append({""})
        elif op is rc.SUBPATTERN:
            out.extend(_strings(arg[3]))
        elif op is rc.BRANCH:
            options = [_whole(x) for x in arg[1]]
            known = None not in options
            out.append(set().union(*options) if known else None)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, inner = arg
            own = _whole(inner)
            if (low, high) == (0, 1) and own is not None:
                out.append(own | {""})
            elif low == high and low <= 8 and own is not None and len(own) == 1:
                out.append({next(iter(own)) * low})
            else:
                out.append(None)
        else:
            out.append(None)
    return out


def _whole(items) -> set[str] | None:
    found = {""}
    for strings in _strings(items):
        if strings is None or len(found) * len(strings) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in strings}
    return found


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """All clauses must hold; in a clause one alternative; in an alternative all trigrams. Lower case."""
    clauses: list[list[list[str]]] = []
    open_: set[str] = {""}

    def close() -> None:
        nonlocal open_
        if all(len(s) >= 3 for s in open_):
            clauses.append([sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in sorted(open_)])
        open_ = {""}

    for strings in _strings(rp.parse(pattern)):
        if strings is None:
            close()
        elif len(open_) * len(strings) > MOST_STRINGS:
            close()
            open_ = set(strings)
        else:
            open_ = {a + b for a in open_ for b in strings}
    close()
    return clauses


def _key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def trigram_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, key) of all trigrams of the whole lower-cased texts; a gram is named by its hash."""
    characters = F.split(F.lower(F.col(text)), "")
    both = lambda x, y: F.xxhash64(x, y)
    grams = F.transform(F.array(characters), lambda c: F.array_distinct(F.zip_with(F.zip_with(c, F.slice(c, 2, F.size(c)), both), F.slice(c, 3, F.size(c)), both)))
    return docs.where(F.length(text) >= 3).select(_key(doc_id, text).alias("key"), F.explode(F.get(grams, F.lit(0))).alias("gram")).select("gram", "key")


def gram_name(gram: Column) -> Column:
    """The hash by which the index knows a trigram."""
    c = [F.substring(gram, k, 1) for k in (1, 2, 3)]
    return F.xxhash64(F.xxhash64(c[0], c[1]), c[2])


def build_index(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the postings to path (a new folder of the shared one if not given); the table that candidates() reads."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex[:12]}"
    posted = trigram_index(docs, doc_id, text)
    posted.sortWithinPartitions("gram").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(posted.schema).parquet(path)


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, kinds): the rules whose trigram query each key's postings meet; one row for each key."""
    spark = index.sparkSession
    wanted = [(r.kind, c, a, g, len(grams), len(q)) for r in rules for q in [trigram_query(r.pattern)] for c, alts in enumerate(q) for a, grams in enumerate(alts) for g in grams]
    if not wanted:
        return spark.createDataFrame([], "key long, kinds array<string>")
    schema = "kind string, clause int, alt int, gram string, need int, clauses int"
    query = spark.createDataFrame(wanted, schema).withColumn("gram", gram_name(F.col("gram")))  # a few rows for each rule
    postings = index.where(F.col("gram").isin(sorted({r.gram for r in query.select("gram").collect()})))
    met = postings.join(F.broadcast(query), "gram").groupBy("key", "kind", "clause", "alt").agg(F.count_distinct("gram").alias("n"), F.first("need").alias("need"), F.first("clauses").alias("clauses"))
    met = met.where("n = need").groupBy("key", "kind").agg(F.count_distinct("clause").alias("n"), F.first("clauses").alias("clauses"))
    return met.where("n = clauses").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _running(sizes: Column) -> Column:
    """Running sums of an array of longs: within runs of 256, then over the runs, so that no long array is copied for each entry."""
    none = F.array().cast("array<bigint>")
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"] + x).alias("out"))
    sums = lambda a: F.aggregate(a, F.struct(F.lit(0).cast("long").alias("sum"), none.alias("out")), add)["out"]
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / 256).cast("int")), lambda k: sums(F.slice(sizes, k * 256 + 1, 256)))
    shifted = F.transform(F.array(runs), lambda r: F.zip_with(r, sums(F.transform(r, lambda x: F.element_at(x, -1))), lambda x, upto: F.transform(x, lambda y: y + upto - F.element_at(x, -1))))
    return F.flatten(F.get(shifted, F.lit(0)))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,ord,stop,kind>> of a rule's matches in a text."""
    pattern = F.lit(rule.java)
    pieces = F.split(text, rule.java, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    none = F.array().cast("array<struct<start:long,ord:int,stop:long,kind:string>>")
    sizes = F.zip_with(F.slice(pieces, 1, F.size(whole)), whole, lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))
    found = F.arrays_zip(_running(sizes).alias("stop"), whole.alias("hit"), part.alias("part"))
    long_enough = F.filter(found, lambda x: F.length(x["part"]) >= rule.min_len)
    span = lambda x: F.struct((x["stop"] - F.length(x["hit"])).alias("start"), F.lit(order).alias("ord"), x["stop"].alias("stop"), F.lit(rule.kind).alias("kind"))
    return F.when(F.size(whole) > 0, F.transform(long_enough, span)).otherwise(none)


def scan(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans): every row of docs with its matches, by start, then in the order of the rules. index: of these docs, if there is one."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    index = index if index is not None else build_index(docs, None, doc_id, text)
    found = written(candidates(index, indexed), "ss-candidates")  # Spark sees its size: only a small one is sent to the texts
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), _key(doc_id, text).alias("key")).join(found, "key", "left")
    none = F.array().cast("array<struct<start:long,ord:int,stop:long,kind:string>>")
    parts = []
    for k, rule in enumerate(rules):
        spans = spans_of(F.col("_text"), rule, k)
        parts.append(F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none) if rule in indexed else spans)
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def digest(found: DataFrame, base: list[Rule] = BASE_RULES) -> DataFrame:
    """Counts of the base kinds, their hash, and all spans as text."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    joined = lambda s: F.array_join(F.transform(s, text), ",")
    kinds = [r.kind for r in base]
    own = F.filter("spans", lambda x: x["kind"].isin(kinds))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
