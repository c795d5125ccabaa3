"""Works, links, mentions, candidates and corpora: which records mean the same thing, and which belong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded_character, normalize_doi, title_key, tokens

#: Roles by precedence where a document has several (fixed values).
ROLES = ("hub", "folder", "embed", "transcript")
#: Words of a candidate's title: whole, phrase, share, prefix, each surplus word and their floor (fixed values).
WHOLE, PHRASE, SHARE, PREFIX, SURPLUS, SURPLUS_FLOOR = 100.0, 45.0, 15.0, 25.0, -8.0, -20.0
#: Tasks over which pairs of works are dealt (a fixed value).
SPREAD = 64


def work_key(doi: Column, pmid: Column, arxiv: Column, title: Column, year: Column, author: Column) -> Column:
    """The first identifier that is there, else title, year and first author; null without any."""
    named = lambda kind, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{kind}:"), F.lower(F.trim(c))))
    key = title_key(title)
    by_title = F.when(key != "", F.concat_ws("|", F.concat(F.lit("title:"), key), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(title_key(author), F.lit(""))))
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi)), named("pmid", pmid), named("arxiv", arxiv), by_title)


def merged_records(records: DataFrame, key: str, order: list[str], scalars: list[str], lists: list[str]) -> DataFrame:
    """One row for each key: the first value that is not null by order, and the distinct entries of lists in order of appearance."""
    at = F.struct(*order)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in scalars]
    every = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(c).alias("_v")))), lambda x: F.coalesce(x["_v"], F.array())))).alias(c) for c in lists]
    return records.groupBy(key).agg(F.count("*").alias("records"), *first, *every)


def field_origins(records: DataFrame, key: str, order: list[str], scalars: list[str]) -> DataFrame:
    """(key, field, value, chosen): every value that a record gives, and whether the merge took it."""
    at = F.struct(*order)
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in scalars]))
    rows = records.select(key, at.alias("_at"), fields.alias("f")).select(key, "_at", "f.field", "f.value").where("value is not null")
    rank = F.row_number().over(Window.partitionBy(key, "field").orderBy("_at"))
    return rows.withColumn("chosen", rank == 1).drop("_at")


def related_works(works: DataFrame, id_: str, title: Column, year: Column, preprint: Column) -> DataFrame:
    """(preprint_id, article_id): equal titles, at most a year apart."""
    rows = works.select(F.col(id_).alias("i"), title_key(title).alias("k"), year.alias("y"), preprint.alias("p")).where("k <> '' and y is not null")
    # an article is met by the years that match it; few small rows give many pairs, so they are dealt over tasks by number, not by size
    a = rows.where("p").select("k", "y", F.col("i").alias("preprint_id")).repartition(SPREAD, "k", "y")
    b = rows.where("not p").select("k", F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"), F.col("i").alias("article_id"))
    return a.join(b.repartition(SPREAD, "k", "y"), ["k", "y"]).select("preprint_id", "article_id")


def first_match(rows: DataFrame, id_: str, keys: dict[str, Column]) -> DataFrame:
    """(id, duplicate_of, matched_by): the earliest row that shares the first of the keys which has an earlier row."""
    named = rows.select(F.col(id_).alias("id"), *[c.alias(f"k_{n}") for n, c in keys.items()])
    for n in keys:
        # a key's first row by grouping, so that a common key stays small before it is met again
        low = named.where(F.col(f"k_{n}").isNotNull()).groupBy(f"k_{n}").agg(F.min("id").alias(f"m_{n}"))
        named = named.join(low, f"k_{n}", "left")
    earlier = [F.when(F.col(f"m_{n}") < F.col("id"), F.struct(F.col(f"m_{n}").alias("duplicate_of"), F.lit(n).alias("matched_by"))) for n in keys]
    return named.withColumn("x", F.coalesce(*earlier)).where("x is not null").select("id", "x.duplicate_of", "x.matched_by")


def mentions(links: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """links (source, target) whose target names no known row (name), any case: (key, display, sources) with `least` sources or more."""
    open_ = links.withColumn("key", F.lower(F.trim("target"))).where("key <> ''").join(known.select(F.lower(F.trim("name")).alias("key")).distinct(), "key", "left_anti")
    g = open_.groupBy("key").agg(F.min_by("target", F.struct("source", "target")).alias("display"), F.count_distinct("source").alias("sources"))
    return g.where(F.col("sources") >= least)


def roster(overlay: DataFrame, directory: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Both lists by name in any case: the overlay's entries win, what they leave open comes from the directory."""
    side = lambda d, mark: d.groupBy(F.lower(name).alias("_k")).agg(F.min(F.struct(name, *columns)).alias(mark))
    both = side(overlay, "_a").join(side(directory, "_b"), "_k", "full")
    return both.select(*[F.coalesce(f"_a.{c}", f"_b.{c}").alias(c) for c in (name, *columns)])


def resolve_in_tiers(links: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """links (source, target) -> source, target, state, entry: the first tier (name, entry) that knows the target decides.

    Several entries of that tier make the link ambiguous; none is picked.
    """
    rows = links.withColumn("_k", F.lower(F.trim("target")))
    for i, tier in enumerate(tiers):
        named = tier.groupBy(F.lower(F.trim("name")).alias("_k")).agg(F.count_distinct("entry").alias(f"_n{i}"), F.min("entry").alias(f"_e{i}"))
        rows = rows.join(named, "_k", "left")
    n = F.coalesce(*[F.col(f"_n{i}") for i in range(len(tiers))])
    entry = reduce(lambda rest, i: F.when(F.col(f"_n{i}").isNotNull(), F.col(f"_e{i}")).otherwise(rest), reversed(range(len(tiers))), F.lit(None))
    state = F.when(n.isNull(), "unresolved").when(n > 1, "ambiguous").otherwise("resolved")
    return rows.select("source", "target", state.alias("state"), F.when(n == 1, entry).alias("entry"))


def corpus(members: DataFrame, excluded: DataFrame) -> DataFrame:
    """members (entry, role) -> one row for each entry with its best role; excluded entries (entry) go first."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    return members.join(excluded.select("entry").distinct(), "entry", "left_anti").groupBy("entry").agg(F.min_by("role", rank).alias("role"), F.count_distinct("role").alias("roles"))


def free_numbers(taken: DataFrame, parent: str, number: str, most: int = 99) -> DataFrame:
    """(parent, number): numbers from 1 to `most` that a parent's rows leave free."""
    every = taken.select(parent).distinct().select(parent, F.explode(F.sequence(F.lit(1), F.lit(most))).alias(number))
    return every.join(taken.select(parent, F.col(number).cast("int").alias(number)).distinct(), [parent, number], "left_anti")


def renumbered(taken: DataFrame, parent: str, number: str, at: int) -> DataFrame:
    """(parent, number, moved_to): to free number `at`, the run of numbers without a gap that begins there moves up by one."""
    own = taken.select(parent, F.col(number).cast("int").alias(number)).where(F.col(number) >= at).distinct()
    place = F.row_number().over(Window.partitionBy(parent).orderBy(number))
    return own.withColumn("_p", place).where(F.col(number) == at + F.col("_p") - 1).select(parent, number, (F.col(number) + 1).alias("moved_to"))


def candidate_score(title: Column, query: str, by_author: Column | None = None, years_off: Column | None = None) -> Column:
    """How well a catalogue title answers a query: whole, as a phrase with few other words, or by its beginning."""
    words = [w for w in title_key_of(query).split(" ") if w]
    key = title_key(title)
    q = F.lit(" ".join(words))
    own = F.filter(F.split(key, " "), lambda w: w != "")
    share = F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), own)) / F.lit(float(max(1, len(set(words)))))
    surplus = F.greatest(F.lit(SURPLUS_FLOOR), F.greatest(F.lit(0), F.size(own) - len(words)) * SURPLUS)
    phrase = F.contains(F.concat(F.lit(" "), key, F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" ")))
    score = F.when(key == q, WHOLE).otherwise(F.when(phrase, PHRASE).otherwise(0.0) + SHARE * share + F.when(F.startswith(key, q), PREFIX).otherwise(0.0) + surplus)
    if by_author is not None:
        score = score + F.when(F.coalesce(by_author, F.lit(False)), 35.0).otherwise(0.0)
    if years_off is not None:
        off = F.abs(years_off)
        score = score + F.when(off.isNull(), 0.0).when(off == 0, 20.0).when(off == 1, 8.0).otherwise(-10.0)
    return score


def title_key_of(text: str) -> str:
    """A query's title key, made by the same rule."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in "".join(map(folded_character, text))).split())


def retained_rare_words(source: Column, cleaned: Column, least_length: int = 7) -> dict[str, Column]:
    """Long words that the source has once, and the share of them that the cleaned text still has; null without such words."""
    words = F.filter(tokens(source), lambda w: F.length(w) >= least_length)
    count = lambda w: F.size(F.filter(words, lambda x: x == w))
    rare = F.filter(F.array_distinct(words), lambda w: count(w) == 1)
    held = F.size(F.array_intersect(rare, tokens(cleaned)))
    return {"rare": F.size(rare), "retention": F.when(F.size(rare) > 0, held / F.size(rare))}


def best_window_share(needle: Column, text: Column) -> Column:
    """The most that a window as long as the needle holds of its distinct words; null without words."""
    want, have = F.array_distinct(tokens(needle)), tokens(text)
    size = F.size(tokens(needle))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(have) - size + 1), F.greatest(F.lit(1), F.floor(size / 2).cast("int")))
    shares = F.transform(starts, lambda i: F.size(F.array_intersect(want, F.slice(have, i, size))) / F.size(want))
    return F.when(F.size(want) > 0, F.array_max(shares))


def acquisition_quality(status: Column, text: Column, least: int = 120) -> dict[str, Column]:
    """1 less what speaks against a fetched page: its status, little text, and walls of several kinds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    faults = {
        "status": (~F.coalesce(status.between(200, 299), F.lit(False)), 0.5),
        "short_text": (F.length(F.trim(low)) < least, 0.3),
        "bot_wall": (low.rlike("captcha|verify you are human|unusual traffic"), 0.5),
        "login_wall": (low.rlike("sign in to continue|log in to continue|please log in"), 0.3),
        "script_wall": (low.rlike("enable javascript|javascript is required"), 0.3),
    }
    loss = reduce(lambda a, b: a + b, [F.when(hit, cost).otherwise(0.0) for hit, cost in faults.values()])
    names = F.array_compact(F.array(*[F.when(hit, F.lit(n)) for n, (hit, _) in faults.items()]))
    return {"quality": F.round(F.greatest(F.lit(0.0), 1.0 - loss), 2), "faults": names}


def cited_lines(docs: DataFrame, id_: str, text: str, least: int = 20, longest: int = 300) -> DataFrame:
    """(url, id, line_no, excerpt): the first line with each URL that also says something, over all documents."""
    lines = docs.where(F.contains(F.col(text), F.lit("http"))).select(F.col(id_).alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    url = F.regexp_replace(F.regexp_extract("line", "https?://[^\\s<>\"')\\]]+", 0), "[.,;:]+$", "")
    rest = F.length(F.regexp_replace(F.regexp_replace("line", "https?://[^\\s<>\"')\\]]+", ""), "[^A-Za-z0-9]", ""))
    rows = lines.withColumn("url", url).where((F.col("url") != "") & (rest >= least))
    best = F.min(F.struct("id", "line_no", F.substring(F.trim("line"), 1, longest).alias("excerpt")))
    return rows.groupBy("url").agg(best.alias("x")).select("url", "x.id", (F.col("x.line_no") + 1).alias("line_no"), "x.excerpt")


def claim_units(claims: DataFrame, evidence: DataFrame, sources: DataFrame, flagged: DataFrame, unsupported: bool = False) -> DataFrame:
    """claims (claim_id, evidence_ids) with evidence (evidence_id, source_id) and sources (source_id, url).

    Flagged claims and evidence (id) go. Claims left without evidence go too, unless asked for. The
    URL is that of the first evidence in the claim's order which has one.
    """
    ok = claims.join(flagged.select(F.col("id").alias("claim_id")), "claim_id", "left_anti")
    refs = ok.select("claim_id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(flagged.select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti")
    held = refs.join(evidence, "evidence_id").join(sources, "source_id", "left")
    g = held.groupBy("claim_id").agg(F.count("*").alias("supports"), F.min_by("url", F.when(F.col("url") != "", F.col("pos"))).alias("url"))
    out = ok.select("claim_id").join(g, "claim_id", "left" if unsupported else "inner")
    return out.select("claim_id", F.coalesce("supports", F.lit(0).cast("long")).alias("supports"), "url")
