"""Record-level rules: scopes, overlays, schedules, evidence decisions, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(focus: str, text: Column, kinds: list[str], kind: Column, when: Column, first: str, last: str) -> Column:
    """Focus text held (any case), kind listed, date in an inclusive range; a missing date fails."""
    held = F.contains(F.lower(text), F.lit(focus.lower()))
    return F.coalesce(held & kind.isin(kinds) & when.between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")), F.lit(False))


def scope_decision(text: Column, exclude: str, include: str, focus: str, related: str) -> Column:
    """The first rule that matches: excluded, included, focus, related; else dropped."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(exclude), "excluded").when(low.rlike(include), "included").when(low.rlike(focus), "focus").when(low.rlike(related), "related").otherwise("dropped")


def grep(docs: DataFrame, id_: str, text: str, pattern: str, context: int = 0, cap: int = 500) -> DataFrame:
    """(id, line_no, line, is_match): matching lines, with `context` lines on both sides once each; lines are cut to `cap` characters."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    hit = F.transform(lines, lambda x: x.rlike(pattern))
    n = F.size(lines)
    near = lambda i: F.exists(F.sequence(F.greatest(F.lit(0), i - context), F.least(n - 1, i + context)), lambda j: F.get(hit, j))
    marked = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), F.substring(x, 1, cap).alias("line"), F.get(hit, i).alias("is_match"), near(i).alias("near")))
    out = docs.where(F.col(text).rlike(pattern)).select(F.col(id_).alias("id"), F.explode(F.filter(marked, lambda m: m["near"])).alias("m"))
    return out.select("id", "m.line_no", "m.line", "m.is_match")


def trigger_cards(cards: DataFrame, material: str, most: int) -> DataFrame:
    """cards (card, tier, triggers array): all of tier "always", then the `most` others with the most triggers in the material."""
    hits = F.size(F.filter("triggers", lambda t: F.contains(F.lit(material.lower()), F.lower(t))))
    rows = cards.withColumn("hits", hits).where("tier = 'always' or hits > 0")
    rank = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("hits"), "card"))
    return rows.withColumn("r", rank).where((F.col("tier") == "always") | (F.col("r") <= most)).select("card", "tier", "hits")


def overlay(base: DataFrame, owned: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with the human-owned columns of a register where it has the key."""
    marks = owned.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = base.join(marks, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c) if c in base.columns else F.col(f"_{c}"))
    return out.drop(*[f"_{c}" for c in columns])


def schedule(rows: DataFrame, source: tuple[str, str], forecast: tuple[str, str]) -> DataFrame:
    """Adds start, stop, days and basis: source dates before forecast ones; days count both ends."""
    start, stop = F.coalesce(source[0], forecast[0]), F.coalesce(source[1], forecast[1])
    basis = F.when(F.col(source[0]).isNotNull() | F.col(source[1]).isNotNull(), "source").when(start.isNotNull() | stop.isNotNull(), "forecast").otherwise("none")
    a, b = F.coalesce(start, stop), F.coalesce(stop, start)
    return rows.withColumn("start", F.to_date(a)).withColumn("stop", F.to_date(b)).withColumn("days", F.datediff("stop", "start") + 1).withColumn("basis", basis)


def evidence_decision(evidence: DataFrame, key: str) -> DataFrame:
    """evidence (key, rank, date, path): the best rank decides, then the earliest date, then the path.

    Several dates at the best rank are a contradiction and lower the confidence.
    """
    known = evidence.where("date is not null")
    best = known.groupBy(key).agg(F.min("rank").alias("_b"))
    top = known.join(best, key).where("rank = _b")
    out = top.groupBy(key).agg(F.min(F.struct("date", "path")).alias("x"), F.count_distinct("date").alias("dates"), F.first("rank").alias("rank"))
    confidence = F.when(F.col("dates") > 1, "medium").when(F.col("rank") == 0, "high").otherwise("low")
    return out.select(key, "x.date", "x.path", confidence.alias("confidence"))


def convention_vote(first: Column, second: Column) -> dict[str, Column]:
    """Aggregates: numeric dates that only one order allows vote for it; both kinds conflict and give null."""
    month, day = F.count_if((second > 12) & (first <= 12)), F.count_if((first > 12) & (second <= 12))
    return {"month_first": month, "day_first": day, "convention": F.when((month > 0) & (day == 0), "month first").when((day > 0) & (month == 0), "day first")}


def pass_summary(attempts: DataFrame, group: str, item: str, ok: Column) -> DataFrame:
    """Items that pass in all attempts, their share, and items with both outcomes."""
    items = attempts.groupBy(group, item).agg(F.bool_and(ok).alias("all_ok"), F.bool_or(ok).alias("any_ok"))
    out = items.groupBy(group).agg(F.count("*").alias("items"), F.count_if("all_ok").alias("passed"), F.count_if(F.col("any_ok") & ~F.col("all_ok")).alias("unstable"))
    return out.withColumn("rate", F.col("passed") / F.col("items"))


def undecided(summary: DataFrame, floor: float) -> DataFrame:
    """Groups within one item of the floor, or with unstable items."""
    return summary.where((F.abs(F.col("rate") - floor) <= 1.0 / F.col("items")) | (F.col("unstable") > 0))


def pair_audit(rows: DataFrame, id_: str, key: str, claims: str) -> DataFrame:
    """Pairs i < j of one key where a side claims nothing, or both claim the same single thing."""
    a = rows.select(F.col(key).alias("k"), F.col(id_).alias("a"), F.col(claims).alias("ca"))
    b = rows.select(F.col(key).alias("k"), F.col(id_).alias("b"), F.col(claims).alias("cb"))
    none = (F.size("ca") == 0) | (F.size("cb") == 0)
    return a.join(b, "k").where("a < b").where(none | ((F.size("ca") == 1) & (F.col("ca") == F.col("cb")))).select("k", "a", "b")


def pair_classes(rows: DataFrame, id_: str, key: str, claims: str) -> DataFrame:
    """(k, n, silent, pairs): rows of a key, those without a claim, and how many pairs pair_audit gives; no pair is made.

    Pairs of a set are (n * n - sum over ids of their rows squared) / 2. A pair counts unless both sides claim
    something; then it counts if both claim the same single thing.
    """
    c = F.col(claims)
    one = rows.select(F.col(key).alias("k"), F.col(id_).alias("id"), c.alias("c")).where("k is not null and id is not null and c is not null")
    one = one.groupBy("k", "c", "id").agg(F.count("*").alias("m"))
    claimed = F.when(F.size("c") > 0, F.col("m")).otherwise(0)
    ids = one.groupBy("k", "id").agg(F.sum("m").alias("m"), F.sum(claimed).alias("claimed"))
    pairs = lambda v: (F.sum(v) * F.sum(v) - F.sum(F.col(v) * F.col(v))) / 2
    whole = ids.groupBy("k").agg(F.sum("m").alias("n"), (F.sum("m") - F.sum("claimed")).alias("silent"), (pairs("m") - pairs("claimed")).alias("free"))
    same = one.where("size(c) = 1").groupBy("k", "c").agg(pairs("m").alias("same")).groupBy("k").agg(F.sum("same").alias("same"))
    return whole.join(same, "k", "left").select("k", "n", "silent", (F.col("free") + F.coalesce("same", F.lit(0.0))).cast("long").alias("pairs"))


def negation_conflicts(members: DataFrame, cluster: str, doc: str, negated: str) -> DataFrame:
    """Clusters of several documents, and whether negated and plain members meet."""
    g = members.groupBy(cluster).agg(F.count("*").alias("size"), F.count_distinct(doc).alias("docs"), F.count_distinct(negated).alias("kinds"))
    return g.select(cluster, "size", (F.col("docs") > 1).alias("cross_document"), (F.col("kinds") > 1).alias("mixed_negation"))


def diverse_first(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The best row of each group first, then the rest; `most` rows in all. Adds place."""
    turn = F.when(F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1, 0).otherwise(1)
    top = rows.withColumn("_turn", turn).orderBy("_turn", *order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_turn", *order))).drop("_turn")


def gaps_and_conflicts(rows: DataFrame, id_: str, required: list[str]) -> DataFrame:
    """(id, missing): a row for each required column that is blank."""
    checks = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required]))
    return rows.select(F.col(id_).alias("id"), F.explode(checks).alias("missing"))


def telemetry(prompt: Column, cached: Column, written: Column, generated: Column, ms: Column) -> dict[str, Column]:
    """Fresh input tokens (never negative), cache share and tokens a second."""
    zero = F.lit(0).cast("long")
    fresh = F.greatest(zero, prompt - F.coalesce(cached, zero) - F.coalesce(written, zero))
    return {"fresh": fresh, "cache_share": F.when(prompt > 0, F.coalesce(cached, zero) / prompt), "per_second": F.when(ms > 0, generated * 1000.0 / ms)}
