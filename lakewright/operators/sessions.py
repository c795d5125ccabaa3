"""Context use of logged sessions, filters over them, and how far files' birth times agree with stated dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_space, fold, once, trim_all

#: A session without an answer has this model (a fixed value).
UNKNOWN_MODEL = "[unknown]/[unknown]"


def session_contexts(entries: DataFrame, windows: DataFrame) -> DataFrame:
    """One row for each session.

    entries: session, place (their order), at, kind (user, assistant, compaction), model, tokens (those in the context).
    windows: model, window. most_tokens is the largest context; first_tokens the one at the first compaction,
    or the last one if there is none. Shares are of the last model whose window is known.
    """
    first = entries.where("kind = 'compaction'").groupBy("session").agg(F.min("place").alias("cut"))
    rows = entries.join(windows, "model", "left").join(first, "session", "left")
    kind = F.col("kind")
    counted = (kind != "user") & F.col("tokens").isNotNull()
    early = counted & (F.col("cut").isNull() | (F.col("place") <= F.col("cut")))
    known = (kind == "assistant") & F.col("window").isNotNull()
    out = rows.groupBy("session").agg(
        F.coalesce(F.max_by(F.when(kind == "assistant", F.col("model")), F.when(kind == "assistant", F.col("place"))), F.lit(UNKNOWN_MODEL)).alias("model"),
        F.max_by("window", F.when(known, F.col("place"))).alias("window"),
        F.max(F.when(counted, F.col("tokens"))).alias("most_tokens"),
        F.max_by("tokens", F.when(early, F.col("place"))).alias("first_tokens"),
        F.count_if(kind == "user").alias("turns"),
        F.count_if(kind == "assistant").alias("answers"),
        F.count_if(kind == "compaction").alias("compactions"),
        ((F.unix_micros(F.max(F.col("at").cast("timestamp"))) - F.unix_micros(F.min(F.col("at").cast("timestamp")))) / 60e6).alias("minutes"),
    )
    share = lambda c: F.col(c) / F.col("window") * 100
    return out.withColumn("most_share", share("most_tokens")).withColumn("first_share", share("first_tokens"))


def context_summary(sessions: DataFrame, by: str = "model") -> DataFrame:
    """Averages, exact medians and counts of session_contexts for each value of `by`."""
    middle = lambda c: F.round(F.percentile(c, F.lit(0.5)), 4)
    over = [F.count_if(F.col("most_share") >= n).alias(f"over_{n}") for n in (80, 90, 100)]
    return sessions.groupBy(by).agg(
        F.count("*").alias("sessions"),
        F.sum("answers").alias("answers"),
        F.round(F.avg("turns"), 4).alias("avg_turns"),
        F.round(F.avg("minutes"), 4).alias("avg_minutes"),
        F.round(F.avg("most_tokens"), 4).alias("avg_most_tokens"),
        middle("most_tokens").alias("median_most_tokens"),
        F.round(F.avg("most_share"), 4).alias("avg_most_share"),
        middle("most_share").alias("median_most_share"),
        middle("first_share").alias("median_first_share"),
        F.count("most_share").alias("known"),
        F.count_if(F.col("compactions") > 0).alias("compacted"),
        F.sum("compactions").alias("compactions"),
        F.round(F.count_if(F.col("compactions") > 0) / F.count("*") * 100, 4).alias("compaction_rate"),
        *over,
    )


def filter_sessions(sessions: DataFrame, commands: DataFrame, model: str = "", prefixes: tuple[str, ...] = (), contains: tuple[str, ...] = ()) -> DataFrame:
    """Sessions whose model holds a text and begins with one of prefixes, and one of whose commands holds one of contains; case does not count.

    sessions: session, model; commands: session, command. An empty filter lets all pass.
    """
    either = lambda tests: reduce(lambda a, b: a | b, tests)
    name = F.lower("model")
    out = sessions.where(name.contains(model.lower())) if model else sessions
    if prefixes:
        out = out.where(either([name.startswith(p.lower()) for p in prefixes]))
    if contains:
        hit = commands.where(either([F.lower("command").contains(c.lower()) for c in contains])).select("session").distinct()
        out = out.join(hit, "session", "left_semi")
    return out


def birth_calibration(files: DataFrame, birth: str, stated: str, most: int = 5) -> DataFrame:
    """One row: how often the birth date (null: unknown) agrees with one of the stated dates (an array), and the days that most files share."""
    gap = F.array_min(F.transform(stated, lambda d: F.abs(F.datediff(d, F.col(birth)))))
    rows = files.select(F.col(birth).alias("day"), gap.alias("gap"))
    counts = rows.agg(
        F.count("*").alias("files"), F.count("day").alias("with_birth"), F.count("gap").alias("labelled"), F.count_if(F.col("gap") == 0).alias("same_day"), F.count_if(F.col("gap") <= 1).alias("within_a_day")
    )
    best = rows.where("day is not null").groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(most)
    days = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "day"))).alias("days"))  # `most` rows
    out = counts.crossJoin(days)  # a row each
    largest = -F.try_element_at("days", F.lit(1))["order"]
    return out.select(
        "files", "with_birth", "labelled", "same_day", "within_a_day",
        F.round(F.try_divide("same_day", "labelled"), 4).alias("agreement"),
        F.round(F.try_divide("within_a_day", "labelled"), 4).alias("loose_agreement"),
        F.round(F.try_divide(largest, F.col("with_birth")), 4).alias("clustered"),
        F.transform("days", lambda x: F.concat(x["day"].cast("string"), F.lit("="), (-x["order"]).cast("string"))).alias("top_days"),
    )


def relevant_text(text: Column, words: list[str], most: int) -> Column:
    """The paragraphs of a text that hold most of the words, in their own order, within `most` characters; the first one counts two more.

    Better paragraphs are taken first, one that no longer fits is passed over. A short text stays whole; a single
    paragraph is cut after its last sentence or line if that lies beyond six tenths. A null text is empty.
    """
    asked = sorted({w for w in words if len(w) >= 4})
    # a text and what is made of it are bound as arguments, so that each is made once, and only where it is needed
    return once(F.coalesce(text, F.lit("")), lambda whole: _shortened(whole, asked, most))


def _shortened(whole: Column, asked: list[str], most: int) -> Column:
    size = lambda c: F.length(collapse_space(c))
    # the beginning of a long text tells already that it is too long
    short = (size(F.substring(whole, 1, 2 * most)) <= most) & (size(whole) <= most)
    # the text is folded as a whole: no line end comes or goes by it, so its pieces stay the same
    pieces = F.zip_with(F.split(whole, "\n{2,}"), F.split(fold(whole), "\n{2,}"), lambda p, f: F.struct(trim_all(p).alias("p"), f.alias("f")))
    parts = F.filter(pieces, lambda x: x["p"] != "")
    several = once(parts, lambda x: F.when(F.size(x) <= 1, once(trim_all(whole), lambda own: _cut(own, most))).otherwise(_best_parts(x, asked, most)))
    return F.when(short, trim_all(whole)).otherwise(several)


def _cut(own: Column, most: int) -> Column:
    head = F.substring(own, 1, most)
    end = F.length(F.regexp_extract(head, "(?s)^(.*)(?:\\n|\\. )", 1))
    cut = F.concat(trim_all(F.when(end > most * 0.6, F.substring(head, F.lit(1), end + 1)).otherwise(head)), F.lit("\n\n[truncated]"))
    return F.when(F.length(own) <= most, own).otherwise(cut)


def _best_parts(parts: Column, asked: list[str], most: int) -> Column:
    """parts: array of (p, f), paragraphs and their folded texts."""
    # runs of other characters count as one space, which a word of letters and digits does not meet
    words_only = all(w.isalnum() for w in asked)
    key = lambda f: f if words_only else F.trim(F.regexp_replace(f, "[^\\p{L}\\p{N}]+", " "))
    score = lambda f, i: once(key(f), lambda k: reduce(lambda a, w: a + k.contains(w).cast("int"), asked, F.when(i == 0, 2).otherwise(0)))
    ranked = F.array_sort(F.transform(parts, lambda x, i: F.struct((-score(x["f"], i)).alias("order"), i.alias("at"), (F.length(x["p"]) + 2).alias("size"))))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        full = (s["used"] >= most) | ((s["used"] + x["size"] > most) & (F.size(s["taken"]) > 0))
        return F.when(full, s).otherwise(F.struct((s["used"] + x["size"]).alias("used"), F.array_append(s["taken"], x["at"]).alias("taken")))

    taken = F.array_sort(F.aggregate(ranked, start, step)["taken"])
    return trim_all(F.substring(F.array_join(F.transform(taken, lambda i: F.get(parts, i)["p"]), "\n\n"), 1, most))
