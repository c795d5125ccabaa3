"""Column functions over numbers, arrays, maps and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where the lengths differ or a vector is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def l2_normalize(a: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def letter_vector(c: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Counts of letters: a deterministic stand-in for an embedding."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in letters])


def bucket_label(c: Column, edges: list[float], labels: list[str]) -> Column:
    """labels[i] for values under edges[i]; the last label beyond all."""
    out = F.lit(labels[-1])
    for e, name in reversed(list(zip(edges, labels[:-1], strict=True))):
        out = F.when(c < e, F.lit(name)).otherwise(out)
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def quantile(c: Column, q: float) -> Column:
    """Exact, with linear interpolation; null of nothing."""
    return F.percentile(c, F.lit(q))


def mcnemar(improved: Column, regressed: Column) -> Column:
    """Exact two-sided p of discordant counts: twice the smaller binomial tail at one half, at most 1."""
    n, k = improved + regressed, F.least(improved, regressed)

    def step(s, i):
        term = F.when(i == 0, F.pow(F.lit(0.5), n)).otherwise(s["term"] * (n - i + 1) / i)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum")), step)["sum"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(1.0)


def valid_date(c: Column) -> Column:
    """A date from ISO text if the calendar has it, else null."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def months_in(start: Column, stop: Column) -> Column:
    """Months of an inclusive window that may wrap the year, in calendar order from its start."""
    n = F.pmod(stop - start, F.lit(12)) + 1
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.pmod(start - 1 + i, F.lit(12)) + 1).cast("int"))


def clock_seconds(c: Column) -> Column:
    """Seconds of [H:]MM:SS."""
    parts = F.transform(F.split(c, ":"), lambda x: x.try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 60 + x)
    return F.when(c.rlike("^([0-9]+:)?[0-9]{1,2}:[0-9]{2}$"), total)


def format_clock(c: Column) -> Column:
    """Seconds as H:MM:SS."""
    c = c.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(c / 3600), F.floor(F.pmod(c, F.lit(3600)) / 60), F.pmod(c, F.lit(60)))


def compact_map(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def text_from_positions(index: Column) -> Column:
    """A text from a map of words to their places."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(flat), lambda x: x["word"]), " ")
