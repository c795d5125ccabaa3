"""Gaps, sessions, islands, budgets and other ordered operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import keep_rounds


def gaps(df: DataFrame, by: str, at: str, key: str, seconds: int = 60) -> DataFrame:
    """Rows that follow the previous one of their group by more than `seconds`."""
    w = Window.partitionBy(by).orderBy(at, key)
    wait = F.timestamp_diff("SECOND", F.lag(at).over(w), F.col(at))
    return df.withColumn("gap", wait).where(F.col("gap") > seconds)


def sessions(df: DataFrame, by: str, at: str, key: str, seconds: int) -> DataFrame:
    """Adds session: 1, 2, … within a group; a new one begins after a wait of more than `seconds`."""
    w = Window.partitionBy(by).orderBy(at, key)
    wait = F.timestamp_diff("SECOND", F.lag(at).over(w), F.col(at))
    new = (F.coalesce(wait, F.lit(seconds + 1)) > seconds).cast("int")
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def islands(df: DataFrame, by: str, at: str, value: str, text: str) -> DataFrame:
    """Consecutive rows of one value as one: (by, value, first, rows, text joined in order)."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    run = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(text).alias("t"))))
    return run.groupBy(by, "_run", value).agg(F.min(at).alias("first"), F.count("*").alias("rows"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text")).drop("_run")


def repeats(df: DataFrame, keys: list[str], is_error: Column, plain: int = 3, with_error: int = 2) -> DataFrame:
    """Groups of equal calls: `plain` or more, or `with_error` or more with an error among them."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(is_error).alias("errors"))
    return g.where((F.col("n") >= plain) | ((F.col("n") >= with_error) & (F.col("errors") > 0)))


def packed(df: DataFrame, by: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Adds packet: items of a group in order, a new packet where the next item would exceed the budget.

    One fold over each group's sizes, which have to fit in a row.
    """
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("_size", size.cast("long"))
    sizes = rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_size"))), lambda x: x["_size"]).alias("sizes"))

    def step(s, x):
        full = (s["used"] > 0) & (s["used"] + x > budget)
        packet = F.when(full, s["packet"] + 1).otherwise(s["packet"])
        return F.struct(F.when(full, x).otherwise(s["used"] + x).alias("used"), packet.alias("packet"), F.array_append(s["out"], packet).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(1).alias("packet"), F.array().cast("array<int>").alias("out"))
    plan = sizes.select(by, F.posexplode(F.aggregate("sizes", start, step)["out"]).alias("_p", "packet")).withColumn("_at", F.col("_p") + 1)
    return rows.join(plan.drop("_p"), [by, "_at"]).drop("_at", "_size")


def budget_suffix(df: DataFrame, by: str, order: str, size: Column, budget: int) -> DataFrame:
    """The longest run of last rows of each group whose sizes fit the budget, and the row that crosses it."""
    after = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_used", F.coalesce(F.sum(size).over(after), F.lit(0))).where(F.col("_used") < budget).drop("_used")


def latest(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The last row of each key: later results supersede earlier ones."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")


def counter_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Adds unique_name: the second and later rows of a case-folded name get " (2)", " (3)", …"""
    k = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    return df.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(name, F.lit(" ("), k.cast("string"), F.lit(")"))))


def daily_groups(df: DataFrame, at: str, kind: str, least: int = 2) -> DataFrame:
    """(day, kind) groups of `least` or more rows with their time span."""
    g = df.groupBy(F.to_date(at).alias("day"), kind).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return g.where(F.col("n") >= least)


def majority_ending(df: DataFrame, id_: str, text: str, ending: str = ".") -> DataFrame:
    """(id, text): values of several words get or lose the ending as most of them have it; even or agreed columns stay."""
    many = F.trim(text).rlike("\\s")
    has = F.endswith(F.col(text), F.lit(ending))
    votes = df.agg(F.count_if(many & has).alias("y"), F.count_if(many & ~has).alias("n"))
    out = df.crossJoin(votes)
    add = many & ~has & (F.col("y") > F.col("n")) & (F.col("n") > 0)
    cut = many & has & (F.col("n") > F.col("y")) & (F.col("y") > 0)
    fixed = F.when(add, F.concat(F.col(text), F.lit(ending))).when(cut, F.substring(F.col(text), F.lit(1), F.length(text) - len(ending))).otherwise(F.col(text))
    return out.select(id_, fixed.alias(text))


def marked_order(df: DataFrame, by: str, order: str, at: str) -> DataFrame:
    """Adds in_order: whether a row's time is not before that of the row ahead of it; drops the time."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("in_order", F.coalesce(F.lag(at).over(w) <= F.col(at), F.lit(True))).drop(at)


def cut_points(df: DataFrame, by: str, order: str, size: Column, valid: Column, budget: int) -> DataFrame:
    """(by, cut): the first valid row at or after the place from which on the last rows reach the budget.

    Where the whole group stays below it, or no valid row follows, the first valid row is the cut.
    """
    used = F.sum(size).over(Window.partitionBy(by).orderBy(F.desc(order)))
    rows = df.select(by, order, valid.alias("_valid"), used.alias("_used"))
    rows = rows.withColumn("_reached", F.max(F.when(F.col("_used") >= budget, F.col(order))).over(Window.partitionBy(by)))
    first = lambda ok: F.min(F.when(ok, F.col(order)))
    return rows.groupBy(by).agg(F.coalesce(first(F.col("_valid") & (F.col(order) >= F.col("_reached"))), first(F.col("_valid"))).alias("cut"))


def repeated_texts(df: DataFrame, by: str, order: str, text: str, least: int = 80) -> DataFrame:
    """(by, order, earlier): rows that hold the whole text, of `least` characters or more, of an earlier row of their group. For groups of bounded length."""
    long_ = df.where(F.length(text) >= least)
    a = long_.select(by, F.col(order).alias("earlier"), F.col(text).alias("_old"))
    b = long_.select(by, order, F.col(text).alias("_new"))
    hit = b.join(a, by).where((F.col("earlier") < F.col(order)) & F.contains("_new", "_old"))
    return hit.groupBy(by, order).agg(F.min("earlier").alias("earlier"))


def smoothed(df: DataFrame, by: str, order: list[str], observed: Column, prior: float, low: float, high: float, keep: float = 0.7) -> DataFrame:
    """(by, n, estimate): exponential smoothing over a group's values in order, each held within low and high."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*order, observed.alias("_o")))).alias("_s"))
    step = lambda s, x: F.lit(keep) * s + F.lit(1 - keep) * F.greatest(F.lit(low), F.least(F.lit(high), x["_o"]))
    return g.select(by, "n", F.aggregate("_s", F.lit(float(prior)), step).alias("estimate"))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the row number by keys over all rows: range partitions, each with the rows before it, so no task sorts everything."""
    keep_rounds(df.sparkSession)
    rows = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).checkpoint()
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", ahead.alias("_ahead"))  # a row for each partition
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return rows.join(parts, "_part").withColumn(name, (at + F.col("_ahead")).cast("long")).drop("_part", "_ahead")
