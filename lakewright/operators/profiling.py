"""Profiles and roll-ups of tables. Every function takes and returns DataFrames; none collects rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank

_INTEGER = "^[+-]?(0|[1-9][0-9]*)$"
_NUMBER = "^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"


def cell_kind(c: Column) -> Column:
    """What a text cell looks like; null for blanks. Whole numbers with leading zeros are text."""
    s = F.trim(c)
    leading_zero = s.rlike("^[+-]?0[0-9]")
    return (
        F.when(is_blank(c), F.lit(None))
        .when(s.startswith("="), "formula")
        .when(F.lower(s).isin("true", "false"), "boolean")
        .when(s.rlike(_INTEGER), "integer")
        .when(s.rlike(_NUMBER) & ~leading_zero, "number")
        .when(F.coalesce(F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")).isNotNull(), F.lit(False)), "date")
        .otherwise("text")
    )


def as_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value): every cell of the named columns as text. One pass, no shuffle."""
    columns = columns or df.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).select("x.column", "x.value")


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind): the one kind of its cells; integers beside numbers are numbers; else mixed; empty without any."""
    kinds = as_long(df, columns).select("column", cell_kind(F.col("value")).alias("kind"))
    seen = kinds.groupBy("column").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    k = F.col("kinds")
    kind = F.when(F.size(k) == 0, "empty").when(F.size(k) == 1, k[0]).when(k == F.array(F.lit("integer"), F.lit("number")), "number").otherwise("mixed")
    return seen.select("column", kind.alias("kind"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, missing, distinct_values)."""
    v = F.when(~is_blank(F.col("value")), F.col("value"))
    return as_long(df, columns).groupBy("column").agg(F.count("*").alias("n"), F.sum(v.isNull().cast("long")).alias("missing"), F.count_distinct(v).alias("distinct_values"))


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column, value, n, rank): the k commonest values of each column; ties by value."""
    counts = as_long(df, columns).where(~is_blank(F.col("value"))).groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Minimum, maximum, mean and exact quartiles of a number by group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), q.alias("q"))
    return out.select(*by, "n", "low", "high", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def outliers(df: DataFrame, by: list[str], value: str, key: list[str], fence: float = 1.5, most: int = 10, least: int = 4) -> DataFrame:
    """The first `most` values of each group, ascending, beyond the quartiles by `fence` times their distance."""
    d = distribution(df, by, value).where(F.col("n") >= least)
    span = F.col("q3") - F.col("q1")
    bounds = d.select(*by, (F.col("q1") - fence * span).alias("lower"), (F.col("q3") + fence * span).alias("upper"))
    out = df.join(bounds, by).where((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value, *key))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).select(*by, *key, value, "rank")


def rare_values(df: DataFrame, column: str, share: float = 0.05, least: int = 10) -> DataFrame:
    """Values whose share is at most `share`, in a column of `least` rows or more with no more than half as many values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    out = counts.crossJoin(whole).where((F.col("total") >= least) & (F.col("kinds") * 2 <= F.col("total")) & (F.col("n") <= share * F.col("total")))
    return out.select(column, "n", "total")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier one in these columns; rows that are blank in all do not count."""
    filled = [~is_blank(F.col(c).cast("string")) for c in columns]
    some = filled[0]
    for f in filled[1:]:
        some = some | f
    return df.where(some).groupBy(*columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def rollup_counts(df: DataFrame, keys: list[str], sums: dict[str, str], distinct: str) -> DataFrame:
    """Sums by all keys, by each shorter list of them, and in total; null keys stand for "all"."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.count_distinct(distinct).alias("groups"), *[F.sum(c).alias(n) for n, c in sums.items()])


def coverage(df: DataFrame, by: str, status: Column, done: str) -> DataFrame:
    """Rows, those done, their share and whether all are, by group."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(status == done).alias("done"))
    return out.withColumn("share", F.col("done") / F.col("n")).withColumn("complete", F.col("done") == F.col("n"))


def status_report(df: DataFrame, status: str, expected: list[str]) -> DataFrame:
    """Counts of each expected status, zero included."""
    spark = df.sparkSession
    all_ = spark.createDataFrame([(s,) for s in expected], f"{status} string")
    return all_.join(df.groupBy(status).agg(F.count("*").alias("n")), status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def paired_deltas(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Means of shared keys before and after, and how many rose or fell."""
    both = before.select(*keys, F.col(value).alias("b")).join(after.select(*keys, F.col(value).alias("a")), keys)
    return both.agg(F.count("*").alias("shared"), F.avg("b").alias("mean_before"), F.avg("a").alias("mean_after"), F.count_if(F.col("a") > F.col("b")).alias("improved"), F.count_if(F.col("a") < F.col("b")).alias("regressed"))


def call_groups(calls: DataFrame, by: Column, success: Column, multi: Column, inflation: Column) -> DataFrame:
    """By group: calls, resolved ones (success is not null), successes, failures, multi calls, their rates (null of nothing), median and 95th percentile of the known inflations."""
    rows = calls.select(by.alias("key"), success.alias("ok"), F.coalesce(multi, F.lit(False)).alias("multi"), inflation.alias("x"))
    known = F.when(F.abs("x") < float("inf"), F.col("x"))
    out = rows.groupBy("key").agg(F.count("*").alias("calls"), F.count("ok").alias("resolved"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("multi").alias("multi"), F.percentile(known, F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select("key", "calls", "resolved", "success", "failed", (F.col("calls") - F.col("resolved")).alias("unresolved"), "multi", rate("multi", "calls").alias("multi_rate"), rate("success", "resolved").alias("success_rate"), F.get("q", F.lit(0)).alias("median_inflation"), F.get("q", F.lit(1)).alias("p95_inflation"))


def time_bucket(at: Column, unit: str, zone: str = "UTC") -> Column:
    """Day, week (its Monday) or hour of a time as a report's time zone has it, as text; unknown without a time."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), zone)
    text = {"day": F.date_format(local, "yyyy-MM-dd"), "week": F.date_format(F.date_trunc("week", local), "yyyy-MM-dd"), "hour": F.date_format(local, "HH:00")}[unit]
    return F.coalesce(text, F.lit("[unknown]"))


def read_buckets(reads: DataFrame, session: str, bucket: Column, partial: Column) -> DataFrame:
    """By time bucket: sessions, reads, full and partial ones, each for a session, and the median over sessions of their partial share. Two levels of sums."""
    rows = reads.select(F.col(session).alias("session"), bucket.alias("key"), F.coalesce(partial, F.lit(False)).alias("partial"))
    own = rows.groupBy("key", "session").agg(F.count("*").alias("reads"), F.count_if("partial").alias("partial"))
    out = own.groupBy("key").agg(F.count("*").alias("sessions"), F.sum("reads").alias("reads"), F.sum("partial").alias("partial"), F.percentile(F.col("partial") / F.col("reads"), F.lit(0.5)).alias("median_partial_rate"))
    each = lambda c: (c / F.col("sessions"))
    full = F.col("reads") - F.col("partial")
    return out.select("key", "sessions", "reads", full.alias("full"), "partial", each(F.col("reads")).alias("reads_per_session"), each(full).alias("full_per_session"), each(F.col("partial")).alias("partial_per_session"), "median_partial_rate")


def type_matrix(items: DataFrame, id_: str, kind: str, text: str, order: str, kinds: list[str]) -> DataFrame:
    """A row for each id and a column for each kind: the texts of that kind in order, joined by semicolons; empty without any.

    Kinds are stated, so the pivot needs no pass of its own. Items of other kinds count for nothing, but their ids have a row.
    """
    pick = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))), lambda x: x["t"]), "; ").alias(k)
    return items.groupBy(id_).agg(*[pick(k) for k in kinds])


def profile_lines(df: DataFrame, name: str, columns: list[str], common: int = 5) -> DataFrame:
    """(at, line): the Markdown profile of a table: its size, then a line for each column with type, missing and distinct values and the commonest ones."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\\s*\\n\\s*", " "), F.lit("|"), F.lit("\\|"))
    top = top_values(df, columns, common).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(cell(F.col("value")), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("v")))).alias("top"))
    rows = profile(df, columns).join(infer_types(df, columns), "column").join(top, "column", "left")
    index = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    values = F.coalesce(F.array_join(F.transform("top", lambda x: x["v"]), ", "), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", index.cast("string"), cell(F.col("column")), "kind", F.col("missing").cast("string"), F.col("distinct_values").cast("string"), values), F.lit(" |"))
    body = rows.select((index + 9).alias("at"), line.alias("line"))
    size = df.agg(F.count("*").alias("n"))
    head = ["# Data Profile", "", f"## Table: {name}", "", None, f"- Columns: {len(columns)}", "", "| # | Header | Inferred type | Missing | Unique | Common values |", "|---:|---|---|---:|---:|---|"]
    lines = F.array(*[F.concat(F.lit("- Data rows: "), F.col("n").cast("string")) if h is None else F.lit(h) for h in head])
    return size.select(F.posexplode(lines).alias("p", "line")).select((F.col("p") + 1).cast("long").alias("at"), "line").union(body)
