"""Packing of a long sequence into packets of a token budget, and its reduction level by level.

A packet takes rows in order until the next one would pass the budget; a row that is larger than the budget is a packet of
its own. Where a packet ends depends on where it began, so the sequence is cut in runs (range partitions with prefix
sums). The first packet that begins in a run begins within the run's first `target` tokens; for each such row the run says
where the packet after the run's last one begins. These few rows are a table of steps, which doubling follows from the
first row of all. Then each run knows its first packet, and cuts itself. No task sees more than one run.

Null counts of tokens are 0. Rows of equal order are packed in any order, so their packets are defined only if the order is
unique. An empty table has no packets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import drop_stored, stored


def _nexts(tokens: np.ndarray, target: int) -> np.ndarray:
    """For a packet that begins at each row, the row at which the next one begins; the number of rows if that is beyond them."""
    upto = np.cumsum(tokens)
    return np.maximum(np.searchsorted(upto, upto - tokens + target, side="right"), np.arange(len(tokens)) + 1)


def _steps(target: int, order: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        tokens, n = rows["tokens"].to_numpy(), len(rows)
        base, first = int(rows["tokens_ahead"].iloc[0]), int(rows["rows_ahead"].iloc[0])
        before = np.cumsum(tokens) - tokens
        nexts, last = _nexts(tokens, target).tolist(), list(range(n))
        for i in range(n - 1, -1, -1):
            if nexts[i] < n:
                last[i] = last[nexts[i]]
        entry = np.flatnonzero(before <= target)
        final = np.array(last)[entry]
        large = tokens[final] > target
        return pd.DataFrame({
            "run": int(rows["run"].iloc[0]), "row": first + entry, "low": base + before[entry], "high": base + (before + tokens)[entry],
            "to_row": pd.Series(np.where(large, first + n, -1)), "reach": pd.Series(np.where(large, -1, base + before[final] + target)),
        })

    return run


def _cut(target: int, order: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        first = rows["first_row"].iloc[0]
        begins = np.zeros(len(rows), dtype="int64")
        if not pd.isna(first):
            at = int(first) - int(rows["rows_ahead"].iloc[0])
            begins[at] = 1
            nexts = _nexts(rows["tokens"].to_numpy()[at:], target)
            k = int(nexts[0])
            while k < len(nexts):
                begins[at + k] = 1
                k = int(nexts[k])
        rows["local"] = np.cumsum(begins)
        return rows[[*order, "tokens", "run", "local"]]

    return run


def packed(rows: DataFrame, order: list[str], tokens: Column, target: int) -> DataFrame:
    """(order, tokens, packet): packets are numbered from 0 in order. A stored table."""
    narrow = stored(rows.select(*order, F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens")), "pack-rows")
    runs = stored(narrow.repartitionByRange(*order).withColumn("run", F.spark_partition_id()), "pack-runs")
    ahead = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    totals = runs.groupBy("run").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    totals = stored(totals.select("run", "sum", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_ahead"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("tokens_ahead")), "pack-totals")
    placed = runs.join(totals.drop("sum"), "run")
    steps = placed.groupBy("run").applyInPandas(_steps(target, order), "run int, row long, low long, high long, to_row long, reach long")
    steps = stored(steps, "pack-steps")
    whole = totals.select(F.col("run").alias("in_run"), F.col("tokens_ahead").alias("from"), (F.col("tokens_ahead") + F.col("sum")).alias("until"))
    # a reach lies in one run, and there on one of its first rows
    met = steps.where("reach >= 0").join(whole, (F.col("reach") >= F.col("from")) & (F.col("reach") < F.col("until"))).select(F.col("row").alias("a"), "in_run", "reach")
    heads = steps.select(F.col("run").alias("in_run"), F.col("row").alias("b"), "low", "high")
    far = met.join(heads, "in_run").where("low <= reach and reach < high").select("a", "b")
    hops = stored(far.union(steps.where("to_row >= 0").select(F.col("row").alias("a"), F.col("to_row").alias("b"))), "pack-hops")
    begun = stored(steps.where("row = 0").select("row"), "pack-begun")
    while not hops.isEmpty():
        old = hops, begun
        begun = stored(begun.union(begun.join(hops, F.col("row") == F.col("a")).select(F.col("b").alias("row"))).distinct(), "pack-begun")
        hops = stored(hops.join(hops.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "pack-hops")
        drop_stored(*old)
    firsts = steps.join(begun, "row").groupBy("run").agg(F.min("row").alias("first_row"))
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in order) + ", tokens long, run int, local long"
    cut = stored(placed.join(firsts, "run", "left").groupBy("run").applyInPandas(_cut(target, order), schema), "pack-cut")
    packets = cut.groupBy("run").agg(F.max("local").alias("k")).select("run", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("packets_ahead"))
    return stored(cut.join(packets, "run").select(*order, "tokens", (F.col("packets_ahead") + F.col("local") - 1).alias("packet")), "packed")


def reduced(rows: DataFrame, order: str, tokens: Column, target: int, budget: int, memo: Callable[[Column, Column], Column]) -> DataFrame:
    """(level, packet, first, items, tokens, memo_tokens): levels of packets until the memos of one fit the budget.

    memo(tokens, items) is how long a packet's memo is. The memos of a level, in order, are the rows of the next. A level that does not come out
    shorter than the one before ends the reduction, since no further one would fit. `first` is a packet's first row, or first memo.
    """
    now, at, made, total = rows.select(F.col(order).alias("item"), tokens.alias("tokens")), 1, [], None
    while True:
        cut = packed(now, ["item"], F.col("tokens"), target)
        level = cut.groupBy("packet").agg(F.min("item").alias("first"), F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
        level = stored(level.withColumn("memo_tokens", memo(F.col("tokens"), F.col("items")).cast("long")), f"level-{at}")
        made.append(level.select(F.lit(at).cast("long").alias("level"), "packet", "first", "items", "tokens", "memo_tokens"))
        left = level.agg(F.coalesce(F.sum("memo_tokens"), F.lit(0))).first()[0]
        if left <= budget or (total is not None and left >= total):
            break
        now, at, total = level.select(F.col("packet").alias("item"), F.col("memo_tokens").alias("tokens")), at + 1, left
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out
