"""Mixing sources to target weights (DataFrame functions only).

Targets. Sources in code point order, null last, get weights 5, 2, 1, repeating. They share `share`
times the words of all documents by weight; a source stops at `cap` times its own words and the rest
is shared again. That is water-filling: with sources by rising cap per weight, the level is the
largest of (left to give) / (weight left).

Quotas. Each source's documents stand in a keyed permutation, its stream; the stream is read again
after its end. The documents whose middle lies before the target are taken, then one document is
added or left out if that comes closer to the target. Streams are cut into blocks of `block_words`.

Draw. A splitting tree halves the shards; at each node the left half's share of every source's blocks
is a multivariate hypergeometric draw, made by halving the sources as well, so quotas stay exact and each
shard is a fair sample. Shards then own disjoint runs of permuted blocks: a draw is one copy of one
document with its shard, block and place. A shard's blocks stand in a keyed order, and so do the rows of a
block. What the mix takes of a document is what its draws add up to.

Positions come from sums for each (source, key bucket), with about sqrt(rows) rows in a bucket, so a
source that holds a third of all rows is no single task's work. A source is one row of the small tables
(targets, quotas), which are sorted in one task. Null texts have size 0. Rows are told apart by a row
number, so repeated rows and null ids are documents of their own. An empty table gives an empty mix. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
BLOCK_WORDS = 4096
SHARDS = 16
SEED = "mix-1"


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """totals (source, source_size, n): one row for each source; adds sid, target. One row a source meets in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sid = F.row_number().over(by_name)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    out = totals.withColumn("sid", sid).withColumn("w", w).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    whole = Window.partitionBy()
    given = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - given) / weight_left
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return out.select("source", "sid", "source_size", "n", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def placed(docs: DataFrame, seed: str = SEED, keep: tuple = (), **goal) -> tuple[DataFrame, DataFrame]:
    """(rows with their place in their source's stream, sources with targets), both written."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in ("doc_id", *keep)])).alias("h"), *keep)
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-rows")
    keep = ("rid", *keep)
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = written(targets(totals, **goal), "mix-sources")
    buckets = F.ceil(F.col("n") / F.greatest(F.lit(500.0), F.sqrt("n")))
    part = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    s = sources.select(F.col("source").alias("_source"), "sid", "n")
    rows = rows.join(s, rows["source"].eqNullSafe(s["_source"])).select("doc_id", "sid", "size", "h", F.floor(part * buckets).alias("bucket"), *keep)
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words")
    sums = sums.select("sid", "bucket", ahead.alias("ahead"))
    own = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum("size").over(own) - F.col("size")).join(sums, ["sid", "bucket"])
    return written(rows.select("doc_id", "sid", "size", "h", (F.col("ahead") + F.col("before")).alias("before"), *keep), "mix-placed"), sources


def taken(rows: DataFrame, sources: DataFrame, keep: tuple = ()) -> DataFrame:
    """Adds source_size, target, copies: how often the mix takes each document."""
    s = sources.select("sid", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"))
    s = s.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = rows.join(s, "sid").withColumn("extra", F.col("before") + F.col("size") / 2.0 < F.col("rest"))
    gap = rows.groupBy("sid").agg((F.max("rest") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("gap"))
    gap = written(gap, "mix-gaps")  # a row for each source: small tables are sent to the rows, not rows to sources
    # of those that could change sides, the one whose size is nearest to the gap
    near = F.abs(F.abs("gap") - F.col("size"))
    fits = (near < F.abs("gap")) & (F.col("size") > 0) & F.when(F.col("gap") > 0, ~F.col("extra")).otherwise(F.col("extra"))
    other = rows.join(gap, "sid").where(fits).groupBy("sid").agg(F.min(F.struct(near.alias("near"), "h", "before")).alias("m"))
    other = written(other.select("sid", F.col("m.before").alias("turned")), "mix-turned")
    rows = rows.join(other, "sid", "left")
    flip = (F.col("size") > 0) & F.coalesce(F.col("before") == F.col("turned"), F.lit(False))
    copies = F.col("whole") + (F.col("extra") != flip).cast("long")
    return rows.select("doc_id", "sid", "size", "h", "before", "source_size", "target", copies.alias("copies"), *keep)


def _ln_factorial(x: Column) -> Column:
    x = x.cast("double")
    big = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(x < 2, 0.0).otherwise(big)


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of `marked` are among `drawn` of `total`, by inversion of u; sums cover 8 standard deviations."""
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked))
    high = F.least(drawn, marked)
    share = marked / F.greatest(total, F.lit(1).cast("long"))
    mean = drawn * share
    spread = 8 * F.sqrt(mean * (1 - share) + 1) + 2
    a = F.greatest(low, F.floor(mean - spread))
    b = F.least(high, F.ceil(mean + spread))
    base = _ln_choose(total, drawn)

    def step(acc, k):
        p = F.exp(_ln_choose(marked, k) + _ln_choose(total - marked, drawn - k) - base)
        return F.struct((acc["cum"] + p).alias("cum"), F.when(acc["cum"] + p < u, k + 1).otherwise(acc["at"]).alias("at"))

    at = F.aggregate(F.sequence(a, b), F.struct(F.lit(0.0).alias("cum"), a.alias("at")), step)["at"]
    return F.least(b, at)


def drawn_shares(rows: DataFrame, levels: int, seed: Column) -> DataFrame:
    """rows (node, sid, c, room): adds k, how many of a source's c are among the room drawn of its node's.

    The sources of a node are halved `levels` times, by the bits of sid. Each row follows its own half down, and rows of one half
    draw the same numbers from the same sums, so no row holds the other sources.
    """
    part = lambda j: F.shiftright("sid", j)
    for j in range(levels + 1):
        rows = rows.withColumn(f"t{j}", F.sum("c").over(Window.partitionBy("node", part(j))))
    rows = rows.withColumn("k", F.col("room"))
    for j in range(levels - 1, -1, -1):  # from halves of 2 ** (j + 1) sources to those of 2 ** j
        left = part(j) % 2 == 0
        low = F.when(left, F.col(f"t{j}")).otherwise(F.col(f"t{j + 1}") - F.col(f"t{j}"))
        u = F.pmod(F.xxhash64(seed, "node", F.lit(j), part(j + 1)), F.lit(1 << 52)) / float(1 << 52)
        rows = rows.withColumn("low", low).withColumn("u", u)
        rows = rows.withColumn("got", hypergeometric(F.col("u"), F.col(f"t{j + 1}"), F.col("low"), F.col("k")).cast("long"))
        rows = rows.withColumn("k", F.when(left, F.col("got")).otherwise(F.col("k") - F.col("got")))
    return rows.select("node", "sid", "c", "k")


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """quotas (sid, blocks) -> (sid, ends): ends[k] is the first block after shard k's. shards: a power of two."""
    assert shards > 0 and shards & (shards - 1) == 0
    now = quotas.select(F.lit(0).alias("node"), "sid", F.col("blocks").cast("long").alias("c"))
    most = quotas.agg(F.max("sid")).first()[0] or 0
    width = shards
    while width > 1:
        width //= 2
        # half of the node's blocks; an odd one goes to a side by hash
        odd = F.pmod(F.xxhash64(F.lit(seed), F.lit(width), "node"), F.lit(2))
        room = F.floor((F.sum("c").over(Window.partitionBy("node")) + odd) / 2).cast("long")
        halves = drawn_shares(now.withColumn("room", room), int(most).bit_length(), F.concat_ws("|", F.lit(seed), F.lit(width)))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), "sid", F.col("k").alias("c")), F.struct((F.col("node") * 2 + 1).alias("node"), "sid", (F.col("c") - F.col("k")).alias("c")))
        now = written(halves.select(F.explode(sides).alias("x")).select("x.*"), f"mix-split-{width}")
    ends = F.sum("c").over(Window.partitionBy("sid").orderBy("node"))
    return now.withColumn("end", ends).groupBy("sid").agg(F.array_sort(F.collect_list("end")).alias("ends"))


def draws(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: str = SEED, keep: tuple = (), **goal) -> tuple[DataFrame, DataFrame]:
    """(rows, draws), both written. rows: a row for each document, with doc_id, size, source_size, target. draws: a row for each
    copy that the mix takes, with rid (of its row), shard, block (the rank of its block in the shard) and place (in the block).

    keep: columns that tell documents of one doc_id (or none) apart; they are part of the key and are returned.
    """
    rows, sources = placed(docs, seed, keep, **goal)
    rows = written(taken(rows, sources, ("rid", *keep)), "mix-taken")
    block = lambda copy: F.floor((F.col("before") + copy * F.col("source_size")) / block_words)
    last = F.when(F.col("copies") > 0, block(F.col("copies") - 1) + 1).otherwise(0)
    quotas = written(rows.groupBy("sid").agg(F.max(last).alias("blocks")), "mix-quotas")
    ends = written(split_quotas(quotas, shards, seed), "mix-ends")
    copies = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("of", block(F.col("copy")))
    copies = copies.join(ends, "sid").withColumn("shard", F.least(F.lit(shards - 1), F.size(F.filter("ends", lambda e: e <= F.col("of")))))
    # blocks of all sources stand in a shard in a keyed order; a block's rows stand in the order of another key
    blocks = written(copies.select("shard", "sid", "of").distinct().withColumn("order", F.xxhash64(F.lit(seed), "shard", "sid", "of")), "mix-shard-blocks")
    blocks = blocks.withColumn("block", F.row_number().over(Window.partitionBy("shard").orderBy("order", "sid", "of")) - 1)
    at = F.row_number().over(Window.partitionBy("sid", "of", "shard").orderBy(F.xxhash64(F.lit(seed), "h", "copy"), "rid")) - 1
    copies = copies.withColumn("place", at).join(written(blocks.drop("order"), "mix-ranks"), ["shard", "sid", "of"])
    return rows, written(copies.select("rid", "doc_id", "size", "copy", "shard", "block", "place", *keep), "mix-draws")


def mix(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: str = SEED, keep: tuple = (), **goal) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (words of its draws), and its draws (shard, block, place)."""
    rows, drawn = draws(docs, shards, block_words, seed, keep, **goal)
    own = drawn.groupBy("rid").agg(F.sum("size").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "block", "place"))).alias("draws"))
    out = rows.join(own, "rid", "left")
    none = F.array().cast("array<struct<shard:int,block:int,place:int>>")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("draws", none).alias("draws"), *keep)
