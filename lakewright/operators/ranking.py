"""Search and ranking: lexical scores, vectors, rank fusion, diverse and sampled selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.values import cosine
from .products import nearest  # noqa: F401

#: Weights of the lexical score, the fusion constant and its boosts (fixed values).
SATURATION, LENGTH_PIVOT, LENGTH_FLOOR, LENGTH_SHARE = 1.2, 200.0, 0.25, 0.75
FUSION_K, ID_BOOST, TITLE_BOOST = 60, 1.0, 0.25


def lexical_scores(docs: DataFrame, id_: str, text: str, query: str) -> DataFrame:
    """(id, score) of documents that hold a term of the query; a repeated term counts again. Empty query: no rows."""
    spark = docs.sparkSession
    terms = spark.createDataFrame([(query,)], "q string").select(F.explode(tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    words = docs.select(F.col(id_).alias("id"), tokens(F.col(text)).alias("w"))
    n = words.agg(F.count("*").alias("n"))
    hits = words.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).join(F.broadcast(terms), "term").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.first("times").alias("times"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(n))
    idf = 1 + F.log((F.col("n") + 1) / (F.col("df") + 1))
    tf = F.col("tf") / (F.col("tf") + SATURATION * (LENGTH_FLOOR + LENGTH_SHARE * F.col("length") / LENGTH_PIVOT))
    return scored.groupBy("id").agg(F.sum(idf * tf * F.col("times")).alias("score"))


def semantic_scores(vectors: DataFrame, id_: str, vector: str, query: list[float]) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_).alias("id"), cosine(F.col(vector), q).alias("score")).where("score is not null")


def fuse_ranks(*rankings: DataFrame, boost: DataFrame | None = None, k: int = FUSION_K) -> DataFrame:
    """Reciprocal-rank fusion of (id, rank) tables; boost (id, boost) adds to it. Ordered by score, then id."""
    parts = [r.select("id", (1.0 / (k + F.col("rank"))).alias("part")) for r in rankings]
    if boost is not None:
        parts.append(boost.select("id", F.col("boost").cast("double").alias("part")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("id").agg(F.round(F.sum("part"), 8).alias("score"))


def ranked(scores: DataFrame, most: int) -> DataFrame:
    """(id, rank) of the best; a top-k needs no full sort."""
    top = scores.orderBy(F.desc("score"), "id").limit(most)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def round_robin(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds turn: the row's place in its group; sorting by turn takes one row of each group in turns."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def overlap_score(question: str, text: Column) -> Column:
    """Share of the question's terms that the text holds; 0 for an empty question."""
    q = F.array_distinct(tokens(F.lit(question)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def seeded_sample(df: DataFrame, key: Column, seed: str, n: int) -> DataFrame:
    """n rows by the hash of seed and key: the same ones on every run."""
    return df.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256)).orderBy("_h", key).limit(n).drop("_h")


def evenly_spaced(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """About n rows of each group at equal steps, the first one included."""
    w = Window.partitionBy(*by)
    total, at = F.count("*").over(w), F.row_number().over(w.orderBy(*order)) - 1
    step = F.greatest(F.lit(1), F.floor(total / n))
    return df.withColumn("_at", at).withColumn("_step", step).where((F.col("_at") % F.col("_step") == 0) & (F.col("_at") < F.col("_step") * n)).drop("_at", "_step")
