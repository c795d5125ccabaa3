"""Toxicity by weak supervision.

Voters are short patterns over words of letters (A-Z lower-cased): whole words of a seed lexicon, and
whole words and word beginnings that labelled rows propose, as they stand, once or a few times, mostly in
toxic documents. Such a voter says "toxic" where its pattern occurs often enough and abstains elsewhere.
Two further voters say "clean": where no voter votes, and where one at most does that is no seed word. Every
pattern that passes the tests of support and precision is a voter; there is no limit to their number.

The generative label model has a latent class, and for each voter the rates at which it votes in either
class, which are its accuracy. It starts from the balance of votes and is fitted by expectation-maximisation
on the votes alone until posteriors no longer change; labels only say which class is the toxic one. Voters
that vote together more than their classes explain are correlated; in a document, a voter's evidence is
divided by the sum of its residual correlations with those that vote alike. The posterior of a document is
its probabilistic label, on which a linear classifier over the votes and their frequency is trained. It is
compiled to a Spark column expression over the pattern counts of each document.

Learning takes at most about MOST_TRAIN labelled rows, chosen by a hash of doc_id. Null and empty texts hold
no pattern and are scored as such; a long text is whole within one task. Repeated rows get equal scores, an
empty table none; other columns of both tables are ignored, whatever their names. Without toxic training
rows only the seed lexicon votes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality import training_rows
from .textscan import byte_set, numbered, slices, word_spans

#: Words that start the lexicon; the training rows add to them.
SEED_LEXICON = ("idiot", "moron", "stupid", "worthless", "pathetic", "disgusting", "scum", "trash", "loser", "clown")
MOST_TRAIN = 20_000
PREFIXES = (4, 5, 6, 7, 8)  # bytes
TIMES = (1, 2, 3)
PRECISION, CHANCE = 0.93, 0.01  # precision: toxic documents with a pattern, against all of them and one more
CUTOFF = 0.7
#: Expectation-maximisation ends at this change of posteriors, or after so many steps.
TOLERANCE, MOST_STEPS = 1e-4, 200
LETTERS = byte_set([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_WORD = re.compile(rb"[a-z\x80-\xff]+")


Voter = tuple[bytes, int]  # a word beginning, or a whole word and a dollar sign; how often it must occur


def _pattern_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> pattern, times, documents with it so often, toxic ones among them."""
    for batch in batches:
        every: Counter = Counter()
        toxic: Counter = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: Counter = Counter()
            for w, c in Counter(_WORD.findall((text or "").encode().lower())).items():
                if len(w) >= 3:
                    own[w + b"$"] += c
                for n in PREFIXES:
                    if len(w) > n:
                        own[w[:n]] += c
            keys = [(k, t) for k, c in own.items() for t in TIMES if t <= c]
            every.update(keys)
            if label:
                toxic.update(keys)
        keys = list(every)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], type=pa.binary()), pa.array([t for _, t in keys], type=pa.int32()), pa.array([every[k] for k in keys], type=pa.int64()), pa.array([toxic[k] for k in keys], type=pa.int64())], ["pattern", "times", "n", "n1"])


def _told_apart(table: pa.Table) -> pa.Table:
    """Of a word and its beginnings, or one pattern more and less often, in about the same documents one is enough."""
    kept: list[tuple[bytes, int, int]] = []
    rows = zip(table.column("pattern").to_pylist(), table.column("times").to_pylist(), table.column("n1").to_pylist(), strict=True)
    for v, times, n1 in sorted(rows, key=lambda r: (-r[2], -len(r[0]), r[0], r[1])):
        stem = v.rstrip(b"$")
        if not any((k.startswith(stem) or stem.startswith(k.rstrip(b"$"))) and n1 >= 0.95 * m for k, _, m in kept):
            kept.append((v, times, n1))
    return pa.table({"pattern": pa.array([k for k, _, _ in kept], type=pa.binary()), "times": pa.array([t for _, t, _ in kept], type=pa.int32()), "n1": pa.array([n for _, _, n in kept], type=pa.int64())})


def mined_voters(train: DataFrame) -> list[Voter]:
    """Patterns of the training rows that stand mostly in toxic documents; the most frequent first."""
    counts = train.select("text", "label").mapInArrow(_pattern_counts, "pattern binary, times int, n long, n1 long")
    counts = written(counts.groupBy("pattern", "times").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")), "tx-patterns")
    share = train.agg(F.avg("label")).first()[0]
    # so often that chance gives less than CHANCE such patterns among all that were counted
    least = max(2, math.ceil(math.log(max(1, counts.count()) / CHANCE) / -math.log(min(max(share or 0.0, 1e-6), 0.9))))
    best = counts.where((F.col("n1") >= least) & (F.col("n1") >= PRECISION * (F.col("n") + 1)))
    stem = F.substring("pattern", 1, 4)  # 3-byte words and their kin of other stems may both stay
    found = best.groupBy(stem.alias("stem")).applyInArrow(_told_apart, "pattern binary, times int, n1 long")
    return [(bytes(r.pattern), r.times) for r in found.orderBy(F.desc("n1"), "pattern", "times").collect()]


def _votes(voters: list[Voter], dense: bool):
    """Documents -> number of words, and the voters that fire with how many words match; dense: 0 or 1 for each voter."""
    patterns = list(dict.fromkeys(v for v, _ in voters))
    number_of = {v: k for k, v in enumerate(patterns)}
    which_pattern = np.array([number_of[v] for v, _ in voters], dtype=np.int64)
    least = np.array([t for _, t in voters])
    by_length: dict[int, list[bytes]] = {}
    for v in patterns:
        by_length.setdefault(0 if v.endswith(b"$") else len(v), []).append(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {n: (pa.array([v[:-1] if n == 0 else v for v in own], type=pa.large_binary()), np.array([number_of[v] for v in own])) for n, own in by_length.items()}
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                rows = part.num_rows
                hits = np.zeros((rows, len(patterns)), dtype=np.int64)
                s, e, row = word_spans(buf, off, LETTERS)
                if len(s):
                    number, words = numbered(buf, s, e, LETTERS, lower=True)
                    size = pc.binary_length(words).to_numpy()
                    for n, (own, which) in sets.items():
                        at = pc.index_in(pc.binary_slice(words, 0, n) if n else words, value_set=own).fill_null(-1).to_numpy().astype(np.int64)
                        if n:
                            at[size <= n] = -1
                        found = at[number]
                        on = np.flatnonzero(found >= 0)
                        np.add.at(hits, (row[on], which[found[on]]), 1)
                hits = hits[:, which_pattern]
                hits[hits < least] = 0
                if dense:
                    ends = pa.array(np.arange(rows + 1, dtype=np.int32) * len(voters))
                    out = pa.ListArray.from_arrays(ends, pa.array((hits.reshape(-1) > 0).astype(np.int32)))
                else:
                    r, v = np.nonzero(hits)
                    ends = pa.array(np.searchsorted(r, np.arange(rows + 1)).astype(np.int32))
                    out = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(v.astype(np.int32)), pa.array(hits[r, v])], ["voter", "n"]))
                total = pa.array(hits.sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.bincount(row, minlength=rows).astype(np.int64)), total, out], [*part.schema.names[:-1], "n_words", "total", "hits"])

    return run


def voted(docs: DataFrame, voters: list[Voter], dense: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, total (matching words), hits (those that fire; dense: one entry for each voter)."""
    hits = "array<int>" if dense else "array<struct<voter: int, n: long>>"
    return docs.select("doc_id", "text").mapInArrow(_votes(voters, dense), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, total long, hits {hits}")


def clean_votes(votes: np.ndarray, voters: list[Voter]) -> np.ndarray:
    """rows x 2: votes for "clean", by silence (no voter votes) and by faintness (one at most does, and it is no seed word)."""
    seeds = {w.encode() + b"$" for w in SEED_LEXICON}
    seed = np.array([v in seeds for v, _ in voters])
    loud = votes.sum(axis=1)
    return np.stack([loud == 0, (loud <= 1) & (votes[:, seed].sum(axis=1) == 0)], axis=1).astype(float)


def label_model(votes: np.ndarray, clean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Posterior of one class for each vote vector, from votes alone. weight: how many rows have it."""
    loud = votes.sum(axis=1)
    belief = (loud + 0.1) / (loud + clean.sum(axis=1) + 0.2)
    votes = np.concatenate([votes, clean], axis=1)
    for _ in range(MOST_STEPS):
        mass1, mass0 = weight @ belief, weight @ (1 - belief)
        prior = np.clip(mass1 / (mass1 + mass0), 0.001, 0.999)
        rate1 = np.clip(((weight * belief) @ votes + 0.5) / (mass1 + 1), 1e-6, 1 - 1e-4)
        rate0 = np.clip(((weight * (1 - belief)) @ votes + 0.5) / (mass0 + 1), 1e-6, 1 - 1e-4)
        # voters that agree beyond their class speak partly for each other
        rest = (votes - belief[:, None] * rate1 - (1 - belief[:, None]) * rate0) * np.sqrt(weight)[:, None]
        cov = rest.T @ rest
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = np.clip(cov / scale[:, None] / scale[None, :], 0, 1)
        np.fill_diagonal(corr, 1)
        fire, silent = np.log(rate1 / rate0), np.log((1 - rate1) / (1 - rate0))
        spoken, quiet = votes * fire / np.maximum(votes @ corr, 1), (1 - votes) * silent / np.maximum((1 - votes) @ corr, 1)
        logit = np.log(prior / (1 - prior)) + spoken.sum(axis=1) + quiet.sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved = np.abs(post - belief).max()
        belief = post
        if moved < TOLERANCE:
            break
    return belief


def _frequency() -> list:
    """Of a document: whether any voter fires, and how many words match, by log and as a share."""
    total = F.col("total").cast("double")
    return [(total > 0).cast("double"), F.log1p(total), F.least(F.lit(1.0), total / F.greatest(F.col("n_words"), F.lit(1)) * 20.0)]


def fit(train: DataFrame, voters: list[Voter]) -> tuple[list[float], float]:
    """train: label, n_words, total, dense hits of the training rows (a bounded number). Weights of voters and frequencies, and the intercept."""
    kinds = train.groupBy("hits").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).collect()
    votes = np.array([k.hits for k in kinds], dtype=float)
    n, toxic = np.array([k.n for k in kinds], dtype=float), np.array([k.toxic for k in kinds], dtype=float)
    post = label_model(votes, clean_votes(votes, voters), n)
    if (toxic @ post) / toxic.sum() < ((n - toxic) @ post) / (n - toxic).sum():
        post = 1 - post  # the labels' only say: which of the two classes is meant
    known = train.sparkSession.createDataFrame([(list(map(int, k.hits)), float(p)) for k, p in zip(kinds, post, strict=True)], "hits array<int>, p double")
    x = array_to_vector(F.concat(F.col("hits").cast("array<double>"), F.array(*_frequency())))
    soft = train.join(known, "hits").select(x.alias("x"), "p")
    both = soft.select("x", F.lit(1.0).alias("y"), F.col("p").alias("w")).union(soft.select("x", F.lit(0.0).alias("y"), (1 - F.col("p")).alias("w"))).where("w > 1e-6")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-4, standardization=False, maxIter=60).fit(both)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted, hits; one row for each row of docs."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    sample = written(training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), "toxic", remainder != held, MOST_TRAIN), "tx-sample")
    voters = list(dict.fromkeys([(w.encode() + b"$", 1) for w in SEED_LEXICON] + mined_voters(sample)))
    rows = voted(docs, voters)
    train = voted(sample.select("doc_id", "text"), voters, dense=True).join(sample.select("doc_id", "label").distinct(), "doc_id")
    train = written(train.coalesce(4), "tx-train")
    seen = train.agg(F.count("*"), F.avg("label")).first()
    if not seen[0] or seen[1] in (0.0, 1.0):
        # nothing to learn from: the seed lexicon alone
        score = F.when(F.col("total") > 0, 0.9).otherwise(0.1)
    else:
        weights, intercept = fit(train, voters)
        own, often = F.lit(weights[: len(voters)]), weights[len(voters) :]
        logit = F.aggregate("hits", F.lit(intercept), lambda a, h: a + F.element_at(own, h["voter"] + 1))
        for c, w in zip(_frequency(), often, strict=True):
            logit = logit + c * F.lit(w)
        score = 1 / (1 + F.exp(-logit))
    out = rows.select("doc_id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), score.alias("score"), "hits")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "hits")
