"""Quality classifier: a sparse ensemble of rules, compiled to Spark column expressions.

Statistics of whole texts (lengths, character classes, word shapes, repetition) are the only inputs.
A small random forest is fitted on labelled rows; every path from a root to a node is a conjunctive
rule. A logistic model with a lasso penalty weighs the rules, most weights become zero, and the rest
is one column expression over the statistics.

Fitting takes at most about MOST_TRAIN labelled rows, chosen by a hash of doc_id. Null and empty texts
have all statistics 0 and a score as any other. Repeated rows get equal scores. Without labels of both
kinds the score is the share of label 1 (1 where there is no label).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textscan import NOT_SPACE, U, byte_set, mix, row_words, slices, word_names, word_spans

MOST_TRAIN = 30_000
TREES, DEPTH, SEED = 12, 3, 17
PENALTY = 0.001
CUTOFF = 0.3

_UPPER, _LOWER, _DIGIT = byte_set([(0x41, 0x5A)]), byte_set([(0x61, 0x7A)]), byte_set([(0x30, 0x39)])
_STOP, _MARK = byte_set([(0x2E, 0x2E), (0x2C, 0x2C)]), byte_set([(0x21, 0x21), (0x3F, 0x3F)])
_SYMBOL = byte_set([(0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5C, 0x5C), (0x5E, 0x60), (0x7B, 0x7B), (0x7D, 0x7E)])
_BAR, _FAR, _LINE = byte_set([(0x7C, 0x7C)]), byte_set([(0x80, 0xFF)]), ~byte_set([(0x0A, 0x0A)])
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "line_words", "upper", "lower", "digit", "stop", "mark", "symbol", "bar", "far", "other",
    "symbol_end", "all_upper", "one_byte", "distinct", "top_word", "repeated_pairs", "repeated_lines", "word_sd",
]


def _share(rows: int, row: np.ndarray, hit: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.bincount(row[hit], minlength=rows) / np.maximum(count, 1)


def _repeats(rows: int, row: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: distinct names, and the count of the commonest."""
    key = mix(name ^ mix(row.astype(U) + U(5)))
    order = np.argsort(key)
    head = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(head, len(key)))
    own = row[order[head]]
    most = np.zeros(rows, dtype=np.int64)
    np.maximum.at(most, own, size)
    return np.bincount(own, minlength=rows), most


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x FEATURES."""
    rows = len(off) - 1
    size = np.diff(off)
    s, e, row = word_spans(buf, off, NOT_SPACE)
    n = np.diff(row_words(row, rows))
    length = (e - s).astype(np.float64)
    mean = np.bincount(row, length, minlength=rows) / np.maximum(n, 1)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    ls, le, lrow = word_spans(buf, off, _LINE)
    lines = np.bincount(lrow, minlength=rows)

    def per_byte(kind: np.ndarray) -> np.ndarray:
        count = np.concatenate([[0], np.cumsum(kind[buf], dtype=np.int64)])
        return np.diff(count[off]) / np.maximum(size, 1)

    kinds = [per_byte(k) for k in (_UPPER, _LOWER, _DIGIT, _STOP, _MARK, _SYMBOL, _BAR, _FAR)]
    last = buf[e - 1] if len(e) else np.zeros(0, dtype=np.uint8)
    low = np.concatenate([[0], np.cumsum(_LOWER[buf] | _FAR[buf], dtype=np.int64)])
    up = np.concatenate([[0], np.cumsum(_UPPER[buf], dtype=np.int64)])
    shout = (low[e] == low[s]) & (up[e] - up[s] >= 2)
    names = word_names(buf, s, e, NOT_SPACE, lower=True)
    distinct, top = _repeats(rows, row, names)
    near = row[1:] == row[:-1]
    pairs = np.bincount(row[1:][near], minlength=rows)
    distinct_pairs, _ = _repeats(rows, row[1:][near], mix(names[:-1][near] * U(3) + names[1:][near]))
    distinct_lines, _ = _repeats(rows, lrow, word_names(buf, ls, le, _LINE))
    spread = np.sqrt(np.maximum(np.bincount(row, length * length, minlength=rows) / np.maximum(n, 1) - mean * mean, 0))
    columns = [np.log1p(size), np.log1p(n), mean, longest, n / np.maximum(lines, 1), *kinds]
    columns += [np.where(size > 0, 1 - sum(kinds), 0)]
    columns += [_share(rows, row, _SYMBOL[last], n), _share(rows, row, shout, n), _share(rows, row, e - s == 1, n)]
    columns += [distinct / np.maximum(n, 1), top / np.maximum(n, 1), 1 - distinct_pairs / np.maximum(pairs, 1), 1 - distinct_lines / np.maximum(lines, 1), spread]
    columns[-3] = np.where(pairs > 0, columns[-3], 0)
    columns[-2] = np.where(lines > 0, columns[-2], 0)
    return np.stack(columns, axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, off in slices(batch, "text"):
            x = statistics(buf, off)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1])]], [*part.schema.names[:-1], *FEATURES])


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and the statistics."""
    return docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{f} double" for f in FEATURES))


def training_rows(rows: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = MOST_TRAIN) -> DataFrame:
    """Rows with the label of their doc_id, of allowed doc_ids only; about `most` at most, by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return rows.join(known, "doc_id")


_TEST = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)")
Rule = tuple[tuple[int, str, float], ...]


def tree_rules(description: str) -> set[Rule]:
    """Every conjunction from a root to a node below it, from Spark's description of a forest."""
    found: set[Rule] = set()
    path: list[tuple[int, tuple[int, str, float]]] = []
    for line in description.splitlines():
        depth = len(line) - len(line.lstrip())
        if m := _TEST.search(line):
            path = [p for p in path if p[0] < depth]
            path.append((depth, (int(m[2]), m[3], float(m[4]))))
            found.add(tuple(sorted({p[1] for p in path})))
    return found


def rule_column(rule: Rule, features: list[str] = FEATURES) -> Column:
    out = F.lit(True)
    for f, op, x in rule:
        out = out & (F.col(features[f]) <= x if op == "<=" else F.col(features[f]) > x)
    return out.cast("double")


def logistic(weights: list[tuple[Column, float]], intercept: float) -> Column:
    total = F.lit(float(intercept))
    for c, w in weights:
        total = total + c * F.lit(float(w))
    return 1 / (1 + F.exp(-total))


def fit(train: DataFrame) -> tuple[list[tuple[Rule, float]], float] | float:
    """Rules with weights and the intercept; with labels of one kind or none, the constant score."""
    seen = train.agg(F.count("*"), F.avg("label")).first()
    if not seen[0] or seen[1] in (0.0, 1.0):
        return 1.0 if seen[1] is None else float(seen[1])
    x = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(train).select("x", "label")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(x)
    rules = sorted(tree_rules(forest.toDebugString))
    if not rules:
        return float(seen[1])
    names = [f"r{k}" for k in range(len(rules))]
    on = train.select("label", *[rule_column(r).alias(n) for r, n in zip(rules, names, strict=True)])
    on = VectorAssembler(inputCols=names, outputCol="x").transform(on).select("x", "label")
    model = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(on)
    return [(r, w) for r, w in zip(rules, model.coefficients.toArray().tolist(), strict=True) if w != 0.0], float(model.intercept)


def score_column(model) -> Column:
    if isinstance(model, float):
        return F.lit(model)
    rules, intercept = model
    return logistic([(rule_column(r), w) for r, w in rules], intercept)


def scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted; one row for each row of docs."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    rows = written(measured(docs), "ql-statistics")
    train = written(training_rows(rows, labels, "quality", remainder != held).coalesce(4), "ql-train")
    score = score_column(fit(train))
    out = rows.select("doc_id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
