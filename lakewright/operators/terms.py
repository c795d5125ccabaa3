"""Terms and names that a text nearly spells, and links between corpora.

Runs of one to three tokens are folded; the distinct ones meet the lexicon once, by first letter and length, so the
costly ratio is taken for a word of the vocabulary, not for each of its occurrences. Null and empty texts offer nothing;
repeated rows of one id count as one text.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import fold, fold_table
from .products import bridges  # noqa: F401
from .stored import stored

#: Least ratio of a near spelling and of a name, and the longest run of tokens (fixed values).
NEAR_RATIO, NAME_RATIO, RUN = 0.72, 0.85, 3
MOST_TERMS, MOST_SPEAKERS = 8, 10


def letters(c: Column) -> Column:
    """Letters a to z in lower case, without their marks."""
    return F.regexp_replace(fold(c), "[^a-z]", "")


def word_list(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("\\p{L}+"), F.lit(0))


def runs(c: Column, most: int = RUN, able: str = "^[a-z]") -> Column:
    """array<struct<at,key,phrase>> of the runs of one to `most` tokens whose folded letters match `able`, shorter ones first.

    A text is folded once, not run by run: folding goes character by character.
    """
    words = word_list(c)
    keys = F.split(F.regexp_replace(fold(F.array_join(words, " ")), "[^a-z ]", ""), " ")
    # words are taken by their place: slice() copies its whole array at each call, which is the square of a text
    joined = lambda xs, i, n, by: F.concat_ws(by, *[F.get(xs, i + d) for d in range(n)])
    starts = lambda x, n: F.transform(F.sequence(F.lit(1), F.size(x["w"]) - n + 1), lambda i: F.struct(F.lit(n).alias("n"), (i - 1).alias("i"), joined(x["k"], i - 1, n, "").alias("key")))
    none = F.array().cast("array<struct<n:int,i:int,key:string>>")
    at = lambda x, n: F.when(F.size(x["w"]) >= n, starts(x, n)).otherwise(none)
    phrase = lambda x, r: F.array_join(F.transform(F.sequence(F.lit(0), r["n"] - 1), lambda d: F.get(x["w"], r["i"] + d)), " ")

    def found(x):
        every = F.transform(F.concat(*[at(x, n) for n in range(1, most + 1)]), lambda r, i: F.struct(i.alias("at"), r["key"].alias("key"), r["n"].alias("n"), r["i"].alias("i")))
        return F.transform(F.filter(every, lambda r: r["key"].rlike(able)), lambda r: F.struct(r["at"].alias("at"), r["key"].alias("key"), phrase(x, r).alias("phrase")))

    # the words are bound as a lambda's argument, so a text is cut once and not for each run
    return F.flatten(F.transform(F.array(F.struct(words.alias("w"), keys.alias("k"))), found))


def _able(folded: list[str], least: float) -> str:
    """A pattern of the keys that may be near one of some folded forms: the same first letter, and a length that allows the ratio."""
    bands: dict[str, list[int]] = {}
    for f in folded:
        n = len(f)
        low, high = -int(-n * least / (2 - least) // 1), int(n * (2 - least) / least)
        now = bands.setdefault(f[0], [low, high])
        now[:] = min(now[0], low), max(now[1], high)
    return "^(?:" + "|".join(f"{c}[a-z]{{{max(low, 1) - 1},{high}}}" for c, (low, high) in sorted(bands.items())) + ")$" if bands else "^$a"


def _ratio():
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return ratio


def _matches(keys: DataFrame, lexicon: DataFrame, least: float) -> DataFrame:
    """(key, and the lexicon's columns, score) of keys near to a folded form with the same first letter."""
    n, m = F.length("folded"), F.length("key")
    able = (F.substring("folded", 1, 1) == F.substring("key", 1, 1)) & (2 * F.least(n, m) / (n + m) >= least)
    return keys.distinct().join(lexicon, able).withColumn("score", _ratio()(F.col("folded"), F.col("key"))).where(F.col("score") >= least)


def _seen(docs: DataFrame, id_: str, text: str, forms: DataFrame, least: float) -> DataFrame:
    """(id, at, key, phrase): runs, as `runs` gives them, that may be near to one of the folded forms of a stated list.

    A task folds each distinct word once; only runs of a fitting first letter and length leave it.
    """
    folded = [r["folded"] for r in forms.select("folded").distinct().collect()]
    able, kind, table = _able(folded, least), docs.schema[id_].dataType, fold_table()

    def close(keys: list[str]) -> np.ndarray:
        """Keys that share letters enough with a form: the ratio is at most that of the letters in common, in any order."""
        length = np.array([len(k) for k in keys])
        codes = np.frombuffer("".join(keys).encode(), dtype="uint8").astype("int64") - 97
        counts = np.bincount(np.repeat(np.arange(len(keys)), length) * 26 + codes, minlength=26 * len(keys)).reshape(-1, 26)
        initial, ok = codes[np.cumsum(length) - length], np.zeros(len(keys), dtype=bool)
        for f in folded:
            own = np.bincount(np.frombuffer(f.encode(), dtype="uint8") - 97, minlength=26)
            ok |= (initial == ord(f[0]) - 97) & (2.0 * np.minimum(counts, own).sum(axis=1) / (length + len(f)) >= least)
        return np.flatnonzero(ok)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, known = re.compile(able.removesuffix("$") + r"\Z").match, {}
        for batch in batches:
            found: list[tuple[int, int, str, str]] = []
            for row in range(len(batch)):
                words = [w for x in re.findall(r"[^\W\d_]+", batch.column(1)[row].as_py() or "") for w in ([x] if x.isalpha() else _letters_only(x))]
                keys = []
                for w in words:
                    k = known.get(w)
                    if k is None:
                        if len(known) > 1 << 18:
                            known.clear()
                        k = known[w] = re.sub("[^a-z]", "", w.translate(table))
                    keys.append(k)
                n0, run = 0, keys
                for n in range(1, RUN + 1):
                    if n > 1:
                        run = [a + b for a, b in zip(run, keys[n - 1 :])]
                    found += [(row, n0 + i, k, " ".join(words[i : i + n])) for i, k in enumerate(run) if fits(k)]
                    n0 += len(run)
                if found and (len(found) > 1 << 16 or row == len(batch) - 1):
                    found = [found[i] for i in close([x[2] for x in found])]
                    at = [pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.string(), pa.string()))]
                    if found:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at[0]), *at[1:]], ["id", "at", "key", "phrase"])
                    found = []

    schema = StructType([StructField("id", kind), *(StructField(n, t) for n, t in (("at", IntegerType()), ("key", StringType()), ("phrase", StringType())))])
    return docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def _letters_only(x: str) -> list[str]:
    """Number signs such as ² are letters to Python's \\w, and cut words here."""
    return "".join(c if c.isalpha() else " " for c in x).split()


def near_miss_terms(docs: DataFrame, id_: str, text: str, terms: list[str], most: int = MOST_TERMS) -> DataFrame:
    """(id, term, heard_as, rank): terms of a stated lexicon that a text nearly spells, best first, at most `most` a text.

    Terms that the text already spells, case and marks aside, are left out, and so are runs that spell another term.
    """
    rows = docs.sparkSession.createDataFrame([(t,) for t in sorted(set(terms))], "term string").withColumn("folded", letters(F.col("term"))).where("folded <> ''")
    seen = _seen(docs, id_, text, rows, NEAR_RATIO)
    other = rows.select(F.col("folded").alias("key")).distinct()
    near = stored(_matches(seen.select("key"), rows, NEAR_RATIO), "near-keys")  # read twice, so found once
    near = near.where("key = folded").unionByName(near.where("key <> folded").join(other, "key", "left_anti"))
    # patterns are made here, once: as columns they would be folded and compiled anew for each text
    words_of = {t: _letters_only(t.translate(fold_table())) for t in sorted(set(terms))}

    def spells(p: Column, words: list[str]) -> Column:
        found = F.rlike(p, F.lit("(?iU)(?<!\\w)" + "\\s+".join(words) + "(?!\\w)"))
        # a plain search comes first; of the characters that remain only ı is an i to the pattern
        return F.contains(F.replace(p, F.lit("ı"), F.lit("i")), F.lit(words[0])) & found if words and re.fullmatch("[a-z]+", words[0]) else found

    # the folded text is bound as a lambda's argument, so it is made once and not for each term
    spelt = F.transform(F.array(fold(F.coalesce(F.col(text), F.lit("")))), lambda p: F.array_compact(F.array(*[F.when(spells(p, x), t) for t, x in words_of.items()])))
    known = docs.select(F.col(id_).alias("id"), F.explode(F.flatten(spelt)).alias("term"))
    near = stored(near, "near-terms")  # its size is known then, so that runs need not be shuffled to meet a few keys
    best = seen.join(near, "key").groupBy("id", "term").agg(F.max_by("phrase", F.struct("score", -F.col("at"))).alias("heard_as"), F.round(F.max("score"), 3).alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.lower("term"), "term"))
    return best.join(known, ["id", "term"], "left_anti").withColumn("rank", rank).where(F.col("rank") <= most).select("id", "term", "heard_as", "rank")


def mentioned_speakers(docs: DataFrame, id_: str, text: str, speakers: list[dict], most: int = MOST_SPEAKERS) -> DataFrame:
    """(id, name, hits, rank) for a stated roster of {name, aliases, appears: always | sometimes | never}.

    Those who always appear come first in the roster's order, without hits; then whoever a text mentions, by the number
    of name forms (name, aliases, first and last name) that it holds or nearly holds. At most `most` a text.
    """
    spark = docs.sparkSession
    who = spark.createDataFrame([(s["name"], [s["name"], *s.get("aliases", [])]) for s in speakers if s.get("appears", "sometimes") == "sometimes"], "name string, said array<string>")
    parts = word_list(F.col("name"))
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    ends = F.array_compact(F.array(F.when(F.length(first) >= 3, first), F.when(F.length(last) >= 4, last)))
    forms = F.concat("said", F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<string>")))
    forms = who.select("name", F.explode(F.array_distinct(F.transform(forms, letters))).alias("folded")).where("folded <> ''")
    seen = _seen(docs, id_, text, forms, NAME_RATIO).select("id", "key").distinct()
    near = stored(_matches(seen.select("key"), forms, NAME_RATIO), "near-names")
    hits = seen.join(near, "key").groupBy("id", "name").agg(F.count_distinct("folded").alias("hits"))
    always = [s["name"] for s in speakers if s.get("appears") == "always"]
    fixed = F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(n).alias("name")) for i, n in enumerate(always)]) if always else F.array().cast("array<struct<tier:int,name:string>>")
    rows = docs.select(F.col(id_).alias("id")).distinct().select("id", F.inline(fixed)).select("id", "name", F.lit(None).cast("long").alias("hits"), "tier")
    rows = rows.unionByName(hits.withColumn("tier", F.lit(len(always))))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("tier", F.desc("hits"), F.lower("name"), "name"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "name", "hits", "rank")
