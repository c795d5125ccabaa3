"""A small search language, compiled to one score column.

`re:` and a pattern finds by regular expression, without regard to case. Otherwise a query is a list of words, which match in
order with gaps, and of phrases in double quotes, which match as they are but for case and white space; all have to match. A quote
that is not closed is no quote. The score grows with the place of a regex or phrase and is that of a fuzzy match for a word:
lower is better. A query without words matches everything, a pattern that is none matches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .matching import token_score

#: What a character further on costs a regex or phrase (a fixed value).
PLACE = 0.1


@dataclass(frozen=True)
class Parsed:
    pattern: str | None = None
    #: (kind, value): kind is "fuzzy" or "phrase"
    tokens: tuple[tuple[str, str], ...] = ()
    error: str | None = None


def parse(query: str, spark: SparkSession) -> Parsed:
    text = query.strip()
    if text.startswith("re:"):
        pattern = text[3:].strip()
        if not pattern:
            return Parsed(error="empty pattern")
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:  # the JVM says what is wrong with it
            return Parsed(error=str(getattr(e, "java_exception", e)).splitlines()[0])
        return Parsed(pattern=pattern)
    if text.count('"') % 2:
        return Parsed(tokens=tuple(("fuzzy", w) for w in text.split()))
    found: list[tuple[str, str]] = []
    for k, piece in enumerate(text.split('"')):
        if k % 2:
            found += [("phrase", piece.strip())] if piece.strip() else []
        else:
            found += [("fuzzy", w) for w in piece.split()]
    return Parsed(tokens=tuple(found))


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "(?U)\\s+", " "))


def score(parsed: Parsed, text: Column) -> Column:
    """Null where a text does not match."""
    text = F.coalesce(text, F.lit(""))
    if parsed.error:
        return F.lit(None).cast("double")
    if parsed.pattern is not None:
        at = F.regexp_instr(text, F.lit(f"(?i){parsed.pattern}"))
        return F.when(at > 0, (at - 1) * F.lit(PLACE))
    total = F.lit(0.0)
    for kind, value in parsed.tokens:
        if kind == "fuzzy":
            total = total + token_score(value, text)
        else:
            phrase = re.sub(r"\s+", " ", value.lower())
            at = F.instr(_plain(text), phrase)
            total = total + F.when(at > 0, (at - 1) * F.lit(PLACE))
    return total


def search(df: DataFrame, text: Column, query: str, modified: Column, name: Column | None = None, named_only: bool = False, by: str = "relevance") -> DataFrame:
    """The rows that match, with their score: best first and then latest, or in order of `modified`, the latest first, if by is "recent".

    named_only: rows whose name is not blank. A blank query gives all rows, the latest first.
    """
    if named_only:
        df = df.where(F.trim(F.coalesce(name, F.lit(""))) != "")
    found = df.withColumn("score", score(parse(query, df.sparkSession), text)).where("score is not null")
    return found.orderBy(modified.desc()) if by == "recent" or not query.strip() else found.orderBy("score", modified.desc())
