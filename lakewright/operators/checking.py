"""Text quality, coverage and grounding checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, tokens


def content_coverage(pairs: DataFrame, id_: str, source: str, other: str) -> DataFrame:
    """(id, coverage): share of the source's tokens, with their numbers, that the other text holds; 1 without tokens."""
    a = pairs.select(F.col(id_).alias("id"), F.explode(tokens(F.col(source))).alias("t")).groupBy("id", "t").agg(F.count("*").alias("na"))
    b = pairs.select(F.col(id_).alias("id"), F.explode(tokens(F.col(other))).alias("t")).groupBy("id", "t").agg(F.count("*").alias("nb"))
    s = a.join(b, ["id", "t"], "left").groupBy("id").agg((F.sum(F.least("na", F.coalesce("nb", F.lit(0)))) / F.sum("na")).alias("coverage"))
    return pairs.select(F.col(id_).alias("id")).join(s, "id", "left").select("id", F.coalesce("coverage", F.lit(1.0)).alias("coverage"))


def added_words(pairs: DataFrame, id_: str, source: str, other: str) -> DataFrame:
    """(id, word, extra): words that the other text has more often than the source."""
    count = lambda c, n: pairs.select(F.col(id_).alias("id"), F.explode(tokens(F.col(c))).alias("word")).groupBy("id", "word").agg(F.count("*").alias(n))
    both = count(other, "nb").join(count(source, "na"), ["id", "word"], "left")
    return both.select("id", "word", (F.col("nb") - F.coalesce("na", F.lit(0))).alias("extra")).where("extra > 0")


def _plain(c: Column) -> Column:
    c = F.translate(F.lower(F.coalesce(c, F.lit(""))), "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def quote_found(quote: Column, source: Column, least: int = 12) -> Column:
    """Whether every fragment of a quotation of `least` characters or more is in the source; quotes, case and spaces do not count. Null without such a fragment."""
    parts = F.filter(F.transform(F.split(quote, "\\.\\.\\.|…|\n|; "), _plain), lambda p: F.length(p) >= least)
    return F.when(F.size(parts) > 0, F.forall(parts, lambda p: F.contains(_plain(source), p)))


def capital_names(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0)))


def numbers_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+(?:\\.[0-9]+)?"), F.lit(0)))


def ungrounded(draft: Column, source: Column) -> Column:
    """Names and numbers of a draft that its source does not hold."""
    return F.filter(F.concat(capital_names(draft), numbers_in(draft)), lambda x: ~F.contains(source, x))


def running_heads(lines: DataFrame, share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """lines (doc, page, line): lines that stand on more than `share` of a document's pages; digits count as one kind."""
    norm = F.regexp_replace(F.lower(F.trim("line")), "[0-9]+", "#")
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    seen = lines.where(F.trim("line") != "").groupBy("doc", norm.alias("head")).agg(F.count_distinct("page").alias("n"))
    return seen.join(pages, "doc").where((F.col("pages") >= least_pages) & (F.col("n") > share * F.col("pages"))).select("doc", "head", "n")


def structure(c: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(p)).cast("long")
    return {"headings": count("(?m)^#{1,6} "), "table_rows": count("(?m)^\\|.*\\|[ ]*$"), "footnotes": count("\\[\\^[^\\]]+\\]"), "urls": count("https?://")}


def comparable_words(c: Column) -> Column:
    """Words of three letters or more, folded; apostrophes are dropped and hyphens belong to a word."""
    return F.regexp_extract_all(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "['\u2019]", ""), F.lit("[a-z][a-z-]{2,}"), F.lit(0))


def prose(c: Column) -> Column:
    """Markdown without headings, and lines without their bullets, quote marks, callouts, bold labels and bars."""

    def line(x: Column) -> Column:
        for pattern in ("^\\s+|\\s+$", "^[-*+]\\s+", "^>\\s*\\[![a-zA-Z]+\\]\\s*", "^>\\s*", "^\\*\\*[^*]{1,60}:?\\*\\*:?\\s*"):
            x = F.regexp_replace(x, pattern, "")
        return F.replace(x, F.lit("|"), F.lit(" "))

    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\\r\\n|[\\n\\r]"), lambda x: ~F.ltrim(x).startswith("#"))
    return F.array_join(F.transform(lines, line), "\n")


def invented_words(source: Column, cleaned: Column, allowed: list[str] = ()) -> Column:
    """Distinct words of the cleaned prose, in order, that have no root in the source.

    A word has one if the source holds it, or a longer word that begins with it, or a shorter one of three letters or more that it begins with, or,
    from five letters on, a word with its first five. Allowed words and words of the list are no evidence.
    """

    def judged(x: Column) -> Column:
        # only words of the source that begin as a new one does can be its root; "\n" stands before and after each of these
        said = F.filter(x["said"], lambda w: F.array_contains(x["starts"], F.substring(w, 1, 3)))
        near = F.concat(F.lit("\n"), F.array_join(said, "\n"), F.lit("\n"))
        return F.get(F.transform(F.array(F.struct(near.alias("near"), said.alias("said"), x["new"].alias("new"))), lambda k: F.filter(k["new"], lambda w: ~rooted(w, k))), F.lit(0))

    def rooted(w: Column, k: Column) -> Column:
        begins = lambda head: F.contains(k["near"], F.concat(F.lit("\n"), head))
        return begins(w) | ((F.length(w) >= 5) & begins(F.substring(w, 1, 5))) | F.exists(k["said"], lambda s: F.startswith(w, s))

    new = F.array_distinct(comparable_words(prose(cleaned)))
    new = F.array_except(new, F.lit(list(allowed))) if allowed else new
    with_starts = F.get(F.transform(F.array(new), lambda n: F.struct(n.alias("new"), F.array_distinct(F.transform(n, lambda w: F.substring(w, 1, 3))).alias("starts"))), F.lit(0))
    bound = F.transform(F.array(F.struct(with_starts.alias("x"), F.array_distinct(comparable_words(source)).alias("said"))), lambda b: judged(F.struct(b["x"]["new"].alias("new"), b["x"]["starts"].alias("starts"), b["said"].alias("said"))))
    return F.get(bound, F.lit(0))


def vocabulary_coverage(source: Column, written: Column, least: int = 5) -> Column:
    """Share of the source's distinct words of `least` letters or more that the written text holds, or a beginning of four letters or more of them; 1 without such words."""

    def share(x: dict[str, Column]) -> Column:
        # a word that begins with a written one shares its first four letters; few words pass that
        near = F.filter(x["own"], lambda w: F.array_contains(x["starts"], F.substring(w, 1, 4)))
        kept = F.filter(near, lambda w: F.exists(x["written"], lambda s: F.startswith(w, s) & (F.length(s) >= F.least(F.length(w), F.lit(4)))))
        return F.when(F.size(x["own"]) > 0, F.size(kept) / F.size(x["own"])).otherwise(1.0)

    own = F.array_distinct(F.filter(comparable_words(source), lambda w: F.length(w) >= least))
    said = F.get(F.transform(F.array(F.array_distinct(comparable_words(written))), lambda s: F.struct(s.alias("written"), F.array_distinct(F.transform(s, lambda w: F.substring(w, 1, 4))).alias("starts"))), F.lit(0))
    bound = F.transform(F.array(F.struct(own.alias("own"), said.alias("said"))), lambda x: share({"own": x["own"], "written": x["said"]["written"], "starts": x["said"]["starts"]}))
    return F.get(bound, F.lit(0))


def dropped_units(units: DataFrame, id_: str, text: Column, written: Column, floor: float = 0.15) -> DataFrame:
    """(id, coverage): units whose vocabulary hardly reached the written text."""
    rows = units.select(F.col(id_).alias("id"), vocabulary_coverage(text, written).alias("coverage"))
    return rows.where(F.col("coverage") < floor).select("id", F.round("coverage", 3).alias("coverage"))
