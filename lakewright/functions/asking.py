"""What a search query asks for: identifiers, topics, intents, and its term without the question round it. Built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of each topic and intent, and the forms of identifiers. A word that ends in \w* may go on.
TOPICS = (
    ("philosophy", r"philosoph\w*|epistemolog\w*|metaphysic\w*|ontolog\w*|phenomenolog\w*|ethic\w*|aesthetic\w*|hermeneutic\w*|dialectic\w*|kant|hegel|husserl|heidegger|wittgenstein|deleuze|foucault|nietzsche|spinoza|aristotle|plato\b"),
    ("buddhism", r"buddhis\w*|buddha|dharma|dhamma|sutta|sutra|sangha|nirvana|nibbana|bodhisattva|madhyamaka|yogacara|abhidharma|abhidhamma|vipassana|anapanasati|zen|chan|theravada|mahayana|vajrayana|tibetan buddhis\w*|pali canon|tripitaka|kangyur|tengyur|taisho"),
    ("religion", r"religio\w*|theolog\w*|scriptur\w*|liturg\w*|monastic\w*"),
    ("biomedical", r"clinical|biomedical|pubmed|disease|drug|therapy|genetic|neuroscience|epidemiolog\w*|public health|patient"),
    ("psychology", r"psycholog\w*|cognitive|behaviou?ral|therapy|perception|memory"),
    ("computing", r"code|github|repository|npm|pypi|package|api|sdk|library|algorithm|programming|softwar\w*|typescript|javascript|python|rust\b"),
    ("mathematics", r"mathematic\w*|theorem|proof|topolog\w*|algebra|calculus|geometr\w*"),
    ("history", r"histor\w*|century|medieval|ancient|dynasty|war\b|empire"),
    ("literature", r"novel|poem|poetry|literatur\w*|author|fiction"),
)
#: Topics whose last word may go on, as their pattern has no word end after it.
OPEN_ENDED = ("philosophy", "computing", "history")
NEWS = r"news|today|yesterday|recent|breaking|latest|this week|headline|reported"
BOOKS = r"book|edition|publisher|isbn|paperback|hardcover|volume|translat(?:ion|ed by)"
DEFINITION = r"define|definition|what is|what are|meaning of|etymolog\w*|glossar\w*"
DOI = r"\b10\.\d{4,9}/[-._;()/:a-z0-9]+\b"
ARXIV = r"\barxiv[:\s]*(\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+/\d{7}(?:v\d+)?)\b"
PMID = r"\bpmid[:\s]*(\d{6,9})\b"
TAISHO = r"\b(?:t\.?\s*|taish[oō]\s*)(\d{1,4})\b"
ISBN, OCLC, LCCN = r"^(?:isbn:?)?(\d{9}[\dXx]|\d{13})$", r"^oclc:?\s*(\d+)$", r"^lccn:?\s*([\w\d-]+)$"
FRAME = r"^\s*(?:what\s+(?:is|are|was|were)|who\s+(?:is|was)|define|definition\s+of|meaning\s+of|etymolog(?:y|ies)\s+of|tell\s+me\s+about)\s+"


_WORD = "[0-9A-Za-z_]"
_BOUND = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _plain(pattern: str) -> str:
    """The pattern as written for engines whose word bounds and white space are ASCII and whose $ is the end: Java takes è for a letter of a word."""
    return "(?i)" + pattern.replace(r"\b", _BOUND).replace(r"\s", r"[\t\n\f\r ]").replace("$", r"\z").replace("ō", "ōŌ")


def _first(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, _plain(pattern), group), F.lit(""))


def topic_pattern(name: str) -> str:
    return rf"\b(?:{dict(TOPICS)[name]})" + ("" if name in OPEN_ENDED else r"\b")


def book_identifier(c: Column) -> Column:
    """isbn:, oclc: or lccn: and the number, of a text that is nothing else."""
    named = lambda kind, text, pattern: F.concat(F.lit(f"{kind}:"), _first(text, pattern, 1))
    return F.coalesce(named("isbn", F.regexp_replace(c, "[\\t\\n\\f\\r -]", ""), ISBN), named("oclc", c, OCLC), named("lccn", c, LCCN))


def bare_term(text: Column) -> Column:
    """A query without the question round it; empty if there is nothing else."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _plain(FRAME), ""), _plain(r"\?+\s*$"), ""))


def classified(c: Column, canon: Column | None = None) -> dict[str, Column]:
    """doi, arxiv, pmid, taisho, book, topics, intents and term of a query; null is an empty query.

    canon: another reference to a canonical text that a caller has found, which counts as one.
    """
    text = F.trim(F.coalesce(c, F.lit("")))
    has = lambda pattern: text.rlike(_plain(pattern))
    found = {"doi": _first(text, DOI, 0), "arxiv": _first(text, ARXIV, 1), "pmid": _first(text, PMID, 1), "taisho": _first(text, TAISHO, 1), "book": book_identifier(text)}
    topics = F.array_compact(F.array(*[F.when(has(topic_pattern(name)), name) for name, _ in TOPICS]))
    intents = [
        F.when(has(rf"\b(?:{NEWS})\b"), "news"), F.when(has(rf"\b(?:{BOOKS})\b") | found["book"].isNotNull(), "books"), F.when(has(rf"\b(?:{DEFINITION})\b"), "definition"),
        F.when(F.coalesce(found["doi"], found["arxiv"], found["pmid"]).isNotNull(), "academic"), F.when(F.coalesce(found["taisho"], canon if canon is not None else F.lit(None)).isNotNull(), "canon"),
    ]
    term = bare_term(text)
    return {**found, "topics": F.when(F.size(topics) > 0, topics).otherwise(F.array(F.lit("general"))), "intents": F.array_compact(F.array(*intents)), "term": F.when(term == "", text).otherwise(term)}


def routed(queries: DataFrame, id_: str, topics: str, providers: DataFrame) -> DataFrame:
    """(id, provider, place): providers (provider, topics, authority) that share a topic with a query, by authority; "general" is no topic to share."""
    own = F.filter(topics, lambda x: x != "general")
    asked = queries.select(F.col(id_).alias("id"), F.explode(own).alias("topic"))
    offered = providers.select("provider", "authority", F.explode("topics").alias("topic"))
    met = asked.join(offered, "topic").groupBy("id", "provider").agg(F.min("authority").alias("authority"))
    place = F.array_sort(F.collect_list(F.struct("authority", "provider")))  # a row for each provider
    return met.groupBy("id").agg(place.alias("p")).select("id", F.posexplode("p").alias("place", "x")).select("id", "x.provider", (F.col("place") + 1).alias("place"))
