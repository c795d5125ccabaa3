"""Column rules over names, dates, commands, facts and pairs. All are built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, once, trim_all
from .values import valid_date

#: Words and endings that mark an organisation (fixed values).
CORPORATE = (
    "\\b(institute|university|universit|organi[sz]ation|committee|association|society|commission|ministry"
    "|department|council|bank|agency|bureau|foundation|centre|center|consortium|network|group|team"
    "|who|unesco|unicef|oecd|nato|nih|cdc|epa|un)\\b"
)
CORPORATE_END = "\\b(inc\\.?|ltd\\.?|llc|plc|gmbh|co\\.)$"
#: Titles after a name, and small words that belong to a surname (fixed values).
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "phd", "ph.d", "md", "m.d", "esq", "mba", "dphil")
PARTICLES = ("van", "von", "de", "del", "della", "di", "da", "dos", "das", "du", "la", "le", "ten", "ter", "bin", "al", "der", "den", "op")
#: Longest key text; least characters and digits of an identifier; cosines and containment of near duplicates (fixed values).
KEY_CHARACTERS = 2000
IDENTIFIER_CHARACTERS, IDENTIFIER_DIGITS = 5, 4
NEAR_AUTO, NEAR_REVIEW, CONTAINED = 0.97, 0.90, 0.90


def key_text(columns: list[Column], most: int = KEY_CHARACTERS) -> Column:
    """Non-blank values, trimmed and joined by a bar, cut to `most` characters."""
    return F.substring(F.concat_ws(" | ", *[F.when(~is_blank(c.cast("string")), trim_all(c.cast("string"))) for c in columns]), 1, most)


def looks_corporate(name: Column) -> Column:
    """A word or ending of organisations, or more than four words without a comma."""
    # four runs of white space in a trimmed text are five words
    many = lambda low: ~low.contains(",") & low.rlike("^\\S++(\\s++\\S++){4}")
    return once(F.lower(trim_all(name)), lambda low: F.when(low == "", False).otherwise(low.rlike(CORPORATE) | low.rlike(CORPORATE_END) | many(low)))


#: Titles at the end of a text of words with one space between them, and its last word with the particles before it.
_TITLES = "(?i)(?:(?:^| )\\.*(?:" + "|".join(re.escape(w) for w in SUFFIXES) + ")\\.*(?![^ ]))++\\z"
_LAST = "(?i)((?:(?<![^ ])(?:" + "|".join(PARTICLES) + ") )*+[^ ]+)\\z"


def display_surname(name: Column) -> Column:
    """What stands before a comma, else the last word, without titles after it and with the particles before it; null if there is none."""
    clean = F.regexp_replace(trim_all(F.regexp_replace(name, "\\s+", " ")), "^,+|,+$", "")
    last = lambda c: F.regexp_extract(F.regexp_replace(F.trim(F.regexp_replace(c, " {2,}", " ")), _TITLES, ""), _LAST, 1)
    return once(clean, lambda c: F.nullif(F.when(c.contains(","), F.trim(F.split_part(c, F.lit(","), F.lit(1)))).otherwise(last(c)), F.lit("")))


def filing_name(family: Column, name: Column) -> dict[str, Column]:
    """surname and kind: a personal family name, else an organisation's display name, else the display name's surname."""
    found = filed_name(family, name)
    return {"surname": found["surname"], "kind": found["kind"]}


def filed_name(family: Column, name: Column) -> Column:
    """The same as one struct, whose parts are made once."""
    given = F.struct(trim_all(F.coalesce(family, F.lit(""))).alias("family"), trim_all(F.coalesce(name, F.lit(""))).alias("name"))
    row = lambda surname, kind: F.struct(surname.cast("string").alias("surname"), kind.cast("string").alias("kind"))
    personal = lambda surname: row(surname, F.when(surname.isNotNull(), "person"))

    def shown_as(shown: Column) -> Column:
        own = once(display_surname(shown), personal)
        return F.when(shown == "", row(F.lit(None), F.lit(None))).when(looks_corporate(shown), row(shown, F.lit("corporate"))).otherwise(own)

    shown = lambda g: once(F.when(g["name"] == "", g["family"]).otherwise(g["name"]), shown_as)
    return once(given, lambda g: F.when((g["family"] != "") & ~looks_corporate(g["family"]), row(g["family"], F.lit("person"))).otherwise(shown(g)))


def year_in_text(c: Column) -> Column:
    """The first year 1600 to 2099 in a date's text."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), "\\b((?:16|17|18|19|20)[0-9]{2})\\b", 1).try_cast("int")


def year_label(year: Column, date: Column) -> Column:
    """A year from 1000 to 2999, else one from 1000 to 2199 in the date's text, else n.d."""
    found = F.regexp_extract(F.coalesce(date, F.lit("")), "\\b(1[0-9]{3}|20[0-9]{2}|21[0-9]{2})\\b", 1)
    return F.when(year.between(1000, 2999), year.cast("string")).when(found != "", found).otherwise("n.d.")


def session_time(name: Column) -> Column:
    """The UTC time at the start of a session file's name, …T12-30-05-123Z_…; null without one."""
    head = F.split_part(F.regexp_extract(name, "([^/]*)$", 1), F.lit("_"), F.lit(1))
    iso = F.regexp_replace(head, "T([0-9]{2})-([0-9]{2})-([0-9]{2})-([0-9]{3})Z$", "T$1:$2:$3.$4Z")
    return F.try_to_timestamp(F.regexp_replace(iso, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))


def compact_time(c: Column) -> Column:
    """20240102T030405Z with its marks; other values stay."""
    return F.regexp_replace(c, "^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})Z$", "$1-$2-$3T$4:$5:$6Z")


def created_date(stem: Column, own: Column, previous: Column, file_date: Column, today: Column) -> dict[str, Column]:
    """created and its evidence: a date that begins the file name, a date property (now, then before), the file system, the run."""
    named = valid_date(F.regexp_extract(stem, "^([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])", 1))
    stated = F.coalesce(valid_date(trim_all(own)), valid_date(trim_all(previous)))
    kind = F.when(named.isNotNull(), "filename").when(stated.isNotNull(), "date_property").when(file_date.isNotNull(), "filesystem").otherwise("run_date")
    return {"created": F.coalesce(named, stated, file_date, today), "evidence": kind}


def looks_binary(c: Column) -> Column:
    """More than a hundredth of the first 10,000 characters are replacement characters, or control characters."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, 10_000)
    n = F.length(head)
    many = lambda p: F.regexp_count(head, F.lit(p)) / n > 0.01
    return (n > 0) & F.coalesce(many("\\x{FFFD}") | many("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), F.lit(False))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of an object with its names sorted and no spaces; nulls are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def fingerprint(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def command_key(c: Column) -> Column:
    """Program and subcommand of the first command of a shell line, without assignments and sudo."""
    first = F.trim(F.regexp_extract(c, "^(.*?)(?:\\n|&&|\\|\\||;|\\||$)", 1))
    pattern = "^(?:\\w+=\\S+\\s+)*(?:sudo\\s+)?(\\S+)(?:\\s+(\\S+))?"
    name, sub = F.regexp_extract(first, pattern, 1), F.regexp_extract(first, pattern, 2)
    return F.when(name == "", "unknown").when((sub != "") & ~sub.startswith("-"), F.concat(name, F.lit(" "), sub)).otherwise(name)


def identifier_core(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]+", "")


def fact_problem(value: Column, due: Column, source: Column) -> Column:
    """bad_due_date, missing_email or missing_identifier; null for a fact that its source bears out or that is no identifier."""
    value = trim_all(value)
    plain = lambda c: F.lower(trim_all(F.regexp_replace(F.translate(c, "‘’“”", "''\"\""), "\\s+", " ")))
    core = identifier_core(value)
    email = value.rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$")
    short = (F.length(core) < IDENTIFIER_CHARACTERS) | (F.length(F.regexp_replace(core, "[^0-9]", "")) < IDENTIFIER_DIGITS)
    out = F.when((F.coalesce(due, F.lit("")) != "") & valid_date(due).isNull(), "bad_due_date").when(is_blank(value), None)
    out = out.when(email & ~plain(F.coalesce(source, F.lit(""))).contains(plain(value)), "missing_email")
    return out.when(email | valid_date(value).isNotNull() | short, None).when(~identifier_core(source).contains(core), "missing_identifier")


def coverage_claims(c: Column) -> Column:
    """What a text says of coverage, "x of y documents" or "sources": array<struct<done,total>>."""
    pattern = "(?i)\\b([0-9]+)\\s+of\\s+([0-9]+)\\s+(?:documents|sources)\\b"
    part = lambda k: F.regexp_extract_all(c, F.lit(pattern), F.lit(k))
    return F.zip_with(part(1), part(2), lambda a, b: F.struct(a.try_cast("long").alias("done"), b.try_cast("long").alias("total")))


def near_decision(cosine: Column, contained: Column) -> Column:
    """Of a pair of notes: duplicate, to be reviewed, or apart."""
    return F.when((cosine >= NEAR_AUTO) & (contained >= CONTAINED), "duplicate").when(cosine >= NEAR_REVIEW, "review").otherwise("apart")


def hybrid_score(cosine: Column, overlap: Column) -> Column:
    return 0.75 * cosine + 0.25 * overlap


def word_share(words: list[str], text: Column) -> Column:
    """Share of a question's distinct words that a text's key holds, to four places."""
    known = sorted(set(words))
    hits = reduce(lambda a, w: a + text.contains(w).cast("int"), known, F.lit(0))
    return F.round(hits / max(1, len(known)), 4)


#: Stems that say nothing, and beginnings of camera exports (fixed values).
GENERIC_STEMS = ("untitled", "document", "new", "copy", "image", "photo", "file", "download", "img", "picture", "final", "draft", "temp", "tmp", "output")
CAMERA = ("img", "dsc", "dscn", "pxl", "vid", "mov", "gopr", "dcim", "p10", "p_")


def name_cluster(name: Column) -> Column:
    """A label for files of like names: screenshots, scans, camera, else the first word of the stem without its counter, or generic."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), "([^/]*)/*$", 1), "(?<=.)\\.[^.]*$", ""))
    base = F.regexp_replace(F.regexp_replace(stem, "[\\s_-]*(\\(?\\d+\\)?|v\\d+|copy|final|draft|rev\\d*)$", ""), "^[ _-]+|[ _-]+$", "")
    word = F.regexp_extract(base, "^[a-z]+", 0)
    out = F.when(word.isin(*GENERIC_STEMS) | (F.length(word) < 2), "generic").otherwise(word)
    out = F.when(stem.rlike("^(" + "|".join(CAMERA) + ")") & stem.rlike("[0-9]"), "camera").otherwise(out)
    return F.when(stem == "", "other").when(stem.rlike("screen[ _]?shot"), "screenshots").when(stem.contains("scan"), "scans").otherwise(out)


def route_path(parts: list[tuple[list[Column], Column]]) -> Column:
    """A folder path from numbered levels, outermost first: each is (numbers from the first level to its own, label). Null where a label cannot be a folder.

    The first level is `NN label`, deeper ones are `N.MM label` with the first number plain. Levels whose last number is null are left out.
    """
    out = []
    for numbers, label in parts:
        pad = [F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0")) for n in numbers]
        number = pad[0] if len(numbers) == 1 else F.concat_ws(".", numbers[0].cast("string"), *pad[1:])
        out.append(F.when(numbers[-1].isNotNull(), F.concat(number, F.lit(" "), label)))
    unsafe = reduce(lambda a, b: a | b, [F.coalesce(p.rlike("[/\\\\]"), F.lit(False)) for p in out])
    return F.when(~unsafe, F.concat_ws("/", *out))
