"""Column functions over strings, URLs and identifiers. All are built-in expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[\\p{L}\\p{N}_-]+"
#: White space as JavaScript has it, for shares that count other characters.
WHITE = "[\\s\\x{0B}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
#: Query parameters that only track visits, besides all that begin with utm_ (fixed values).
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "mkt_tok", "msclkid", "ref", "ref_src", "spm", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term", "yclid")
#: Hosts that wrap a target URL, and the parameters that hold it (fixed values).
WRAPPERS = {"www.google.com": ("url", "q"), "google.com": ("url", "q"), "duckduckgo.com": ("uddg",), "l.facebook.com": ("u",), "lm.facebook.com": ("u",)}
#: Cues of negation in a claim (fixed values).
NEGATION_CUES = ("not", "no", "never", "without", "cannot", "n't", "fails to", "failed to", "lack", "absence of", "insignificant", "no significant", "no effect", "did not", "does not")
#: Marks in messages of failed edits and their kinds, first match first (fixed values).
EDIT_ERRORS = (
    ("file_not_found", "file not found"),
    ("not_found_exact_text", "could not find the exact text"),
    ("multiple_occurrences", "found multiple occurrences|(?m)^found [0-9]+ occurrences"),
    ("no_changes_made", "no changes made"),
    ("invalid_input", "input is invalid"),
    ("overlapping_edits", "must not overlap"),
    ("aborted", "aborted"),
)
#: Bounds of text quality: least characters, least share of letters and digits, most of marks, most of dot runs (fixed values).
LEAST_CHARACTERS, LEAST_ALNUM, MOST_MARKS, MOST_DOTS = 40, 0.2, 0.55, 0.2


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space (Unicode)."""
    return c.isNull() | c.rlike("(?U)^\\s*$")


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def collapse_space(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, "(?U)\\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased tokens of letters, digits, underscores and hyphens."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def estimate_tokens(c: Column, chars_per_token: float = 4.0) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / F.lit(chars_per_token)).cast("long")


def stable_id(prefix: str, c: Column, length: int = 12) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(c, 256), 1, length))


def slug(c: Column, longest: int = 60, fallback: str = "item") -> Column:
    """ASCII letters and digits, other runs become one hyphen."""
    return once(title_key(c), lambda k: slug_of(k, longest, fallback))


def slug_of(key: Column, longest: int = 60, fallback: str = "item") -> Column:
    """The slug of a text whose title key is known."""
    s = F.rtrim(F.substring(key, 1, longest))
    return F.when(s == "", F.lit(fallback)).otherwise(F.replace(s, F.lit(" "), F.lit("-")))


def letters_of(key: Column) -> Column:
    """The letters a to z of a text whose title key is known."""
    return F.regexp_replace(key, "[^a-z]+", "")


def folded_character(c: str) -> str:
    """A character decomposed for compatibility, without its combining marks, in folded case."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()


@cache
def _fold_tables() -> tuple[str, str, tuple[str, ...]]:
    """Characters that become one or none, what they become, and those that become several with a letter or digit among them (each before its text)."""
    found = {c: folded_character(c) for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"}
    found = {c: f for c, f in found.items() if f != c}
    one, none = [c for c, f in found.items() if len(f) == 1], [c for c, f in found.items() if not f]
    several = tuple(c + f for c, f in found.items() if len(f) > 1 and re.search("[a-z0-9]", f))
    return "".join(one + none), "".join(found[c] for c in one), several


#: Most kinds of characters in a text that are folded one by one (a fixed value).
MOST_KINDS = 64
#: Letters whose lower case is not what they fold to, and those younger than the tables (fixed ranges).
UNEVEN = "[\\x{13A0}-\\x{13FF}\\x{1C89}\\x{1C8A}\\x{A7C0}-\\x{A7FF}\\x{AB70}-\\x{ABBF}\\x{10D40}-\\x{10D8F}\\x{16EA0}-\\x{16EDF}]"


def _ranges(points: list[int]) -> str:
    """A character class of sorted code points."""
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


def fold(c: Column) -> Column:
    """Text without marks and case: ā is a, ß is ss, ﬁ is fi. Hangul and others that fold to several letters beyond a to z stay as they are.

    Text in ASCII is only lower-cased; the other steps are taken where there is something to fold. Looking up every character costs
    far more than a search for each of the few kinds beyond ASCII that a text has, so those are replaced one by one.
    """
    marked, plain, several = _fold_tables()

    def spell_out(text: Column) -> Column:
        pairs = F.split(F.lit("\n".join(several)), "\n")
        return F.aggregate(pairs, text, lambda s, p: F.replace(s, F.substring(p, 1, 1), F.substring(p, 2, 100)))

    rare = _ranges(sorted(ord(x[0]) for x in several if x[0] != "ß"))
    kinds = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit("[^\\x00-\\x7F]"), F.lit(0)))

    def looked_up(text: Column, found: Column) -> Column:
        becomes = lambda k: F.split(F.translate(F.array_join(k, "\n"), marked, plain), "\n")
        pairs = F.filter(F.zip_with(found, becomes(found), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != x["b"])
        few = lambda p: F.lower(F.aggregate(p, text, lambda s, x: F.replace(s, x["a"], x["b"])))
        return once(pairs, lambda p: F.when((F.size(p) > MOST_KINDS) | F.array_join(found, "").rlike(UNEVEN), F.translate(text, marked, plain)).otherwise(few(p)))

    # Java tries the parts of a class one by one for each character, so the classes meet the kinds of characters, not the text
    again = lambda text: once(kinds(text), lambda k: looked_up(text, k))
    spelt = lambda text, k: F.when(F.array_join(k, "").rlike(rare), once(spell_out(text), again)).otherwise(looked_up(text, k))
    full = lambda text: once(F.replace(text, F.lit("ß"), F.lit("ss")), lambda t: once(kinds(t), lambda k: spelt(t, k)))
    return once(c, lambda t: F.when(F.octet_length(t) != F.length(t), full(t)).otherwise(F.lower(t)))


def fold_table() -> dict[int, str]:
    """The same folding for str.translate."""
    marked, plain, several = _fold_tables()
    upper = {chr(c): chr(c).lower() for c in range(65, 91)}
    return str.maketrans({**upper, **dict(zip(marked, plain)), **dict.fromkeys(marked[len(plain) :], ""), **{p[0]: p[1:] for p in several}, "ß": "ss"})


def title_key(c: Column) -> Column:
    """Case, marks and punctuation do not count."""
    return F.trim(F.regexp_replace(fold(c), "\\P{Alnum}+", " "))  # folded text has no ASCII capitals


def truncate_at_boundary(c: Column, most: int) -> Column:
    """At most `most` characters, cut at the last space if there is one in the second half."""
    head = F.substring(c, 1, most)
    at = F.length(F.regexp_extract(head, "^(.*)\\s", 1))
    return F.when(F.length(c) <= most, c).when(at > most // 2, F.rtrim(F.substring(c, F.lit(1), at))).otherwise(head)


def normalize_body(c: Column) -> Column:
    """Line ends unified, trailing white space of lines and outer blank lines removed; inner ones stay.

    Most texts have nothing to replace, which a search for plain strings tells sooner than a pattern does. The end is that of the text
    alone: "$" also stands before a last line separator of another kind.
    """
    has = lambda x, *found: reduce(lambda p, q: p | q, [F.contains(x, F.lit(f)) for f in found])
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    s = bound(c, lambda x: F.when(has(x, "\r"), F.regexp_replace(x, "\\r\\n?", "\n")).otherwise(x))
    loose = lambda x: has(x, " \n", "\t\n") | F.endswith(x, F.lit(" ")) | F.endswith(x, F.lit("\t"))
    s = bound(s, lambda x: F.when(loose(x), F.regexp_replace(x, "[ \\t]++(\n|\\z)", "$1")).otherwise(x))
    return F.btrim(s, F.lit("\n"))


def normalize_doi(c: Column) -> Column:
    """A bare lower-case DOI, or null if it is not shaped like one."""
    s = F.regexp_replace(F.lower(F.trim(c)), "^(https?://(dx\\.)?doi\\.org/|doi:\\s*)", "")
    s = F.regexp_replace(s, "[.,;)\\]]+$", "")
    return F.when(s.rlike("^10\\.[0-9]{4,9}/\\S+$"), s)


def _parameter(query: Column, name: str) -> Column:
    value = F.regexp_extract(query, f"(?:^|&){name}=([^&]*)", 1)
    return F.when(value != "", F.try_url_decode(value))


def unwrapped_url(c: Column) -> Column:
    """The target of a redirect wrapper's URL, or the URL itself."""
    host, query = F.lower(F.regexp_extract(c, "(?i)^https?://([^/?#:]*)", 1)), F.regexp_extract(c, "^[^?#]*\\?([^#]*)", 1)
    out = c
    for wrapper, names in WRAPPERS.items():
        for name in reversed(names):
            target = _parameter(query, name)
            out = F.when((host == wrapper) & target.rlike("(?i)^https?://"), target).otherwise(out)
    return out


def once(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def canonical_url(c: Column) -> Column:
    """Unwrapped (up to three times); lower-case scheme and host without m. or amp., no default port, tracking parameters or fragment;
    parameters by name, a slash at the end of the host only; a DOI's path in lower case. Escapes stay as they are written.
    """
    for _ in range(3):
        c = once(c, unwrapped_url)
    return once(c, _canonical)


def _canonical(url: Column) -> Column:
    whole = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"
    part = lambda k: F.regexp_extract(url, whole, k)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), "^m\\.", ""), "^amp\\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.when(part(3) == "", "/").when(part(3) != "/", F.regexp_replace(part(3), "/$", "")).otherwise(part(3))
    path = F.when(host.rlike("(^|\\.)doi\\.org$") & path.rlike("(?i)^/10\\.[0-9]{4,9}/"), F.lower(path)).otherwise(path)
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    keep = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(name(p)).startswith("utm_") & ~F.lower(name(p)).isin(*TRACKING))
    placed = F.array_sort(F.transform(keep, lambda p, i: F.struct(name(p).alias("name"), i.alias("at"), p.alias("p"))))
    query = F.array_join(F.transform(placed, lambda x: x["p"]), "&")
    out = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.rlike(whole), out).otherwise(url)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def readable_html(c: Column) -> Column:
    """Text of a page: no scripts, styles or tags; block ends are line ends; common entities decoded."""
    s = F.regexp_replace(c, "(?is)<(script|style|noscript|template)\\b.*?</\\1\\s*>", " ")
    s = F.regexp_replace(s, "(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, "(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/section|/article)\\b[^>]*>", "\n")
    s = F.regexp_replace(s, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    s = F.regexp_replace(s, "[ \\t\\x0B\\f\\r]+", " ")
    s = F.regexp_replace(s, " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(s, "^\\s+|\\s+$", "")


def _meta(c: Column, key: str, name: str) -> Column:
    first = F.regexp_extract(c, f"(?is)<meta\\s[^>]*{key}=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    last = F.regexp_extract(c, f"(?is)<meta\\s[^>]*content=[\"']([^\"']*)[\"'][^>]*{key}=[\"']{name}[\"']", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))


def html_title(c: Column) -> Column:
    """og:title, else citation_title, else the title element; null where all are missing or empty."""
    element = F.trim(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1))
    return F.coalesce(_meta(c, "property", "og:title"), _meta(c, "name", "citation_title"), F.nullif(element, F.lit("")))


def html_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?i)<a\\s[^>]*href=[\"']([^\"'#]+)"), F.lit(1))


def wikilinks(c: Column) -> Column:
    """Targets of [[target|label]] and [[target#heading]]."""
    return F.transform(F.regexp_extract_all(c, F.lit("\\[\\[([^\\]\\|#]+)"), F.lit(1)), lambda x: F.trim(x))


def has_negation(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("(^|[^a-z])(" + "|".join(NEGATION_CUES) + ")([^a-z]|$)"), F.lit(False))


def error_kind(text: Column, is_error: Column, matched: Column) -> Column:
    """The kind of a failed edit: missing_result without a result, null for a success, else by the first mark in its message."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("other")
    for name, pattern in reversed(EDIT_ERRORS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return F.when(~matched, "missing_result").when(is_error, out)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common beginning: bisection over equal prefixes."""
    low, high = F.lit(0), F.least(F.length(a), F.length(b))
    state = F.struct(low.alias("lo"), high.alias("hi"))

    def step(s, _):
        mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(F.greatest(s["lo"], mid - 1)).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), state, step)["lo"]


def text_quality(c: Column) -> dict[str, Column]:
    """Counts, shares (to four places), a weighted score, and the reasons for which a text looks like noise."""
    text = F.coalesce(c, F.lit(""))
    # characters of a class are counted by taking out its runs
    counted = lambda runs: F.length(text) - F.length(F.regexp_replace(text, runs, ""))
    counts = F.struct(
        F.length(F.regexp_replace(text, f"{WHITE}+", "")).alias("n"),
        counted("[\\p{L}\\p{N}]+").alias("alnum"),
        F.regexp_count(text, F.lit("\\p{L}{3,}")).alias("words"),
        counted("[.!?,;:$%#&*()]+").alias("marks"),
        counted("\\.{3,}").alias("dots"),
    )
    # bound as one argument: branches of conditions would count again
    result = once(counts, lambda k: F.struct(*[x.alias(name) for name, x in _quality_of(k["n"], k["alnum"], k["words"], k["marks"], k["dots"]).items()]))
    return {name: result[name] for name in ("n", "alnum", "words", "alnum_share", "mark_share", "dot_share", "score", "reasons")}


def _quality_of(n: Column, alnum: Column, words: Column, marks: Column, dots: Column) -> dict[str, Column]:
    share = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    score = F.least(F.lit(1.0), share(alnum) / 0.7) * 0.55 + F.least(F.lit(1.0), words / 20.0) * 0.25
    score = score + F.greatest(F.lit(0.0), 1 - share(marks) / MOST_MARKS) * 0.1 + F.greatest(F.lit(0.0), 1 - share(dots) / MOST_DOTS) * 0.1
    long_ = n > 100
    reasons = [
        F.when(alnum < LEAST_CHARACTERS, "low-text"),
        F.when(long_ & (share(alnum) < LEAST_ALNUM), "low-alphanumeric-ratio"),
        F.when(long_ & (share(marks) > MOST_MARKS), "punctuation-heavy"),
        F.when(long_ & (share(dots) > MOST_DOTS), "dot-run-heavy"),
        F.when((alnum >= LEAST_CHARACTERS) & (words < 3), "insufficient-word-like-text"),
    ]
    return {"n": n, "alnum": alnum, "words": words, "alnum_share": F.round(share(alnum), 4), "mark_share": F.round(share(marks), 4), "dot_share": F.round(share(dots), 4), "score": F.round(score, 4), "reasons": F.array_compact(F.array(*reasons))}


def any_of(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs)
