"""Fuzzy matches, dates in text, JSON in text, dictionary corrections and edits, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names and their numbers (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: What a match step is worth (fixed values): run, gap, word start, place, whole text, letters and digits swapped.
RUN, GAP, WORD_START, PLACE, WHOLE, SWAPPED = -5.0, 2.0, -10.0, 0.1, -100.0, 5.0


def _in_order(needle: str, text: Column) -> Column:
    """Score of the leftmost in-order match of the needle's characters; null if there is none. Lower is better."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0.0).alias("score"), F.lit(True).alias("ok"))

    def step(s, c):
        i = F.position(c, text, s["at"] + 1)  # 0 if it is not there
        next_to = i == s["at"] + 1
        run = F.when(next_to, s["run"] + 1).otherwise(0)
        gap = F.when(~next_to & (s["at"] > 0), (i - s["at"] - 1) * GAP).otherwise(0.0)
        word = F.when((i == 1) | F.substring(text, i - 1, F.lit(1)).rlike("[\\s\\-_./:]"), WORD_START).otherwise(0.0)
        return F.struct(i.alias("at"), run.alias("run"), (s["score"] + run * RUN + gap + word + (i - 1) * PLACE).alias("score"), (s["ok"] & (i > 0)).alias("ok"))

    end = F.aggregate(F.array(*[F.lit(c) for c in needle]), start, step)
    return F.when(end["ok"], end["score"] + F.when(text == needle, WHOLE).otherwise(0.0))


def token_score(token: str, text: Column) -> Column:
    """Score of one token; null if it does not match. A token of letters then digits, or the reverse, may match with its parts swapped."""
    low, token = F.lower(text), token.lower()
    score = _in_order(token, low)
    if m := re.fullmatch(r"([a-z]+)([0-9]+)|([0-9]+)([a-z]+)", token):
        a, b = (m[1], m[2]) if m[1] else (m[3], m[4])
        score = F.coalesce(score, _in_order(b + a, low) + SWAPPED)
    return score


def fuzzy_score(query: str, text: Column) -> Column:
    """Sum over the query's tokens (split at spaces and slashes), all of which must match; null if one does not."""
    total = F.lit(0.0)
    for token in [t for t in re.split(r"[\s/]+", query.strip().lower()) if t]:
        total = total + token_score(token, text)
    return total


def _dates(c: Column, pattern: str, y: int, m: int, d: int, month_names: bool = False) -> Column:
    part = lambda k: F.regexp_extract_all(c, F.lit(pattern), F.lit(k))
    rows = F.arrays_zip(part(y).alias("y"), part(m).alias("m"), part(d).alias("d"))
    month = (lambda x: F.lpad(F.array_position(F.array(*[F.lit(n[:3]) for n in MONTHS]), F.substring(F.lower(x), 1, 3)).cast("string"), 2, "0")) if month_names else (lambda x: F.lpad(x, 2, "0"))
    return F.array_compact(F.transform(rows, lambda r: F.try_to_date(F.concat_ws("-", r["y"], month(r["m"]), F.lpad(r["d"], 2, "0")), "yyyy-MM-dd")))


def dates_in_text(c: Column) -> Column:
    """Every date that has one reading, kind by kind: ids of 12 or 14 digits, ISO, 8 digits, numeric where only one order is possible, month names."""
    names = "|".join(n if len(n) < 4 else f"{n[:3]}(?:{n[3:]})?" for n in MONTHS)
    year, month, day = "((?:19|20)\\d\\d)", "(0[1-9]|1[0-2])", "(0[1-9]|[12]\\d|3[01])"
    numeric = "(?<!\\d)(\\d{1,2})[-/.](\\d{1,2})[-/.]((?:19|20)\\d\\d)(?!\\d)"
    part = lambda k: F.regexp_extract_all(c, F.lit(numeric), F.lit(k))

    def read(r):
        a, b = r["a"].cast("int"), r["b"].cast("int")
        date = lambda m, d: F.try_to_date(F.concat_ws("-", r["y"], F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
        return F.when((a > 12) & (b <= 12), date(b, a)).when((b > 12) & (a <= 12), date(a, b))

    return F.concat(
        _dates(c, f"(?<!\\d){year}{month}{day}\\d{{4}}(?:\\d\\d)?(?!\\d)", 1, 2, 3),
        _dates(c, f"(?<!\\d){year}-{month}-{day}(?!\\d)", 1, 2, 3),
        _dates(c, f"(?<!\\d){year}{month}{day}(?!\\d)", 1, 2, 3),
        F.array_compact(F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("y")), read)),
        _dates(c, f"(?i)\\b(\\d{{1,2}})(?:st|nd|rd|th)? ({names})\\.?,? {year}(?!\\d)", 3, 2, 1, True),
        _dates(c, f"(?i)\\b({names})\\.? (\\d{{1,2}})(?:st|nd|rd|th)?,? {year}(?!\\d)", 3, 1, 2, True),
    )


def json_in_text(c: Column, schema: str) -> Column:
    """The first of these that parses: the whole text, a fenced block, the outermost braces. Null otherwise."""
    fenced = F.regexp_extract(c, "(?s)```(?:json)?\\s*(.*?)```", 1)
    braces = F.regexp_extract(c, "(?s)(\\{.*\\})", 1)
    parse = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(parse(F.trim(c)), parse(F.trim(fenced)), parse(braces))


def correct_words(c: Column, entries: list[tuple[str, str]], whole_word: bool = True) -> Column:
    """Variants become their correct form, longest first, in any case and with any spacing."""
    out = c
    for variant, right in sorted(entries, key=lambda e: -len(e[0])):
        pattern = "\\s+".join(re.escape(w) for w in variant.split())
        pattern = f"(?<!\\w){pattern}(?!\\w)" if whole_word else pattern
        out = F.regexp_replace(out, f"(?iU){pattern}", right.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def apply_edits(c: Column, edits: list[tuple[str, str]]) -> Column:
    """Each old text must occur exactly once and overlap no other; null if one does not, or if nothing changes."""
    count = lambda old: (F.length(c) - F.length(F.replace(c, F.lit(old), F.lit("")))) / len(old)
    spots = F.array_sort(F.array(*[F.struct(F.instr(c, old).alias("at"), F.lit(len(old)).alias("n"), F.lit(new).alias("new")) for old, new in edits]))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"), F.lit(True).alias("ok"))
    step = lambda s, e: F.struct((e["at"] + e["n"]).alias("at"), F.concat(s["out"], F.substring(c, s["at"], e["at"] - s["at"]), e["new"]).alias("out"), (s["ok"] & (e["at"] >= s["at"])).alias("ok"))
    end = F.aggregate(spots, start, step)
    whole = F.concat(end["out"], F.substring(c, end["at"], F.length(c)))
    once = F.lit(True)
    for old, _ in edits:
        once = once & (count(old) == 1)
    return F.when(once & end["ok"] & (whole != c), whole)
