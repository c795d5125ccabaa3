"""JSON as models send it: whole, with raw control characters or bad escapes, or cut off. All are built-in expressions.

The ladder is the text as it is, with its strings repaired, completed, and repaired and completed; the first that parses counts.
Completion reads the text once, character by character, with the stack of open brackets; it closes what is open, takes the part of
a string, number or literal that has come, and drops a key without value. What does not parse at all is an empty object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LITERALS = ("true", "false", "null")
_NAMED = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _once(c: Column, f) -> Column:
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: Stand for a pair of backslashes and an escaped quote while strings are cut out; no text has them (noncharacters).
_PAIR, _QUOTE = "\ufdd0", "\ufdd1"


def repaired(c: Column) -> Column:
    """Control characters within strings escaped, backslashes doubled that begin no escape."""

    def controls(s: Column) -> Column:
        for code in range(0x20):
            s = F.replace(s, F.lit(chr(code)), F.lit(_NAMED.get(chr(code), f"\\u{code:04x}")))
        return s

    def mend(s: Column) -> Column:
        s = F.regexp_replace(s, "\\\\(?![/bfnrt]|u[0-9a-fA-F]{4})", "\\\\\\\\")
        return _once(s, lambda v: F.when(v.rlike("[\\x00-\\x1f]"), controls(v)).otherwise(v))

    marked = F.replace(F.replace(c, F.lit("\\\\"), F.lit(_PAIR)), F.lit('\\"'), F.lit(_QUOTE))
    pieces = F.transform(F.split(marked, '"'), lambda p, i: F.when(i % 2 == 1, mend(p)).otherwise(p))
    return F.replace(F.replace(F.array_join(pieces, '"'), F.lit(_PAIR), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))


def completed(c: Column) -> Column:
    """A text that begins as JSON and is cut off, with an end; null where it is no beginning of an object, array or value."""
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(False).alias("quoted"),
        F.lit(0).alias("escape"),  # characters of an escape still to come; -1 after a backslash
        F.lit("").alias("open"),  # brackets that are open, the last one first
        F.lit(0).alias("kept"),  # length of the text without its last member
        F.lit(0).alias("token"),  # where the last string, number or literal begins; 0 if there is none
        F.lit(False).alias("valued"),  # whether the last member has its colon
    )

    def step(s: Column, ch: Column) -> Column:
        at = s["at"] + 1
        opens, closes, comma = ch.isin("{", "["), ch.isin("}", "]"), ch == ","
        space = ch.isin(" ", "\n", "\r", "\t")
        escape = F.when(s["escape"] == -1, F.when(ch == "u", 4).otherwise(0)).when(s["escape"] > 0, s["escape"] - 1).when(ch == "\\", -1).otherwise(0)
        quoted = F.when(s["quoted"], ~((ch == '"') & (s["escape"] == 0))).otherwise(ch == '"')
        free = ~s["quoted"]
        return F.struct(
            at.alias("at"),
            quoted.alias("quoted"),
            F.when(free, 0).otherwise(escape).alias("escape"),
            F.when(free & opens, F.concat(F.when(ch == "{", "}").otherwise("]"), s["open"])).when(free & closes, F.substring(s["open"], 2, 1 << 30)).otherwise(s["open"]).alias("open"),
            F.when(free & (opens | closes), at).when(free & comma, at - 1).otherwise(s["kept"]).alias("kept"),
            F.when(free & (opens | closes | comma | (ch == ":")), 0).when(free & ~space & (s["token"] == 0), at).otherwise(s["token"]).alias("token"),
            F.when(free & (opens | comma), False).when(free & (ch == ":"), True).when(free & closes, True).otherwise(s["valued"]).alias("valued"),
        )

    def bare(word: Column) -> Column:
        """A literal or number as far as it has come; a string that is whole as it is."""
        number = F.regexp_extract(word, "^-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", 0)
        out = F.nullif(number, F.lit(""))
        for name in _LITERALS:
            out = F.when((word != "") & F.lit(name).startswith(word), name).otherwise(out)
        return F.when(word.startswith('"'), word).otherwise(out)

    def end(text: Column, s: Column) -> Column:
        cut_escape = F.regexp_replace(F.substring(text, s["token"], s["at"]), "\\\\(u[0-9a-fA-F]{0,3})?$", "")
        string = F.concat(F.when(s["escape"] != 0, cut_escape).otherwise(F.substring(text, s["token"], s["at"])), F.lit('"'))
        value = F.when(s["quoted"], string).otherwise(_once(F.rtrim(F.substring(text, s["token"], s["at"])), bare))
        # a key without value, a value that has not begun, a comma at the end: the text without the last member
        member = (s["token"] > 0) & ~(s["open"].startswith("}") & ~s["valued"])
        whole = F.when(member, F.concat(F.substring(text, F.lit(1), s["token"] - 1), value))
        return F.concat(F.coalesce(whole, F.substring(text, F.lit(1), s["kept"])), s["open"])

    # after a bracket closes, nothing of the last member is open
    scanned = lambda text: F.aggregate(F.split(text, ""), start, step)
    return _once(c, lambda text: _once(scanned(text), lambda s: F.nullif(end(text, s), F.lit(""))))


def tolerant_json(c: Column) -> Column:
    """The JSON text (canonical) that a possibly broken one stands for; '{}' for nothing. White space round the text does not count."""
    parsed = lambda x: F.to_json(F.try_parse_json(x))

    def ladder(text: Column) -> Column:
        mended = lambda f: _once(repaired(text), f)
        return F.coalesce(parsed(text), mended(parsed), parsed(completed(text)), mended(lambda m: parsed(completed(m))), F.lit("{}"))

    return _once(F.regexp_replace(F.coalesce(c, F.lit("")), "^\\s+|\\s+$", ""), lambda t: F.when(t == "", "{}").otherwise(ladder(t)))
