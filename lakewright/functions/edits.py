"""Where an edit's old text stands in a content: as it is, or once both are folded."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that count as one plain mark (fixed values): single and double quotes, dashes, spaces; and white space that ends a line.
SINGLE_QUOTES, DOUBLE_QUOTES = "\u2018\u2019\u201a\u201b", "\u201c\u201d\u201e\u201f"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
SPACES = "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LINE_ENDS = "\t\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_PLAIN = str.maketrans({**dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"'), **dict.fromkeys(DASHES, "-"), **dict.fromkeys(SPACES, " ")})
LOCATED = "found boolean, fuzzy boolean, index int, length int, start int, stop int"


def folded(text: str) -> str:
    """Compatibility composition, no white space at the ends of lines, plain quotes, dashes and spaces."""
    lines = unicodedata.normalize("NFKC", text).split("\n")
    return "\n".join(line.rstrip(LINE_ENDS) for line in lines).translate(_PLAIN)


def folded_with_map(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The folded text and, for each of its characters, the stretch of the text that it comes from."""
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    out: list[str] = []
    where: list[tuple[int, int]] = []
    start = 0
    for i in range(1, len(text) + 1):
        piece = text[start:i]
        if i < len(text):
            c = text[i]
            if (not piece.isascii() or not c.isascii()) and (unicodedata.combining(c) or nfkc(piece + c) != nfkc(piece) + nfkc(c)):
                continue  # these characters compose or change places
        plain = nfkc(piece)
        out += plain
        where += [(start, i)] * len(plain)
        start = i
    keep, line_end = [], True
    for k in range(len(out) - 1, -1, -1):
        if out[k] == "\n":
            line_end = True
        elif line_end and out[k] in LINE_ENDS:
            continue
        else:
            line_end = False
        keep.append(k)
    keep.reverse()
    return "".join(out[k] for k in keep).translate(_PLAIN), [where[k] for k in keep]


def locate(content: str, old: str) -> tuple:
    at = content.find(old)
    if at >= 0:
        return True, False, at, len(old), at, at + len(old)
    text, wanted = folded(content), folded(old)
    at = text.find(wanted)
    if at < 0:
        return False, False, -1, 0, None, None
    _, where = folded_with_map(content)
    if not wanted:
        return True, True, at, 0, 0, 0
    return True, True, at, len(wanted), where[at][0], where[at + len(wanted) - 1][1]


def located(content: Column, old: Column) -> Column:
    """found, fuzzy, index and length of the first exact match, else of the first folded one (there in the folded content, as code points);
    start and stop are the stretch of the content itself. Null content or old text is empty; an empty old text stands at 0.
    """

    @F.pandas_udf(LOCATED)
    def find(contents: pd.Series, olds: pd.Series) -> pd.DataFrame:
        rows = [locate(c or "", o or "") for c, o in zip(contents, olds, strict=True)]
        out = pd.DataFrame(rows, columns=["found", "fuzzy", "index", "length", "start", "stop"])
        return out.astype({"start": "Int32", "stop": "Int32"})

    return find(content, old)
