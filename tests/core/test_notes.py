"""Near-verbatim edits, searches, partial JSON, pasted texts, revisions and mail threads."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewright.functions import edits, partial_json, search
from lakewright.operators import graphs, pasted, revisions


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab e\u0301\u0323\n\t\u00a0ﬁ½が\u3099か“”’–\u2003ＡAÅ\u1100\u1161\u11a8\ufeff", max_size=30))
def test_folded_texts_keep_their_places(text):
    plain, where = edits.folded_with_map(text)
    assert plain == edits.folded(text) and len(where) == len(plain)
    assert all(0 <= a < b <= len(text) for a, b in where) and where == sorted(where)


def test_locations(spark):
    rows = [
        ("say “hi” – now", 'say "hi" - now', (True, True, 0, 14, 0, 14)), ("x\u00a0y z", "y z", (True, False, 2, 3, 2, 5)), ("a  \nb\t\nc", "a\nb\nc", (True, True, 0, 5, 0, 8)),
        ("ﬁne ½ day", "fine", (True, True, 0, 4, 0, 3)), ("abc", "abd", (False, False, -1, 0, None, None)), (None, "x", (False, False, -1, 0, None, None)), ("abc", None, (True, False, 0, 0, 0, 0)),
        ("pre e\u0301t ’s", "ét 's", (True, True, 4, 5, 4, 10)), ("one ‘two’ one 'two'", "'two'", (True, False, 14, 5, 14, 19)),
    ]
    df = spark.createDataFrame([(i, c, o) for i, (c, o, _) in enumerate(rows)], "i int, c string, o string")
    got = {r.i: tuple(r.x) for r in df.select("i", edits.located(F.col("c"), F.col("o")).alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, _, w in rows]


def test_query_language(spark):
    parse = lambda q: search.parse(q, spark)
    assert parse('foo "node cve"  bar').tokens == (("fuzzy", "foo"), ("phrase", "node cve"), ("fuzzy", "bar"))
    assert parse('a"b c"d').tokens == (("fuzzy", "a"), ("phrase", "b c"), ("fuzzy", "d"))
    assert parse('foo "bar baz').tokens == (("fuzzy", "foo"), ("fuzzy", '"bar'), ("fuzzy", "baz"))
    assert parse('"" x " "').tokens == (("fuzzy", "x"),) and parse("  ").tokens == ()
    assert parse("re: a+b ").pattern == "a+b" and parse("re:").error and parse("re:(").error


def test_search_order_and_filters(spark):
    rows = [(1, "Fix  the\nBug", "n", 10), (2, "the bug is fixed", " ", 30), (3, "nothing", None, 20), (4, None, "n", 40), (5, "THE BUG", "n", 5)]
    df = spark.createDataFrame(rows, "id long, t string, name string, at long")
    find = lambda q, **k: [r.id for r in search.search(df, F.col("t"), q, F.col("at"), **k).collect()]
    assert find('"the bug"') == [2, 5, 1] and find('"the bug"', by="recent") == [2, 1, 5]
    assert find("re:BUG") == [2, 5, 1] and find("re:(") == [] and find("re:zz") == []
    assert find("") == [4, 2, 3, 1, 5] and find("", name=F.col("name"), named_only=True) == [4, 1, 5]
    assert sorted(find('bug "fix"')) == [1, 2]
    assert find('nthg') == [3]


def read_partly(text):
    """A plain reader of the beginnings of JSON, for comparison; raises ValueError where it is none."""
    nothing = object()
    text = text.strip()

    def value(i):
        i = space(i)
        if i >= len(text):
            return nothing, i
        if text[i] == "{":
            out, i = {}, space(i + 1)
            while i < len(text) and text[i] != "}":
                key, j = value(i)
                if j >= len(text):
                    return out, j
                j = space(j)
                if j >= len(text):
                    return out, j
                item, i = value(j + 1)
                if item is nothing:
                    return out, i
                out[key], i = item, space(i)
                if i < len(text) and text[i] == ",":
                    i = space(i + 1)
            return out, i + 1
        if text[i] == "[":
            out, i = [], space(i + 1)
            while i < len(text) and text[i] != "]":
                item, i = value(i)
                if item is nothing:
                    return out, i
                out.append(item)
                i = space(i)
                if i < len(text) and text[i] == ",":
                    i = space(i + 1)
            return out, i + 1
        if text[i] == '"':
            j = i + 1
            while j < len(text) and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            if j < len(text):
                return json.loads(text[i : j + 1]), j + 1
            return json.loads(re.sub(r"(?<!\\)((?:\\\\)*)\\(u[0-9a-fA-F]{0,3})?$", r"\1", text[i:]) + '"'), len(text)
        word = re.match(r"[^\s,\]}:]*", text[i:])[0]
        j = i + len(word)
        for name, v in (("true", True), ("false", False), ("null", None)):
            if word and name.startswith(word):
                return v, j
        number = re.match(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", word)
        return (json.loads(number[0]) if number else nothing), j

    def space(i):
        while i < len(text) and text[i] in " \n\r\t":
            i += 1
        return i

    found = value(0)[0]
    return {} if found is nothing else found


def test_every_beginning_of_json_is_read(spark):
    whole = [
        '{"a": 1, "b": [1, 2.5, {"c": "d\\n\\u00e9\\"q\\\\"}, true, null], "e": {"f": {}, "g": []}, "h": -12e3}', '[ "x", [ ], { } , false , "y\\/z" ]', '"plain \\t text"',
    ]
    rows = [w[:k] for w in whole for k in range(len(w) + 1)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r.i: json.loads(r.j) for r in df.select("i", partial_json.tolerant_json(F.col("t")).alias("j")).collect()}
    assert [(rows[i], got[i]) for i in range(len(rows))] == [(t, read_partly(t)) for t in rows]


@pytest.mark.parametrize(("text", "want"), [
    ('{"a": "l1\nl2\ttab\x01"}', {"a": "l1\nl2\ttab\x01"}), ('{"p": "c:\\dir\\q"}', {"p": "c:\\dir\\q"}), ('{"p": "\\u12"}', {"p": "\\u12"}), ('{"p": "a\\qb', {"p": "a\\qb"}),
    ("", {}), (None, {}), ("nope", {}), ("   ", {}), ('{"a": "' + "x\\n" * 30000, {"a": "x\n" * 30000}),
])
def test_broken_json(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(partial_json.tolerant_json(F.col("t")).alias("j")).first().j
    assert json.loads(got) == want


def test_pasted_texts(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "epsilon", "ζήτα"]
    rows = []
    for k in range(260):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))
        if rows and rng.random() < 0.5:
            t = t + "  " + rng.choice(rows)[2].upper() + "\n" + t
        rows.append((k % 3 if k % 9 else None, k, t))
    rows += [(0, 900 + k, rows[3][2]) for k in range(50)] + [(0, 990, None), (0, 991, "")]
    probes = [(g, k, t) for g, k, t in rows if k % 7 == 0]
    plain = lambda t: " ".join((t or "").split()).lower()
    want = set()
    for g, k, t in rows:
        if len(plain(t)) < 80:
            continue
        for kind, old in (("text", rows), ("error", [(a, b, plain(c)[:120]) for a, b, c in probes])):
            hits = [b for a, b, c in old if a == g and b < k and len(plain(c)) >= 80 and plain(c) in plain(t)]
            want |= {(g, k, min(hits), kind)} if hits else set()
    df = spark.createDataFrame(rows, "g long, k long, t string")
    got = pasted.pasted(df, "g", "k", F.col("t"), spark.createDataFrame(probes, "g long, k long, text string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60
    assert pasted.pasted(df.limit(0), "g", "k", F.col("t")).count() == 0


def test_revisions(spark):
    at = lambda d: F.timestamp_seconds(F.lit(d))
    snap = lambda rows: spark.createDataFrame(rows, "source long, content string")
    history, changes = revisions.merged(revisions.empty_history(spark), snap([(1, "a"), (2, "b"), (None, "x"), (3, None)]), at(1))
    assert {(r.source, r.change) for r in changes.collect()} == {(1, "added"), (2, "added"), (3, "added")}
    history, changes = revisions.merged(history, snap([(1, "A"), (1, "A"), (3, None), (4, "d")]), at(2))
    assert {tuple(r) for r in changes.collect()} == {(1, "changed", 1, 2), (2, "removed", 1, None), (3, "unchanged", 1, 1), (4, "added", None, 1)}
    history, changes = revisions.merged(history, snap([(2, "b"), (4, "d")]), at(3))
    assert {(r.source, r.change, r.current) for r in changes.collect()} == {(1, "removed", None), (2, "added", 2), (3, "removed", None), (4, "unchanged", 1)}
    rows = {(r.source, r.revision): (r.valid_from.timestamp(), r.valid_to and r.valid_to.timestamp(), r.active) for r in history.collect()}
    assert rows == {(1, 1): (1, 2, False), (1, 2): (2, 3, False), (2, 1): (1, 2, False), (2, 2): (3, None, True), (3, 1): (1, 3, False), (4, 1): (2, None, True)}
    packets = spark.createDataFrame([(10, 1, 1), (11, 2, 2), (12, 9, 1)], "packet long, source long, revision long")
    assert {(r.packet, r.state) for r in revisions.packet_states(history, packets).collect()} == {(10, "retired"), (11, "current"), (12, "unknown")}


def test_mail_threads(spark):
    rows = [(1, "a", [], []), (2, "b", ["gone", "a"], []), (3, "c", [], ["a", "b"]), (4, None, ["c"], None), (5, "e", ["e"], ["zz"]), (6, "dup", None, None), (7, "dup", None, None), (8, "h", ["dup"], []), (9, "i", ["j"], []), (10, "j", ["i"], [])]
    df = spark.createDataFrame(rows, "id long, m string, r array<string>, s array<string>")
    got = {r.id: (r.parent, r.root) for r in graphs.mail_threads(df, "id", "m", "r", "s").collect()}
    assert got == {1: (None, 1), 2: (1, 1), 3: (2, 1), 4: (3, 1), 5: (None, 5), 6: (None, 6), 7: (None, 7), 8: (7, 7), 9: (10, 9), 10: (9, 9)}


def test_shingles_and_their_least_by_doubling():
    rng = random.Random(2)
    mask = (1 << 64) - 1

    def plain(codes):
        h = 0
        for c in codes:
            h = (h * 0x9E3779B97F4A7C15 + c + 1) & mask
        h ^= h >> 29
        h = h * 0xBF58476D1CE4E5B9 & mask
        return h ^ h >> 32

    for n in (0, 15, 16, 78, 79, 80, 300):
        text = "".join(rng.choices("ab é😀", k=n))
        own = [plain(map(ord, text[i : i + 16])) for i in range(n - 15)]
        assert pasted._shingles(text).tolist() == own
        assert pasted._least(pasted._shingles(text)).tolist() == sorted({min(own[i : i + 64]) for i in range(len(own) - 63)})
