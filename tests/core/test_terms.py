import difflib
import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lakewright.functions import validation as C
from lakewright.operators import terms
from lakewright.sources import files, sinks


def fold(s):
    return re.sub("[^a-z]", "", "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold())


def heard(text):
    words = re.findall(r"[^\W\d_]+", text or "")
    out = {}
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            out.setdefault(fold("".join(words[i : i + n])), " ".join(words[i : i + n]))
    out.pop("", None)
    return out


def near(text, lexicon):
    runs, known, out = heard(text), {fold(t) for t in lexicon}, []
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    for t in lexicon:
        f = fold(t)
        if re.search(rf"(?<!\w){re.escape(t)}(?!\w)", bare, re.I):
            continue
        scores = [(difflib.SequenceMatcher(None, f, k).ratio(), p) for k, p in runs.items() if k[0] == f[0] and not (k in known and k != f)]
        best = max(scores, key=lambda s: s[0], default=(0, ""))
        if best[0] >= 0.72:
            out.append((-round(best[0], 3), t.lower(), t, best[1]))
    return [(t, p) for *_, t, p in sorted(out)][:8]


TEXTS = [(1, "The pipe line feeds a Spork shuffel"), (2, "spark and SPÁRK, partitions; cat a list"), (3, None), (4, ""), (5, "vectors vector katalyst streeming custom er"), (6, "x" * 5000 + " pipelines " * 50), (7, "The pipe line feeds a Spork shuffel")]
LEXICON = ["pipeline", "spark", "shuffle", "partition", "catalyst", "streaming", "vectors", "customer"]


def test_near_terms_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in TEXTS], "doc_id long, text string, key string, at int")
    got = {}
    for r in terms.near_miss_terms(docs, "doc_id", "text", LEXICON).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.term, r.heard_as))
    assert got == {i: n for i, t in TEXTS if (n := near(t, LEXICON))}
    assert terms.near_miss_terms(docs.limit(0), "doc_id", "text", LEXICON).count() == 0


def test_speakers(spark):
    roster = [{"name": "Mary Ann Porter", "aliases": ["Annie"]}, {"name": "Li Wu"}, {"name": "Host", "appears": "always"}, {"name": "Porter", "appears": "never"}]
    docs = spark.createDataFrame([(1, "Mary and annie saw Mr Portr"), (2, None), (3, "li wu, li")], "doc_id long, text string")
    got = [(r.id, r.name, r.hits, r["rank"]) for r in terms.mentioned_speakers(docs, "doc_id", "text", roster).orderBy("id", "rank").collect()]
    assert got == [(1, "Host", None, 1), (1, "Mary Ann Porter", 3, 2), (2, "Host", None, 1), (3, "Host", None, 1), (3, "Li Wu", 1, 2)]
    assert terms.mentioned_speakers(docs.limit(0), "doc_id", "text", roster).count() == 0


def test_bridges(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.1], "b"), (2, [1.0, 0.0], "a"), (3, [1.0, 0.0], None), (50, [0.9, 0.1], "c"), (51, [0.0, 0.0], "b"), (52, None, "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {(r.left_id, r.right_id) for r in terms.bridges(df.where("vec_id % 50 = 0"), df, "vec_id", "embedding", "label").collect()}
    assert got == {(0, 1), (0, 50), (1, 50), (2, 50)}


@pytest.mark.parametrize(
    "kind, sent, want",
    [("number", '" 1e3 "', "1000"), ("number", "2.5", "2.5"), ("number", '""', None), ("number", "[1]", None), ("integer", "2.0", "2"), ("integer", '"2.5"', None), ("integer", "false", "0"), ("boolean", "2", None), ("boolean", '"TRUE"', None), ("string", "{}", None), ("string", "true", "true")],
)
def test_coercion(spark, kind, sent, want):
    out = C.tool_arguments(F.concat(F.lit('{"k": '), F.col("v"), F.lit("}")), {"k": kind}, ("k",))
    r = spark.createDataFrame([(sent,)], "v string").select(out["problems"].alias("p"), out["values"]["k"].alias("x")).first()
    assert (r.x, r.p) == (want, [] if want is not None else [f"k: {kind}"])


def test_arguments_that_are_no_object(spark):
    out = C.tool_arguments(F.col("v"), {"k": "string"}, ("k",))
    rows = spark.createDataFrame([(x,) for x in (None, "", "[1]", "{}", '{"k": "a", "other": 1}')], "v string").select(out["problems"].alias("p"), out["values"].alias("v")).collect()
    assert [r.p for r in rows] == [["malformed"], ["malformed"], ["malformed"], ["k: missing"], []] and rows[4].v == {"k": "a"}


def test_items(spark):
    sound = {"item_type": F.lit("task"), "title": F.lit("t"), "direct_quotes": F.array(F.lit("q"))}
    case = lambda **k: C.item_problem(C.item_defaults({**sound, **{n: F.lit(v) for n, v in k.items()}}))
    cases = [case(), case(title=" "), case(date_kind="exact"), case(date_kind="exact", date="2024-02-29"), case(date_kind="recurring"), case(confidence="sure"), case(item_type=None), case(scope_relation="none")]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cases)]).first()
    assert list(row) == [None, "title", "date", None, "recurrence", "confidence", "item_type", "scope_relation"]
    no_quotes = C.item_problem(C.item_defaults({k: v for k, v in sound.items() if k != "direct_quotes"}))
    assert spark.range(1).select(no_quotes).first()[0] == "direct_quotes"


def test_meeting_turns(spark, tmp_path):
    (tmp_path / "call 2024-05-06.json").write_text('[{"speaker": " A ", "text": "one"}, {"speaker": "B", "text": " two ", "more": 1}]')
    got = [(str(r.date), r["at"], r.speaker, r.text) for r in files.meeting_turns(spark, str(tmp_path)).orderBy("at").collect()]
    assert got == [("2024-05-06", 0, "A", "one"), ("2024-05-06", 1, "B", "two")]
    for i, bad in enumerate(("{}", "[]", "[", '[{"speaker": "A"}]', '[{"speaker": " ", "text": "x"}]')):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "x.json").write_text(bad)
        with pytest.raises(Exception, match="blank|no transcript|MALFORMED"):
            files.meeting_turns(spark, str(tmp_path / str(i))).collect()


def test_mail(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Message-ID: <1@x>\r\nIn-Reply-To: <0@x>\r\nReferences: <9@x> <0@x>\r\nFrom: A <a@x>\r\nTo: b@x\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nDate: Mon, 6 May 2024 10:00:00 +0200\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=k\r\n\r\n--k\r\nContent-Type: text/html\r\n\r\n<p>Hi &amp; bye</p><script>x()</script>\r\n--k\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename=t.csv\r\n\r\na,b\r\n--k--\r\n")
    (tmp_path / "b.eml").write_bytes(b"\r\n")
    (tmp_path / "c.txt").write_text("no mail")
    a, b = files.mail(spark, str(tmp_path)).orderBy("path").collect()
    assert (a.message_id, a.reply_to, a.sender, a.subject, a.sent, a.body) == ("1@x", ["0@x", "9@x"], "A <a@x>", "café", "2024-05-06T10:00:00+02:00", "Hi & bye")
    assert [(x.name, x.type, x.bytes) for x in a.attachments] == [("t.csv", "text/csv", 3)] and a.attachments[0].sha256 == hashlib.sha256(b"a,b").hexdigest()
    assert (b.message_id, b.sender, b.sent, b.body, b.attachments) == (None, None, None, "", [])


def test_lines_keep_their_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line {i}") for i in range(50, 0, -1)], "at int, line string")
    sinks.write_lines(df, str(tmp_path / "o"), ["at"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text.split("\n")[:-1] == [f"line {i}" for i in range(1, 51)]
    assert spark.range(1).select(sinks.markdown_row([F.lit("a|b"), F.lit("c\n d"), F.lit(None).cast("string")])).first()[0] == "| a\\|b | c d |  |"


def test_runs_that_leave_a_task_are_those_of_the_columns(spark):
    few = "The pipelne ran. ² Ünïcode x²y " + "lorem ipsum " * 2000
    docs = spark.createDataFrame([(i, few) for i in range(40)] + [(99, None)], "doc_id long, text string")
    forms = spark.createDataFrame([("pipeline",), ("unicodexy",)], "folded string")
    seen = terms._seen(docs, "doc_id", "text", forms, 0.72).orderBy("id", "at").collect()
    rows = docs.select("doc_id", F.explode(terms.runs(F.col("text"), able=terms._able(["pipeline", "unicodexy"], 0.72))).alias("r")).orderBy("doc_id", "r.at").collect()
    assert {tuple(r) for r in seen} <= {(r.doc_id, r.r.at, r.r.key, r.r.phrase) for r in rows}
    near = [k for k in ("pipelne", "nicode") if difflib.SequenceMatcher(None, "pipeline", k).ratio() >= 0.72]
    assert {r.key for r in seen} >= set(near) and len(seen) < len(rows) + 1
    assert (0, "pipelne", "pipelne") in {(r.id, r.key, r.phrase) for r in seen}
    got = [(r.id, r.term, r.heard_as) for r in terms.near_miss_terms(docs, "doc_id", "text", ["pipeline"]).collect()]
    assert sorted(got) == [(i, "pipeline", "pipelne") for i in range(40)]
