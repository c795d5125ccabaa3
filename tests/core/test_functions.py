import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakewright.functions import rules
from lakewright.functions import text as X
from lakewright.functions import values as V
from lakewright.operators import checking, graphs, identity, profiling, ranking, relating, sequences


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "cell, kind",
    [("007", "text"), ("7", "integer"), ("1.5", "number"), ("1e3", "number"), ("true", "boolean"), ("2024-02-30", "text"), ("2024-02-29", "date"), ("=A1", "formula"), ("  ", None), (None, None)],
)
def test_cell_kinds(spark, cell, kind):
    assert one(spark, profiling.cell_kind(F.lit(cell).cast("string"))) == kind


def test_profiles_of_empty_and_blank_tables(spark):
    df = spark.createDataFrame([(None, " "), (None, "")], "a string, b string")
    assert {r.column: r.kind for r in profiling.infer_types(df).collect()} == {"a": "empty", "b": "empty"}
    assert profiling.duplicate_rows(df, ["a", "b"]).first()[0] == 0
    assert profiling.profile(df.limit(0)).count() == 0


def test_month_window_wraps(spark):
    assert one(spark, V.months_in(F.lit(11), F.lit(2))) == [11, 12, 1, 2]
    assert one(spark, V.months_in(F.lit(3), F.lit(3))) == [3]


def test_mcnemar(spark):
    p = lambda a, b: one(spark, V.mcnemar(F.lit(a), F.lit(b)))
    assert p(6, 0) == pytest.approx(0.03125) and p(0, 0) == 1.0 and p(3, 3) == 1.0


def test_urls(spark):
    got = one(spark, X.canonical_url(F.lit("HTTP://M.Example.org:80/a/?utm_source=x&b=2&a=1#f")))
    assert got == "http://example.org/a?a=1&b=2"
    assert one(spark, X.canonical_url(F.lit("not a url"))) == "not a url"
    wrapped = "https://www.google.com/url?q=https%3A%2F%2Fduckduckgo.com%2Fl%2F%3Fuddg%3Dhttps%253A%252F%252Fdoi.org%252F10.1000%252FAbC%252F&sa=D"
    assert one(spark, X.canonical_url(F.lit(wrapped))) == "https://doi.org/10.1000/abc"
    assert one(spark, X.canonical_url(F.lit("https://A.org?ref=1&z=1&a=2&z=0&yclid=4"))) == "https://a.org/?a=2&z=1&z=0"


def test_titles_and_quality(spark):
    page = '<head><title> T </title><meta content="C" name="citation_title"><meta property="og:title" content="O"></head>'
    assert one(spark, X.html_title(F.lit(page))) == "O"
    assert one(spark, X.html_title(F.lit(page.replace("og:title", "og:x")))) == "C"
    q = X.text_quality(F.lit("word " * 30 + "....."))
    assert one(spark, q["score"]) == pytest.approx(0.55 + 0.25 + 0.1 * (1 - 5 / 125 / 0.55) + 0.1 * (1 - 5 / 125 / 0.2), abs=1e-4)
    assert one(spark, X.text_quality(F.lit("a1"))["reasons"]) == ["low-text"]
    assert one(spark, X.has_negation(F.lit("It Fails to hold"))) and not one(spark, X.has_negation(F.lit("nothing, neither")))


def test_identifiers_and_names(spark):
    assert one(spark, X.normalize_doi(F.lit("https://doi.org/10.1000/AbC.1."))) == "10.1000/abc.1"
    assert one(spark, X.normalize_doi(F.lit("10.x"))) is None
    assert one(spark, X.slug(F.lit("Élan: vital — 2"))) == "elan-vital-2"
    assert one(spark, X.slug(F.lit("!!"))) == "item"
    assert one(spark, X.title_key(F.lit("The  Über-Text!"))) == "the uber text"


def test_bodies_keep_inner_blank_lines(spark):
    assert one(spark, X.normalize_body(F.lit("\r\n a \r\n\r\nb\t\n\n"))) == " a\n\nb"


def test_common_prefix(spark):
    assert one(spark, X.common_prefix(F.lit("abcdef"), F.lit("abcxef"))) == 3
    assert one(spark, X.common_prefix(F.lit(""), F.lit("abc"))) == 0


def test_clock(spark):
    assert one(spark, V.clock_seconds(F.lit("1:02:03"))) == 3723
    assert one(spark, V.clock_seconds(F.lit("2:03"))) == 123
    assert one(spark, V.clock_seconds(F.lit("x"))) is None
    assert one(spark, V.format_clock(F.lit(3723))) == "1:02:03"


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, V.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.70710678)
    assert one(spark, V.cosine(v(0, 0), v(1, 1))) is None
    assert one(spark, V.cosine(v(1), v(1, 1))) is None
    assert one(spark, V.l2_normalize(v(0, 0))) == [0.0, 0.0]


def test_quotes(spark):
    found = lambda q, s: one(spark, checking.quote_found(F.lit(q), F.lit(s)))
    assert found("“It’s  a long quotation”", 'he said "it\'s a long quotation" then') is True
    assert found("It is a wholly other one", "nothing of the kind") is False
    assert found("short", "short") is None


def test_line_containment(spark):
    assert one(spark, identity.line_containment(F.lit("a\na\nb"), F.lit("a\nb\nc"))) == pytest.approx(2 / 3)
    assert one(spark, identity.line_containment(F.lit(""), F.lit("a"))) == 0.0


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 40)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)] + [(i, i + 1) for i in range(10, 30)], "a long, b long")
    got = {r.id: r.component for r in identity.contraction_components(edges, nodes, "id").collect()}
    assert got[3] == 1 and got[4] == 4 and got[6] == 5 and got[30] == 10 and got[31] == 31


def test_lexical_score_and_empty_query(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat"), (3, None)], "id long, t string")
    got = {r.id: r.score for r in ranking.lexical_scores(docs, "id", "t", "Dog").collect()}
    import math

    assert got == {1: pytest.approx((1 + math.log(4 / 2)) * 1 / (1 + 1.2 * (0.25 + 0.75 * 2 / 200)))}
    assert ranking.lexical_scores(docs, "id", "t", " ").count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1)], "id long, rank int")
    got = {r.id: r.score for r in ranking.fuse_ranks(a, b).collect()}
    assert got == {1: round(1 / 61, 8), 2: round(1 / 62 + 1 / 61, 8)}


def test_links_are_never_guessed(spark):
    links = spark.createDataFrame([(1, "Note"), (1, "twice"), (1, "none")], "src long, target string")
    index = spark.createDataFrame([("note", 7, 0), ("NOTE", 8, 1), ("Twice", 5, 1), ("twice", 6, 1)], "key string, id long, tier int")
    got = {r.target: (r.found, r.state) for r in graphs.resolve(links, index).collect()}
    assert got == {"Note": (7, "resolved"), "twice": (None, "ambiguous"), "none": (None, "unresolved")}


def test_threads_with_a_cycle(spark):
    spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id long, parent long").createOrReplaceTempView("t_threads")
    got = {r.id: r.root for r in graphs.thread_roots(spark, "t_threads", "id", "parent").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_manifest_needs_both_values(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "k string, h string")
    new = spark.createDataFrame([("a", "2"), ("b", "9"), ("d", "4")], "k string, h string")
    assert {r.k: r.change for r in relating.manifest_diff(old, new, "k", "h").collect()} == {"a": "changed", "c": "removed", "d": "added"}


def test_harmonising_needs_disagreement(spark):
    df = spark.createDataFrame([(1, "a b."), (2, "c d."), (3, "e f"), (4, "one")], "id long, t string")
    assert {r.id: r.t for r in sequences.majority_ending(df, "id", "t").collect()} == {1: "a b.", 2: "c d.", 3: "e f.", 4: "one"}
    same = df.where("id < 3")
    assert {r.id: r.t for r in sequences.majority_ending(same, "id", "t").collect()} == {1: "a b.", 2: "c d."}


def test_running_heads(spark):
    rows = [("d", p, f"Report page {p}") for p in range(1, 5)] + [("d", p, f"text {chr(96 + p)}") for p in range(1, 5)]
    got = checking.running_heads(spark.createDataFrame(rows, "doc string, page int, line string")).collect()
    assert [(r.head, r.n) for r in got] == [("report page #", 4)]


def test_text_quality_counts_once_and_by_code_points(spark, capsys):
    df = spark.createDataFrame([("\U0001d400b1\u0301 x\u00a0...!\u3000(42) d\u00e9j\u00e0 ....",), (None,), ("",)], "t string")
    df.select(X.text_quality(F.col("t"))["reasons"].alias("r")).explain()
    assert capsys.readouterr().out.count("\\p{N}]") == 1  # letters and digits are counted once, whatever names them
    q = X.text_quality(F.col("t"))
    assert [tuple(r) for r in df.select(q["n"], q["alnum"], q["words"], q["alnum_share"], q["mark_share"], q["dot_share"]).collect()] == [(21, 10, 1, 0.4762, 0.4762, 0.3333), (0, 0, 0, 0.0, 0.0, 0.0), (0, 0, 0, 0.0, 0.0, 0.0)]


def test_roots_and_coverage_without_lists_of_beginnings(spark, capsys):
    words = ["tablet", "table", "tab", "tablecloth", "cabinets", "cab", "cabin", "chairs", "chair", "lamp", "lamplight", "table-top"]
    rows = [(i, " ".join(words[k] for k in range(12) if (i * 37) >> k & 1), " ".join(words[k] for k in range(12) if (i * 91) >> k & 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    out = df.select("i", checking.invented_words(F.col("a"), F.col("b"), ["lamp"]).alias("new"), checking.vocabulary_coverage(F.col("a"), F.col("b")).alias("c"))
    out.explain()
    assert "sequence(" not in capsys.readouterr().out
    for (_, a, b), r in zip(rows, sorted(out.collect()), strict=True):
        a, b = set(a.split()), list(dict.fromkeys(b.split()))
        rooted = lambda w: any(s.startswith(w) or w.startswith(s) or (len(w) >= 5 and s.startswith(w[:5])) for s in a)  # noqa: E731, B023
        assert r.new == [w for w in b if w != "lamp" and not rooted(w)]
        own = [w for w in a if len(w) >= 5]
        assert r.c == pytest.approx(sum(any(w.startswith(s) and len(s) >= 4 for s in b) for w in own) / len(own) if own else 1.0)


def test_filing_names_against_plain_python(spark, sf_dir):
    """Titles, particles, commas and organisations in any order; the query names its text once."""

    def plain(name):
        clean = re.sub("^,+|,+$", "", re.sub("\\s+", " ", name, flags=re.A).strip())
        if "," in clean:
            return clean.split(",")[0].strip(" ") or None
        words = [w for w in clean.split(" ") if w]
        while words and words[-1].lower().strip(".") in rules.SUFFIXES:
            words.pop()
        k = len(words) - 1
        while k > 0 and words[k - 1].lower() in rules.PARTICLES:
            k -= 1
        return " ".join(words[k:]) or None if words else None

    rng = random.Random(5)
    pool = ["Ann", "Lee", "van", "DER", "de", "la", "Jr.", "III", "v", "ph.d", "M.D.", ".", "vander", "iv.x", "O'Neil", "Ærø", ",", "Ng,"]
    names = [" ".join(rng.choices(pool, k=rng.randint(0, 6))) for _ in range(3000)] + ["Jr Sr", ",,", "x ,", "  ", "iii"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    assert [(n, r[1]) for n, r in zip(names, sorted(df.select("i", rules.display_surname(F.col("n"))).collect()))] == [(n, plain(n)) for n in names]
    kinds = [(None, "a b c d e"), ("", "a b  c\td"), (None, "Ann, b c d e"), ("Bank", "Lee"), ("Lee", "Bank"), ("Bank", None), (None, None), (None, ",")]
    got = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "i int, f string, n string").select("i", *rules.filing_name(F.col("f"), F.col("n")).values()).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == [("a b c d e", "corporate"), ("d", "person"), ("Ann", "person"), ("Lee", "person"), ("Lee", "person"), ("Bank", "corporate"), (None, None), (None, None)]
    plan = entry.queries()["filing_names"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("World Health Organization") == 1


def test_bodies_end_only_at_their_end(spark):
    """A line separator of another kind is no end of the text, so what stands before it stays, as in the SQL."""
    for text, want in [("a \u2028", "a \u2028"), ("a\n\u2028", "a\n\u2028"), ("a \r\n \n\tb \t", "a\n\n\tb"), ("\n", ""), ("", ""), ("a\r\r", "a"), (" a", " a")]:
        assert one(spark, X.normalize_body(F.lit(text))) == want
