import pytest
from pyspark.sql import functions as F

from lakewright.operators import entities, sequences


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_links_resolve_by_the_first_tier_that_knows_them(spark):
    links = frame(spark, [(1, "A"), (2, "b "), (3, "c"), (4, "x"), (5, None)], "source int, target string")
    paths = frame(spark, [("a", 10), ("B", 11), ("b", 12)], "name string, entry int")
    aliases = frame(spark, [("A", 99), ("c", 13), ("c", 13)], "name string, entry int")
    got = [(r.source, r.state, r.entry) for r in entities.resolve_in_tiers(links, [paths, aliases]).orderBy("source").collect()]
    assert got == [(1, "resolved", 10), (2, "ambiguous", None), (3, "resolved", 13), (4, "unresolved", None), (5, "unresolved", None)]


def test_first_match_prefers_the_first_key(spark):
    df = frame(spark, [(1, "u", "h"), (2, "v", "h"), (3, "u", "h"), (4, None, None), (5, None, None)], "id int, url string, sum string")
    assert rows_of(entities.first_match(df, "id", {"url": F.col("url"), "sum": F.col("sum")})) == [(2, 1, "sum"), (3, 1, "url")]


def test_merged_records_take_the_first_value_there_is(spark):
    df = frame(spark, [("k", 2, "late", ["b", "a"]), ("k", 1, None, ["a", "c"]), ("k", 3, "later", None)], "k string, at int, v string, tags array<string>")
    assert rows_of(entities.merged_records(df, "k", ["at"], ["v"], ["tags"])) == [("k", 3, "late", ["a", "c", "b"])]
    assert rows_of(entities.field_origins(df, "k", ["at"], ["v"])) == [("k", "v", "late", True), ("k", "v", "later", False)]


def test_roster_and_mentions(spark):
    a = frame(spark, [("Ann", None), ("Bo", "chair")], "name string, role string")
    b = frame(spark, [("ANN", "clerk"), ("bo", "guest"), ("Cy", "guest")], "name string, role string")
    assert rows_of(entities.roster(a, b, "name", ["role"])) == [("Ann", "clerk"), ("Bo", "chair"), ("Cy", "guest")]
    links = frame(spark, [(1, "Dot"), (2, "dot"), (2, "DOT"), (3, "ann")], "source int, target string")
    assert rows_of(entities.mentions(links, a)) == [("dot", "Dot", 2)]


def test_free_and_moved_numbers(spark):
    df = frame(spark, [("p", n) for n in (1, 2, 3, 5)], "parent string, number int")
    assert [r.number for r in entities.free_numbers(df, "parent", "number", 7).orderBy("number").collect()] == [4, 6, 7]
    assert rows_of(entities.renumbered(df, "parent", "number", 2)) == [("p", 2, 3), ("p", 3, 4)]
    assert rows_of(entities.renumbered(df, "parent", "number", 4)) == []


@pytest.mark.parametrize("title, score", [("The Long Road", 100.0), ("The long road home", 45 + 15 + 25 - 8), ("A road", 15 / 3), ("", 0.0)])
def test_candidate_scores(spark, title, score):
    got = spark.range(1).select(entities.candidate_score(F.lit(title), "the LONG road!").alias("s")).first().s
    assert got == pytest.approx(score)


def test_retention_and_windows(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    kept = entities.retained_rare_words(F.lit("harvest harvest mountain rivulet ok"), F.lit("a mountain"))
    assert one(kept["rare"]) == 2 and one(kept["retention"]) == 0.5
    assert one(entities.retained_rare_words(F.lit(""), F.lit("x"))["retention"]) is None
    assert one(entities.best_window_share(F.lit("c d"), F.lit("a b c d e"))) == 1.0
    assert one(entities.best_window_share(F.lit(""), F.lit("a"))) is None


def test_unsupported_claims_stay_only_on_request(spark):
    claims = frame(spark, [(1, [5, 6]), (2, [7]), (3, [])], "claim_id int, evidence_ids array<int>")
    evidence = frame(spark, [(5, 1), (6, 2), (7, 1)], "evidence_id int, source_id int")
    sources = frame(spark, [(1, ""), (2, "http://x")], "source_id int, url string")
    flagged = frame(spark, [(7,)], "id int")
    assert rows_of(entities.claim_units(claims, evidence, sources, flagged)) == [(1, 2, "http://x")]
    assert rows_of(entities.claim_units(claims, evidence, sources, flagged, unsupported=True)) == [(1, 2, "http://x"), (2, 0, None), (3, 0, None)]


def test_cut_points_of_short_and_long_conversations(spark):
    df = frame(spark, [("a", i, "user" if i % 2 else "tool", 10) for i in range(1, 7)] + [("b", 1, "tool", 1), ("b", 2, "user", 1), ("c", 1, "tool", 99)], "c string, turn int, role string, n int")
    got = rows_of(sequences.cut_points(df, "c", "turn", F.col("n"), F.col("role") == "user", 30))
    assert got == [("a", 5), ("b", 2), ("c", None)]


def test_empty_tables(spark):
    links = frame(spark, [], "source int, target string")
    names = frame(spark, [], "name string, entry int")
    assert entities.resolve_in_tiers(links, [names, names]).count() == 0
    assert entities.mentions(links, names).count() == 0
    assert sequences.smoothed(frame(spark, [], "k int, at int, v double"), "k", ["at"], F.col("v"), 4, 2.5, 5.0).count() == 0


def test_related_works_are_dealt_over_tasks(spark):
    rows = [(i, f"Title {i % 3}", None if i == 7 else i % 5, i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, title string, year int, p boolean").coalesce(1)
    found = entities.related_works(df, "id", F.col("title"), F.col("year"), F.col("p"))
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[3] and not b[3] and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 1)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert found.rdd.getNumPartitions() == entities.SPREAD
