"""Folding in the JVM against Unicode's own tables."""

import re
import unicodedata

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakewright.functions import text as X
from lakewright.operators import entities, terms


def full(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()


def test_every_character_with_a_letter_or_digit(spark):
    chars = [c for c in map(chr, range(0x20, 0x110000)) if not "\ud800" <= c <= "\udfff" and c != " " and re.search("[a-z0-9]", full(c))]
    assert len(chars) > 1500
    df = spark.createDataFrame([(i, c, f"x{c}Y ß") for i, c in enumerate(chars)], "i int, c string, s string")
    rows = {r.i: (r.a, r.b, r.k) for r in df.select("i", terms.letters(F.col("c")).alias("a"), terms.letters(F.col("s")).alias("b"), X.title_key(F.col("c")).alias("k")).collect()}
    want = {i: (re.sub("[^a-z]", "", full(c)), re.sub("[^a-z]", "", full(f"x{c}Y ß")), " ".join(re.sub("[^a-z0-9]+", " ", full(c)).split())) for i, c in enumerate(chars)}
    assert rows == want


def test_words(spark):
    words = ["Nāgārjuna", "Straße", "STRASSE ẞ", "ﬁnd ﬃ", "Dvořák – Šárka", "été", "İstanbul", "Ⅻ ½ №", "naïve Ångström", "Æsir œuvre", "日本 한국", "", None]
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    got = {r.i: (r.l, r.k, r.s) for r in df.select("i", terms.letters(F.col("w")).alias("l"), X.title_key(F.col("w")).alias("k"), X.slug(F.col("w")).alias("s")).collect()}
    assert got[0] == ("nagarjuna", "nagarjuna", "nagarjuna") and got[1][0] == "strasse" and got[2][0] == "strassess" and got[3][0] == "findffi"
    assert got[4] == ("dvoraksarka", "dvorak sarka", "dvorak-sarka") and got[5][0] == "ete" and got[6][0] == "istanbul" and got[7][1] == "xii 1 2 no"
    assert got[10][0] == "" and got[11] == ("", "", "item") and got[12] == (None, None, None)
    assert entities.title_key_of("Straße – Nāgārjuna, Ⅻ") == "strasse nagarjuna xii"


def test_near_spellings_and_speakers_beyond_latin_1(spark):
    df = spark.createDataFrame([(1, "We read Nāgārjunā and walked the Strasse with Dvorak"), (2, "nothing")], "id long, t string")
    got = {(r.id, r.term, r.heard_as) for r in terms.near_miss_terms(df, "id", "t", ["Nagarjuna", "Straßen"]).collect()}
    assert got == {(1, "Straßen", "Strasse")} or got == {(1, "Straßen", "the Strasse"), (1, "Straßen", "Strasse")}
    found = {(r.id, r.name) for r in terms.mentioned_speakers(df, "id", "t", [{"name": "Antonín Dvořák"}]).collect()}
    assert found == {(1, "Antonín Dvořák")}


def test_a_text_is_folded_once_and_by_its_kinds(spark, sf_dir):
    """Every character beyond ASCII, few and many kinds in a text, as the table folds them; the query names its text once."""
    table = X.fold_table()
    chars = [c for c in map(chr, range(0x80, 0x110000)) if not "\ud800" <= c <= "\udfff"]
    texts = [*(f"A{c}z {c}ÄB" for c in chars[: 0x2C00 - 0x80]), *("".join(chars[i : i + 7]) + "Éa ẞ" for i in range(0, 0x1F000, 7)), *("".join(chars[i : i + 500]) for i in range(0, 0x3000, 500))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    wrong = [(i, f) for i, f in df.select("i", X.fold(F.col("s"))).collect() if f != texts[i].translate(table)]
    assert wrong == []
    plan = entry.queries()["folded_texts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coalesce(text") == 1
