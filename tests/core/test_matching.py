import pytest
from pyspark.sql import functions as F

from lakewright.functions import matching


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def plain(needle, text):
    at, run, score = -1, 0, 0.0
    for c in needle:
        i = text.find(c, at + 1)
        if i < 0:
            return None
        run = run + 1 if i == at + 1 else 0
        score += -5 * run + (0 if i == at + 1 or at < 0 else 2 * (i - at - 1)) + (-10 if i == 0 or text[i - 1] in " -_./:\t" else 0) + 0.1 * i
        at = i
    return score - (100 if needle == text else 0)


@pytest.mark.parametrize("needle, text", [("abc", "abc"), ("ac", "a-c b"), ("lw", "lake wright"), ("x", "abc"), ("bb", "abab b"), ("wright", "lake/wright.py")])
def test_fuzzy(spark, needle, text):
    want = plain(needle, text)
    got = one(spark, matching.fuzzy_score(needle, F.lit(text)))
    assert got is None if want is None else got == pytest.approx(want)


def test_fuzzy_swaps_and_tokens(spark):
    assert one(spark, matching.fuzzy_score("v2", F.lit("2v"))) == pytest.approx(plain("2v", "2v") + 5)
    assert one(spark, matching.fuzzy_score("lake py", F.lit("lake.py"))) == pytest.approx(plain("lake", "lake.py") + plain("py", "lake.py"))
    assert one(spark, matching.fuzzy_score("lake zz", F.lit("lake.py"))) is None


def test_dates(spark):
    text = "20240131 and 2023-02-29, 2023-02-28; 31/12/2020 01/02/2020 12/31/2021; 3rd March 2019, Dec 25, 2018; 202405061230"
    got = [str(d) for d in one(spark, matching.dates_in_text(F.lit(text)))]
    assert got == ["2024-05-06", "2023-02-28", "2024-01-31", "2020-12-31", "2021-12-31", "2019-03-03", "2018-12-25"]


def test_json(spark):
    read = lambda s: one(spark, matching.json_in_text(F.lit(s), "a int")["a"])
    assert read('{"a": 1}') == read('so:\n```json\n{"a": 1}\n```\nthanks') == read('text {"a": 1} more') == 1
    assert read("none {a") is None


def test_corrections_and_edits(spark):
    assert one(spark, matching.correct_words(F.lit("The new  yorck and yorck"), [("yorck", "York"), ("new yorck", "New York")])) == "The New York and York"
    edit = lambda *e: one(spark, matching.apply_edits(F.lit("a b c"), list(e)))
    assert edit(("b", "X"), ("a", "Y")) == "Y X c"
    assert edit(("z", "X")) is None and edit((" ", "X")) is None and edit(("a b", "1"), ("b c", "2")) is None and edit(("a", "a")) is None
