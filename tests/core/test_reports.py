"""Cleaning steps, file names, query classification, word checks, items from JSON, backup dates, schedules and time buckets."""

import datetime as dt
import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakewright.functions import asking
from lakewright.functions import rules as U
from lakewright.functions import validation as C
from lakewright.operators import checking, cleaning, profiling
from lakewright.sources import sinks


def values(spark, column, rows, name="x"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, {name} string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_operations_in_order(spark):
    df = spark.createDataFrame([(1, " a ", "n/a"), (2, None, " "), (3, "N/A ", "b")], "k int, x string, `y z` string")
    ops = [{"op": "trim"}, {"op": "normalize_blanks", "tokens": ["n/a", " N/A"]}, {"op": "rename", "from": "y z", "to": "y"}, {"op": "drop_columns", "columns": ["k"]}, {"op": "drop_blank_rows"}]
    assert [tuple(r) for r in cleaning.apply_operations(df, ops).collect()] == [("a", ""), ("", "b")]
    assert cleaning.apply_operations(df, [{"op": "select_columns", "columns": ["y z", "k"]}]).columns == ["y z", "k"]
    for bad in ({"op": "sort"}, {"op": "rename", "from": "q", "to": "r"}, {"op": "rename", "from": "x", "to": "k"}, {"op": "select_columns", "columns": []}, {"op": "drop_columns", "columns": ["q"]}, {"op": "normalize_blanks"}, "trim"):
        with pytest.raises(ValueError):
            cleaning.apply_operations(df, [bad])


def test_name_clusters(spark):
    cases = {"Screen Shot 2020.png": "screenshots", "scan003.pdf": "scans", "IMG_2020.jpg": "camera", "Report final.docx": "report", "report (2).md": "report", "untitled 3.txt": "generic", "x.txt": "generic", "42.csv": "generic", "invoice-v12.pdf": "invoice", "a/b/Notes_draft.md": "notes", "": "other", ".hidden": "generic"}
    assert values(spark, U.name_cluster(F.col("x")), list(cases)) == list(cases.values())
    assert values(spark, U.name_cluster(F.col("x")), [None]) == ["other"]


def test_classified_queries(spark):
    queries = ["What is dependent origination?", "10.1038/s41586-020 in biomedical drug trials", "arxiv:2101.00001v2", "pmid 1234567 today", "Taishō 262 and the Lotus sutra", "978-0-306-40615-7", "  ", None, "how do I fix a leaky tap", "definition of ontologies?", "rusty war stories", "hep-th oclc: 12"]
    df = spark.createDataFrame(list(enumerate(queries)), "i int, q string")
    rows = {r.i: r for r in df.select("i", *[c.alias(n) for n, c in asking.classified(F.col("q")).items()]).collect()}
    assert rows[0].term == "dependent origination" and rows[0].intents == ["definition"]
    assert rows[1].doi == "10.1038/s41586-020" and rows[1].topics == ["biomedical"] and rows[1].intents == ["academic"]
    assert rows[2].arxiv == "2101.00001v2" and rows[3].pmid == "1234567" and rows[3].intents == ["news", "academic"]
    assert rows[4].taisho == "262" and rows[4].topics == ["buddhism"] and rows[4].intents == ["canon"]
    assert rows[5].book == "isbn:9780306406157" and rows[5].intents == ["books"]
    assert rows[6].term == rows[7].term == "" and rows[7].topics == ["general"] and rows[8].topics == ["general"]
    assert rows[9].term == "ontologies" and rows[9].topics == ["philosophy"] and rows[10].topics == ["history"]
    providers = spark.createDataFrame([("b", ["biomedical", "history"], 2), ("a", ["history"], 2), ("z", ["history", "*"], 1)], "provider string, topics array<string>, authority int")
    asked = spark.createDataFrame([(1, ["history"]), (2, ["general"]), (3, ["biomedical", "history"])], "id int, topics array<string>")
    assert sorted(tuple(r) for r in asking.routed(asked, "id", "topics", providers).collect()) == [(1, "a", 2), (1, "b", 3), (1, "z", 1), (3, "a", 2), (3, "b", 3), (3, "z", 1)]


def plain_invented(source, cleaned, allowed):
    words = lambda t: re.findall("[a-z][a-z-]{2,}", t.lower().replace("'", ""))
    said = set(words(source))
    heads = {w[:k] for w in said for k in range(3, len(w) + 1)}
    out = []
    for w in words(cleaned):
        if w in allowed or w in heads or any(w[:k] in said for k in range(3, len(w))) or (len(w) >= 5 and w[:5] in heads) or w in out:
            continue
        out.append(w)
    return out


def test_invented_words(spark):
    source = "We expand the rpgnet application, Śāntideva's cats don't run on-line over there"
    cleaned = "# Heading invented\n- expands app rpg\n> [!note] quoted planet\n**Label:** santideva's caterpillar |table| running onward tomato tomato thereafter expansion"
    df = spark.createDataFrame([(source, cleaned), (None, "brand new words"), ("a b", None)], "s string, c string")
    got = [r.v for r in df.select(checking.invented_words(F.col("s"), F.col("c"), ["table"]).alias("v")).collect()]
    assert got[0] == ["quoted", "planet", "caterpillar", "onward", "tomato"] and got[1] == ["brand", "new", "words"] and got[2] == []
    plain = cleaned.split("\n", 1)[1].replace("**Label:** ", "").replace("[!note]", "")
    assert got[0] == plain_invented(source.replace("Śā", "sa"), plain, ["table"])
    cover = [r.v for r in df.select(checking.vocabulary_coverage(F.col("s"), F.col("c")).alias("v")).collect()]
    # expand, rpgnet, application, santidevas, don't (dont), on-line, there: five letters or more, and their beginnings of four or more
    assert cover[1] == 1.0 and cover[2] == 1.0 and 0 < cover[0] < 1
    units = spark.createDataFrame([(1, "wonderful elephants marching", "tiny"), (2, "wonderful elephants", "wonderful elephant")], "id int, t string, w string")
    assert [tuple(r) for r in checking.dropped_units(units, "id", F.col("t"), F.col("w")).collect()] == [(1, 0.0)]


def test_items_from_json(spark):
    base = {"item_type": "task", "title": " T ", "direct_quotes": ["q"]}
    cases = [
        ({}, None), ({"direct_quotes": " one "}, None), ({"direct_quotes": [1]}, "direct_quotes"), ({"direct_quotes": []}, "direct_quotes"), ({"direct_quotes": None}, "direct_quotes"), ({"direct_quotes": ["a", " "]}, "direct_quotes"),
        ({"offset_days": "3"}, "offset_days"), ({"offset_days": 2.5}, "offset_days"), ({"offset_days": -3}, None), ({"offset_days": ""}, None), ({"teams": "a"}, None), ({"teams": " "}, None), ({"teams": [" "]}, "teams"), ({"teams": 3}, "teams"), ({"workstreams": {"a": 1}}, "workstreams"),
        ({"start_date": "2024-02-30"}, "start_date"), ({"end_date": "soon"}, "end_date"), ({"start_date": ""}, None), ({"duration_days": -1}, "duration_days"), ({"duration_days": 1.5}, "duration_days"), ({"duration_days": 0}, None), ({"scope_relation": "far"}, "scope_relation"),
        ({"date_kind": "exact"}, "date"), ({"date_kind": "exact", "date": "2024-02-29"}, None), ({"date": "2024-02-29"}, "date of no exact kind"), ({"item_type": "wish"}, "item_type"), ({"title": " "}, "title"), ({"date_kind": "recurring"}, "recurrence"), ({"confidence": "sure"}, "confidence"),
    ]
    sent = [json.dumps({**base, **c}) for c, _ in cases] + ["[1]", "{", None]
    df = spark.createDataFrame(list(enumerate(sent)), "i int, j string")
    item = C.extracted_item(F.col("j"))
    rows = {r.i: r for r in df.select("i", *[c.alias(k) for k, c in item.items()]).collect()}
    assert [rows[i].problem for i in range(len(cases))] == [w for _, w in cases]
    assert all(rows[len(cases) + k].problem == "item" for k in range(3))
    assert rows[0].title == "T" and rows[0].confidence == "medium" and rows[0].teams == [] and rows[0].schedule_basis is None and rows[1].direct_quotes == ["one"]
    assert rows[10].teams == ["a"] and rows[11].teams == [] and rows[8].offset_days == -3 and rows[23].schedule_basis == "source"


def test_backup_dates(spark):
    copies = spark.createDataFrame([("a", "r2", "created: 2020-01-02"), ("a", "r1", "created: soon"), ("b", "r1", "date: 2019-05-05\n"), ("b", "r0", None), ("c", "r1", "x: 1")], "note string, run string, t string")
    found = C.created_from_backups(copies, "note", "run", F.col("t"))
    assert sorted((r.note, r.run, str(r.created)) for r in found.collect()) == [("a", "r2", "2020-01-02"), ("b", "r1", "2019-05-05")]
    notes = spark.createDataFrame([("a", "2001-01-01"), ("b", None), ("c", None), ("d", None)], "note string, own string")
    got = {r.note: (str(r.created), r.evidence) for r in C.created_with_backups(notes, "note", F.to_date("own"), found, F.when(F.col("note") == "c", F.to_date(F.lit("1999-09-09")))).collect()}
    assert got == {"a": ("2001-01-01", "note"), "b": ("2019-05-05", "backup"), "c": ("1999-09-09", "other"), "d": ("None", None)}


def test_schedule_page(spark, tmp_path):
    controls = spark.createDataFrame([("c1", "a </script> 'b'", "2024-01-01", None, "2024-02-02", 3, None, [], ["w"], ["c2"], []), ("c2", "t", None, None, None, None, "me", ["x"], [], [], [])],
        "control_id string, title string, start_date string, end_date string, date string, duration_days long, owner string, teams array<string>, workstreams array<string>, depends_on array<string>, source_evidence_ids array<string>")
    status = spark.createDataFrame([("c2", None, None, "2024-03-03", "late", "you")], "control_id string, forecast_start_date string, forecast_end_date string, forecast_date string, working_status string, current_owner string")
    rows = sinks.gantt_rows(controls, status)
    got = {r.control_id: (r.section, r.start_date, r.end_date, r.date_basis, r.scheduled, r.working_status, r.owner) for r in rows.collect()}
    assert got == {"c1": ("w", "2024-01-01", "2024-02-02", "source", "yes", "unknown", None), "c2": ("x", "2024-03-03", "2024-03-03", "human_forecast", "yes", "late", "you")}
    sinks.write_lines(sinks.gantt_page(rows), str(tmp_path / "page"), ["at", "id"])
    page = "\n".join(r.value for r in spark.read.text(str(tmp_path / "page")).select("value", F.input_file_name().alias("f")).orderBy("f").collect())
    data = re.search(r"const data=\[(.*)\];", page, re.S)[1]
    assert [x["control_id"] for x in json.loads("[" + data.strip().rstrip(",") + "]")] == ["c1", "c2"] and "</script> &" not in page and page.count("</script>") == 1


def test_time_buckets(spark):
    at = dt.datetime(2024, 3, 31, 23, 30, tzinfo=dt.UTC)
    df = spark.createDataFrame([(at,), (None,)], "t timestamp")
    rows = df.select(*[profiling.time_bucket(F.col("t"), u, z).alias(f"{u}{k}") for u in ("day", "week", "hour") for k, z in enumerate(("UTC", "Europe/Berlin", "America/New_York"))]).collect()
    assert tuple(rows[0]) == ("2024-03-31", "2024-04-01", "2024-03-31", "2024-03-25", "2024-04-01", "2024-03-25", "23:00", "01:00", "19:00")
    assert set(rows[1]) == {"[unknown]"}


def test_call_groups_of_nothing(spark):
    df = spark.createDataFrame([("a", None, None, None), ("b", True, False, float("inf"))], "k string, ok boolean, m boolean, x double")
    got = {r.key: r for r in profiling.call_groups(df, F.col("k"), F.col("ok"), F.col("m"), F.col("x")).collect()}
    assert (got["a"].resolved, got["a"].success_rate, got["a"].median_inflation, got["a"].unresolved) == (0, None, None, 1) and got["b"].success_rate == 1.0 and got["b"].p95_inflation is None


def test_binary_like_of_texts_of_nearly_the_characters_looked_at(spark, tmp_path):
    rows = [(0, "a" * 9950), (5, "b" * 9999), (10, "c" * 10_000), (15, ""), (20, None), (21, "d" * 9950), (25, "e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.binary for r in entry.queries()["binary_like"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 5: True, 10: False, 15: False, 20: False, 21: False, 25: True}


def test_words_end_before_letters_beyond_ascii(spark, tmp_path):
    queries = ["Un laa. Chanè ouoi", "chaná", "zen", "é zené", "TAISHŌ 262", "doi 10.1234/abcé"]
    df = spark.createDataFrame(list(enumerate(queries)), "i int, q string")
    rows = [r for r in df.select("i", *[c.alias(n) for n, c in asking.classified(F.col("q")).items()]).orderBy("i").collect()]
    assert [r.topics for r in rows[:4]] == [["buddhism"]] * 4 and rows[4].taisho == "262" and rows[5].doi == "10.1234/abc"
    docs = [(0, None), (8, "Chanè"), (7, " "), (16, "?"), (24, "\x0bx?\u2028")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r) for r in entry.queries()["classified_queries"](spark, str(tmp_path)).collect()}
    found = duckdb.sql(entry.oracle_sql()["classified_queries"].replace("FROM documents)", f"FROM '{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    lists = lambda r: tuple(list(x) if isinstance(x, (list, tuple)) else x for x in r)
    assert {k: lists(v) for k, v in got.items()} == {r[0]: lists(r) for r in found}


def test_an_item_is_read_once(spark, sf_dir):
    plan = entry.queries()["extracted_items"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(") + plan.count("parseJson") == 1
